"""Embedding of long texts: chunks, a pluggable encoder, pooled vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MAX_TOKENS, OVERLAP_TOKENS = 254, 32
Counter = Callable[[str], int]
Encoder = Callable[[list[str]], np.ndarray]


def words_in(text: str) -> int:
    return len(text.split())


def chunk(text: str | None, budget: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, count: Counter = words_in) -> list[str]:
    """Pieces of at most ``budget`` tokens: whole lines, long lines cut at words, consecutive pieces sharing up to ``overlap`` tokens of lines."""
    units: list[tuple[str, int]] = []
    for line in (text or "").splitlines():
        size = count(line)
        if size <= budget:
            if line.strip():
                units.append((line, size))
            continue
        part: list[str] = []
        for word in line.split():
            if part and count(" ".join([*part, word])) > budget:
                units.append((" ".join(part), count(" ".join(part))))
                part = []
            part.append(word)
        if part:
            units.append((" ".join(part), count(" ".join(part))))
    out: list[str] = []
    held: list[tuple[str, int]] = []
    for unit in units:
        if held and sum(n for _, n in held) + unit[1] > budget:
            out.append("\n".join(t for t, _ in held))
            keep, total = len(held), 0
            while keep and total + held[keep - 1][1] <= overlap:
                keep -= 1
                total += held[keep][1]
            held = held[keep:]
        held.append(unit)
    return [*out, "\n".join(t for t, _ in held)] if held else out


def hashed_encoder(dim: int = 64) -> Encoder:
    """Deterministic encoder of hashed words, for tests and as a stand-in: no model needed."""
    from zlib import crc32

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = crc32(w.encode())
                out[i, h % dim] += 1.0 if h & 0x10000 else -1.0
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1.0)

    return encode


def pool(vectors: np.ndarray) -> np.ndarray:
    """Unit vector of the mean of unit vectors; the first if the mean vanishes."""
    mean = vectors.mean(0)
    n = float(np.linalg.norm(mean))
    return mean / n if n > 1e-12 else vectors[0]


def chunks(docs: DataFrame, key: str, text: str, budget: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, count: Counter = words_in) -> DataFrame:
    """Rows (key, chunk_no, chunk) of every text."""

    @F.pandas_udf(ArrayType(StringType()))
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunk(t, budget, overlap, count))

    return docs.select(F.col(key), F.posexplode(cut(F.col(text))).alias("chunk_no", "chunk"))


def embed(docs: DataFrame, key: str, text: str, make_encoder: Callable[[], Encoder] = hashed_encoder, budget: int = MAX_TOKENS) -> DataFrame:
    """Rows (key, n_chunks, embedding); null embedding for texts without words.

    A text's chunks are encoded and pooled where the text is, so nothing is
    shuffled; the encoder is made once per Python worker.
    """

    @F.pandas_udf("n_chunks int, embedding array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for texts in batches:
            pieces = [chunk(t, budget) for t in texts]
            flat = [p for ps in pieces for p in ps]
            vectors = encode(flat) if flat else np.zeros((0, 1), np.float32)
            ends = np.cumsum([len(p) for p in pieces])
            rows = [pool(vectors[e - len(p) : e]).astype(np.float32).tolist() if p else None for p, e in zip(pieces, ends)]
            yield pd.DataFrame({"n_chunks": [len(p) for p in pieces], "embedding": rows})

    return docs.select(F.col(key), run(F.col(text)).alias("e")).select(key, "e.n_chunks", "e.embedding")


def pool_vectors(rows: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Pooled vector per key from one row per chunk vector (``chunk_no`` orders them), by built-in aggregation."""
    each = rows.select(key, "chunk_no", F.posexplode(vector).alias("d", "x"))
    mean = each.groupBy(key, "d").agg(F.avg(F.col("x").cast("double")).alias("m"), F.min_by("x", "chunk_no").cast("double").alias("f"))
    per = mean.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("d", "m", "f"))).alias("v"), F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("n"))
    unit = F.transform("v", lambda s: F.when(F.col("n") > 1e-12, s["m"] / F.col("n")).otherwise(s["f"]).cast("float"))
    return per.select(key, unit.alias("embedding"))


__all__ = ["chunk", "chunks", "embed", "hashed_encoder", "pool", "pool_vectors"]

"""Token counts by section: whole documents are encoded once, token spans are joined to sections.

A section is a line of the text with its line break, or a span given by the
caller.  Tokens that cross a boundary go to one section by an explicit rule:
``majority`` (the section with most of the token's characters, the earlier on
a tie), ``first`` (that of the first character) or ``last``.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from matchloom.llm.common import slices

RULES = ("majority", "first", "last")
TOKENIZER_DIR = "/opt/tokenizers"


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str | None = None) -> tuple:
    """Encoding from a file of base64 tokens and ranks, and the byte length of every token id."""
    import tiktoken

    if pattern is None:
        from public_tokenizers import PATTERN as pattern
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        lengths[rank] = len(token)
    return tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, path: str, pattern: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Character start and end (exclusive) of every token; tokens that hold part of a character span the whole of it."""
    enc, lengths = encoder(path, pattern)
    ids = enc.encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.int64)
    end = np.cumsum(lengths[ids])
    if len(end) and end[-1] == len(text):  # ASCII
        return end - lengths[ids], end
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    start = end - lengths[ids]
    return (char[start] - 1, char[end - 1]) if len(end) else (start, end)


def line_bounds(text: str) -> np.ndarray:
    """Starts of the lines, and the length of the text at the end; an empty text has one empty line."""
    at, out = 0, [0]
    while (at := text.find("\n", at) + 1) > 0:
        if at < len(text):
            out.append(at)
        else:
            break
    return np.array([*out, len(text)])


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str = "majority") -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section, and how many of them cross its boundary.  ``bounds`` are section starts and the text's end."""
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, start, "right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, np.maximum(end - 1, start), "right") - 1, 0, n - 1)
    to = last.copy() if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "majority":
        for k in crossing:
            own = range(first[k], last[k] + 1)
            to[k] = max(own, key=lambda s: (min(end[k], bounds[s + 1]) - max(start[k], bounds[s]), -s))
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def count_tokens(docs: DataFrame, tokenizer: str = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken", pattern: str | None = None, rule: str = "majority", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and section: ``doc_id``, ``section``, ``start``, ``n_chars``, ``n_tokens``, ``n_crossing``, ``doc_tokens``.

    Sections are lines.  Null text counts as empty: one section without tokens.
    Repeated rows are counted each; other columns are ignored.  No shuffle.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}, not {rule!r}")
    id_type = docs.schema[doc_id].dataType
    schema = T.StructType([T.StructField("doc_id", id_type), *[T.StructField(n, T.IntegerType() if n == "section" else T.LongType()) for n in ("section", "start", "n_chars", "n_tokens", "n_crossing", "doc_tokens")]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            take, cols = [], [[] for _ in range(6)]
            for k, t in enumerate(b.column(1).to_pylist()):
                t = t or ""
                start, end = token_spans(t, tokenizer, pattern)
                bounds = line_bounds(t)
                counts, crossing = attribute(start, end, bounds, rule)
                n = len(counts)
                take.append(np.full(n, k))
                for c, v in zip(cols, (np.arange(n), bounds[:-1], np.diff(bounds), counts, crossing, np.full(n, len(start)))):
                    c.append(v)
            ids = b.column(0).take(pa.array(np.concatenate(take)))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.concatenate(c), pa.int32() if i == 0 else pa.int64()) for i, c in enumerate(cols)]], schema_names)

    schema_names = schema.names
    return docs.select(doc_id, text).mapInArrow(run, schema)

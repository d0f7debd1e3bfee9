"""Alignment of two tokenizers: which tokens of one meet which of the other, and how many documents hold each pair.

Both encode the same bytes; offsets where tokens of both end cut them into
groups, and tokens whose bytes overlap are linked.  Most groups hold one token
of each side with the same bytes.  An array from each A id to the B id with its
bytes is made once from the vocabularies; links that agree with it are counted
in vectors as long as A's vocabulary, one a task, and only the others, from
irregular groups, are shuffled as pairs.

Neither tokenizer joins what stands before a space that follows a printable
character to what stands behind it, so texts are cut there, pieces that a
worker remembers are not encoded again, and the others are encoded many at a
time.  The vocabularies are checked for this; texts that B does not give back,
byte for byte, are encoded whole.  Each document's pairs are written once, and
counted and looked up from there.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut, ensure_checkpoint_dir, slices

TOKENIZER_DIR = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Pieces that a worker remembers, and the longest it remembers.
REMEMBERED, LONGEST = 400_000, 64
#: So many pieces are encoded together.
TOGETHER = 400
#: Pair counts that are broadcast, the largest first; the others are joined.
BROADCAST_PAIRS = 1 << 21
#: Pairs a task holds before it sends its counts on.
HELD_PAIRS = 1 << 21

ID = np.dtype("<u4")

_CUT = re.compile(r"(?<=[!-~\w])(?= )")
_UNSAFE = re.compile(r"(?<![!-~\w]) ")


def _byte_of_char() -> dict[str, int]:
    """Bytes behind the characters of byte-level vocabularies: printable ones stand for themselves, the others follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """The two tokenizers, the bytes of their tokens, and the identity map from A to B (-1: no token with the same bytes)."""

    def __init__(self, a_path: str, b_path: str, pattern: str | None = None):
        import sentencepiece
        import tiktoken

        if pattern is None:
            from public_tokenizers import PATTERN as pattern
        chars = _byte_of_char()
        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        special = {t["id"] for t in made["added_tokens"]}
        # Ids of byte-level BPE follow the order of its merges, so they serve as ranks.
        ranks = {bytes(chars[c] for c in token): k for token, k in made["model"]["vocab"].items() if k not in special}
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes: list[bytes] = [b""] * (1 + max(ranks.values()))
        for token, k in ranks.items():
            self.a_bytes[k] = token
        n = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(k) for k in range(n)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        by_bytes: dict[bytes, int] = {}
        for k in range(n):  # whole pieces before single bytes
            if not self.b.is_control(k) and not self.b.is_unknown(k) and (not self.b.is_byte(k) or self.b_bytes[k] not in by_bytes):
                by_bytes[self.b_bytes[k]] = k
        self.identity = np.array([by_bytes.get(b, -1) if b else -1 for b in self.a_bytes], np.int64)
        self.b_size = n
        self.a_size, self.b_sizes = (np.array([len(x) for x in names], np.int64) for names in (self.a_bytes, self.b_bytes))
        #: Text of each token within a group and at its end.
        self.words = [f"{k}{c}" for k in range(len(self.a_bytes)) for c in ",|"] + [f"{k}{c}" for k in range(n) for c in ",;"]
        #: Whether B may be encoded in pieces: none of its own holds a space behind another character.
        self.cuts = not any("▁" in p.lstrip("▁") for k, p in enumerate(pieces) if not self.b.is_control(k))
        self.space = self.b.piece_to_id("▁")


@lru_cache(maxsize=2)
def vocabularies(a_path: str, b_path: str) -> Vocabularies:
    return Vocabularies(a_path, b_path)


@dataclass
class Memory:
    """Token ids of the pieces that this worker has seen, as bytes: those of A, then those of B with ``|A|`` added.  ``None`` for pieces whose bytes B does not give back."""

    v: Vocabularies
    known: dict[str, bytes | None] = field(default_factory=dict)

    def cut(self, text: str) -> list[str]:
        """Pieces of a space and the text, each without its first space."""
        if not text:
            return []
        if not self.v.cuts:
            return [text]
        if _UNSAFE.search(text) is None:
            return text.split(" ")
        return [p[1:] for p in _CUT.split(" " + text)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Token ids of each text behind a space; none for texts that are empty or that a side does not give back."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        known = self.known
        cuts = [self.cut(t) for t in texts]
        new = list(set(chain.from_iterable(cuts)).difference(known))
        self._learn(new)
        out = []
        for text, c in zip(texts, cuts):
            ids = list(map(known.__getitem__, c))
            if None in ids:  # what B changes in one piece it might make up for in another
                ids = [self._encode([text])[0] or b""]
            out.append(b"".join(ids))
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out

    def _learn(self, new: list[str]) -> None:
        alone = [p for p in new if len(p) > LONGEST or not p or not ("!" <= p[-1] <= "~" or p[-1].isalnum())]
        self.known.update(zip(alone, self._encode(alone)))
        rest = new if not alone else list(set(new).difference(alone))
        together = [rest[i : i + TOGETHER] for i in range(0, len(rest), TOGETHER)]
        for some, ids in zip(together, self._encode([" ".join(x) for x in together])):
            ends = np.cumsum([len(p.encode()) + 1 for p in some])
            self.known.update(zip(some, (ids and _dealt(ids, self.v, ends)) or self._encode(some)))

    def _encode(self, texts: list[str]) -> list[bytes | None]:
        v, out = self.v, []
        for t, b in zip(texts, v.b.encode(texts, num_threads=1)):
            a, data = v.a.encode_ordinary(" " + t), f" {t}".encode()
            b = b if t else [v.space]
            same = b"".join([v.a_bytes[k] for k in a]) == data and b"".join([v.b_bytes[k] for k in b]) == data
            out.append(np.concatenate([np.array(a, ID), np.array(b, ID) + ID.type(len(v.a_size))]).tobytes() if same else None)
        return out


def _dealt(ids: bytes, v: Vocabularies, ends: np.ndarray) -> list[bytes] | None:
    """Token ids dealt to pieces that end at the byte offsets; None if a token crosses one."""
    ids = np.frombuffer(ids, ID)
    n = int(np.searchsorted(ids >= len(v.a_size), True))
    cuts = []
    for some, sizes, shift in ((ids[:n], v.a_size, 0), (ids[n:] - ID.type(len(v.a_size)), v.b_sizes, n)):
        at = np.cumsum(sizes[some])
        k = np.searchsorted(at, ends)
        if not np.array_equal(at[k], ends):
            return None
        cuts.append([shift * ID.itemsize, *((k + 1 + shift) * ID.itemsize).tolist()])
    raw, (a, b) = ids.tobytes(), cuts
    return [raw[w:x] + raw[y:z] for w, x, y, z in zip(a[:-1], a[1:], b[:-1], b[1:])]


def align(v: Vocabularies, ids: list[bytes]) -> tuple[list[np.ndarray], list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Of documents given by their token ids: tokens of A and of B, groups and links of each; the groups as text; and document, pair (``a * |B| + b``) and times of all distinct links."""
    every = np.frombuffer(b"".join(ids), ID).astype(np.int64)
    is_a = every < len(v.a_size)
    sizes = np.array([len(x) // ID.itemsize for x in ids], np.int64)
    n_a = np.bincount(np.repeat(np.arange(len(ids)), sizes)[is_a], minlength=len(ids))
    n_b = sizes - n_a
    a, b = every[is_a], every[~is_a] - len(v.a_size)
    a_end, b_end = np.cumsum(v.a_size[a]), np.cumsum(v.b_sizes[b])  # documents follow each other, and both sides give the same bytes
    total = int(a_end[-1]) if len(a) else 0
    of_a, of_b = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    of_a[a_end], of_b[b_end] = True, True
    doc_end = np.concatenate([[0], a_end])[np.cumsum(n_a)]
    # Between two ends lies a part of one token of each side: a link.
    ends = np.flatnonzero(of_a | of_b)
    token = lambda of: np.cumsum(of)[ends] - of[ends]
    key = a[token(of_a)] * v.b_size + b[token(of_b)]
    doc = np.searchsorted(doc_end, ends)
    space = len(v.a_size) * v.b_size
    both, times = np.unique(doc * space + key, return_counts=True)
    counts = [n_a, n_b, *(np.bincount(x, minlength=len(ids)) for x in (np.searchsorted(doc_end, np.flatnonzero(of_a & of_b)), doc))]
    # Tokens in the order of the text form: group by group, A before B; the last of a group ends in | or ;
    a_last, b_last = of_b[a_end], of_a[b_end]
    a_cut, b_cut = (np.concatenate([[0], np.flatnonzero(x) + 1]) for x in (a_last, b_last))
    item = np.zeros(len(a) + len(b), np.int64)
    item[np.arange(len(a)) + b_cut[np.cumsum(a_last) - a_last]] = 2 * a + a_last
    item[np.arange(len(b)) + a_cut[np.cumsum(b_last) - b_last + 1]] = 2 * (len(v.a_size) + b) + b_last
    words = list(map(v.words.__getitem__, item.tolist()))
    at = [0, *np.cumsum(n_a + n_b).tolist()]
    groups = ["".join(words[x:y])[:-1] for x, y in zip(at[:-1], at[1:])]
    return counts, groups, both // space, both % space, times


_MEMORY: dict[tuple[str, str], Memory] = {}


def memory(a_path: str, b_path: str) -> Memory:
    if (a_path, b_path) not in _MEMORY:
        _MEMORY[a_path, b_path] = Memory(vocabularies(a_path, b_path))
    return _MEMORY[a_path, b_path]


_MADE = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _encode(a_path: str, b_path: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sizes, digest, and the distinct linked pairs of each document with how often they occur."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = memory(a_path, b_path)
        for batch in slices(batches, 1, 1 << 20):
            ids = m.encode(batch.column(1).to_pylist())
            counts, groups, doc, pairs, times = align(m.v, ids)
            digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            cuts = np.searchsorted(doc, np.arange(1, len(ids)))
            parts = ([x.tobytes() for x in np.split(y, cuts)] for y in (pairs.astype(np.uint64), times.astype(np.uint32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest), *(pa.array(x, pa.binary()) for x in parts)], _names(_MADE))

    return run


def _pairs(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and times of everything in columns ``at`` and the next."""
    pairs, times = batch.column(at).to_pylist(), batch.column(at + 1).to_pylist()
    row = np.repeat(np.arange(len(pairs)), [len(p) // 8 for p in pairs])
    return row, np.frombuffer(b"".join(pairs), np.uint64).astype(np.int64), np.frombuffer(b"".join(times), np.uint32)


def _counts(identity: np.ndarray, b_size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents per linked pair: identity pairs from a vector, the others from arrays of bounded size."""

    def rows(keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 1 << 16):
            k = keys[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k // b_size), pa.array(k % b_size), pa.array(n[i : i + (1 << 16)])], ["a", "b", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        same = np.zeros(len(identity), np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in slices(batches, 0, 8 << 20):
            _, key, _ = _pairs(batch, 0)
            a, other = np.divmod(key, b_size)
            regular = identity[a] == other
            same += np.bincount(a[regular], minlength=len(same))
            held.append(key[~regular])
            size += len(held[-1])
            if size > HELD_PAIRS:
                yield from rows(*np.unique(np.concatenate(held), return_counts=True))
                held, size = [], 0
        if size:
            yield from rows(*np.unique(np.concatenate(held), return_counts=True))
        seen = np.flatnonzero(same)
        yield from rows(seen * b_size + identity[seen], same[seen])

    return run


def align_documents(docs: DataFrame, a_path: str = f"{TOKENIZER_DIR}/{A_FILE}", b_path: str = f"{TOKENIZER_DIR}/{B_FILE}", doc_id: str = "doc_id", text: str = "text", broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256``.

    A space and the text are encoded by A (byte-level) and B (with byte
    fallback).  A link's count is the number of rows that hold its pair;
    ``n_best`` counts the links whose count is the highest of their A id,
    ``count_sum`` adds up the counts.  Null and empty texts, and texts whose
    bytes either side does not give back, have no tokens: zeros, and an empty
    ``groups_sha256``.  Repeated rows count each.  Other columns are ignored;
    an empty table gives an empty result.  Texts travel through no shuffle.

    Counts of the ``broadcast_pairs`` most frequent pairs are broadcast, those
    of the others joined to the rows that hold them.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/alignment-{uuid.uuid4().hex}"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows.mapInArrow(_encode(a_path, b_path), _MADE).select(F.monotonically_increasing_id().alias("row"), "*").write.option("compression", "zstd").parquet(path)
    made = spark.read.parquet(path)
    v = vocabularies(a_path, b_path)
    b_size = v.b_size
    counts = cut(made.select("pairs", "times").mapInArrow(_counts(v.identity, b_size), "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
    best = np.zeros(len(v.identity), np.int64)
    top = counts.groupBy("a").agg(F.max("n").alias("n")).toArrow()  # at most a row per A id
    best[top.column("a").to_numpy()] = top.column("n").to_numpy()
    # The least power of two that few enough pairs reach.
    sizes = dict(counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).count().collect())
    least, total = 1 << 62, 0
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > broadcast_pairs:
            break
        least = 1 << p
    known = counts.filter(F.col("n") >= least).toArrow()
    keys = known.column("a").to_numpy() * b_size + known.column("b").to_numpy()
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast((keys[order], known.column("n").to_numpy()[order], best))

    def found(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs have a broadcast count, and the counts of all (0 where there is none)."""
        keys, n, _ = shared.value
        if not len(keys):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = keys[at] == key
        return hit, np.where(hit, n[at], 0)

    def known_sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 8 << 20):
            row, key, times = _pairs(batch, 1)
            hit, n = found(key)
            is_best = hit & (n == shared.value[2][key // b_size])
            sums = [np.bincount(row, w * times, batch.num_rows) for w in (is_best, n.astype(float))]
            # Sums of doubles are exact below 2^53; larger ones are added as integers.
            if len(sums[1]) and sums[1].max() >= 1 << 53:
                sums[1] = np.zeros(batch.num_rows, np.int64)
                np.add.at(sums[1], row, n * times.astype(np.int64))
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(batch.columns) if i not in (1, 2)], *[pa.array(x.astype(np.int64)) for x in sums]], _names(_SUMS))

    def unknown(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1, 8 << 20):
            row, key, times = _pairs(batch, 1)
            rest = np.flatnonzero(~found(key)[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[rest])), pa.array(key[rest] // b_size), pa.array(key[rest] % b_size), pa.array(times[rest].astype(np.int64))], ["row", "a", "b", "times"])

    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    out = made.select("row", "pairs", "times", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").mapInArrow(known_sums, _SUMS)
    if total <= broadcast_pairs:
        return out.select(*columns)
    tops = spark.createDataFrame([(int(a), int(best[a])) for a in np.flatnonzero(best)], "a long, top long")
    rare = cut(counts.filter(F.col("n") < least).join(F.broadcast(tops), "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("is_best")))
    left = made.select("row", "pairs", "times").mapInArrow(unknown, "row long, a long, b long, times long")
    late = left.join(rare.hint("merge"), ["a", "b"]).groupBy("row").agg(F.sum(F.col("n") * F.col("times")).alias("more"), F.sum(F.when(F.col("is_best"), F.col("times")).otherwise(0)).alias("more_best"))
    both = out.join(late.hint("merge"), "row", "left")
    more = {"n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0))}
    return both.withColumns(more).select(*columns)


_SUMS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"

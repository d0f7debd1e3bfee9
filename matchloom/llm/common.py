"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace that separates words: space, tab, LF, VT, FF, CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
ASCII_LOWER = bytes.maketrans(UPPER, LOWER)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names; on one machine, where none is set (tests), a private one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="matchloom-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and return it without its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this job wrote and nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str | Column) -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def id_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those whose key has the lowest hashes.

    Rows are counted first, so that about as many pass the hash filter as are
    wanted; what meets in one task does not grow with the number of tasks.
    """
    total = rows.count()
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    rate = min(1.0, (1.2 * most + 100) / max(total, 1))
    return rows.filter(h < int(rate * (1 << 40))).orderBy(h, key).limit(most)


def extended(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    """``schema`` with the named fields replaced or appended at the end."""
    names = {n for n, _ in fields}
    return T.StructType([f for f in schema.fields if f.name not in names] + [T.StructField(n, t) for n, t in fields])


def unused(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores behind it until no column in ``taken`` has it in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column; null counts as empty."""
    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text_at: int, budget: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each piece holds about ``budget`` bytes of text (one row at least)."""
    for batch in batches:
        col = batch.column(text_at)
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(np.asarray(pc.binary_length(col.cast(pa.large_binary())).to_numpy(zero_copy_only=False), dtype=float))
        group = np.floor(np.cumsum(sizes) / budget).astype(np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [batch.num_rows]])
        for a, b in zip(edges[:-1], edges[1:]):
            yield batch.slice(a, b - a)


# --- fixed-size membership bitmaps -------------------------------------------------

ID_BITS = 24


def slot_of(ids: np.ndarray, bits: int = ID_BITS) -> np.ndarray:
    """Slot of each integer id in a bitmap of ``2**bits`` bits."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def id_bitmap(ids: DataFrame, bits: int = ID_BITS) -> np.ndarray:
    """OR of one bit per id of a single-column frame.

    The result has ``2**bits / 8`` bytes whatever the number of ids (2 MB by
    default), so it may be broadcast.  False positives are possible, false
    negatives are not: use it only ahead of an exact join.
    """

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << (bits - 5), np.uint32)
        for b in batches:
            col = pc.drop_null(b.column(0))
            s = slot_of(np.asarray(col.to_numpy(zero_copy_only=False), dtype=np.int64), bits)
            np.bitwise_or.at(words, s >> 5, np.uint32(1) << (s & 31).astype(np.uint32))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(words[at].astype(np.int64))], ["at", "word"])

    name = ids.columns[0]
    found = ids.select(F.col(name).cast("long")).mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word"))
    words = np.zeros(1 << (bits - 5), np.uint32)
    got = found.toArrow()
    words[got.column("at").to_numpy()] = got.column("word").to_numpy().astype(np.uint32)
    return words


def maybe_members(ids: pa.Array, bitmap: np.ndarray, bits: int = ID_BITS) -> np.ndarray:
    """Mask of the ids that may be in the bitmap; null ids never are."""
    known = np.asarray(pc.is_valid(ids))
    s = slot_of(np.asarray(pc.fill_null(ids.cast(pa.int64()), 0)), bits)
    return known & ((bitmap[s >> 5] >> (s & 31).astype(np.uint32)) & 1).astype(bool)


def without_ids(docs: DataFrame, drop: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose id is in ``drop``; only rows the bitmap suspects are shuffled.

    ``drop`` is read twice, so pass a checkpointed or written frame.
    """
    bitmap = docs.sparkSession.sparkContext.broadcast(id_bitmap(drop.select(key)))
    at = docs.columns.index(key)

    def pick(suspect: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array(maybe_members(b.column(at), bitmap.value) == suspect))

        return docs.mapInArrow(run, docs.schema)

    rest = pick(True).join(drop.select(key).distinct().hint("shuffle_hash"), key, "left_anti").select(*docs.columns)
    return pick(False).unionByName(rest)


# --- vectorised words --------------------------------------------------------------

_RNG = np.random.default_rng(20240531)
_BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_GRAM = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

_LOWERED = np.frombuffer(bytes(range(256)).translate(ASCII_LOWER), np.uint8)
#: Which bytes are part of a word: all but the white space of WORD_PATTERN ...
NOT_SPACE = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
#: ... or letters, digits and the bytes of non-ASCII characters only.
ALNUM = np.array([chr(c).isalnum() or c >= 128 for c in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 19)
        inverse = pow(_BASE, -1, 1 << 64)
        for name, base in (("up", _BASE), ("down", inverse)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], in_word: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once: 64-bit hashes, text index, byte start and end within the joined texts.

    A-Z count as a-z.  The hash is a polynomial over random byte values, taken
    from one running sum over the whole chunk, so no Python code runs per word.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    joins = np.cumsum([len(t) + 1 for t in texts]) - 1
    inside = in_word[raw]
    inside[joins] = False
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUE[_LOWERED[raw]] * up)])
    h = mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(joins, start), start, end


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` consecutive words from each position on (``len - k + 1`` values)."""
    n = max(0, len(words) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h += words[j : j + n] * _GRAM[j]
    return mix64(h)

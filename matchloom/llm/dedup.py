"""Exact deduplication by content sort.

Rows are range-partitioned on (leading bytes of the normalised text, its
digest, identifier) with splitters that Spark samples, and each partition is
sorted externally on the same key.  Equal texts therefore stand next to each
other, across partition borders too: because the identifier is part of the
key, a text that makes up a third of all rows is spread over many partitions
instead of landing in one.  Every row is compared in full with its neighbour.
A run of equal texts that touches a partition border is joined with its other
parts through one summary row per border run, at most two per partition.

Only 48 leading bytes and the digest are sampled for the splitters, so the
driver never receives whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from matchloom.llm.common import ASCII_LOWER, extended, shuffle_parts, slices, text_bytes, unused

LEAD = 48


def normalise(text: bytes) -> bytes:
    """Lower-case A-Z only."""
    return text.translate(ASCII_LOWER)


def _key_names(columns: list[str]) -> list[str]:
    return [unused(k, columns) for k in ("__lead", "__digest")]


def _with_keys(rows: DataFrame, text: str) -> DataFrame:
    names, added = rows.columns, _key_names(rows.columns)
    at = names.index(text)

    def keys(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at, 8 << 20):
            norm = [normalise(t) for t in text_bytes(b.column(at))]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([n[:LEAD] for n in norm], pa.binary()), pa.array([hashlib.sha256(n).digest() for n in norm], pa.binary())],
                [*names, *added],
            )

    return rows.mapInArrow(keys, extended(rows.schema, *((k, T.BinaryType()) for k in added)))


def content_sorted(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Rows in content order over the whole table: equal normalised texts adjacent, then by identifier."""
    key: list[Column] = [F.col(f"`{k}`") for k in (*_key_names(rows.columns), doc_id)]
    return _with_keys(rows, text).repartitionByRange(shuffle_parts(rows.sparkSession), *key).sortWithinPartitions(*key)


def _runs(names: list[str], keep: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Arrow function that finds runs in a sorted partition; ids only are buffered, never texts."""
    from pyspark import TaskContext

    id_at, text_at, digest_at = names.index("doc_id"), names.index("text"), names.index("__digest")

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        run: list = []
        last: tuple[bytes, bytes] | None = None
        first_run = True
        out: list[tuple] = []
        target = to_arrow_schema(_OUT)

        def close(at_end: bool) -> None:
            edge = first_run or at_end
            known = [i for i in run if i is not None]
            low, high = (known[0], known[-1]) if known else (None, None)
            keeper = len(run) - 1 if keep == "largest" else next((k for k, i in enumerate(run) if i is not None), 0)
            digest, full = last
            for k, i in enumerate(run):
                head = edge and k == 0
                out.append((i, digest.hex(), low, high, len(run), k == keeper, edge, part if head else None, full if head else None))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * len(_OUT.names)
            rb = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, target)], schema=target)
            out.clear()
            return rb

        for b in slices(batches, text_at, 8 << 20):
            ids = b.column(id_at).to_pylist()
            digests = b.column(digest_at).to_pylist()
            for i, d, t in zip(ids, digests, text_bytes(b.column(text_at))):
                if last is not None and d == last[0] and normalise(t) == last[1]:
                    run.append(i)
                    continue
                if last is not None:
                    close(False)
                    first_run = False
                run, last = [i], (d, normalise(t))
            if len(out) > 20_000:
                yield flush()
        if last is not None:
            close(True)
        yield flush()

    return scan


_OUT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text_sha256", T.StringType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("local_keep", T.BooleanType()),
        T.StructField("edge", T.BooleanType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("full", T.BinaryType()),
    ]
)


def duplicate_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    ``keep`` is ``smallest`` or ``largest`` identifier.  Null texts count as
    empty; empty texts equal each other.  Of rows that agree in text and
    identifier one is kept.  Null identifiers sort first and never serve as
    ``keep_id`` unless the group has no other.  Other columns are ignored.  An
    empty table gives an empty result.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = content_sorted(rows, "doc_id", "text")
    runs = ordered.mapInArrow(_runs(ordered.columns, keep), _OUT)
    # At most two rows per partition have "full"; both branches read one and the same exchange.
    whole = (
        runs.filter(F.col("full").isNotNull())
        .groupBy("text_sha256", "full")
        .agg(F.min("low").alias("g_low"), F.max("high").alias("g_high"), F.sum("n").alias("g_n"), F.max("part").alias("g_part"), F.min(F.when(F.col("low").isNotNull(), F.col("part"))).alias("g_from"))
        .drop("full")
    )
    joined = runs.drop("full").join(F.broadcast(whole.withColumn("edge", F.lit(True))), ["text_sha256", "edge"], "left")
    low, high = F.when(F.col("edge"), F.col("g_low")).otherwise(F.col("low")), F.when(F.col("edge"), F.col("g_high")).otherwise(F.col("high"))
    keep_id = low if keep == "smallest" else high
    return joined.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.when(F.col("edge"), F.col("g_n")).otherwise(F.col("n")).alias("group_size"),
        (F.col("local_keep") & F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`duplicate_groups` keeps.

    Streams each sorted partition with a look-ahead of one row.  The row at a
    partition border is settled against the border rows of the other
    partitions, by their whole texts (two rows of each partition at most).
    Null texts count as empty and empty texts equal each other; of rows that
    agree in text and identifier one is kept; a row without identifier is kept
    only if its group has no other.  Names of other columns do not matter.  An
    empty table gives an empty result.
    """
    from pyspark import TaskContext

    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be 'smallest' or 'largest', not {keep!r}")
    ordered = content_sorted(docs, doc_id, text)
    names = ordered.columns
    keys = _key_names(docs.columns)
    id_at, text_at, digest_at = names.index(doc_id), names.index(text), names.index(keys[1])
    edge_, at_, known_ = (unused(c, docs.columns) for c in ("__edge", "__at", "__known"))
    schema = extended(docs.schema, (edge_, T.BinaryType()), (at_, T.LongType()), (known_, T.BooleanType()))
    out_names = schema.names

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each run the row to keep; border runs carry their text, their place among all borders, and whether they have an id."""
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        held_key: tuple[bytes, bytes] | None = None
        held_known = False
        first = True

        def emit(edge: bool) -> pa.RecordBatch:
            extra = [pa.array([held_key[1] if edge else None], pa.binary()), pa.array([2 * part + (not first) if edge else None], pa.int64()), pa.array([held_known if edge else None], pa.bool_())]
            return pa.RecordBatch.from_arrays([*[c for c, n in zip(held.columns, names) if n not in keys], *extra], out_names)

        for b in slices(batches, text_at, 8 << 20):
            ids, digests, texts = b.column(id_at).to_pylist(), b.column(digest_at).to_pylist(), text_bytes(b.column(text_at))
            done: list[pa.RecordBatch] = []
            for k, (i, d, t) in enumerate(zip(ids, digests, texts)):
                norm = normalise(t)
                if held is not None and d == held_key[0] and norm == held_key[1]:
                    if keep == "largest" or not held_known and i is not None:
                        held, held_known = b.slice(k, 1), i is not None
                    continue
                if held is not None:
                    done.append(emit(first))
                    first = False
                held, held_key, held_known = b.slice(k, 1), (d, norm), i is not None
            if done:
                yield pa.concat_batches(done)
        if held is not None:
            yield emit(True)

    kept = ordered.mapInArrow(scan, schema)
    at = F.col(at_)
    rank = F.struct(F.col(known_), at if keep == "largest" else -at)
    met = kept.filter(at.isNotNull()).groupBy(edge_).agg(F.max_by(at, rank).alias("best"), F.collect_list(at).alias("all"))
    lost = met.select("best", F.explode("all").alias(at_)).filter(at != F.col("best")).select(at_)
    return kept.join(F.broadcast(lost), at_, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])

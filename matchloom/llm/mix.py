"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source should be copied ``target / source_size`` times.
The whole part of that number is certain; the fractional parts are rounded
jointly: two fractional documents exchange mass, weighted by their sizes, so
that the words expected from the source stay exactly the same, until one of
them is 0 or 1.  What is left over of a bucket (one document at most) goes to
the next level of a reduction tree, until one document per source remains and
is rounded by itself.  A source therefore misses its target by less than the
size of one document, and every document keeps its copy probability.

Buckets hold about a thousand documents each, whatever the source's size, so a
source with a third of all rows is dealt over many tasks.  All random numbers
are hashes of (seed, level, identifiers): reruns and recomputed partitions
agree.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import WORD_PATTERN, cut, shuffle_parts

BUCKET_ROWS = 1000
FAN_IN = 16
#: A table of sources up to this many rows is broadcast (counted first); a larger one is joined by shuffle.
BROADCAST_SOURCES = 100_000


def word_count(text: str | Column) -> Column:
    """Number of maximal runs of non-white-space; 0 for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(c, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Targets per source from rows (``source``, ``size``): ``source``, ``n_docs``, ``source_size``, ``target``.

    Sources in code-point order, null last, take the weights in turn and share
    the sum of all sizes.  A target stops at ``most`` times its source's size;
    the excess is shared again by weight.  The level at which nothing exceeds
    its cap is found from running sums over sources ordered by cap / weight.
    One row per source enters the two windows, never documents.
    """
    from pyspark.sql import Window

    per = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    turn = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("w", F.element_at(cycle, ((F.row_number().over(turn) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    # Sources up to the first whose cap is not exceeded are capped; its level holds for it and all after it.
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    per = per.withColumn("at", F.first(fits, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.coalesce(F.least(F.col("at") * F.col("w"), F.col("cap")), F.col("cap")))
    return per.select("source", "n_docs", "source_size", target.alias("target"))


def _uniform(seed: int, level: int, a: int | None, b: int | None, turn: int) -> float:
    return xxhash.xxh64_intdigest(struct.pack("<5q", seed, level, -1 if a is None else a, -1 if b is None else b, turn)) / 2.0**64


def pivot(rows: Iterable[tuple[int | None, int, float]], uniform: Callable[[int | None, int | None, int], float]) -> Iterator[tuple[int, float]]:
    """Pair (id, size, fraction) rows one after another; yields (position, fraction) as rows settle, the residual last.

    Sums of size times fraction are kept in every step; fractions keep their expectation.
    """
    held: tuple[int, int | None, int, float] | None = None
    for k, (doc, size, x) in enumerate(rows):
        if not 0.0 < x < 1.0:
            yield k, x
            continue
        if held is None:
            held = (k, doc, size, x)
            continue
        j, other, s, y = held
        up, down = min(1 - y, x * size / s), min(y, (1 - x) * size / s)
        if uniform(other, doc, k) * (up + down) < down:
            y, x = y + up, x - up * s / size
        else:
            y, x = y - down, x + down * s / size
        x, y = (round(v) if abs(v - round(v)) < 1e-9 else v for v in (x, y))
        if 0.0 < y < 1.0:
            yield k, float(x)
            held = (j, other, s, y)
        else:
            yield j, float(y)
            held = (k, doc, size, x) if 0.0 < x < 1.0 else None
            if held is None:
                yield k, float(x)
    if held is not None:
        yield held[0], held[3]


def _level(df: DataFrame, level: int, seed: int, last: bool) -> DataFrame:
    """One level of the tree: rows settle within (source, bucket); ``x`` of the residual stays fractional unless it is the last level."""
    names = df.columns
    key_at, bucket_at, id_at, size_at, x_at = (names.index(n) for n in ("source_key", "bucket", "doc_id", "size", "x"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def uniform(a: int | None, b: int | None, turn: int) -> float:
            return _uniform(seed, level, a, b, turn)

        def settle(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            b = pa.concat_batches(group)
            ids = b.column(id_at).to_pylist()
            x = [0.0] * b.num_rows
            for k, v in pivot(zip(ids, b.column(size_at).to_pylist(), b.column(x_at).to_pylist()), uniform):
                x[k] = float(uniform(ids[k], None, -1) < v) if last and 0.0 < v < 1.0 else v
            return b.set_column(x_at, "x", pa.array(x))

        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            keys = list(zip(b.column(key_at).to_pylist(), b.column(bucket_at).to_pylist()))
            at = 0
            for k in range(1, len(keys) + 1):
                if k < len(keys) and keys[k] == keys[at]:
                    continue
                if held and now != keys[at]:
                    yield settle(held)
                    held = []
                held.append(b.slice(at, k - at))
                now, at = keys[at], k
        if held:
            yield settle(held)

    order = ["source_key", "bucket", F.desc("size"), "doc_id", "x"]
    return df.repartition(shuffle_parts(df.sparkSession), "source_key", "bucket").sortWithinPartitions(*order).mapInArrow(run, df.schema)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (1, 2, 3), most: float = 3.0, seed: int = 0) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``size`` counts words (null text: 0), ``taken`` is ``size * copies``.
    Documents without words take 0 copies.  Null sources form one source that
    comes last.  Repeated rows are rounded as separate documents; null
    identifiers are allowed.  An empty table gives an empty result.  Texts are
    read once and never shuffled.
    """
    sized = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size")))
    targets = cut(source_targets(sized, weights, most))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")).alias("source_key")
    side = targets.select(key, "n_docs", "source_size", "target")
    side = F.broadcast(side) if targets.count() <= BROADCAST_SOURCES else side.hint("merge")
    rows = sized.withColumn("source_key", key).join(side, "source_key")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    buckets = F.ceil(F.col("n_docs") / BUCKET_ROWS)
    rows = rows.select(
        "doc_id", "source", "source_key", "size", "source_size", "target",
        F.when(F.col("size") > 0, F.floor(rate + 1e-12)).otherwise(0).cast("long").alias("whole"),
        F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), buckets).cast("long").alias("bucket"),
        F.when(F.col("size") > 0, F.greatest(rate - F.floor(rate + 1e-12), F.lit(0.0))).otherwise(0.0).alias("x"),
    )
    most_buckets = max(1, -(-(targets.agg(F.max("n_docs")).first()[0] or 0) // BUCKET_ROWS))
    settled = []
    level = 0
    while True:
        last = most_buckets <= 1
        done = cut(_level(rows, level, seed, last))
        fractional = (F.col("x") > 0) & (F.col("x") < 1)
        settled.append(done.filter(~fractional))
        if last:
            break
        rows = done.filter(fractional).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN).cast("long"))
        most_buckets, level = -(-most_buckets // FAN_IN), level + 1
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    copies = F.col("whole") + F.col("x").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))

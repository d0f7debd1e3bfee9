"""Ranks, running sums and order statistics within groups of any size.

A window puts a whole group into one task.  Here the rows are range-partitioned
and sorted by group and order, so that a large group lies in many partitions;
one small table of counts per group and partition then gives the number that
each partition's rows of a group start from.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.shared import hinted, written

#: Groups of at most so many rows may go through a plain window.
WINDOW_ROWS = 1 << 20
_PART, _AT = "_part", "_at"



def _placed(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    key = [F.col(f"`{c}`").asc_nulls_first() for c in by] + [F.col(f"`{c}`").asc_nulls_first() if isinstance(c, str) else c for c in order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *key).sortWithinPartitions(*key)
    return written(ranged.withColumns({_PART: F.spark_partition_id(), _AT: F.monotonically_increasing_id()}))


def _offsets(placed: DataFrame, by: Sequence[str], value: str | None) -> DataFrame:
    """Per group and partition, as few rows as there are partitions and groups: what stands before, and the group's total."""
    amount = F.count("*") if value is None else F.coalesce(F.sum(value), F.lit(0))
    counts = placed.groupBy(*by, _PART).agg(amount.alias("_c"), F.count("*").alias("_k"), F.min(_AT).alias("_start"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = counts.withColumns({"_before": F.sum("_c").over(whole.orderBy(_PART)) - F.col("_c"), "_n": F.sum("_k").over(whole)})
    return written(sums.select(*[F.col(f"`{c}`").alias(f"_g{i}") for i, c in enumerate([*by, _PART])], "_start", "_before", "_n"))


def _joined(placed: DataFrame, offsets: DataFrame, by: Sequence[str]) -> DataFrame:
    names = [*by, _PART]
    met = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(names)])
    return placed.join(hinted(offsets), met).drop(*[f"_g{i}" for i in range(len(names))])


def largest_group(rows: DataFrame, by: Sequence[str]) -> int:
    return rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank", total: str | None = None) -> DataFrame:
    """``rows`` with their number in their group, from 1, and the group's size if ``total`` names it.

    As ``row_number`` over a window, nulls first: give an order without ties
    for a repeatable result.  Null groups are groups.
    """
    placed = _placed(rows, by, order)
    out = _joined(placed, _offsets(placed, by, None), by).withColumn(name, F.col(_AT) - F.col("_start") + F.col("_before") + 1)
    if total:
        out = out.withColumn(total, F.col("_n"))
    return out.drop(_PART, _AT, "_start", "_before", "_n")


def running_sum(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` (null counts as 0) over the group's rows up to and with each."""
    placed = _placed(rows, by, order)
    local = Window.partitionBy(_PART, *by).orderBy(_AT).rowsBetween(Window.unboundedPreceding, 0)
    here = placed.withColumn(name, F.coalesce(F.sum(value).over(local), F.lit(0)))
    return _joined(here, _offsets(placed, by, value), by).withColumn(name, F.col(name) + F.col("_before")).drop(_PART, _AT, "_start", "_before", "_n")


def selected(rows: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """Per group ``n`` and, under each name, the value at that rank; ranks are expressions over the group's size ``n``.

    Equal values are counted before they are sorted, so a value that a third
    of all rows have is one row.
    """
    known = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_times"))
    placed = running_sum(known, by, ["_v"], "_times", "_upto")
    totals = written(known.groupBy(*by).agg(F.sum("_times").alias("n")))
    totals = totals.select(*[F.col(f"`{c}`").alias(f"_t{i}") for i, c in enumerate(by)], "n", *[r.cast("long").alias(f"_r{i}") for i, r in enumerate(ranks.values())])
    if by:
        met = placed.join(hinted(totals), reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"_t{i}")) for i, c in enumerate(by)]))
    else:
        only = totals.first()
        met = placed.withColumns({"n": F.lit(only["n"]).cast("long"), **{f"_r{i}": F.lit(only[f"_r{i}"]).cast("long") for i in range(len(ranks))}})
    here = lambda i: (F.col("_upto") >= F.col(f"_r{i}")) & (F.col("_upto") - F.col("_times") < F.col(f"_r{i}"))
    met = met.filter(reduce(lambda a, b: a | b, [here(i) for i in range(len(ranks))]))
    return met.groupBy(*by).agg(F.max("n").alias("n"), *[F.max(F.when(here(i), F.col("_v"))).alias(name) for i, name in enumerate(ranks)])


__all__ = ["WINDOW_ROWS", "largest_group", "numbered", "running_sum", "selected"]

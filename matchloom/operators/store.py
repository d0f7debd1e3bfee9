"""Mutable tables as snapshots: keyed upserts by one full outer join, and numbered versions."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an upsert does with a column of an existing row.
REPLACE, COALESCE_NEW, KEEP_OLD = "replace", "coalesce_new", "keep_old"
Rule = str | Column


def upsert(current: DataFrame, updates: DataFrame, keys: list[str], rules: Mapping[str, Rule], default: str = REPLACE, insert: bool = True) -> DataFrame:
    """``current`` with ``updates`` merged on ``keys``.

    Per column the rule is ``replace``, ``coalesce_new`` (the new value unless
    null), ``keep_old``, or an expression over ``old.<col>`` and ``new.<col>``.
    New rows take the update's values; columns that updates lack are kept, and
    null in new rows.  Keys of ``updates`` must be unique.
    """
    cols = current.columns
    have = set(updates.columns)
    old, new = current.withColumn("_o", F.lit(True)).alias("old"), updates.withColumn("_n", F.lit(True)).alias("new")
    joined = old.join(new, [F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys], "full" if insert else "left")
    hit, fresh = F.col("new._n").isNotNull(), F.col("old._o").isNull()
    out = []
    for c in cols:
        o, n = F.col(f"old.{c}"), F.col(f"new.{c}") if c in have else F.lit(None).cast(current.schema[c].dataType)
        if c in keys:
            out.append(F.when(fresh, n).otherwise(o).alias(c))
            continue
        rule = rules.get(c, default if c in have else KEEP_OLD)
        if isinstance(rule, str):
            if rule not in (REPLACE, COALESCE_NEW, KEEP_OLD):
                raise ValueError(f"unknown rule {rule!r} for column {c}")
            merged = {REPLACE: n, COALESCE_NEW: F.coalesce(n, o), KEEP_OLD: o}[rule]
            out.append(F.when(fresh, n).when(hit, merged).otherwise(o).alias(c))
        else:
            out.append(F.when(hit | fresh, rule).otherwise(o).alias(c))
    return joined.select(*out)


class SnapshotStore:
    """Versioned Parquet tables under one folder.

    Rows are in ``<root>/<table>/<folder>``; version ``n`` is the list of
    folders in ``<root>/<table>.versions/<n>``, and the current version is the
    highest number whose list is written in full.  Nothing that was published
    is changed: a crash between the writes leaves the version before current,
    and readers of an older version are not disturbed.  Two writers of one
    version number conflict, and the later one fails.  All access goes through
    Spark.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self, table: str) -> dict[int, bool]:
        """Numbers of all versions, and whether each is complete."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}.versions")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return {}
        found = [f.getPath() for f in fs.listStatus(path)]
        return {int(f.getName()): fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS")) for f in found if f.getName().isdigit()}

    def version(self, table: str) -> int | None:
        return max((n for n, complete in self._versions(table).items() if complete), default=None)

    def _folders(self, table: str, version: int) -> list[str]:
        return sorted(r[0] for r in self.spark.read.text(f"{self.root}/{table}.versions/{version}").collect())

    def _publish(self, table: str, folders: list[str]) -> DataFrame:
        n = max(self._versions(table), default=0) + 1
        self.spark.createDataFrame([(f,) for f in folders], "v string").coalesce(1).write.text(f"{self.root}/{table}.versions/{n}")
        return self.read(table, n)

    def read(self, table: str, version: int | None = None) -> DataFrame:
        v = self.version(table) if version is None else version
        if v is None:
            raise FileNotFoundError(f"{table} has no version in {self.root}")
        return self.spark.read.parquet(*[f"{self.root}/{table}/{f}" for f in self._folders(table, v)])

    def _stored(self, table: str, rows: DataFrame) -> str:
        folder = uuid.uuid4().hex
        rows.write.parquet(f"{self.root}/{table}/{folder}")
        return folder

    def write(self, table: str, rows: DataFrame) -> DataFrame:
        """Write a version and make it the current one."""
        return self._publish(table, [self._stored(table, rows)])

    def append(self, table: str, rows: DataFrame) -> DataFrame:
        """A version of the current rows and ``rows``; only the latter are written."""
        v = self.version(table)
        return self._publish(table, [*(self._folders(table, v) if v is not None else []), self._stored(table, rows)])

    def upsert(self, table: str, updates: DataFrame, keys: list[str], rules: Mapping[str, Rule], **options: object) -> DataFrame:
        return self.write(table, upsert(self.read(table), updates, keys, rules, **options))

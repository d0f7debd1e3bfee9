"""Folders that driver and executors share, and frames written to them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of at most this many rows, counted first, are broadcast.
BROADCAST_ROWS = 100_000


def shared_folder(spark: SparkSession, kind: str = "stream") -> str:
    """A new folder under the checkpoint folder the session names; a private one only on one machine where none is set (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="matchloom-")
    return f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def written(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back: computed once, with sizes that Spark knows."""
    path = shared_folder(rows.sparkSession, "rows")
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def hinted(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows``, which should be written, with the hint to broadcast them if they are few, counted, and to sort and merge if not."""
    return rows.hint("broadcast" if rows.count() <= most else "merge")


__all__ = ["BROADCAST_ROWS", "hinted", "shared_folder", "written"]

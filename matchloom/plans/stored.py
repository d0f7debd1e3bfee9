"""Feeds of the bindings, built once for a session and a set of tables, as a service keeps them."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matchloom.operators.buckets import BucketStore
from matchloom.operators.feed_state import FeedState
from matchloom.operators.shared import shared_folder
from matchloom.plans import bindings as b

SCORED_AT = "2001-06-01 00:00:00"
_BUILT: dict[tuple[str, str], FeedState] = {}


def feeds(spark: SparkSession, sf_dir: str) -> FeedState:
    """The stored feeds of all profiles: queries that read feeds read these rows and do not build them anew."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _BUILT:
        state = FeedState(BucketStore(spark, shared_folder(spark, "feeds")), buckets=8)
        state.build(b.profiles_full(spark, sf_dir), b.postings_full(spark, sf_dir), scored_at=F.lit(SCORED_AT).cast("timestamp"))
        _BUILT[key] = state
    return _BUILT[key]

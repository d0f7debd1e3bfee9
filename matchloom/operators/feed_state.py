"""Feeds kept up to date: after a change only the profiles that it can reach are worked on.

A profile's state is one row: its nearest postings, somewhat more than are
scored, and its scored ones.  A posting that comes, or comes back changed, can
enter a list only if it ranks before the list's floor, the last place up to
which the list is known to be complete; a posting that goes leaves a gap, and
only a list that falls short of the recall limit is looked up anew.  Of the
lists that changed, only pairs that are new, or whose posting or profile
changed, are scored.  The state is a bucketed table, so other profiles' buckets
are not written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.operators import scoring
from matchloom.operators.buckets import BucketStore
from matchloom.operators.feed import FEED_SIZE, rerank, score_pairs
from matchloom.operators.recall import RECALL_LIMIT, eligible, recall

#: Postings a list holds beyond the recall limit, so that a few may go before it is looked up anew.
RESERVE = 56
#: Changed rows that are broadcast, counted first.
BROADCAST_ROWS = 100_000
TABLE = "feeds"

_NEAR = "array<struct<semantic_score:double,posting_id:bigint>>"


def _order(score: Column, posting: Column) -> Column:
    """Sorts ascending as (similarity falling, posting rising); similarities have six digits."""
    return F.struct((-score).alias("s"), posting.alias("p"))


class FeedState:
    """The maintained feeds in a :class:`BucketStore`.

    ``refresh`` has to be told which postings and profiles changed since the
    last time: came, went, were closed or reopened, or differ in vector,
    requirements or skills.  The result is that of :func:`build_feed` on the
    tables as they are.
    """

    def __init__(self, store: BucketStore, recall_limit: int = RECALL_LIMIT, feed_size: int = FEED_SIZE, reserve: int = RESERVE, buckets: int = 64) -> None:
        self.store, self.recall_limit, self.feed_size, self.reserve, self.buckets = store, recall_limit, feed_size, reserve, buckets
        self.work = f"{store.root}/{TABLE}.work/{uuid.uuid4().hex}"

    @property
    def capacity(self) -> int:
        return self.recall_limit + self.reserve

    # --- state ---

    def _lists(self, found: DataFrame) -> DataFrame:
        """Lists of (profile_id, posting_id, semantic_score), each complete up to its last place, or altogether if it is not full."""
        per = found.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct(_order(F.col("semantic_score"), F.col("posting_id")).alias("o"), "semantic_score", "posting_id"))).alias("l"))
        near = F.transform("l", lambda x: F.struct(x["semantic_score"], x["posting_id"])).cast(_NEAR)
        return per.select("profile_id", near.alias("near"), F.when(F.size("l") >= self.capacity, F.element_at("l", -1)["o"]).alias("floor"))

    def _scored(self, wanted: DataFrame, kept: DataFrame | None, profiles: DataFrame, postings: DataFrame, scored_at: Column) -> DataFrame:
        """``matches`` arrays of the wanted pairs; pairs in ``kept`` (profile_id, m) are not scored again."""
        todo = wanted if kept is None else wanted.join(kept.select("profile_id", F.col("m.posting_id").alias("posting_id")).hint("merge"), ["profile_id", "posting_id"], "left_anti")
        made = score_pairs(todo, profiles, postings).withColumns({"scorer_version": F.lit(scoring.SCORER_VERSION), "scored_at": scored_at})
        fields = ["posting_id", "semantic_score", "skill_score", "final_score", "breakdown", "scorer_version", "scored_at"]
        rows = made.select("profile_id", F.struct(*fields).alias("m"))
        if kept is not None:
            still = wanted.select(F.col("profile_id").alias("_id"), F.col("posting_id").alias("_p")).hint("merge")
            rows = rows.unionByName(kept.join(still, (F.col("profile_id") == F.col("_id")) & (F.col("m.posting_id") == F.col("_p")), "left_semi"))
        flat = rerank(rows.select("profile_id", "m.*"), self.recall_limit)
        best = F.array_sort(F.collect_list(F.struct("feed_rank", *fields)))
        return flat.groupBy("profile_id").agg(best.alias("matches"))

    def _top(self, lists: DataFrame) -> DataFrame:
        return lists.select("profile_id", F.explode(F.slice("near", 1, self.recall_limit)).alias("n")).select("profile_id", "n.posting_id", "n.semantic_score")

    def build(self, profiles: DataFrame, postings: DataFrame, scored_at: Column | None = None) -> None:
        """All feeds from scratch: the table's first version."""
        at = scored_at if scored_at is not None else F.current_timestamp()
        lists = self._cut(self._lists(recall(profiles, postings, self.capacity)))
        rows = lists.join(self._scored(self._top(lists), None, profiles, postings, at).hint("merge"), "profile_id", "left")
        self.store.create(TABLE, rows, ["profile_id"], self.buckets)
        self.store.remove(self.work)

    def _cut(self, rows: DataFrame) -> DataFrame:
        path = f"{self.work}/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return self.store.spark.read.parquet(path)

    def _small(self, rows: DataFrame) -> DataFrame:
        return rows.hint("broadcast" if rows.count() <= BROADCAST_ROWS else "merge")

    def refresh(self, profiles: DataFrame, postings: DataFrame, changed_postings: DataFrame, changed_profiles: DataFrame | None = None, scored_at: Column | None = None, writer: str | None = None, batch: int | None = None) -> dict[str, int]:
        """Bring the feeds up to date; returns how many profiles were ``touched``, ``recalled`` anew, and stand in the table.

        ``changed_postings`` (posting_id) and ``changed_profiles``
        (profile_id) may name rows that no longer exist.
        """
        at = scored_at if scored_at is not None else F.current_timestamp()
        spark = self.store.spark
        ids = self._cut(changed_postings.select("posting_id").distinct())
        people = self._cut((changed_profiles if changed_profiles is not None else spark.createDataFrame([], "profile_id bigint")).select("profile_id").distinct())
        version = self.store.version(TABLE)
        state = self.store.read(TABLE, version).join(self._small(people), "profile_id", "left_anti")

        # What goes: places of changed postings in the lists, found without the scored pairs.
        places = state.select("profile_id", F.explode("near.posting_id").alias("posting_id"))
        lost = places.join(self._small(ids), "posting_id").groupBy("profile_id").agg(F.collect_set("posting_id").alias("gone"))
        # What may come: changed postings that are eligible, where they rank before the floor.
        fresh = eligible(postings).join(self._small(ids), "posting_id", "left_semi")
        same = profiles.join(self._small(people), "profile_id", "left_anti")
        near = recall(same, fresh, self.capacity).select("profile_id", "posting_id", "semantic_score")
        floors = state.select(F.col("profile_id").alias("_id"), "floor", F.lit(True).alias("known"))
        new_order = _order(F.col("semantic_score"), F.col("posting_id"))
        come = near.join(floors.hint("merge"), F.col("profile_id") == F.col("_id")).filter(F.col("floor").isNull() | (new_order <= F.col("floor")))
        come = come.groupBy("profile_id").agg(F.collect_list(F.struct("semantic_score", "posting_id")).alias("new"))
        moved = self._cut(lost.join(come, "profile_id", "full"))

        pair = lambda x: F.struct(_order(x["semantic_score"], x["posting_id"]).alias("o"), x["semantic_score"], x["posting_id"])
        empty = F.array().cast(_NEAR)
        left = F.when(F.col("gone").isNull(), F.col("near")).otherwise(F.filter("near", lambda x: ~F.array_contains("gone", x["posting_id"])))
        joined = F.array_sort(F.transform(F.concat(left, F.coalesce(F.col("new").cast(_NEAR), empty)), pair))
        lists = state.drop("matches").join(moved.hint("merge"), "profile_id").withColumn("l", joined)
        full = F.size("l") >= self.capacity
        lists = lists.withColumn("l", F.slice("l", 1, self.capacity)).select(
            "profile_id", F.transform("l", lambda x: F.struct(x["semantic_score"], x["posting_id"])).cast(_NEAR).alias("near"), F.when(full, F.element_at("l", -1)["o"]).otherwise(F.col("floor")).alias("floor")
        )
        lists = self._cut(lists)
        short = F.col("floor").isNotNull() & (F.size("near") < self.recall_limit)

        # Lists to look up anew: those that fell short, changed profiles, and profiles that had no eligible posting.
        embedded = profiles.filter(F.col("embedding").isNotNull())
        missing = embedded.select("profile_id").join(self.store.read(TABLE, version).select("profile_id").hint("merge"), "profile_id", "left_anti")
        again = self._cut(lists.filter(short).select("profile_id").unionByName(people).unionByName(missing).distinct())
        looked = self._lists(recall(embedded.join(self._small(again), "profile_id", "left_semi"), postings, self.capacity))
        lists = self._cut(lists.filter(~short).unionByName(looked))

        gone = again.join(lists.select("profile_id").hint("merge"), "profile_id", "left_anti").join(self.store.read(TABLE, version).select("profile_id").hint("merge"), "profile_id", "left_semi")
        touched = self._cut(lists.select("profile_id").unionByName(gone).distinct())
        old = self.store.read(TABLE, version).join(self._small(lists.join(people, "profile_id", "left_anti").select("profile_id")), "profile_id", "left_semi")
        kept = old.select("profile_id", F.explode("matches").alias("m")).join(self._small(ids.withColumnRenamed("posting_id", "_p")), F.col("m.posting_id") == F.col("_p"), "left_anti")
        kept = self._cut(kept.filter(F.col("m.scorer_version") == scoring.SCORER_VERSION))
        wanted = self._cut(self._top(lists))
        rows = self._cut(lists.join(self._scored(wanted, kept.withColumn("m", F.col("m").dropFields("feed_rank")), profiles, postings, at).hint("merge"), "profile_id", "left"))

        def merge(current: DataFrame) -> DataFrame:
            return current.join(touched.hint("merge"), "profile_id", "left_anti").unionByName(rows.select(*current.columns))

        made = self.store.update(TABLE, touched, merge, writer, batch)
        if made != version + 1 and writer is None:
            raise RuntimeError("another writer changed the feeds meanwhile; refresh again")
        counts = {"touched": touched.count(), "recalled": again.count(), "profiles": self.store.read(TABLE).count()}
        self.store.remove(self.work)
        return counts

    # --- reading ---

    def matches(self, size: int | None = None) -> DataFrame:
        """The feeds in the shape of ``matches``: stored rows, nothing is computed but their ranks' limit."""
        m = self.store.read(TABLE).select("profile_id", F.explode("matches").alias("m")).select("profile_id", "m.*")
        return m.filter(F.col("feed_rank") <= (self.feed_size if size is None else size)).withColumn("origin", F.lit("recommendation"))

    def scored(self) -> DataFrame:
        """All scored pairs: as many as the recall limit of each profile."""
        return self.matches(self.recall_limit)


__all__ = ["FeedState", "RESERVE"]

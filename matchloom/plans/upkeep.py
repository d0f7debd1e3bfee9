"""Queries over state that is kept: the recall index and maintained feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import audit, feed, index, insights, ops, recall, sketches
from matchloom.operators.buckets import BucketStore
from matchloom.operators.feed_state import FeedState
from matchloom.operators.store import SnapshotStore
from matchloom.plans import bindings as b
from matchloom.plans.registry import ORACLE_SQL, query
from matchloom.operators.shared import shared_folder


@query(
    "recall_index",
    b.with_(b.SQL_POSTINGS, b.SQL_PROFILES, b.SQL_RECALL) + "SELECT count(*) AS exact_rows, true AS enough, (SELECT count(*) FROM postings WHERE embedding IS NOT NULL) AS coded FROM recalled",
)
def recall_index(spark: SparkSession, d: str) -> DataFrame:
    """The index, fitted on nine tenths of the postings with the others appended, against the exact rows of all profiles."""
    p, q = b.profiles(spark, d), b.postings(spark, d)
    known = index.RecallIndex(SnapshotStore(spark, shared_folder(spark)))
    known.create(q.filter("posting_id % 10 <> 1"), p)
    known.append(q)
    found = recall.recall_at_k(recall.recall(p, q), known.search(p, q))
    return found.select("exact_rows", (F.col("recall") >= 0.9).alias("enough"), F.lit(known.codes().count()).cast("long").alias("coded"))


def _earlier(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Profiles and postings as they were: some not there yet, some still open, some with other vectors, requirements or skills."""
    p, q = b.profiles_full(spark, d), b.postings_full(spark, d)
    i, j = F.col("posting_id"), F.col("profile_id")
    q = q.filter("posting_id % 17 <> 0")
    q = q.withColumns({
        "closed_at": F.when(i % 5 == 1, F.when(F.col("closed_at").isNull(), F.col("first_seen_at"))).otherwise(F.col("closed_at")),
        "embedding": F.when(i % 7 == 2, F.reverse("embedding")).otherwise(F.col("embedding")),
        "requirements": F.when(i % 11 == 3, F.slice("requirements", 1, 1)).otherwise(F.col("requirements")),
    })
    p = p.filter("profile_id % 150 <> 0").withColumn("skills", F.when(j % 4 == 1, F.slice("skills", 1, 2)).otherwise(F.col("skills")))
    return p, q


@query(
    "feed_refresh",
    b.with_(*b.FEED_PARTS) + "SELECT profile_id, posting_id, CAST(round(sim * 1e6) AS BIGINT) AS score_millionths, round(skill, 4) AS skill_score, round(final, 4) AS final_score, CAST(feed_rank AS INTEGER) AS feed_rank FROM feed",
)
def feed_refresh(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of earlier tables brought up to date: the rows of a full rebuild."""
    at = F.lit("2001-06-01 00:00:00").cast("timestamp")
    state = FeedState(BucketStore(spark, shared_folder(spark)), buckets=8)
    state.build(*_earlier(spark, d), scored_at=at)
    p, q = b.profiles_full(spark, d), b.postings_full(spark, d)
    changed = q.filter("posting_id % 17 = 0 or posting_id % 5 = 1 or posting_id % 7 = 2 or posting_id % 11 = 3")
    state.refresh(p, q, changed, p.filter("profile_id % 150 = 0 or profile_id % 4 = 1"), scored_at=at)
    r = lambda c: F.round(c, 4).alias(c)
    return state.matches().select("profile_id", "posting_id", F.round(F.col("semantic_score") * 1e6).cast("long").alias("score_millionths"), r("skill_score"), r("final_score"), "feed_rank")


@query(
    "distinct_sketches",
    "SELECT o_orderstatus AS status, count(*) AS rows, true AS near FROM orders GROUP BY 1",
)
def distinct_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Customers per status from sketches kept by year, added year after year, against counting them all: are they within three percent?"""
    o = b.table(spark, d, "orders").select(F.year("o_orderdate").alias("snapshot"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    kept = sketches.DistinctCounts(BucketStore(spark, shared_folder(spark)), "customers", ["status"])
    for part in ("snapshot < 1995", "snapshot >= 1995", "snapshot = 1996"):  # the last year once more
        kept.add(o.filter(part), "customer")
    exact = o.groupBy("status").agg(F.count_distinct("customer").alias("exact"))
    both = kept.counts("status").join(exact.hint("merge"), "status")
    return both.select("status", "rows", (F.abs(F.col("distinct") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))


@query("audit_counts", ORACLE_SQL["constraint_audit"])
def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    """The violations of ``constraint_audit``, found while the tables are written."""
    j = b.jobs(spark, d).withColumn("status", F.when(F.col("status") == "dead", "lost").otherwise(F.col("status")))
    batches = j.filter("batch_id % 2 = 0").select("batch_id").distinct()
    return audit.write_audited({"ingest_jobs": j, "url_batches": batches}, shared_folder(spark))[1]


QUEUES = ("click", "view", "purchase", "signup", "error")


@query("depth_csv", ORACLE_SQL["depth_wide"].replace("coalesce(max(depth)", "CAST(coalesce(max(depth)").replace(", 0) AS ", ", 0) AS INTEGER) AS "))
def depth_csv(spark: SparkSession, d: str) -> DataFrame:
    """Depths written as CSV, a column per queue, and read again."""
    samples = b.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("t"), F.col("event_type").alias("queue")).agg(F.count("*").alias("depth"))
    path = shared_folder(spark)
    ops.write_depth_csv(samples, list(QUEUES), path)
    return spark.read.option("header", True).schema("t string, " + ", ".join(f"{q} int" for q in QUEUES)).csv(path).withColumn("t", F.date_format(F.col("t").cast("timestamp"), "yyyy-MM-dd HH:mm:ss"))


@query(
    "pairs_without_vectors",
    b.with_(*b.FEED_PARTS[:7]) + "SELECT profile_id, posting_id, CASE WHEN profile_id % 50 = 0 OR posting_id % 3 = 0 THEN 0 ELSE CAST(round(sim * 1e6) AS BIGINT) END AS score_millionths, round(skill, 6) AS skill_score FROM scored",
)
def pairs_without_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Given pairs scored from the vectors of both sides, of which some have none: these count as unlike."""
    pairs = recall.recall(b.profiles(spark, d), b.postings(spark, d)).select("profile_id", "posting_id")
    p = b.profiles_full(spark, d).withColumn("embedding", F.when(F.col("profile_id") % 50 != 0, F.col("embedding")))
    q = b.postings_full(spark, d).withColumn("embedding", F.when(F.col("posting_id") % 3 != 0, F.col("embedding")))
    s = feed.score_pairs(pairs, p, q)
    return s.select("profile_id", "posting_id", F.round(F.col("semantic_score") * 1e6).cast("long").alias("score_millionths"), F.round("skill_score", 6).alias("skill_score"))


_SPELLED = "CASE l_orderkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN replace(p_name, ' ', '-') ELSE p_name END"


@query(
    "gap_spellings",
    f"""WITH v AS (SELECT l_suppkey % 10 AS scope, {_SPELLED} AS name, CASE l_returnflag WHEN 'A' THEN 'missing' WHEN 'R' THEN 'partial' ELSE 'matched' END AS bucket, l_linestatus = 'O' AS needed FROM lineitem JOIN part ON p_partkey = l_partkey WHERE NOT (l_orderkey % 3 = 1 AND l_suppkey % 2 = 0)),
c AS (SELECT scope, name, count(*) AS n, count(*) FILTER (bucket = 'missing') AS missing, count(*) FILTER (bucket = 'missing' AND needed) AS blocking FROM v GROUP BY 1, 2)
SELECT scope, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(blocking) AS BIGINT) AS blocking, arg_min(name, (len(string_split(name, ' ')), -n, -length(regexp_replace(name, '[^A-Z]', '', 'g')), name)) AS skill FROM c GROUP BY scope, replace(replace(lower(name), ' ', ''), '-', '')""",
)
def gap_spellings(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that spell one skill in several ways, added up under the spelling that is shown."""
    l, p = b.table(spark, d, "lineitem"), b.table(spark, d, "part")
    rows = l.join(p, l.l_partkey == p.p_partkey).filter("not (l_orderkey % 3 = 1 and l_suppkey % 2 = 0)")
    v = rows.select(
        (F.col("l_suppkey") % 10).alias("scope"), F.expr(_SPELLED).alias("name"), F.when(F.col("l_returnflag") == "A", "missing").when(F.col("l_returnflag") == "R", "partial").otherwise("matched").alias("bucket"),
        F.when(F.col("l_linestatus") == "O", "required").otherwise("preferred").alias("necessity"),
    )
    return insights.fold_spellings(insights.gap_counts(v, "scope"), "scope").select("scope", "missing", "blocking", "skill")

"""Operational rollups: statuses, queues, sources, latencies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.classify import FAILURE_LIMIT, freshness, human_age, queue_verdict
from matchloom.operators.ranks import WINDOW_ROWS, largest_group, selected


def status_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")


def source_health(sources: DataFrame, postings: DataFrame, now: Column) -> DataFrame:
    """Sources with open postings (0 if none), age, staleness and circuit, by display name."""
    counts = postings.filter("closed_at IS NULL").groupBy("source_id").agg(F.count("*").alias("open_postings"))
    rows = sources.join(counts, "source_id", "left").withColumn("open_postings", F.coalesce("open_postings", F.lit(0)))
    fresh = freshness(F.col("last_success_at"), F.col("crawl_interval_seconds"), F.col("consecutive_failures"), now)
    rows = rows.withColumn("f", fresh).select(*[c for c in rows.columns], F.col("f.age_seconds"), F.col("f.is_stale"), F.col("f.circuit_open"))
    return rows.withColumn("age", human_age(F.col("age_seconds"))).orderBy("display_name", "source_id")


def fold_attempts(sources: DataFrame, attempts: DataFrame) -> DataFrame:
    """Sources after a log of crawl attempts (source_id, ts, ok): last attempt, last success, failures since the last success."""
    ok = attempts.groupBy("source_id").agg(F.max("ts").alias("_tried"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("_ok"))
    since = attempts.join(ok, "source_id").filter(~F.col("ok") & (F.col("_ok").isNull() | (F.col("ts") > F.col("_ok")))).groupBy("source_id").agg(F.count("*").alias("_n"))
    rows = sources.join(ok, "source_id", "left").join(since, "source_id", "left")
    n = F.coalesce("_n", F.lit(0))
    failures = F.when(F.col("_tried").isNull(), F.col("consecutive_failures")).when(F.col("_ok").isNotNull(), n).otherwise(F.col("consecutive_failures") + n)
    return rows.withColumn("last_crawled_at", F.greatest("last_crawled_at", "_tried")).withColumn("last_success_at", F.greatest("last_success_at", "_ok")).withColumn("consecutive_failures", failures.cast("int")).select(*sources.columns)


def circuit_open(failures: Column) -> Column:
    return failures >= FAILURE_LIMIT


def queue_overview(declared: DataFrame, depths: DataFrame, workers: DataFrame) -> DataFrame:
    """Declared and observed queues with depth, workers that drain them, and a verdict.

    ``declared`` (queue), ``depths`` (queue, depth), ``workers`` (worker, queues array).
    """
    names = declared.select("queue").union(depths.select("queue")).distinct()
    cover = workers.select("worker", F.explode("queues").alias("queue")).groupBy("queue").agg(F.count_distinct("worker").alias("workers"))
    rows = names.join(declared.select("queue", F.lit(True).alias("declared")).distinct(), "queue", "left").join(depths.groupBy("queue").agg(F.sum("depth").alias("depth")), "queue", "left").join(cover, "queue", "left")
    rows = rows.select("queue", F.coalesce("declared", F.lit(False)).alias("declared"), F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("workers", F.lit(0)).alias("workers"))
    return rows.withColumn("verdict", queue_verdict(F.col("declared"), F.col("workers"), F.col("depth"))).orderBy("queue")


def latency_summary(samples: DataFrame, value: str, *by: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Exact n, mean, interpolated median, and nearest-rank p95 and p99 (the int(n q)-th smallest); nulls do not count.

    Groups of more than ``window_rows`` samples are ranked over sorted ranges
    instead of in one task each.
    """
    if largest_group(samples, by) <= window_rows:
        rows = samples.filter(F.col(value).isNotNull())
        whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        ranked = rows.select(*by, F.col(value).alias("v"), F.row_number().over(whole.orderBy(value)).alias("rn"), F.count("*").over(whole).alias("n"))
        nth = lambda k: F.max(F.when(F.col("rn") == k, F.col("v")))
        n = F.col("n")
        low, high = nth(F.floor((n + 1) / 2)), nth(F.floor(n / 2) + 1)
        return ranked.groupBy(*by).agg(F.max("n").alias("n"), F.avg("v").alias("mean"), ((low + high) / 2).alias("p50"), *[nth(F.greatest(F.lit(1), F.floor(n * q))).alias(name) for name, q in (("p95", 0.95), ("p99", 0.99))])
    n = F.col("n")
    at = lambda q: F.greatest(F.lit(1), F.floor(n * q))
    found = selected(samples, by, value, {"_low": F.floor((n + 1) / 2), "_high": F.floor(n / 2) + 1, "p95": at(0.95), "p99": at(0.99)})
    means = samples.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"))
    if not by:
        return found.select("n", F.lit(means.first()["mean"]).alias("mean"), ((F.col("_low") + F.col("_high")) / 2).alias("p50"), "p95", "p99")
    means = means.select(*[F.col(c).alias(f"_m{i}") for i, c in enumerate(by)], "mean")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_m{i}")) for i, c in enumerate(by)])
    return found.join(means.hint("merge"), same).select(*by, "n", "mean", ((F.col("_low") + F.col("_high")) / 2).alias("p50"), "p95", "p99")


def latency_approx(samples: DataFrame, value: str, *by: str, accuracy: int = 10_000) -> DataFrame:
    """The same from one mergeable sketch per group, for groups of any size."""
    q = F.percentile_approx(value, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), accuracy)
    return samples.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), q.alias("q")).select(*by, "n", "mean", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"))


def depth_peaks(samples: DataFrame) -> DataFrame:
    """Peak and last depth per queue; missing samples count as 0."""
    return samples.groupBy("queue").agg(F.max(F.coalesce("depth", F.lit(0))).alias("peak"), F.max_by(F.coalesce("depth", F.lit(0)), "t").alias("at_finish"))


def depth_wide(samples: DataFrame, queues: list[str]) -> DataFrame:
    """One row per sample time, one column per queue, missing as 0."""
    return samples.groupBy("t").pivot("queue", queues).agg(F.max("depth")).na.fill(0, queues)


def write_depth_csv(samples: DataFrame, queues: list[str], path: str) -> None:
    depth_wide(samples, queues).orderBy("t").write.mode("overwrite").option("header", True).csv(path)


def recent_depths(samples: DataFrame, keep: int = 60) -> DataFrame:
    """The last ``keep`` samples of each queue with the change from the sample before."""
    w = Window.partitionBy("queue").orderBy(F.desc("t"))
    rows = samples.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= keep)
    trend = F.col("depth") - F.lag("depth").over(Window.partitionBy("queue").orderBy("t"))
    return rows.withColumn("trend", F.coalesce(trend, F.lit(0))).select("queue", "t", "depth", "age", "trend")


def distinct_companies(postings: DataFrame, exact: bool = True) -> DataFrame:
    f = F.count_distinct("company") if exact else F.approx_count_distinct("company")
    return postings.agg(f.alias("companies"), F.count("*").alias("postings"))

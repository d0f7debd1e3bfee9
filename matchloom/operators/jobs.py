"""Ingest jobs: batches of URLs, duplicates in flight, failures, retries, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.classify import RETRY_LIMIT, retry_delay
from matchloom.functions.text import ERROR_CHARS, strip
from matchloom.functions.urls import dedupe_key, hash_url, normalize_url
from matchloom.operators.ranks import WINDOW_ROWS, largest_group, numbered, running_sum

IN_FLIGHT = ("queued", "running")
BATCH_CAP, OPEN_BATCHES = 500, 3


def parse_url_lines(lines: DataFrame, cap: int = BATCH_CAP, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Outcome of every non-blank line (batch_id, line_no, line): accepted, duplicate, rejected or over_cap.

    The first line of a URL counts; the cap falls after duplicates are gone.
    Where a batch has more than ``window_rows`` lines, places come from sorted
    ranges instead of windows, so that it does not meet in one task.
    """
    large = largest_group(lines, ["batch_id"]) > window_rows
    rows = lines.filter(strip(F.col("line")) != "").withColumn("url", normalize_url(F.col("line")))
    if large:
        rows = numbered(rows, ["batch_id", "url"], ["line_no"], "_k").withColumn("_first", F.col("url").isNotNull() & (F.col("_k") == 1)).drop("_k")
        rows = running_sum(rows.withColumn("_one", F.col("_first").cast("int")), ["batch_id"], ["line_no"], "_one", "_nth").drop("_one")
    else:
        same = Window.partitionBy("batch_id", "url").orderBy("line_no")
        rows = rows.withColumn("_first", F.col("url").isNotNull() & (F.row_number().over(same) == 1))
        order = Window.partitionBy("batch_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_nth", F.sum(F.col("_first").cast("int")).over(order))
    outcome = F.when(F.col("url").isNull(), "rejected").when(~F.col("_first"), "duplicate").when(F.col("_nth") > cap, "over_cap").otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("_first", "_nth")


def batch_counts(parsed: DataFrame) -> DataFrame:
    """Per batch: total, rejected (over the cap included), duplicates."""
    return parsed.groupBy("batch_id").agg(F.count_if(F.col("outcome") == "accepted").alias("total_urls"), F.count_if(F.col("outcome").isin("rejected", "over_cap")).alias("rejected_urls"), F.count_if(F.col("outcome") == "duplicate").alias("duplicate_urls"))


def not_in_flight(new: DataFrame, jobs: DataFrame) -> DataFrame:
    """New jobs whose (kind, dedupe_key) is neither queued nor running, one each; finished jobs never block."""
    busy = jobs.filter(F.col("status").isin(*IN_FLIGHT)).select("kind", "dedupe_key")
    return new.dropDuplicates(["kind", "dedupe_key"]).join(busy, ["kind", "dedupe_key"], "left_anti")


def split_submitted(new: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(existing job of the same profile and URL whatever its status, newest first; rows to insert)."""
    w = Window.partitionBy("profile_id", "url_hash").orderBy(F.desc("created_at"), F.desc("job_id"))
    known = jobs.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select("profile_id", "url_hash", "job_id", "status")
    return new.join(known, ["profile_id", "url_hash"]), new.join(known, ["profile_id", "url_hash"], "left_anti")


def create_batches(lines: DataFrame, batches: DataFrame, jobs: DataFrame, cap: int = BATCH_CAP) -> tuple[DataFrame, DataFrame]:
    """(batch rows with counts by what was really inserted, job rows to insert), from lines and ``batches`` (batch_id, user_id, profile_id)."""
    parsed = parse_url_lines(lines, cap)
    rows = parsed.filter("outcome = 'accepted'").join(batches.select("batch_id", "profile_id"), "batch_id")
    rows = rows.withColumn("kind", F.lit("posting")).withColumn("url_hash", hash_url(F.col("url")))
    rows = rows.withColumn("dedupe_key", dedupe_key("profile", F.col("profile_id"), F.col("url_hash")))
    fresh = not_in_flight(rows.select("kind", "dedupe_key", "profile_id", "batch_id", "url", "url_hash"), jobs).withColumn("status", F.lit("queued")).withColumn("attempts", F.lit(0))
    inserted = fresh.groupBy("batch_id").agg(F.count("*").alias("n"))
    counted = batches.join(batch_counts(parsed), "batch_id", "left").join(inserted, "batch_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return counted.select(*batches.columns, zero("n").alias("total_urls"), zero("rejected_urls").alias("rejected_urls"), (zero("duplicate_urls") + zero("total_urls") - zero("n")).alias("duplicate_urls")), fresh


def admitted(batches: DataFrame, jobs: DataFrame, limit: int = OPEN_BATCHES) -> DataFrame:
    """Open batches per user (distinct batches with jobs in flight) and whether another may start."""
    busy = jobs.filter(F.col("status").isin(*IN_FLIGHT) & F.col("batch_id").isNotNull()).select("batch_id").distinct()
    per = batches.join(busy.withColumn("_open", F.lit(1)), "batch_id", "left").groupBy("user_id").agg(F.count_distinct(F.when(F.col("_open").isNotNull(), F.col("batch_id"))).alias("open_batches"))
    return per.withColumn("may_start", F.col("open_batches") < limit)


def fail(jobs: DataFrame, failures: DataFrame, now: Column) -> DataFrame:
    """Jobs after failures (job_id, error, permanent): dead if permanent or out of attempts, else failed."""
    rows = jobs.join(failures.select("job_id", "error", "permanent"), "job_id", "left")
    hit = F.col("permanent").isNotNull()
    status = F.when(F.col("permanent") | (F.col("attempts") > RETRY_LIMIT), "dead").otherwise("failed")
    changed = {"status": status, "last_error": F.substring("error", 1, ERROR_CHARS), "updated_at": now}
    return rows.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in jobs.columns])


def fold_lifecycle(events: DataFrame, retry_jitter: float = 0.2) -> DataFrame:
    """Current state of each job from its events (job_id, seq, event in started/succeeded/failed, ts, error, permanent, posting_id).

    Attempts are starts; success clears the error and ends the job (what comes
    after is a replay and changes nothing); a failed job has its next attempt.
    """
    done = events.filter("event = 'succeeded'").groupBy("job_id").agg(F.min("seq").alias("_end"))
    live = events.join(done, "job_id", "left").filter("_end IS NULL OR seq <= _end")
    per = live.groupBy("job_id").agg(F.count_if(F.col("event") == "started").cast("int").alias("attempts"), F.max_by(F.struct("event", "ts", "error", "permanent", "posting_id"), "seq").alias("l"))
    status = (
        F.when(F.col("l.event") == "succeeded", "succeeded")
        .when(F.col("l.event") == "started", "running")
        .when(F.coalesce("l.permanent", F.lit(False)) | (F.col("attempts") > RETRY_LIMIT), "dead")
        .otherwise("failed")
    )
    error = F.when(F.col("l.event") == "failed", F.substring("l.error", 1, ERROR_CHARS))
    again = F.when(status == "failed", (F.col("l.ts").cast("timestamp").cast("double") + retry_delay(F.col("job_id"), F.col("attempts"), retry_jitter)).cast("timestamp"))
    return per.select("job_id", status.alias("status"), "attempts", error.alias("last_error"), F.col("l.posting_id").alias("posting_id"), again.alias("next_attempt_at"))


def requeue(jobs: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(jobs to put back with their queue, refused ids with the reason).  Only failed and dead jobs may return."""
    rows = ids.select("job_id").distinct().join(jobs, "job_id", "left")
    reason = F.when(F.col("status").isNull(), "no such job").when(~F.col("status").isin("failed", "dead"), F.concat(F.lit("job is "), F.col("status")))
    rows = rows.withColumn("reason", reason)
    good = rows.filter("reason IS NULL").drop("reason").withColumn("status", F.lit("queued")).withColumn("attempts", F.lit(0)).withColumn("last_error", F.lit(None).cast("string")).withColumn("updated_at", now)
    return good.withColumn("queue", F.when(F.col("batch_id").isNotNull(), "ingest").otherwise("interactive")), rows.filter("reason IS NOT NULL").select("job_id", "reason")


def listing(jobs: DataFrame, owned: DataFrame | None = None, profile_id: int | None = None, status: str | None = None, limit: int = 50) -> DataFrame:
    """Jobs of the owned profiles, newest first."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    rows = jobs if owned is None else jobs.join(owned.select("profile_id").distinct(), "profile_id", "left_semi")
    if profile_id is not None:
        rows = rows.filter(F.col("profile_id") == profile_id)
    if status is not None:
        rows = rows.filter(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def dead_letters(jobs: DataFrame, limit: int = 50) -> DataFrame:
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    return jobs.filter(F.col("status").isin("failed", "dead")).orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def batch_progress(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each batch with its jobs' statuses as a map, and whether nothing is queued or running."""
    per = jobs.filter(F.col("batch_id").isNotNull()).groupBy("batch_id", "status").agg(F.count("*").alias("n"))
    counts = per.groupBy("batch_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"), F.sum(F.when(F.col("status").isin(*IN_FLIGHT), F.col("n")).otherwise(0)).alias("in_flight"))
    rows = batches.join(counts, "batch_id", "left")
    return rows.withColumn("counts", F.coalesce("counts", F.create_map().cast("map<string,bigint>"))).withColumn("is_complete", F.coalesce("in_flight", F.lit(0)) == 0).drop("in_flight")


def batch_listing(batches: DataFrame, limit: int = 100) -> DataFrame:
    """The newest batches first, at most ``limit``."""
    return batches.orderBy(F.desc("created_at"), F.desc("batch_id")).limit(limit)

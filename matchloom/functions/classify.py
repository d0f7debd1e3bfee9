"""Small classifications: fetch outcomes, score bands, severities, queue verdicts, ages, retry times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# HTTP statuses worth a retry; delays before the attempts; limits.
TRANSIENT = (408, 425, 429, 500, 502, 503, 504, 507, 509)
RETRY_SECONDS = (10, 60, 300)
RETRY_LIMIT = 3
FAILURE_LIMIT = 5


def fetch_outcome(status: Column, content_type: Column, n_bytes: Column, error: Column, most_bytes: int = 5_000_000) -> Column:
    """ok, transient or permanent.  Time-outs and connection errors are transient; other content than text or too much of it is permanent."""
    textual = F.coalesce(content_type, F.lit("text/html")).rlike(r"(?i)^\s*(?:text/|application/(?:xhtml\+xml|xml|json))")
    return (
        F.when(status.isin(*TRANSIENT), "transient")
        .when(status >= 400, "permanent")
        .when(status.isNull() & error.isNotNull(), "transient")
        .when(~textual | (n_bytes > most_bytes), "permanent")
        .otherwise("ok")
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 0.70, "high").when(score >= 0.45, "mid").otherwise("low")


def percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")


def gap_severity(blocking: Column, analyzed: Column) -> Column:
    share = F.when(analyzed > 0, blocking / analyzed).otherwise(0.0)
    return F.when(share >= 0.40, "high").when(share >= 0.15, "medium").otherwise("low")


def queue_verdict(declared: Column, workers: Column, depth: Column, backlog: int = 100) -> Column:
    return (
        F.when(~declared & (depth > 0), "stranded")
        .when(~declared, "unwatched")
        .when((workers == 0) & (depth > 0), "no consumer")
        .when(workers == 0, "unwatched")
        .when(depth > backlog, "backlog")
        .when(depth > 0, "draining")
        .otherwise("idle")
    )


def human_age(seconds: Column) -> Column:
    """just now, minutes, hours up to two days, then days; 'never' for null."""
    whole = lambda unit: F.floor(seconds / unit).cast("string")
    return (
        F.when(seconds.isNull(), "never")
        .when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(whole(60), F.lit("m ago")))
        .when(seconds < 48 * 3600, F.concat(whole(3600), F.lit("h ago")))
        .otherwise(F.concat(whole(86400), F.lit("d ago")))
    )


def retry_delay(job_id: Column, attempts: Column, jitter: float = 0.2) -> Column:
    """Seconds before the next attempt: 10, 60, 300 (the last repeats) times 1 +- jitter, at least 1; the jitter is a hash of job and attempt."""
    base = F.element_at(F.array(*[F.lit(float(s)) for s in RETRY_SECONDS]), F.least(F.greatest(attempts, F.lit(1)), F.lit(len(RETRY_SECONDS))).cast("int"))
    unit = F.pmod(F.xxhash64(job_id, attempts), F.lit(1_000_003)) / 1_000_002
    return F.greatest(F.lit(1.0), base * (1 - jitter + 2 * jitter * unit))


def freshness(last: Column, interval_seconds: Column, failures: Column, now: Column) -> Column:
    """Age in seconds, staleness (never read, or older than the interval) and the state of the circuit."""
    age = now.cast("timestamp").cast("double") - last.cast("timestamp").cast("double")
    return F.struct(age.alias("age_seconds"), (age.isNull() | (age > interval_seconds)).alias("is_stale"), (failures >= FAILURE_LIMIT).alias("circuit_open"))

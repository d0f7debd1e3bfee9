"""Queries over the bindings, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions import classify, seniority, skills, text, urls, vectors
from matchloom.operators import catalog, embed, feed, insights, jobs, maintenance, ops, profiles, ranks, recall
from matchloom.plans import bindings as b
from matchloom.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from matchloom.plans.stored import feeds
from matchloom.sources import texts
from matchloom.streaming import flows

NOW = "TIMESTAMP '2001-06-01 00:00:00'"


def _now():
    return F.lit("2001-06-01 00:00:00").cast("timestamp")


def _millionths(score: str):
    """A score of six digits as a whole number: engines round halves of doubles differently."""
    return F.round(F.col(score) * 1e6).cast("long").alias("score_millionths")


# --- matching -------------------------------------------------------------------------


@query("recall_exact", b.with_(b.SQL_POSTINGS, b.SQL_PROFILES, b.SQL_RECALL) + "SELECT profile_id, posting_id, CAST(round(sim * 1e6) AS BIGINT) AS score_millionths, CAST(rank AS INTEGER) AS rank FROM recalled")
def recall_exact(spark: SparkSession, d: str) -> DataFrame:
    r = recall.recall(b.profiles(spark, d), b.postings(spark, d))
    return r.select("profile_id", "posting_id", _millionths("semantic_score"), "rank")


@query(
    "recall_filtered",
    b.with_(b.SQL_POSTINGS, b.SQL_PROFILES, b.SQL_RECALL.replace("IS NOT NULL)) WHERE", "IS NOT NULL AND q.remote_type = 'remote' AND q.seniority IN ('senior', 'staff') AND (q.min_years IS NULL OR q.min_years <= 5))) WHERE"))
    + "SELECT profile_id, posting_id, CAST(round(sim * 1e6) AS BIGINT) AS score_millionths FROM recalled",
)
def recall_filtered(spark: SparkSession, d: str) -> DataFrame:
    filters = recall.FeedFilters(remote_only=True, seniority=("senior", "staff"), max_min_years=5)
    r = recall.recall(b.profiles(spark, d), b.postings(spark, d), filters=filters)
    return r.select("profile_id", "posting_id", _millionths("semantic_score"))


@query("recall_cells", b.with_(b.SQL_POSTINGS, b.SQL_PROFILES, b.SQL_RECALL) + "SELECT count(*) AS exact_rows, true AS enough FROM recalled")
def recall_cells(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the approximate form against the exact one, 200 postings a profile: is it 0.9 or more?"""
    p, q = b.profiles(spark, d), b.postings(spark, d)
    return recall.recall_at_k(recall.recall(p, q), recall.recall_cells(p, q)).select("exact_rows", (F.col("recall") >= 0.9).alias("enough"))


@query(
    "skill_scores",
    b.with_(*b.FEED_PARTS[:7]) + "SELECT profile_id, posting_id, round(skill, 6) AS skill_score, matched, partial, missing, missing_required FROM scored",
)
def skill_scores(spark: SparkSession, d: str) -> DataFrame:
    pairs = recall.recall(b.profiles(spark, d), b.postings(spark, d)).drop("rank")
    s = feed.score_pairs(pairs, b.profiles_full(spark, d), b.postings_full(spark, d))
    return s.select("profile_id", "posting_id", F.round("skill_score", 6).alias("skill_score"), "breakdown.counts.matched", "breakdown.counts.partial", "breakdown.counts.missing", "breakdown.counts.missing_required")


def _feed(spark: SparkSession, d: str) -> DataFrame:
    """The stored feeds."""
    return feeds(spark, d).matches()


@query("feed_build", b.with_(*b.FEED_PARTS) + "SELECT profile_id, posting_id, CAST(round(sim * 1e6) AS BIGINT) AS score_millionths, round(skill, 4) AS skill_score, round(final, 4) AS final_score, CAST(feed_rank AS INTEGER) AS feed_rank FROM feed")
def feed_build(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: recall, score and rerank for all profiles in one job."""
    r = lambda c: F.round(c, 4).alias(c)
    made = feed.build_feed(b.profiles_full(spark, d), b.postings_full(spark, d), scored_at=_now())
    return made.select("profile_id", "posting_id", _millionths("semantic_score"), r("skill_score"), r("final_score"), "feed_rank")


@query(
    "feed_read",
    b.with_(*b.FEED_PARTS)
    + """SELECT profile_id, posting_id, CAST(position AS INTEGER) AS position, CASE WHEN final >= 0.7 THEN 'high' WHEN final >= 0.45 THEN 'mid' ELSE 'low' END AS band, seniority, min_years FROM (
  SELECT f.profile_id, f.posting_id, f.final, q.seniority, q.min_years, row_number() OVER (PARTITION BY f.profile_id ORDER BY f.final DESC, f.posting_id) AS position
  FROM feed f JOIN postings q USING (posting_id) JOIN profiles p USING (profile_id)
  WHERE p.user_id IN (0, 5) AND q.closed_at IS NULL AND q.remote_type = 'remote' AND (q.min_years IS NULL OR q.min_years <= 6)) WHERE position <= 25""",
)
def feed_read(spark: SparkSession, d: str) -> DataFrame:
    """Feed pages of two users' profiles with filters."""
    owned = b.profiles(spark, d).filter("user_id in (0, 5)").select("profile_id")
    filters = recall.FeedFilters(remote_only=True, max_min_years=6)
    return feed.read_feed(_feed(spark, d), b.postings(spark, d), owned, filters).select("profile_id", "posting_id", "position", "band", "seniority", "min_years")


_GAP_SQL = """, g AS (SELECT name, count(*) FILTER (bucket = 'missing') AS missing, count(*) FILTER (bucket = 'partial') AS partial, count(*) FILTER (bucket = 'matched') AS matched,
  count(*) FILTER (bucket = 'missing' AND necessity = 'required') AS blocking FROM verdicts WHERE name IS NOT NULL GROUP BY 1),
k AS (SELECT replace(name, ' ', '') AS key, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(partial) AS BIGINT) AS partial, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(blocking) AS BIGINT) AS blocking, min(name) AS skill FROM g GROUP BY 1)
"""


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the stored scored pairs."""
    return insights.verdict_rows(feeds(spark, d).scored())


@query("skill_gaps", b.with_(*b.FEED_PARTS[:6]) + _GAP_SQL + "SELECT skill, missing, partial, matched, blocking FROM k WHERE missing > 0 OR partial > 0 ORDER BY blocking DESC, missing DESC, partial DESC, skill LIMIT 12")
def skill_gaps(spark: SparkSession, d: str) -> DataFrame:
    return insights.skill_gaps(_verdicts(spark, d)).select("skill", "missing", "partial", "matched", "blocking")


@query(
    "skill_gap_severity",
    b.with_(*b.FEED_PARTS[:6])
    + _GAP_SQL
    + "SELECT skill, blocking, (SELECT count(*) FROM recalled) AS analyzed, CASE WHEN blocking / (SELECT count(*) FROM recalled) >= 0.4 THEN 'high' WHEN blocking / (SELECT count(*) FROM recalled) >= 0.15 THEN 'medium' ELSE 'low' END AS severity FROM k WHERE missing > 0 OR partial > 0",
)
def skill_gap_severity(spark: SparkSession, d: str) -> DataFrame:
    v = _verdicts(spark, d)
    total = F.lit(feeds(spark, d).scored().count()).cast("long").alias("analyzed")
    gaps = insights.fold_spellings(insights.gap_counts(v)).filter("missing > 0 or partial > 0").select("*", total)
    return insights.with_severity(gaps).select("skill", "blocking", "analyzed", "severity")


# --- feedback -------------------------------------------------------------------------


@query("feedback_latest", b.with_(b.SQL_FEEDBACK) + "SELECT match_id, id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) AS rn FROM feedback) WHERE rn = 1")
def feedback_latest(spark: SparkSession, d: str) -> DataFrame:
    return feed.latest_feedback(b.feedback(spark, d)).select("match_id", "id", "verdict")


@query("feedback_interested", b.with_(b.SQL_FEEDBACK) + "SELECT match_id, id, verdict FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) AS rn FROM feedback WHERE verdict = 'interested') WHERE rn = 1")
def feedback_interested(spark: SparkSession, d: str) -> DataFrame:
    return feed.latest_feedback(b.feedback(spark, d), "interested").select("match_id", "id", "verdict")


@query(
    "feedback_saved",
    b.with_(*b.FEED_PARTS, b.SQL_FEEDBACK)
    + """, m AS (SELECT CAST(row_number() OVER (ORDER BY profile_id, feed_rank) - 1 AS BIGINT) AS match_id, profile_id, posting_id FROM feed)
SELECT l.id, l.match_id, l.verdict, m.profile_id, m.posting_id FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY created_at DESC, id DESC) AS rn FROM feedback) WHERE rn = 1) l
JOIN m USING (match_id) JOIN profiles p USING (profile_id) JOIN postings q USING (posting_id) WHERE p.user_id = 0 ORDER BY l.created_at DESC, l.id DESC LIMIT 50""",
)
def feedback_saved(spark: SparkSession, d: str) -> DataFrame:
    """A user's tracker: feedback, matches, profiles and postings joined."""
    m = ranks.numbered(_feed(spark, d).select("profile_id", "feed_rank", "posting_id", "final_score"), [], ["profile_id", "feed_rank"], "match_id").withColumn("match_id", F.col("match_id") - 1)
    owned = b.profiles(spark, d).filter("user_id = 0").select("profile_id")
    return feed.saved_matches(b.feedback(spark, d), m, owned, b.postings(spark, d)).select("id", "match_id", "verdict", "profile_id", "posting_id")


@query(
    "feedback_funnel",
    b.with_(b.SQL_FEEDBACK)
    + """, s AS (SELECT *, lag(verdict) OVER (PARTITION BY match_id ORDER BY created_at, id) AS p FROM feedback)
SELECT match_id, count(*) FILTER (p <> verdict) AS changes, count(*) AS n_events, arg_max(verdict, (created_at, id)) = 'applied' AS applied, string_agg(verdict, '>' ORDER BY created_at, id) AS path FROM s GROUP BY 1""",
)
def feedback_funnel(spark: SparkSession, d: str) -> DataFrame:
    return feed.feedback_funnel(b.feedback(spark, d)).select("match_id", "changes", "n_events", "applied", F.array_join("path", ">").alias("path"))


@query("feed_currency", b.with_(*b.FEED_PARTS) + "SELECT profile_id, CASE WHEN EXISTS (SELECT 1 FROM feed f WHERE f.profile_id = p.profile_id) THEN 'already_current' ELSE 'queued' END AS state FROM profiles p")
def feed_currency(spark: SparkSession, d: str) -> DataFrame:
    return feed.feed_currency(b.profiles(spark, d), _feed(spark, d))


@query("match_totals", b.with_(*b.FEED_PARTS) + "SELECT p.user_id, count(f.posting_id) AS analyzed FROM profiles p LEFT JOIN feed f USING (profile_id) GROUP BY 1")
def match_totals(spark: SparkSession, d: str) -> DataFrame:
    return feed.match_totals(_feed(spark, d), b.profiles(spark, d).select("user_id", "profile_id"))


# --- jobs ------------------------------------------------------------------------------


@query("job_status_counts", b.with_(b.SQL_JOBS) + "SELECT status, count(*) AS n FROM jobs GROUP BY 1")
def job_status_counts(spark: SparkSession, d: str) -> DataFrame:
    return ops.status_counts(b.jobs(spark, d))


@query(
    "batch_progress",
    b.with_(b.SQL_JOBS)
    + "SELECT batch_id, CAST(count(*) FILTER (status = 'queued') AS BIGINT) AS queued, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status IN ('queued', 'running')) = 0 AS is_complete FROM jobs GROUP BY 1",
)
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    j = b.jobs(spark, d)
    p = jobs.batch_progress(j.select("batch_id").distinct(), j)
    n = lambda s: F.coalesce(F.element_at("counts", F.lit(s)), F.lit(0)).cast("long").alias(s)
    return p.select("batch_id", n("queued"), n("succeeded"), "is_complete")


@query("dead_letters", b.with_(b.SQL_JOBS) + "SELECT job_id, status, attempts FROM jobs WHERE status IN ('dead', 'failed') ORDER BY created_at DESC, job_id DESC LIMIT 200")
def dead_letters(spark: SparkSession, d: str) -> DataFrame:
    return jobs.dead_letters(b.jobs(spark, d), 200).select("job_id", "status", "attempts")


@query("job_listing", b.with_(b.SQL_JOBS) + "SELECT job_id, status FROM jobs WHERE status = 'running' ORDER BY created_at DESC, job_id DESC LIMIT 200")
def job_listing(spark: SparkSession, d: str) -> DataFrame:
    return jobs.listing(b.jobs(spark, d), status="running", limit=200).select("job_id", "status")


@query("job_failures", b.with_(b.SQL_JOBS) + "SELECT job_id, CASE WHEN status = 'running' THEN CASE WHEN job_id % 2 = 0 OR attempts > 3 THEN 'dead' ELSE 'failed' END ELSE status END AS status FROM jobs")
def job_failures(spark: SparkSession, d: str) -> DataFrame:
    """All running jobs fail, every second one for good."""
    j = b.jobs(spark, d).withColumn("last_error", F.lit(None).cast("string")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    bad = j.filter("status = 'running'").select("job_id", F.lit("timeout").alias("error"), (F.col("job_id") % 2 == 0).alias("permanent"))
    return jobs.fail(j, bad, _now()).select("job_id", "status")


@query("retry_delays", b.with_(b.SQL_JOBS) + "SELECT job_id, CASE WHEN attempts <= 1 THEN 10.0::DOUBLE WHEN attempts = 2 THEN 60.0 ELSE 300.0 END AS delay_s FROM jobs")
def retry_delays(spark: SparkSession, d: str) -> DataFrame:
    return b.jobs(spark, d).select("job_id", classify.retry_delay(F.col("job_id"), F.col("attempts"), jitter=0.0).alias("delay_s"))


@query("requeue", b.with_(b.SQL_JOBS) + "SELECT job_id, CASE WHEN status IN ('failed', 'dead') THEN 'queued' ELSE 'refused' END AS outcome FROM jobs")
def requeue(spark: SparkSession, d: str) -> DataFrame:
    j = b.jobs(spark, d).withColumn("last_error", F.lit(None).cast("string")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    good, refused = jobs.requeue(j, j.select("job_id"), _now())
    return good.select("job_id", F.lit("queued").alias("outcome")).unionByName(refused.select("job_id", F.lit("refused").alias("outcome")))


@query("not_in_flight", b.with_(b.SQL_JOBS) + ", k AS (SELECT DISTINCT dedupe_key FROM jobs) SELECT dedupe_key FROM k WHERE dedupe_key NOT IN (SELECT dedupe_key FROM jobs WHERE status IN ('queued', 'running'))")
def not_in_flight(spark: SparkSession, d: str) -> DataFrame:
    """Keys that may be queued again."""
    j = b.jobs(spark, d)
    return jobs.not_in_flight(j.select("kind", "dedupe_key"), j).select("dedupe_key")


@query("open_batches", b.with_(b.SQL_JOBS) + "SELECT batch_id % 10 AS user_id, count(DISTINCT batch_id) FILTER (open) AS open_batches, count(DISTINCT batch_id) FILTER (open) < 3 AS may_start FROM (SELECT batch_id, bool_or(status IN ('queued', 'running')) AS open FROM jobs GROUP BY 1) GROUP BY 1")
def open_batches(spark: SparkSession, d: str) -> DataFrame:
    j = b.jobs(spark, d)
    return jobs.admitted(j.select("batch_id", (F.col("batch_id") % 10).alias("user_id")).distinct(), j)


@query(
    "batch_lines",
    """WITH l AS (SELECT user_id AS batch_id, event_id AS line_no, 'https://e.example.com/' || event_type || '/' || json_extract_string(props, '$.k') AS url FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY batch_id, url ORDER BY line_no) = 1 AS first FROM l),
n AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY batch_id ORDER BY line_no) AS nth FROM f)
SELECT batch_id, count(*) FILTER (first AND nth <= 100) AS total_urls, count(*) FILTER (first AND nth > 100) AS rejected_urls, count(*) FILTER (NOT first) AS duplicate_urls FROM n GROUP BY 1""",
)
def batch_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as URL lines of their user's batch; the cap is 100 here."""
    e = b.table(spark, d, "events")
    url = F.concat(F.lit("https://E.example.com/"), "event_type", F.lit("/"), F.get_json_object("props", "$.k"), F.lit("/?utm_source=x#y"))
    return jobs.batch_counts(jobs.parse_url_lines(e.select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("line_no"), url.alias("line")), 100))


# --- sources and catalog -----------------------------------------------------------------


@query("due_sources", b.with_(b.SQL_SOURCES) + f"SELECT source_id, consecutive_failures FROM sources WHERE enabled AND consecutive_failures < 5 AND (last_crawled_at IS NULL OR last_crawled_at < {NOW} - to_seconds(crawl_interval_seconds))")
def due_sources(spark: SparkSession, d: str) -> DataFrame:
    return catalog.due_sources(b.sources(spark, d), _now()).select("source_id", "consecutive_failures")


@query(
    "source_health",
    b.with_(b.SQL_SOURCES, b.SQL_SOURCE_POSTINGS)
    + f"""SELECT s.source_id, coalesce(n, 0) AS open_postings, s.last_success_at IS NULL OR epoch({NOW}) - epoch(s.last_success_at) > s.crawl_interval_seconds AS is_stale, s.consecutive_failures >= 5 AS circuit_open
FROM sources s LEFT JOIN (SELECT source_id, count(*) AS n FROM source_postings WHERE closed_at IS NULL GROUP BY 1) c USING (source_id)""",
)
def source_health(spark: SparkSession, d: str) -> DataFrame:
    return ops.source_health(b.sources(spark, d), b.source_postings(spark, d), _now()).select("source_id", "open_postings", "is_stale", "circuit_open")


@query("company_backfill", b.with_(b.SQL_SOURCES, b.SQL_SOURCE_POSTINGS) + "SELECT p.posting_id, CASE WHEN p.source_id IS NOT NULL THEN s.display_name ELSE p.company END AS company FROM source_postings p LEFT JOIN sources s USING (source_id)")
def company_backfill(spark: SparkSession, d: str) -> DataFrame:
    fixed, _, _ = maintenance.backfill_company(b.source_postings(spark, d), b.sources(spark, d))
    return fixed.select("posting_id", "company")


@query(
    "company_transitions",
    b.with_(b.SQL_SOURCES, b.SQL_SOURCE_POSTINGS)
    + "SELECT coalesce(p.company, 'null') || ' -> ' || s.display_name AS change, count(*) AS n FROM source_postings p JOIN sources s USING (source_id) WHERE p.company IS DISTINCT FROM s.display_name GROUP BY 1 ORDER BY n DESC, change LIMIT 20",
)
def company_transitions(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.backfill_company(b.source_postings(spark, d), b.sources(spark, d))[2]


@query(
    "company_report",
    b.with_(b.SQL_SOURCES, b.SQL_SOURCE_POSTINGS)
    + """, r AS (SELECT p.posting_id, p.company, s.display_name FROM source_postings p JOIN sources s USING (source_id)),
c AS (SELECT posting_id, coalesce(company, 'null') || ' -> ' || display_name AS change FROM r WHERE company IS DISTINCT FROM display_name)
SELECT (SELECT count(*) FROM r) AS examined, (SELECT count(*) FROM c) AS to_correct, string_agg(posting_id || ' ' || change, '; ' ORDER BY posting_id) AS examples FROM (SELECT * FROM c ORDER BY posting_id LIMIT 15)""",
)
def company_report(spark: SparkSession, d: str) -> DataFrame:
    """Totals and examples of a dry run of the company backfill."""
    p, s = b.source_postings(spark, d), b.sources(spark, d)
    examined = p.join(s.select("source_id"), "source_id", "left_semi")
    _, changed, _ = maintenance.backfill_company(p, s)
    r = maintenance.backfill_report(examined, changed, "company", "employer")
    line = lambda x: F.concat(x["posting_id"].cast("string"), F.lit(" "), F.coalesce(x["before"], F.lit("null")), F.lit(" -> "), x["after"])
    return r.select("examined", "to_correct", F.array_join(F.transform("examples", line), "; ").alias("examples"))


@query("company_residue", b.with_(b.SQL_SOURCE_POSTINGS) + "SELECT source_id IS NOT NULL AS has_source, count(*) AS n FROM source_postings WHERE company IS NULL GROUP BY 1")
def company_residue(spark: SparkSession, d: str) -> DataFrame:
    return maintenance.residue(b.source_postings(spark, d))


@query("distinct_companies", b.with_(b.SQL_SOURCE_POSTINGS) + "SELECT count(DISTINCT company) AS companies, count(*) AS postings FROM source_postings")
def distinct_companies(spark: SparkSession, d: str) -> DataFrame:
    return ops.distinct_companies(b.source_postings(spark, d))


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Documents as a stored catalog, and as a later crawl of it: some gone, some changed."""
    docs = b.table(spark, d, "documents")
    key = F.concat(F.lit("doc:"), F.col("doc_id").cast("string"))
    old = docs.select(key.alias("canonical_key"), "doc_id", text.content_hash(F.col("text")).alias("content_hash"), F.col("text").alias("raw_text"), F.when(F.col("doc_id") % 3 != 0, F.lit(2)).alias("extraction_version"), F.lit(None).cast("timestamp").alias("source_updated_at"), F.lit(None).cast("timestamp").alias("closed_at"), F.col("source").alias("source_id"))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nan added line"))).otherwise(F.col("text"))
    new = docs.filter("doc_id % 7 <> 0").select(key.alias("canonical_key"), body.alias("content"), text.content_hash(body).alias("new_hash"), F.lit(None).cast("timestamp").alias("updated_at"), F.col("source").alias("source_id"))
    return old, new


# DuckDB's trim takes a set of characters; the bindings' texts hold blanks and line feeds only.
_SNAP = """WITH d AS (SELECT doc_id, source, text, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'an added line' ELSE text END AS body FROM documents),
h AS (SELECT *, sha256(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS old_hash,
  sha256(array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS new_hash FROM d),
a AS (SELECT *, CASE WHEN length(body) >= 200 THEN 'ingest' WHEN length(body) > 0 THEN 'too_short' ELSE 'fetch' END AS action,
  length(body) >= 200 AND old_hash = new_hash AND doc_id % 3 <> 0 AS gate_hit FROM h WHERE doc_id % 7 <> 0)
"""


@query("content_hashes", _SNAP + "SELECT doc_id, old_hash AS content_hash FROM h")
def content_hashes(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("crawl_actions", _SNAP + "SELECT 'doc:' || doc_id AS canonical_key, action, gate_hit FROM a")
def crawl_actions(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return catalog.crawl_actions(new, old).select("canonical_key", "action", "gate_hit")


@query(
    "crawl_summary",
    _SNAP
    + """SELECT source AS source_id, count(*) AS enumerated, count(*) FILTER (action = 'ingest') AS ingested, count(*) FILTER (action = 'too_short') AS too_short, count(*) FILTER (gate_hit) AS gate_hits,
  count(*) FILTER (action = 'ingest' AND NOT gate_hit) AS gate_misses FROM a GROUP BY 1""",
)
def crawl_summary(spark: SparkSession, d: str) -> DataFrame:
    old, new = _snapshots(spark, d)
    return catalog.crawl_summary(catalog.crawl_actions(new, old), "source_id").select("source_id", "enumerated", "ingested", "too_short", "gate_hits", "gate_misses")


@query("crawl_hit_rates", _SNAP + "SELECT source AS source_id, CAST(CASE WHEN count(*) FILTER (action = 'ingest') > 0 THEN round_even(count(*) FILTER (gate_hit) / count(*) FILTER (action = 'ingest'), 4) ELSE 0 END AS DOUBLE) AS hit_rate FROM a GROUP BY 1")
def crawl_hit_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often the gate spared an extraction, by source."""
    old, new = _snapshots(spark, d)
    return catalog.crawl_summary(catalog.crawl_actions(new, old), "source_id").select("source_id", "hit_rate")


@query("close_missing", "SELECT source AS source_id, count(*) FILTER (doc_id % 7 = 0 AND source <> 'src1') AS closed, count(*) AS postings FROM documents GROUP BY 1")
def close_missing(spark: SparkSession, d: str) -> DataFrame:
    """Postings a crawl no longer lists are closed; one source was not read to its end and keeps all of its."""
    old, new = _snapshots(spark, d)
    done = new.select("source_id").distinct().filter("source_id <> 'src1'")
    after = catalog.close_missing(old, new, done, _now())
    return after.groupBy("source_id").agg(F.count("closed_at").alias("closed"), F.count("*").alias("postings"))


@query("catalog_merge", _SNAP + "SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR action <> 'ingest' OR gate_hit THEN old_hash ELSE new_hash END AS content_hash, CASE WHEN doc_id % 3 <> 0 AND (doc_id % 7 = 0 OR action <> 'ingest' OR gate_hit) THEN 2 END AS extraction_version FROM (SELECT *, CASE WHEN length(body) >= 200 THEN 'ingest' ELSE 'other' END AS action, old_hash = new_hash AND doc_id % 3 <> 0 AS gate_hit FROM h)")
def catalog_merge(spark: SparkSession, d: str) -> DataFrame:
    """The catalog after a crawl, behind the content-hash gate."""
    old, new = _snapshots(spark, d)
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    cat = old.select("canonical_key", "doc_id", "content_hash", "raw_text", "extraction_version", "source_updated_at", "closed_at", "source_id", *none("string", "url", "title", "company", "seniority"), *none("timestamp", "first_seen_at", "last_seen_at"))
    acts = catalog.crawl_actions(new.select("*", *none("string", "url", "title")), cat)
    return catalog.merge_crawl(cat, acts, _now()).select("doc_id", "content_hash", "extraction_version")


@query(
    "pacing",
    """WITH f AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, url FROM pages)
SELECT page_id, greatest(0.0, (row_number() OVER (PARTITION BY host ORDER BY url, page_id) - 3) / 1.0) AS wait_s FROM f""",
)
def pacing(spark: SparkSession, d: str) -> DataFrame:
    f = b.table(spark, d, "pages").select("page_id", urls.domain_of(F.col("url")).alias("host"), F.struct("url", "page_id").alias("url"))
    return catalog.pace(f, _now()).select("page_id", "wait_s")


# --- functions ---------------------------------------------------------------------------


@query(
    "normalize_urls",
    """WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages),
q AS (SELECT page_id, lower(regexp_extract(u, '^(https?://[^/?]+)', 1)) AS origin, regexp_replace(regexp_extract(u, '^https?://[^/?]+([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT split_part(x, '=', 1) IN ('ref', 'utm_source', 'utm_medium', 'utm_campaign', 'source', 'gclid', 'fbclid'))) AS params FROM p),
n AS (SELECT page_id, origin || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS url FROM q)
SELECT page_id, url AS normalized, 'url:' || sha256(url) AS canonical_key, split_part(split_part(url, '://', 2), '/', 1) AS domain FROM n""".replace("split_part(split_part(url, '://', 2), '/', 1)", "regexp_extract(url, '^https?://([^/?]+)', 1)"),
)
def normalize_urls(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return b.table(spark, d, "pages").select("page_id", urls.normalize_url(u).alias("normalized"), urls.canonical_key_for_url(u).alias("canonical_key"), urls.domain_of(u).alias("domain"))


@query("hash_urls", "SELECT page_id, sha256(url) AS url_hash FROM pages")
def hash_urls(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "pages").select("page_id", urls.hash_url(F.col("url")).alias("url_hash"))


@query("page_texts")
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """Text of every page; pages without text are left out."""
    return texts.non_empty_pages(b.table(spark, d, "pages")).select("page_id", "url", "text")


@query("skill_keys", "SELECT p_partkey, replace(p_name, ' ', '') AS key, CASE WHEN p_name = 'small ring' THEN 'Ring S' ELSE p_name END AS skill FROM part")
def skill_keys(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return b.table(spark, d, "part").select("p_partkey", skills.canonical_key(n).alias("key"), skills.normalize_skill(n, {"small-ring": "Ring S"}, {"smallring": "Ring S"}).alias("skill"))


@query(
    "skill_lists",
    """WITH s AS (SELECT l_orderkey, p_name, min((l_linenumber, p_name)) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT l_orderkey, string_agg(p_name, '|' ORDER BY first) AS skills FROM s GROUP BY 1""",
)
def skill_lists(spark: SparkSession, d: str) -> DataFrame:
    """Skill list of every order, in line order, canonical and without repeats."""
    l, p = b.table(spark, d, "lineitem"), b.table(spark, d, "part")
    rows = l.join(p, l.l_partkey == p.p_partkey).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name"))).alias("s"))
    return rows.select("l_orderkey", F.array_join(skills.normalize_skills(F.transform("s", lambda x: x["p_name"])), "|").alias("skills"))


_TITLE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Principal ' WHEN '2-HIGH' THEN 'Sr. ' WHEN '3-MEDIUM' THEN '' WHEN '5-LOW' THEN 'Junior ' ELSE 'Chief of Staff, ' END || 'Engineer'"


@query("title_levels", "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'staff' WHEN '2-HIGH' THEN 'senior' WHEN '5-LOW' THEN 'junior' END AS level FROM orders")
def title_levels(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select("o_orderkey", F.expr(_TITLE).alias("title"))
    return o.select("o_orderkey", seniority.seniority_from_title(F.col("title")).alias("level"))


@query(
    "level_deltas",
    f"""WITH o AS (SELECT o.o_orderkey, {b.CASE_LEVEL} AS posting_level, CASE o.o_custkey % 4 WHEN 0 THEN 'junior' WHEN 1 THEN 'mid' WHEN 2 THEN 'senior' ELSE 'staff' END AS profile_level, o.o_custkey % 12 AS have, CASE WHEN o.o_orderkey % 3 <> 0 THEN o.o_orderkey % 9 END AS need FROM orders o),
r AS (SELECT *, list_position(['junior', 'mid', 'senior', 'staff'], profile_level) - list_position(['junior', 'mid', 'senior', 'staff'], posting_level) AS s FROM o)
SELECT o_orderkey, CAST(s AS INTEGER) AS steps, CASE WHEN s IS NULL THEN 'unknown' WHEN s = 0 THEN 'match' WHEN s < 0 THEN 'under' ELSE 'over' END AS direction, CAST(have - need AS DOUBLE) AS years_gap FROM r""",
)
def level_deltas(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders")
    mine = F.element_at(F.array(*[F.lit(x) for x in seniority.LADDER]), (F.col("o_custkey") % 4 + 1).cast("int"))
    delta = seniority.seniority_delta(mine, b._case("o_orderpriority", b.LEVELS, "unknown"), F.col("o_custkey") % 12, F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderkey") % 9))
    return o.select("o_orderkey", delta.alias("d")).select("o_orderkey", "d.steps", "d.direction", "d.years_gap")


@query(
    "seniority_backfill",
    f"SELECT o_orderkey AS posting_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'staff' WHEN '2-HIGH' THEN 'senior' WHEN '5-LOW' THEN 'junior' ELSE 'unknown' END AS seniority FROM orders /* {_TITLE} */",
)
def seniority_backfill(spark: SparkSession, d: str) -> DataFrame:
    o = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"), F.expr(_TITLE).alias("title"), F.lit("unknown").alias("seniority"))
    return maintenance.backfill_seniority(o)[0].select("posting_id", "seniority")


# --- operational rollups -------------------------------------------------------------------


@query(
    "latency_summary",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, round(avg(CASE WHEN rn = (n + 1) // 2 OR rn = n // 2 + 1 THEN value END), 6) AS p50, max(CASE WHEN rn = greatest(1, CAST(floor(n * 0.95) AS BIGINT)) THEN value END) AS p95, max(CASE WHEN rn = greatest(1, CAST(floor(n * 0.99) AS BIGINT)) THEN value END) AS p99 FROM r GROUP BY 1""",
)
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    s = ops.latency_summary(b.table(spark, d, "events"), "value", "event_type")
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("p50", 6).alias("p50"), "p95", "p99")


def _depths(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("t"), F.col("event_type").alias("queue")).agg(F.count("*").alias("depth"))


_DEPTHS = "WITH q AS (SELECT date_trunc('hour', ts) AS t, event_type AS queue, count(*) AS depth FROM events GROUP BY 1, 2)\n"


@query("depth_peaks", _DEPTHS + "SELECT queue, max(depth) AS peak, arg_max(depth, t) AS at_finish FROM q GROUP BY 1")
def depth_peaks(spark: SparkSession, d: str) -> DataFrame:
    return ops.depth_peaks(_depths(spark, d))


@query("depth_wide", _DEPTHS + "SELECT CAST(t AS VARCHAR) AS t, " + ", ".join(f"coalesce(max(depth) FILTER (queue = '{q}'), 0) AS {q}" for q in ("click", "view", "purchase", "signup", "error")) + " FROM q GROUP BY q.t")
def depth_wide(spark: SparkSession, d: str) -> DataFrame:
    w = ops.depth_wide(_depths(spark, d), ["click", "view", "purchase", "signup", "error"])
    return w.withColumn("t", F.date_format("t", "yyyy-MM-dd HH:mm:ss"))


@query("depth_recent", _DEPTHS + "SELECT queue, CAST(age AS INTEGER) AS age, depth, CASE WHEN p IS NULL THEN 0 ELSE depth - p END AS trend FROM (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY t DESC) AS age, CASE WHEN row_number() OVER (PARTITION BY queue ORDER BY t DESC) = 60 THEN NULL ELSE lag(depth) OVER (PARTITION BY queue ORDER BY t) END AS p FROM q) WHERE age <= 60")
def depth_recent(spark: SparkSession, d: str) -> DataFrame:
    return ops.recent_depths(_depths(spark, d)).select("queue", "age", "depth", "trend")


@query(
    "queue_overview",
    _DEPTHS
    + """, o AS (SELECT queue, CAST(sum(depth) AS BIGINT) AS depth FROM q GROUP BY 1), k AS (SELECT queue FROM (VALUES ('click'), ('view'), ('scoring')) v(queue)),
n AS (SELECT queue FROM o UNION SELECT queue FROM k), x AS (SELECT n.queue, k.queue IS NOT NULL AS declared, coalesce(o.depth, 0) AS depth, CASE WHEN n.queue = 'click' THEN 2 WHEN n.queue = 'scoring' THEN 1 ELSE 0 END AS workers FROM n LEFT JOIN k USING (queue) LEFT JOIN o USING (queue))
SELECT queue, declared, depth, CAST(workers AS BIGINT) AS workers, CASE WHEN NOT declared AND depth > 0 THEN 'stranded' WHEN NOT declared THEN 'unwatched' WHEN workers = 0 AND depth > 0 THEN 'no consumer' WHEN workers = 0 THEN 'unwatched' WHEN depth > 100 THEN 'backlog' WHEN depth > 0 THEN 'draining' ELSE 'idle' END AS verdict FROM x""",
)
def queue_overview(spark: SparkSession, d: str) -> DataFrame:
    declared = spark.sql("SELECT * FROM VALUES ('click'), ('view'), ('scoring') AS v(queue)")
    workers = spark.sql("SELECT * FROM VALUES ('w1', array('click')), ('w2', array('click', 'scoring')) AS v(worker, queues)")
    return ops.queue_overview(declared, _depths(spark, d).select("queue", "depth"), workers)


# --- profiles ---------------------------------------------------------------------------


def _profile_table(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("profile_id"), F.col("c_nationkey").cast("long").alias("user_id"), (F.col("c_acctbal") > 9000).alias("is_active"), F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("created_at"))


@query("promote_survivors", "WITH s AS (SELECT c_custkey, c_nationkey, c_acctbal > 9000 AS a, max(c_custkey) OVER (PARTITION BY c_nationkey) AS newest, bool_or(c_acctbal > 9000) OVER (PARTITION BY c_nationkey) AS any_a FROM customer WHERE c_mktsegment <> 'BUILDING') SELECT c_custkey AS profile_id, a OR (NOT any_a AND c_custkey = newest) AS is_active FROM s")
def promote_survivors(spark: SparkSession, d: str) -> DataFrame:
    gone = b.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("profile_id"))
    return profiles.delete_profiles({"profiles": _profile_table(spark, d)}, gone)["profiles"].select("profile_id", "is_active")


@query("activate_profiles", "SELECT c_custkey AS profile_id, c_custkey = max(c_custkey) OVER (PARTITION BY c_nationkey) AS is_active FROM customer")
def activate_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = _profile_table(spark, d)
    return profiles.activate(p, p.groupBy("user_id").agg(F.max("profile_id").alias("profile_id"))).select("profile_id", "is_active")


@query("cascade_delete", b.with_(b.SQL_FEEDBACK) + "SELECT f.id FROM feedback f JOIN orders o ON o.o_orderkey = f.match_id JOIN customer c ON c.c_custkey = o.o_custkey WHERE c.c_mktsegment <> 'BUILDING'")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Feedback left after profiles, with their matches (orders), are deleted."""
    m = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("profile_id"))
    fb = b.feedback(spark, d).join(m.select("match_id"), "match_id", "left_semi")
    gone = b.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("profile_id"))
    return profiles.delete_profiles({"profiles": _profile_table(spark, d), "matches": m, "match_feedback": fb}, gone)["match_feedback"].select("id")


# --- embedding -----------------------------------------------------------------------------


@query("embed_documents")
def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Chunked, encoded and pooled documents: number of chunks and norm of the vector."""
    e = embed.embed(b.table(spark, d, "documents"), "doc_id", "text")
    return e.select("doc_id", "n_chunks", F.round(vectors.norm(F.col("embedding")), 3).alias("norm"))


@query("pooled_vectors", "WITH s AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), m AS (SELECT label, d, avg(x) AS m FROM s GROUP BY 1, 2) SELECT label, round(sqrt(sum(m * m)), 3) AS mean_norm, count(*) AS dims FROM m GROUP BY 1")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Norm of each label's mean vector, recovered from its pooled unit vector."""
    e = b.table(spark, d, "embeddings").select("label", F.col("vec_id").alias("chunk_no"), "embedding")
    unit = embed.pool_vectors(e, "label")
    mean = e.join(unit.withColumnRenamed("embedding", "u"), "label").groupBy("label").agg(F.avg(vectors.dot(F.col("embedding"), F.col("u"))).alias("m"), F.max(F.size("u")).cast("long").alias("dims"))
    return mean.select("label", F.round("m", 3).alias("mean_norm"), "dims")


# --- streams -------------------------------------------------------------------------------


# Events in six batches of event time; every twentieth comes one batch late and as many come four batches late.
_SLOT = "CAST(floor((epoch(ts) - (SELECT epoch(min(ts)) FROM events)) / ((SELECT epoch(max(ts)) - epoch(min(ts)) FROM events) / 6 + 1)) AS INTEGER)"
_LATE = f"""WITH a AS (SELECT *, {_SLOT} + CASE event_id % 20 WHEN 3 THEN 1 WHEN 7 THEN 4 ELSE 0 END AS batch FROM events),
w AS (SELECT b.batch, coalesce(epoch(max(a.ts)) - 600, 0) AS mark FROM (SELECT DISTINCT batch FROM a) b LEFT JOIN a ON a.batch < b.batch - 1 GROUP BY 1),
kept AS (SELECT a.* FROM a JOIN w USING (batch) WHERE epoch(date_trunc('hour', ts)) + 3600 > mark)
"""


def _late_events(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    ends = e.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("z")).first()
    slot = F.floor((F.col("ts").cast("double") - ends["a"]) / ((ends["z"] - ends["a"]) / 6 + 1))
    late = F.when(F.col("event_id") % 20 == 3, 1).when(F.col("event_id") % 20 == 7, 4).otherwise(0)
    return flows.in_batches(e.withColumn("batch", (slot + late).cast("int")), "batch")


@query("stream_status_counters", _LATE + "SELECT event_type AS status, date_trunc('hour', ts) AS window_start, count(*) AS n FROM kept GROUP BY 1, 2")
def stream_status_counters(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counters over events that come in batches, some too late: those whose hour the watermark has closed are dropped."""
    out = flows.drain(flows.status_counters(_late_events(spark, d), "ts", "event_type"), "update")
    return out.groupBy(F.col("event_type").alias("status"), F.col("window_start").cast("timestamp_ntz").alias("window_start")).agg(F.max("n").alias("n"))


@query(
    "stream_dedupe",
    f"""WITH x AS (SELECT min(epoch(ts)) AS a, (max(epoch(ts)) - min(epoch(ts))) / 6 + 1 AS width FROM events),
e AS (SELECT event_id, epoch(ts) AS t, {_SLOT} AS batch FROM events),
r AS (SELECT event_id, t, batch, false AS again FROM e UNION ALL SELECT event_id, t + 2 * width, batch + 2, true FROM e, x WHERE event_id % 10 = 3 AND batch + 2 <= 5),
m AS (SELECT b.batch, coalesce((SELECT max(t) FROM r WHERE r.batch < b.batch) - 3600, 0) AS mark FROM (SELECT DISTINCT batch FROM e) b)
SELECT event_id % 10 AS kind, count(*) AS n FROM r LEFT JOIN m ON m.batch = r.batch - 1 WHERE NOT again OR t - 2 * (SELECT width FROM x) + 3600 <= mark GROUP BY 1""",
)
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Work delivered again: at once, in the next batch, or so much later that its state is gone and it passes once more."""
    e = b.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    ends = e.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("z")).first()
    width = (ends["z"] - ends["a"]) / 6 + 1
    first = e.withColumn("batch", F.floor((F.col("ts").cast("double") - ends["a"]) / width).cast("int"))
    kind = F.col("event_id") % 10
    later = first.filter(kind == 3).select("event_id", (F.col("ts").cast("double") + 2 * width).cast("timestamp").alias("ts"), (F.col("batch") + 2).alias("batch")).filter("batch <= 5")
    rows = first.unionByName(first.filter(kind == 1)).unionByName(first.filter(kind == 2).withColumn("batch", F.col("batch") + 1)).unionByName(later)
    out = flows.drain(flows.once(flows.in_batches(rows, "batch"), "ts", ["event_id"]))
    return out.groupBy((F.col("event_id") % 10).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "stream_pacing",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t AS since, 3.0::DOUBLE AS tokens, 0.0::DOUBLE AS wait, false AS over_limit, 2.0::DOUBLE AS left_ FROM e WHERE n = 1
  UNION ALL SELECT user_id, event_id, n, since, tokens, wait, wait > 3600, CASE WHEN wait > 3600 THEN tokens ELSE tokens - 1 END FROM (
    SELECT *, CASE WHEN tokens >= 1 THEN 0.0 ELSE (1 - tokens) / (2.0::DOUBLE / 86400) END AS wait FROM (
      SELECT e.user_id, e.event_id, e.n, greatest(r.since, e.t) AS since, least(3.0, r.left_ + greatest(0.0, e.t - r.since) * (2.0::DOUBLE / 86400)) AS tokens FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)))
SELECT CAST(user_id AS VARCHAR) AS host, event_id AS request_id, CAST(round(wait, 1) AS DOUBLE) AS wait_s, over_limit FROM r""",
)
def stream_pacing(spark: SparkSession, d: str) -> DataFrame:
    """Waits of the events' users under a token bucket of two requests a day; the events come in four batches, and a last one moves the watermark past them."""
    e = b.table(spark, d, "events").select(F.col("user_id").cast("string").alias("host"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"))
    last = e.agg(F.lit("-").alias("host"), F.lit(-1).cast("long").alias("request_id"), (F.max("ts") + F.expr("interval 3000 days")).alias("ts"))
    batch = F.ntile(4).over(Window.orderBy("day"))
    days = e.select(F.to_date("ts").alias("day")).distinct().select("day", batch.alias("batch"))  # a row per day
    rows = e.withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day").drop("day").unionByName(last.withColumn("batch", F.lit(5)))
    s = flows.in_batches(rows, "batch")
    with flows.rocksdb(spark):
        out = flows.drain(flows.pace_requests(s, rate=2 / 86400, burst=3, most_wait=3600.0, late="1 day", slot_s=86400, idle_s=30 * 86400))
    return out.filter("host <> '-'").select("host", "request_id", F.round("wait_s", 1).alias("wait_s"), "over_limit")


@query(
    "stream_job_states",
    """WITH e AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'started' WHEN event_type = 'purchase' AND value > 95 THEN 'succeeded' ELSE 'failed' END AS event FROM events),
d AS (SELECT job_id, min(seq) AS fin FROM e WHERE event = 'succeeded' GROUP BY 1), l AS (SELECT e.* FROM e LEFT JOIN d USING (job_id) WHERE fin IS NULL OR seq <= fin)
SELECT job_id, CAST(count(*) FILTER (event = 'started') AS INTEGER) AS attempts, CASE arg_max(event, seq) WHEN 'succeeded' THEN 'succeeded' WHEN 'started' THEN 'running' ELSE CASE WHEN count(*) FILTER (event = 'started') > 3 THEN 'dead' ELSE 'failed' END END AS status FROM l GROUP BY 1""",
)
def stream_job_states(spark: SparkSession, d: str) -> DataFrame:
    """Lifecycle of jobs (users) folded from a stream of attempts (events)."""
    event = F.when(F.col("event_type").isin("click", "view", "signup"), "started").when((F.col("event_type") == "purchase") & (F.col("value") > 95), "succeeded").otherwise("failed")
    s = flows.replay(spark, f"{d}/events.parquet").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), event.alias("event"), F.lit("timeout").alias("error"), F.lit(False).alias("permanent"))
    with flows.rocksdb(spark):
        out = flows.drain(flows.job_states(s), "update")
    last = out.groupBy("job_id").agg(F.max_by(F.struct("attempts", "status"), F.struct("attempts", (F.col("status") != "running").cast("int"))).alias("l"))
    return last.select("job_id", "l.attempts", "l.status")


@query(
    "job_lifecycle",
    ORACLE_SQL["stream_job_states"],
)
def job_lifecycle(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the same fold."""
    event = F.when(F.col("event_type").isin("click", "view", "signup"), "started").when((F.col("event_type") == "purchase") & (F.col("value") > 95), "succeeded").otherwise("failed")
    e = b.table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), event.alias("event"), "ts", F.lit("timeout").alias("error"), F.lit(False).alias("permanent"), F.lit(None).cast("long").alias("posting_id"))
    return jobs.fold_lifecycle(e).select("job_id", "attempts", "status")


@query("stream_depths", _LATE + "SELECT event_type AS queue, date_trunc('hour', ts) AS window_start, CAST(floor(max(value)) AS BIGINT) AS peak, CAST(floor(arg_max(value, (ts, event_id))) AS BIGINT) AS last FROM kept WHERE value IS NOT NULL GROUP BY 1, 2")
def stream_depths(spark: SparkSession, d: str) -> DataFrame:
    """Peak and last depth of the windows that the watermark has closed or not, late samples dropped; the latest state of each window counts."""
    s = _late_events(spark, d).filter("value is not null").select("ts", F.col("event_type").alias("queue"), F.floor("value").alias("depth"), F.struct("ts", "event_id").alias("sampled"))
    out = flows.drain(flows.depth_series(s, "ts", "queue", "depth", order="sampled"), "update")
    last = out.groupBy("queue", "window_start").agg(F.max("peak").alias("peak"), F.max_by("last", "last_at").alias("last"))
    return last.select("queue", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "peak", "last")


@query(
    "stream_sessions",
    b.with_(b.SQL_FEEDBACK)
    + """, g AS (SELECT *, CASE WHEN created_at - lag(created_at) OVER (PARTITION BY match_id ORDER BY created_at) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM feedback),
s AS (SELECT *, sum(new) OVER (PARTITION BY match_id ORDER BY created_at ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT match_id, count(DISTINCT sid) AS sessions, count(*) AS n_events FROM s GROUP BY 1""",
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions over six batches, each given out once the watermark has passed it; a last event of another match moves it past all."""
    e = b.table(spark, d, "events").filter(F.col("event_type").isin(*b.VERDICT))
    e = e.select(F.col("user_id").alias("match_id"), F.col("ts").cast("timestamp").alias("ts"), b._case("event_type", b.VERDICT, None).alias("verdict"))
    ends = e.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("z")).first()
    rows = e.withColumn("batch", F.floor((F.col("ts").cast("double") - ends["a"]) / ((ends["z"] - ends["a"]) / 6 + 1)).cast("int"))
    last = e.agg(F.lit(-1).cast("long").alias("match_id"), (F.max("ts") + F.expr("interval 3 days")).alias("ts"), F.lit("applied").alias("verdict"), F.lit(6).alias("batch"))
    out = flows.drain(flows.feedback_sessions(flows.in_batches(rows.unionByName(last), "batch"), "match_id", "ts", "verdict"))
    return out.filter("match_id >= 0").groupBy("match_id").agg(F.count("*").alias("sessions"), F.sum("n_events").alias("n_events"))


# --- functions ------------------------------------------------------------------------


@query(
    "age_labels",
    """WITH a AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE date_diff('second', ts, TIMESTAMP '2030-01-01 00:00:00') % (20 * (event_id % 5000) + 1) END AS s FROM events)
    SELECT event_id, CASE WHEN s IS NULL THEN 'never' WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 172800 THEN (s // 3600) || 'h ago' ELSE (s // 86400) || 'd ago' END AS age FROM a""",
)
def age_labels(spark: SparkSession, d: str) -> DataFrame:
    """Ages of events as a reader sees them; the modulus spreads them over all units."""
    ev = b.table(spark, d, "events")
    seconds = F.lit("2030-01-01 00:00:00").cast("timestamp").cast("long") - F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000)
    spread = F.when(F.col("event_id") % 9 != 0, seconds % (F.col("event_id") % 5000 * 20 + 1))
    return ev.select("event_id", classify.human_age(spread).alias("age"))


@query(
    "fetch_outcomes",
    """WITH f AS (SELECT event_id, [200, 301, 404, 429, 503, 500, NULL][1 + event_id % 7] AS status, ['text/html; charset=utf-8', 'application/pdf', 'Application/JSON', NULL, 'image/png'][1 + event_id % 5] AS kind,
      CASE WHEN event_id % 11 = 0 THEN 5000001 ELSE 1000 END AS n, CASE WHEN event_id % 7 = 6 AND event_id % 2 = 0 THEN 'timed out' END AS error FROM events)
    SELECT event_id, CASE WHEN status IN (429, 500, 503) THEN 'transient' WHEN status >= 400 THEN 'permanent' WHEN status IS NULL AND error IS NOT NULL THEN 'transient'
      WHEN n > 5000000 OR kind IN ('application/pdf', 'image/png') THEN 'permanent' ELSE 'ok' END AS outcome FROM f""",
)
def fetch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcome of one response per event."""
    i = F.col("event_id")
    pick = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), (i % len(values) + 1).cast("int"))
    status = pick((200, 301, 404, 429, 503, 500, None), "int")
    kind = pick(("text/html; charset=utf-8", "application/pdf", "Application/JSON", None, "image/png"), "string")
    size, error = F.when(i % 11 == 0, 5_000_001).otherwise(1000), F.when((i % 7 == 6) & (i % 2 == 0), "timed out")
    return b.table(spark, d, "events").select("event_id", classify.fetch_outcome(status, kind, size, error).alias("outcome"))


@query(
    "iso_times",
    """SELECT o_orderkey, CAST(epoch(CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate - INTERVAL 150 MINUTE WHEN 2 THEN o_orderdate END) AS BIGINT) AS unix_seconds FROM orders""",
)
def iso_times(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in four ways and read again: Z, an offset, no zone, and no date at all."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("o_orderkey") % 4
    written = F.when(k == 0, F.concat(day, F.lit("Z"))).when(k == 1, F.concat(day, F.lit("+0230"))).when(k == 2, F.translate(day, "T", " ")).otherwise("soon")
    return b.table(spark, d, "orders").select("o_orderkey", F.unix_seconds(text.iso_timestamp(written)).alias("unix_seconds"))


@query(
    "truncated_texts",
    """SELECT doc_id, length(substr(text, 1, 2000)) AS n_chars, sha256(substr(text, 1, 2000)) AS text_sha256, length(text) > 2000 AS truncated FROM documents""",
)
def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts cut at 2,000 characters."""
    cut = b.table(spark, d, "documents").select("doc_id", text.truncate(F.col("text"), 2000).alias("t"))
    return cut.select("doc_id", F.length("t.text").cast("long").alias("n_chars"), F.sha2("t.text", 256).alias("text_sha256"), "t.truncated")


@query(
    "unit_vectors",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (1 + vec_id % 3)) AS v FROM embeddings), n AS (SELECT *, sqrt(list_inner_product(v, v)) AS len FROM e),
    u AS (SELECT vec_id, list_transform(v, lambda x: CAST(CAST(x / len AS FLOAT) AS DOUBLE)) AS u FROM n)
    SELECT a.vec_id, CAST(round(a.u[1] * 1e5) AS BIGINT) AS first_e5, CAST(round(list_inner_product(a.u, c.u) * 1e5) AS BIGINT) AS cosine_e5
    FROM u a JOIN u c ON c.vec_id = a.vec_id + 1""",
)
def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Scaled vectors brought back to length one, stored as floats, and the cosine of each with the next."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 3 + 1))
    v = b.table(spark, d, "embeddings").select("vec_id", vectors.l2_normalize(scaled).cast("array<float>").alias("v"))
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")).hint("merge")
    e5 = lambda x: F.round(x * 1e5).cast("long")
    return v.join(following, "vec_id").select("vec_id", e5(F.col("v")[0].cast("double")).alias("first_e5"), e5(vectors.cosine_of_units(F.col("v"), F.col("w"))).alias("cosine_e5"))


@query(
    "dedupe_keys",
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'profile:' || o_custkey || ':' || sha256('https://example.com/' || o_orderkey) WHEN 1 THEN 'posting:' || o_orderpriority ELSE 'discover:' || o_custkey END AS dedupe_key FROM orders""",
)
def dedupe_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys under which equal work is submitted once."""
    k, url = F.col("o_orderkey") % 3, F.concat(F.lit("https://example.com/"), F.col("o_orderkey").cast("string"))
    key = F.when(k == 0, urls.dedupe_key("profile", F.col("o_custkey"), urls.hash_url(url))).when(k == 1, urls.dedupe_key("posting", F.col("o_orderpriority"))).otherwise(urls.dedupe_key("discover", F.col("o_custkey")))
    return b.table(spark, d, "orders").select("o_orderkey", key.alias("dedupe_key"))


from matchloom.plans import boards, ingest, upkeep  # noqa: E402, F401  (they register their queries)

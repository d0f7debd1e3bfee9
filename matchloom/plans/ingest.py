"""Queries over the catalog, jobs, profiles and their maintenance, with the DuckDB SQL of their rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.functions import registry, skills, text, urls
from matchloom.operators import buckets, catalog, feed, jobs, maintenance, ops, profiles, recall, store
from matchloom.operators.shared import written
from matchloom.plans import bindings as b
from matchloom.plans.registry import query
from matchloom.sources import texts
from matchloom.streaming import flows

NOW = "TIMESTAMP '2001-06-01 00:00:00'"


def _at(when: str):
    return F.lit(when).cast("timestamp")


def _null(kind: str, *names: str) -> list:
    return [F.lit(None).cast(kind).alias(n) for n in names]


# --- catalog ----------------------------------------------------------------------------

_URL = "'https://c.example.com/' || doc_id"
_HASH = "sha256(array_to_string(list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10)))"
_DOCS = f"""WITH d AS (SELECT doc_id, 'url:' || sha256({_URL}) AS canonical_key, text, CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'an added line' ELSE text END AS body, doc_id % 2 = 0 AS old, doc_id % 3 <> 0 AS new FROM documents),
h AS (SELECT *, {_HASH.format("text")} AS old_hash, {_HASH.format("body")} AS new_hash FROM d)
"""


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    """Every second document as a posting of the catalog, every fourth closed."""
    docs = b.table(spark, d, "documents").filter("doc_id % 2 = 0")
    url = F.concat(F.lit("https://c.example.com/"), F.col("doc_id").cast("string"))
    return docs.select(
        urls.canonical_key_for_url(url).alias("canonical_key"), url.alias("url"), text.content_hash(F.col("text")).alias("content_hash"), F.col("text").alias("raw_text"), F.lit(2).alias("extraction_version"),
        *_null("long", "source_id"), _at("2000-01-01").alias("source_updated_at"), F.lit("Old title").alias("title"), F.lit("Old").alias("company"), F.lit("mid").alias("seniority"),
        _at("2000-01-01").alias("first_seen_at"), _at("2000-01-01").alias("last_seen_at"), F.when(F.col("doc_id") % 4 == 0, _at("2000-02-01")).alias("closed_at"),
    )


def _body():
    return F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nan added line"))).otherwise(F.col("text"))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the documents as a later crawl lists them: some under a tracked address, some changed."""
    i = F.col("doc_id")
    url = F.concat(F.lit("https://c.example.com/"), i.cast("string"), F.when(i % 7 == 0, "?utm_source=feed").otherwise(""))
    title = F.when(i % 4 == 0, "").when(i % 8 == 2, "Junior Developer").when(i % 4 == 1, "Senior Engineer").otherwise("Engineer")
    return b.table(spark, d, "documents").filter("doc_id % 3 <> 0").select("doc_id", url.alias("url"), _body().alias("raw_text"), title.alias("title"), F.when(i % 2 == 1, "New").otherwise("").alias("company"))


@query(
    "catalog_fetched",
    _DOCS
    + """SELECT canonical_key, CASE WHEN new THEN new_hash ELSE old_hash END AS content_hash, CAST(CASE WHEN old AND (NOT new OR new_hash = old_hash) THEN 2 END AS INTEGER) AS extraction_version,
  CASE WHEN NOT new OR doc_id % 4 = 0 THEN 'Old title' WHEN doc_id % 8 = 2 THEN 'Junior Developer' WHEN doc_id % 4 = 1 THEN 'Senior Engineer' ELSE 'Engineer' END AS title, CASE WHEN old THEN 'Old' ELSE 'New' END AS company,
  CASE WHEN new AND doc_id % 8 = 2 THEN 'junior' WHEN old THEN 'mid' WHEN doc_id % 4 = 1 THEN 'senior' END AS seniority,
  old AS seen_before, new AS seen_now, NOT new AND doc_id % 4 = 0 AS closed FROM h WHERE old OR new""",
)
def catalog_fetched(spark: SparkSession, d: str) -> DataFrame:
    """The catalog after pages were fetched one by one: changed texts lose their extraction, seen postings reopen."""
    after = catalog.merge_fetched(_catalog(spark, d), _listed(spark, d), _at("2001-06-01"))
    early = _at("2000-06-01")
    return after.select("canonical_key", "content_hash", "extraction_version", "title", "company", "seniority", (F.col("first_seen_at") < early).alias("seen_before"), (F.col("last_seen_at") > early).alias("seen_now"), F.col("closed_at").isNotNull().alias("closed"))


def _dated(spark: SparkSession, d: str) -> DataFrame:
    """Listings with a date and without content."""
    i = F.col("doc_id")
    url = F.concat(F.lit("https://c.example.com/"), i.cast("string"))
    dated = F.when(i % 5 == 0, _at("2001-01-01")).when(i % 11 != 0, _at("1999-01-01"))
    return b.table(spark, d, "documents").filter("doc_id % 3 <> 0").select(urls.canonical_key_for_url(url).alias("canonical_key"), url.alias("url"), *_null("string", "content", "new_hash", "title"), dated.alias("updated_at"), *_null("long", "source_id"))


_DATED = _DOCS + ", t AS (SELECT *, CASE WHEN old AND length(text) > 0 AND doc_id % 5 <> 0 AND doc_id % 11 <> 0 THEN 'skip' ELSE 'fetch' END AS action FROM h WHERE new)\n"


@query("crawl_dated", _DATED + "SELECT canonical_key, action, old AS known FROM t")
def crawl_dated(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl does with listings that state a date only."""
    return catalog.crawl_actions(_dated(spark, d), _catalog(spark, d)).select("canonical_key", "action", "known")


@query(
    "catalog_touch",
    _DOCS + "SELECT canonical_key, old_hash AS content_hash, new AS seen_now, NOT new AND doc_id % 4 = 0 AS closed, CAST(year(CASE WHEN NOT new THEN DATE '2000-01-01' WHEN doc_id % 5 = 0 THEN DATE '2001-01-01' WHEN doc_id % 11 <> 0 THEN DATE '1999-01-01' ELSE DATE '2000-01-01' END) AS INTEGER) AS dated FROM h WHERE old",
)
def catalog_touch(spark: SparkSession, d: str) -> DataFrame:
    """Heartbeat of the postings such a crawl has seen: times move, texts stay, unknown ones are not added."""
    c = _catalog(spark, d)
    after = catalog.merge_crawl(c, catalog.crawl_actions(_dated(spark, d), c), _at("2001-06-01"))
    return after.select("canonical_key", "content_hash", (F.col("last_seen_at") > _at("2000-06-01")).alias("seen_now"), F.col("closed_at").isNotNull().alias("closed"), F.year("source_updated_at").alias("dated"))


@query(
    "extraction_merge",
    """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 3 <> 0 AS hit, CASE WHEN o_orderkey % 2 = 0 THEN 'Senior Engineer' ELSE 'Engineer' END AS title, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS company FROM orders)
SELECT k AS posting_id, CASE WHEN hit AND k % 4 <> 0 THEN 'Analyst' ELSE title END AS title, CASE WHEN NOT hit OR (k % 11 <> 0 AND company IS NOT NULL) OR k % 7 = 0 THEN company ELSE 'Extracted' END AS company, CASE WHEN hit THEN 'Here' END AS location, 'onsite' AS remote_type,
  CASE WHEN NOT hit THEN 'mid' WHEN k % 2 = 0 THEN 'senior' ELSE 'junior' END AS seniority, CAST(CASE WHEN hit AND k % 2 = 1 THEN k % 9 ELSE k % 5 END AS DOUBLE) AS min_years, CAST(CASE WHEN hit THEN 2 END AS INTEGER) AS extraction_version FROM o""",
)
def extraction_merge(spark: SparkSession, d: str) -> DataFrame:
    """Postings after extraction: values of the board and stated levels first, then extracted ones, then old ones."""
    k = F.col("o_orderkey")
    p = b.table(spark, d, "orders").select(
        k.alias("posting_id"), F.when(k % 11 != 0, F.col("o_custkey")).alias("source_id"), F.when(k % 2 == 0, "Senior Engineer").otherwise("Engineer").alias("title"), F.when(k % 5 != 0, F.col("o_orderpriority")).alias("company"),
        *_null("string", "location"), F.lit("onsite").alias("remote_type"), F.lit("mid").alias("seniority"), (k % 5).cast("decimal(4,1)").alias("min_years"), *_null("int", "extraction_version"),
    )
    i = F.col("posting_id")
    x = F.struct(
        F.when(i % 4 != 0, "Analyst").otherwise("").alias("title"), F.when(i % 7 != 0, "Extracted").otherwise("").alias("company"), F.lit("Here").alias("location"), *_null("string", "remote_type"),
        F.lit("junior").alias("seniority"), F.when(i % 2 == 1, (i % 9).cast("double")).alias("min_years_experience"),
    )
    merged = catalog.merge_extraction(p, p.filter("posting_id % 3 <> 0").select("posting_id", x.alias("extracted")))
    return merged.withColumn("min_years", F.col("min_years").cast("double")).drop("source_id")


@query(
    "crawl_completeness",
    """WITH p AS (SELECT o_custkey AS source_id, o_orderkey AS page_no, CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 100 ELSE 250 END AS n_items, CASE WHEN o_orderkey % 5 <> 0 THEN 1800 END AS total_found, o_orderkey % 29 = 0 AS corrupt FROM orders),
g AS (SELECT source_id, bool_or(corrupt) AS corrupt, arg_max(n_items, page_no) AS last_n, max_by({'t': total_found}, page_no).t AS last_total, sum(n_items) AS n FROM p GROUP BY 1)
SELECT source_id, NOT corrupt AND CASE source_id % 3 WHEN 0 THEN last_n = 0 OR n >= coalesce(last_total, 0) WHEN 1 THEN last_n < 250 ELSE true END AS complete FROM g""",
)
def crawl_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Which customers, as sources, were read to the end: their orders as pages of three kinds of boards."""
    k, kinds = F.col("o_orderkey"), ("smartrecruiters", "usajobs", "greenhouse")
    kind = F.element_at(F.array(*[F.lit(x) for x in kinds]), (F.col("o_custkey") % 3 + 1).cast("int"))
    n = F.when(k % 4 == 0, 0).when(k % 4 == 1, 100).otherwise(250)
    pages = b.table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), F.lit(1).alias("crawl_id"), kind.alias("kind"), k.alias("page_no"), n.alias("n_items"), F.when(k % 5 != 0, 1800).alias("total_found"), (k % 29 == 0).alias("corrupt"))
    return catalog.completeness(pages).select("source_id", "complete")


_PATHS = "p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages)"


@query(
    "robots_allowed",
    f"""WITH {_PATHS}, r AS (SELECT host, page_id AS seq, page_id % 5 < 2 AS allow, left(path, CAST(3 + page_id % 11 AS INTEGER)) AS prefix FROM p WHERE page_id % 3 = 1),
f AS (SELECT p.page_id, arg_min(r.allow, r.seq) AS allow FROM p JOIN r ON r.host = p.host AND starts_with(p.path, r.prefix) GROUP BY 1)
SELECT page_id FROM p WHERE page_id NOT IN (SELECT page_id FROM f WHERE NOT allow)""",
)
def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Pages that the rules of their host let through; a third of all pages give a rule over the beginning of their path."""
    f = b.table(spark, d, "pages").select("page_id", F.concat_ws("#", "page_id", "url").alias("url"), urls.domain_of(F.col("url")).alias("host"), F.regexp_extract("url", r"^https?://[^/?#]+(/[^?#]*)", 1).alias("path"))
    f = written(f)
    rules = f.filter("page_id % 3 = 1").select("host", F.col("page_id").alias("seq"), (F.col("page_id") % 5 < 2).alias("allow"), F.expr("left(path, cast(3 + page_id % 11 as int))").alias("prefix"))
    return catalog.allowed(f, rules).select("page_id")


@query("stale_extractions", b.with_(b.SQL_POSTINGS) + "SELECT posting_id FROM postings WHERE extraction_version IS NULL")
def stale_extractions(spark: SparkSession, d: str) -> DataFrame:
    return catalog.stale_extractions(b.postings(spark, d), 2).select("posting_id")


@query("needs_preparation", b.with_(b.SQL_POSTINGS) + "SELECT posting_id FROM postings WHERE closed_at IS NULL AND (extraction_version IS NULL OR posting_id % 10 = 0)")
def needs_preparation(spark: SparkSession, d: str) -> DataFrame:
    """Open postings that lack an extraction or a vector; every tenth has no vector here."""
    p = b.postings(spark, d).withColumn("embedding", F.when(F.col("posting_id") % 10 != 0, F.col("embedding")))
    return catalog.needs_preparation(p).select("posting_id")


@query(
    "stream_catalog",
    _DOCS
    + """SELECT canonical_key, CASE WHEN length(body) >= 200 AND (NOT old OR new_hash <> old_hash) THEN new_hash ELSE old_hash END AS content_hash, CAST(CASE WHEN old AND (length(body) < 200 OR new_hash = old_hash) THEN 2 END AS INTEGER) AS extraction_version FROM h WHERE old OR length(body) >= 200""",
)
def stream_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The documents streamed in three batches into a bucketed catalog that holds every second one."""
    root = flows.shared_folder(spark)
    s = buckets.BucketStore(spark, f"{root}/store")
    s.create("postings", _catalog(spark, d), ["canonical_key"], 8)
    docs = b.table(spark, d, "documents").select("doc_id", "text", F.pmod(F.hash("doc_id"), F.lit(3)).alias("batch"))
    url = F.concat(F.lit("https://c.example.com/"), F.col("doc_id").cast("string"))
    stream = flows.in_batches(docs, "batch", file_rows=20_000).select(url.alias("url"), F.col("doc_id").cast("string").alias("external_id"), _body().alias("content"), *_null("string", "title"), *_null("timestamp", "updated_at"), *_null("long", "source_id"))
    flows.ingest_catalog(stream, s, lambda: "2001-06-01 00:00:00", f"{root}/log").awaitTermination()
    return s.read("postings").select("canonical_key", "content_hash", "extraction_version")


# --- matches, sources, jobs -----------------------------------------------------------------


@query(
    "match_upsert",
    """SELECT CASE WHEN event_id % 2 = 0 THEN event_id END AS match_id, user_id AS profile_id, event_id AS posting_id, CASE WHEN event_id % 3 = 0 THEN value + 1 ELSE value END AS final_score,
  CASE WHEN event_id % 2 = 0 AND event_type = 'view' THEN 'user_submission' ELSE 'recommendation' END AS origin, CAST(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS INTEGER) AS scorer_version FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""",
)
def match_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Matches after some pairs were scored again and others for the first time."""
    e = b.table(spark, d, "events")
    pair = (F.col("user_id").alias("profile_id"), F.col("event_id").alias("posting_id"))
    old = e.filter("event_id % 2 = 0").select(F.col("event_id").alias("match_id"), *pair, F.col("value").alias("final_score"), F.when(F.col("event_type") == "view", "user_submission").otherwise("recommendation").alias("origin"), F.lit(1).alias("scorer_version"))
    new = e.filter("event_id % 3 = 0").select(*pair, (F.col("value") + 1).alias("final_score"), F.lit("recommendation").alias("origin"), F.lit(2).alias("scorer_version"))
    return maintenance.upsert_matches(old, new)


@query(
    "source_seeds",
    """SELECT 'lever' AS kind, c_name AS board_token, CASE WHEN c_custkey % 3 = 0 THEN 'New ' || c_name ELSE c_name END AS display_name, CAST(CASE WHEN c_custkey % 3 = 0 THEN 3600 ELSE 60 END AS INTEGER) AS crawl_interval_seconds, c_nationkey <> 3 AS enabled, CAST(c_custkey % 7 AS INTEGER) AS consecutive_failures FROM customer
UNION ALL SELECT 'ashby', s_name, s_name, 86400, true, 0 FROM supplier""",
)
def source_seeds(spark: SparkSession, d: str) -> DataFrame:
    """Sources (customers) after a seed list in CSV was merged: a third renamed, the suppliers added with the default interval."""
    c, s = b.table(spark, d, "customer"), b.table(spark, d, "supplier")
    now = c.select(F.lit("lever").alias("kind"), F.col("c_name").alias("board_token"), F.col("c_name").alias("display_name"), F.lit(60).alias("crawl_interval_seconds"), (F.col("c_nationkey") != 3).alias("enabled"), (F.col("c_custkey") % 7).cast("int").alias("consecutive_failures"))
    seeds = c.filter("c_custkey % 3 = 0").select(F.lit("lever").alias("kind"), F.col("c_name").alias("board_token"), F.concat(F.lit("New "), "c_name").alias("display_name"), F.lit(3600).alias("crawl_interval_seconds"))
    added = s.select(F.lit("ashby").alias("kind"), F.col("s_name").alias("board_token"), F.col("s_name").alias("display_name"), *_null("int", "crawl_interval_seconds"))
    path = flows.shared_folder(spark)
    seeds.unionByName(added).write.option("header", True).csv(path)
    return maintenance.seed_sources(now, texts.seed_list(spark, path))


@query("dangling_sources", "SELECT o_orderkey AS posting_id, c_custkey AS source_id FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey")
def dangling_sources(spark: SparkSession, d: str) -> DataFrame:
    """Postings (orders) after sources (customers) of one segment are deleted."""
    p = b.table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"), F.col("o_custkey").alias("source_id"))
    return profiles.null_dangling(p, "source_id", b.table(spark, d, "customer").filter("c_mktsegment <> 'BUILDING'"), "c_custkey")


@query(
    "crawl_attempts",
    """WITH s AS (SELECT c_custkey AS source_id, TIMESTAMP '1996-01-01 00:00:00' AS seen, CAST(c_custkey % 7 AS INTEGER) AS n FROM customer),
a AS (SELECT o_custkey AS source_id, max(o_orderdate) AS tried, max(o_orderdate) FILTER (o_orderstatus = 'O') AS ok FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1),
f AS (SELECT o.o_custkey AS source_id, count(*) AS n FROM orders o JOIN a ON a.source_id = o.o_custkey WHERE o.o_orderkey % 3 <> 0 AND o.o_orderstatus <> 'O' AND (a.ok IS NULL OR o.o_orderdate > a.ok) GROUP BY 1)
SELECT s.source_id, CAST(epoch(greatest(s.seen, a.tried)) AS BIGINT) AS crawled_s, CAST(epoch(greatest(s.seen, a.ok)) AS BIGINT) AS success_s, CAST(CASE WHEN a.tried IS NULL THEN s.n WHEN a.ok IS NOT NULL THEN coalesce(f.n, 0) ELSE s.n + coalesce(f.n, 0) END AS INTEGER) AS consecutive_failures
FROM s LEFT JOIN a USING (source_id) LEFT JOIN f USING (source_id)""",
)
def crawl_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Clocks and failure counters of sources (customers) after a log of attempts (orders)."""
    seen = _at("1996-01-01")
    s = b.table(spark, d, "customer").select(F.col("c_custkey").alias("source_id"), seen.alias("last_crawled_at"), seen.alias("last_success_at"), (F.col("c_custkey") % 7).cast("int").alias("consecutive_failures"))
    log = b.table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select(F.col("o_custkey").alias("source_id"), F.col("o_orderdate").cast("timestamp").alias("ts"), (F.col("o_orderstatus") == "O").alias("ok"))
    return ops.fold_attempts(s, log).select("source_id", F.unix_seconds("last_crawled_at").alias("crawled_s"), F.unix_seconds("last_success_at").alias("success_s"), "consecutive_failures")


_LINES = """WITH l AS (SELECT user_id AS batch_id, event_id AS n, event_type, CASE WHEN event_id % 17 <> 0 THEN 'https://e.example.com/' || event_type || '/' || json_extract_string(props, '$.k') END AS url FROM events),
f AS (SELECT *, url IS NOT NULL AND row_number() OVER (PARTITION BY batch_id, url ORDER BY n) = 1 AS first FROM l),
o AS (SELECT *, sum(CAST(first AS INTEGER)) OVER (PARTITION BY batch_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS nth FROM f),
busy AS (SELECT DISTINCT batch_id, url FROM l WHERE n % 4 = 0 AND event_type = 'click' AND url IS NOT NULL),
x AS (SELECT o.*, first AND nth <= 5 AS accepted, busy.url IS NOT NULL AS busy FROM o LEFT JOIN busy ON busy.batch_id = o.batch_id AND busy.url = o.url)
"""


def _batch(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Events as the URL lines of their user's batch, five at most; every fourth is in work already if it is a click."""
    e = b.table(spark, d, "events")
    good = F.concat(F.lit("https://e.example.com/"), "event_type", F.lit("/"), F.get_json_object("props", "$.k"))
    line = F.when(F.col("event_id") % 17 != 0, good).otherwise("no address at all")
    lines = e.select(F.col("user_id").alias("batch_id"), F.col("event_id").alias("line_no"), line.alias("line"))
    key = urls.dedupe_key("profile", F.col("user_id"), urls.hash_url(good))
    busy = e.filter("event_id % 4 = 0 and event_id % 17 <> 0").select(F.lit("posting").alias("kind"), key.alias("dedupe_key"), F.when(F.col("event_type") == "click", "queued").otherwise("succeeded").alias("status"))
    batches = e.select(F.col("user_id").alias("batch_id"), "user_id", F.col("user_id").alias("profile_id")).distinct()
    return jobs.create_batches(lines, batches, busy, 5)


@query("batch_creation", _LINES + "SELECT batch_id, count(*) FILTER (accepted AND NOT busy) AS total_urls, count(*) FILTER (url IS NULL OR (first AND nth > 5)) AS rejected_urls, count(*) FILTER ((url IS NOT NULL AND NOT first) OR (accepted AND busy)) AS duplicate_urls FROM x GROUP BY 1")
def batch_creation(spark: SparkSession, d: str) -> DataFrame:
    """Batches with the counts of what was inserted, rejected and already in work."""
    return _batch(spark, d)[0].select("batch_id", "total_urls", "rejected_urls", "duplicate_urls")


@query("batch_jobs", _LINES + "SELECT batch_id, url, sha256(url) AS url_hash, 'profile:' || batch_id || ':' || sha256(url) AS dedupe_key FROM x WHERE accepted AND NOT busy")
def batch_jobs(spark: SparkSession, d: str) -> DataFrame:
    """The jobs those batches insert."""
    return _batch(spark, d)[1].select("batch_id", "url", "url_hash", "dedupe_key")


@query(
    "submitted_before",
    """WITH e AS (SELECT event_id AS job_id, user_id AS profile_id, event_type || '/' || json_extract_string(props, '$.k') AS url_hash, ts FROM events),
n AS (SELECT DISTINCT profile_id + 1 AS profile_id, url_hash FROM e), k AS (SELECT profile_id, url_hash, arg_max(job_id, (ts, job_id)) AS job_id FROM e GROUP BY 1, 2)
SELECT n.profile_id, n.url_hash, k.job_id FROM n LEFT JOIN k USING (profile_id, url_hash)""",
)
def submitted_before(spark: SparkSession, d: str) -> DataFrame:
    """Submissions with the newest job of the same profile and address, if there is one."""
    e = b.table(spark, d, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("profile_id"), F.concat("event_type", F.lit("/"), F.get_json_object("props", "$.k")).alias("url_hash"), F.col("ts").alias("created_at"), F.lit("succeeded").alias("status"))
    known, fresh = jobs.split_submitted(e.select((F.col("profile_id") + 1).alias("profile_id"), "url_hash").distinct(), e)
    return known.select("profile_id", "url_hash", "job_id").unionByName(fresh.select("profile_id", "url_hash", *_null("long", "job_id")))


@query("batch_listing", "SELECT user_id AS batch_id, CAST(epoch_us(min(ts)) AS BIGINT) AS created_us FROM events GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 100")
def batch_listing(spark: SparkSession, d: str) -> DataFrame:
    """The newest hundred batches."""
    made = b.table(spark, d, "events").groupBy(F.col("user_id").alias("batch_id")).agg(F.min("ts").cast("timestamp").alias("created_at"))
    return jobs.batch_listing(made).select("batch_id", F.unix_micros("created_at").alias("created_us"))


@query("feedback_append", b.with_(b.SQL_FEEDBACK) + "SELECT match_id, verdict, count(*) + count(*) FILTER (id % 3 = 0) AS n FROM feedback GROUP BY 1, 2")
def feedback_append(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts after a third of them were given once more; repeats are kept."""
    f = b.feedback(spark, d)
    return feed.append_feedback(f, f.filter("id % 3 = 0")).groupBy("match_id", "verdict").agg(F.count("*").alias("n"))


@query(
    "purged",
    """WITH p AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), l AS (SELECT * FROM lineitem JOIN p ON o_orderkey = l_orderkey)
SELECT 'postings' AS "table", count(*) AS removed FROM p UNION ALL SELECT 'ingest_jobs', count(*) FROM events WHERE event_id IN (SELECT o_orderkey FROM p) UNION ALL SELECT 'matches', count(*) FROM l UNION ALL SELECT 'match_feedback', count(*) FROM l WHERE l_returnflag = 'R'""",
)
def purged(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table that go with the postings of one key prefix."""
    o, l, e = (b.table(spark, d, t) for t in ("orders", "lineitem", "events"))
    key = F.concat(F.when(F.col("o_orderstatus") == "P", "test:").otherwise("url:"), F.col("o_orderkey").cast("string"))
    m = l.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("match_id"), F.col("l_orderkey").alias("posting_id"), "l_returnflag")
    tables = {
        "postings": o.select(F.col("o_orderkey").alias("posting_id"), key.alias("canonical_key")), "ingest_jobs": e.select(F.col("event_id").alias("job_id"), F.col("event_id").alias("posting_id")),
        "matches": m.drop("l_returnflag"), "match_feedback": m.filter("l_returnflag = 'R'").select("match_id"),
    }
    return maintenance.purge(tables, "test:")[1]


# --- profiles and scores ---------------------------------------------------------------------


def _generations(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").select(F.col("user_id").alias("profile_id"), F.col("event_id").alias("posting_id"), F.when(F.col("event_id") % 9 != 0, F.length("event_type") % 3).alias("scorer_version"))


@query("scorer_generations", "WITH m AS (SELECT user_id AS profile_id, CASE WHEN event_id % 9 <> 0 THEN length(event_type) % 3 END AS v FROM events) SELECT profile_id, coalesce(string_agg(DISTINCT CAST(v AS VARCHAR), ',' ORDER BY CAST(v AS VARCHAR)), '') AS versions, count(DISTINCT v) > 1 AS mixed FROM m GROUP BY 1")
def scorer_generations(spark: SparkSession, d: str) -> DataFrame:
    return feed.scorer_generations(_generations(spark, d)).select("profile_id", F.array_join("versions", ",").alias("versions"), "mixed")


@query("rescore_sweep", "SELECT user_id AS profile_id, event_id AS posting_id FROM events WHERE event_id % 9 = 0 OR length(event_type) % 3 <> 2")
def rescore_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that another generation than the second scored, or none that is known."""
    return feed.rescore_sweep(_generations(spark, d), 2)


@query(
    "profile_summary",
    b.with_(b.SQL_PROFILES, b.SQL_PROFILE_SKILLS)
    + "SELECT user_id, profile_id, CAST(coalesce(n, 0) AS INTEGER) AS skill_count, CAST(profile_id % 50 AS INTEGER) AS characters, CAST(row_number() OVER (PARTITION BY user_id ORDER BY profile_id % 7 DESC, profile_id DESC) AS INTEGER) AS position FROM profiles LEFT JOIN (SELECT profile_id, count(*) AS n FROM profile_skills GROUP BY 1) USING (profile_id)",
)
def profile_summary(spark: SparkSession, d: str) -> DataFrame:
    """Skills and characters per profile, newest first within an owner."""
    p = b.profiles_full(spark, d)
    rows = p.withColumn("raw_text", F.repeat(F.lit("x"), (F.col("profile_id") % 50).cast("int"))).withColumn("created_at", F.col("profile_id") % 7).withColumn("is_active", F.lit(True))
    return profiles.summary(rows).drop("is_active")


@query(
    "breakdowns",
    b.with_(*b.FEED_PARTS[:7])
    + """, n AS (SELECT *, (profile_id + posting_id) % 7 <> 0 AS kept FROM scored)
SELECT profile_id, posting_id, CASE WHEN kept THEN matched ELSE 0 END AS matched_count, CASE WHEN kept THEN partial ELSE 0 END AS partial_count, CASE WHEN kept THEN missing ELSE 0 END AS missing_count, CASE WHEN kept THEN missing_required ELSE 0 END AS missing_required_count,
  CAST(CASE WHEN kept THEN matched + partial + missing ELSE 0 END AS INTEGER) AS n_verdicts, CASE WHEN kept THEN 0.6::DOUBLE END AS semantic_weight FROM n""",
)
def breakdowns(spark: SparkSession, d: str) -> DataFrame:
    """Explanations of all recalled pairs as flat columns; every seventh pair is of a generation without one."""
    pairs = recall.recall(b.profiles(spark, d), b.postings(spark, d)).drop("rank")
    s = feed.score_pairs(pairs, b.profiles_full(spark, d), b.postings_full(spark, d))
    old = s.withColumn("breakdown", F.when((F.col("profile_id") + F.col("posting_id")) % 7 != 0, F.col("breakdown")))
    flat = feed.with_breakdown_defaults(old)
    return flat.select("profile_id", "posting_id", "matched_count", "partial_count", "missing_count", "missing_required_count", F.size("skill_verdicts").alias("n_verdicts"), F.col("breakdown.weights.semantic").alias("semantic_weight"))


@query("telling_skills", "SELECT p_partkey, CASE p_partkey % 4 WHEN 1 THEN 'integrity' WHEN 2 THEN 'api' ELSE replace(p_name, ' ', '') END AS key, p_partkey % 4 <> 1 AS is_skill FROM part")
def telling_skills(spark: SparkSession, d: str) -> DataFrame:
    """Keys without qualifying words, and which names are skills at all."""
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat("p_name", F.lit(" Framework"))).when(k == 1, " Integrity ").when(k == 2, "API").otherwise(F.col("p_name"))
    return b.table(spark, d, "part").select("p_partkey", skills.canonical_key(name).alias("key"), skills.is_skill(name).alias("is_skill"))


# --- functions, sources and checks ------------------------------------------------------------


@query(
    "blocked_hosts",
    """SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'loopback name' WHEN 1 THEN 'loopback name' WHEN 2 THEN 'private address' WHEN 3 THEN 'loopback address' WHEN 4 THEN 'link-local address' WHEN 7 THEN 'numeric encoding of an address' END AS reason FROM orders""",
)
def blocked_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Why hosts must not be fetched."""
    k = F.col("o_orderkey")
    host = (
        F.when(k % 8 == 0, "LOCALHOST").when(k % 8 == 1, "a.localhost").when(k % 8 == 2, F.concat(F.lit("10.0.0."), (k % 256).cast("string"))).when(k % 8 == 3, "127.0.0.1").when(k % 8 == 4, "169.254.169.254")
        .when(k % 8 == 5, F.concat(F.lit("h"), k.cast("string"), F.lit(".example.com"))).when(k % 8 == 6, "8.8.8.8").otherwise("0x7f000001")
    )
    return b.table(spark, d, "orders").select("o_orderkey", urls.blocked_host_reason(host).alias("reason"))


@query(
    "decoded_values",
    """SELECT o_orderkey, o_orderstatus || ' & <' || o_orderkey || '> é' AS unescaped, CASE o_orderkey % 4 WHEN 0 THEN o_orderpriority || chr(10) || o_orderstatus || chr(10) || 'say "so"' WHEN 1 THEN o_orderpriority END AS flat FROM orders""",
)
def decoded_values(spark: SparkSession, d: str) -> DataFrame:
    """Character references decoded once, and JSON strings or nested lists of them as text."""
    k, p, s = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    coded = F.concat(s, F.lit(" &amp; &lt;"), k.cast("string"), F.lit("&gt; &#233;"))
    nested = F.concat(F.lit('["'), p, F.lit('", ["'), s, F.lit('", "", "say \\"so\\""]]'))
    value = F.when(k % 4 == 0, nested).when(k % 4 == 1, p).when(k % 4 == 2, "[]")
    return b.table(spark, d, "orders").select("o_orderkey", text.html_unescape(coded).alias("unescaped"), text.flatten_text(value).alias("flat"))


@query("url_list_files", "SELECT CAST(o_custkey % 16 AS INTEGER) AS list, CAST(row_number() OVER (PARTITION BY o_custkey % 16 ORDER BY o_orderkey) - 1 AS INTEGER) AS line_no, 'https://x.example.com/' || o_orderkey AS line FROM orders QUALIFY o_orderkey % 9 <> 0")
def url_list_files(spark: SparkSession, d: str) -> DataFrame:
    """Lines of sixteen list files; blank ones are left out and keep their number."""
    line = F.when(F.col("o_orderkey") % 9 == 0, "  ").otherwise(F.concat(F.lit("https://x.example.com/"), F.col("o_orderkey").cast("string")))
    o = b.table(spark, d, "orders").select((F.col("o_custkey") % 16).cast("int").alias("list"), "o_orderkey", line.alias("line"))
    path = flows.shared_folder(spark)
    o.repartition(16, "list").sortWithinPartitions("list", "o_orderkey").drop("o_orderkey").write.partitionBy("list").text(path)
    return texts.url_lists(spark, path).select(F.regexp_extract("path", r"list=(\d+)", 1).cast("int").alias("list"), "line_no", "line")


@query(
    "constraint_audit",
    b.with_(b.SQL_JOBS)
    + """SELECT 'ingest_jobs' AS "table", 'unique(kind, dedupe_key)' AS rule, 'posting|' || dedupe_key AS key, count(*) AS n FROM jobs WHERE status IN ('queued', 'running') GROUP BY dedupe_key HAVING count(*) > 1
UNION ALL SELECT 'ingest_jobs', 'vocabulary(status)', 'lost', count(*) FROM jobs WHERE status = 'dead' HAVING count(*) > 0
UNION ALL SELECT 'ingest_jobs', 'reference(batch_id)', CAST(batch_id AS VARCHAR), count(*) FROM jobs WHERE batch_id % 2 = 1 GROUP BY batch_id""",
)
def constraint_audit(spark: SparkSession, d: str) -> DataFrame:
    """Violations among jobs: equal work twice in flight, a status that is none, batches that are gone."""
    j = b.jobs(spark, d).withColumn("status", F.when(F.col("status") == "dead", "lost").otherwise(F.col("status")))
    return schemas.audit({"ingest_jobs": j, "url_batches": j.filter("batch_id % 2 = 0").select("batch_id").distinct()})


@query("extraction_contract", "SELECT o_orderkey AS posting_id, ['fits', 'malformed JSON', 'missing skills', 'unknown seniority', 'no output', 'unnamed skill'][1 + o_orderkey % 6] AS reason FROM orders")
def extraction_contract(spark: SparkSession, d: str) -> DataFrame:
    """What keeps an extractor's output from being used."""
    answers = ('{"title": "x", "skills": [{"name": "a", "necessity": "required"}]}', '{"skills": [', '{"title": "x"}', '{"skills": [], "seniority": "boss"}', None, '{"skills": [{"necessity": "required"}]}')
    raw = F.element_at(F.array(*[F.lit(a).cast("string") for a in answers]), (F.col("o_orderkey") % len(answers) + 1).cast("int"))
    good, bad = schemas.parse_extraction(b.table(spark, d, "orders").select(F.col("o_orderkey").alias("posting_id"), raw.alias("raw")), "raw")
    return good.select("posting_id", F.lit("fits").alias("reason")).unionByName(bad.select("posting_id", "reason"))


@query(
    "snapshot_versions",
    """SELECT 1 AS version, o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 2
UNION ALL SELECT 2, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, count(*) FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 GROUP BY 2
UNION ALL SELECT 3, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END, count(*) FROM orders GROUP BY 2""",
)
def snapshot_versions(spark: SparkSession, d: str) -> DataFrame:
    """A stored table after a write, an upsert and an append; every version stays readable."""
    s = store.SnapshotStore(spark, flows.shared_folder(spark))
    o = b.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    s.write("t", o.filter("o_orderkey % 2 = 0"))
    s.upsert("t", o.filter("o_orderkey % 3 = 0").withColumn("status", F.lit("X")), ["o_orderkey"], {})
    s.append("t", o.filter("o_orderkey % 2 <> 0 and o_orderkey % 3 <> 0"))
    all_ = [s.read("t", v).groupBy("status").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "status", "n") for v in (1, 2, 3)]
    return all_[0].unionByName(all_[1]).unionByName(all_[2])


@query(
    "sql_names",
    """SELECT o_orderkey, lower(replace(replace(o_orderpriority, '-', ''), ' ', '')) AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'PostgreSQL' ELSE o_orderpriority END AS skill, CASE WHEN o_orderkey % 3 = 0 THEN 'senior' END AS level,
  sha256(o_orderstatus || chr(10) || o_orderpriority) AS hash, CAST(o_orderkey % 2 AS DOUBLE) AS cos, round(CAST(0.3 + 0.2 * (o_orderkey % 3) AS DOUBLE), 6) AS score, 'https://x.example.com/a?b=' || o_orderkey AS url FROM orders""",
)
def sql_names(spark: SparkSession, d: str) -> DataFrame:
    """The library's functions called from SQL."""
    registry.register(spark)
    b.table(spark, d, "orders").createOrReplaceTempView("matchloom_orders")
    return spark.sql(
        """SELECT o_orderkey, canonical_key(o_orderpriority) AS key, normalize_skill(CASE WHEN o_orderkey % 2 = 0 THEN 'postgres' ELSE o_orderpriority END) AS skill, seniority_from_title(CASE WHEN o_orderkey % 3 = 0 THEN 'Senior Engineer' ELSE 'Engineer' END) AS level,
        content_hash(concat('  ', o_orderstatus, '\n\n', o_orderpriority, ' \n')) AS hash, cosine(array(1F, 0F), array(float(o_orderkey % 2), 1F)) AS cos, round(blend(0.5D, double(o_orderkey % 3) / 2), 6) AS score,
        normalize_url(concat('HTTPS://X.example.com:443/a/?b=', o_orderkey, '&utm_source=q#f')) AS url FROM matchloom_orders"""
    )


def _counting_extractor():
    """Extractor of the query below: how many characters it was given."""
    return lambda given: [json.dumps({"n": len(t)}) for t in given]


@query("extractor_seam", "SELECT doc_id, CAST(least(length(text), 500) AS INTEGER) AS n FROM documents")
def extractor_seam(spark: SparkSession, d: str) -> DataFrame:
    """A caller's extractor over the documents, texts cut to 500 characters."""
    out = registry.extract(b.table(spark, d, "documents"), "doc_id", "text", _counting_extractor, 500)
    return out.select("doc_id", F.get_json_object("raw", "$.n").cast("int").alias("n"))


@query(
    "url_table_function",
    """WITH l AS (SELECT o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INTEGER) AS line_no, CASE WHEN o_orderkey % 7 <> 0 THEN 'https://x.example.com/' || o_orderstatus || '/' || o_orderkey % 2 END AS url FROM orders),
f AS (SELECT *, url IS NOT NULL AND row_number() OVER (PARTITION BY o_custkey, url ORDER BY line_no) = 1 AS first FROM l),
n AS (SELECT *, sum(CAST(first AS INTEGER)) OVER (PARTITION BY o_custkey ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS nth FROM f)
SELECT o_custkey, line_no, url, CASE WHEN url IS NULL THEN 'rejected' WHEN NOT first THEN 'duplicate' WHEN nth <= 3 THEN 'accepted' ELSE 'over_cap' END AS outcome FROM n""",
)
def url_table_function(spark: SparkSession, d: str) -> DataFrame:
    """URL lists of the customers (a line per order) parsed by the table function, three addresses a list."""
    registry.register_url_table_function(spark)
    line = F.when(F.col("o_orderkey") % 7 == 0, "no address").otherwise(F.concat(F.lit("https://X.example.com/"), "o_orderstatus", F.lit("/"), (F.col("o_orderkey") % 2).cast("string"), F.lit("#top")))
    lists = b.table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("l"))
    lists.select("o_custkey", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("body")).createOrReplaceTempView("matchloom_url_lists")
    return spark.sql("SELECT o_custkey, t.line_no, t.url, t.outcome FROM matchloom_url_lists, LATERAL parse_url_list(body, 3) AS t")

"""The library's tables seen in the benchmark tables, as frames and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEVELS = {"1-URGENT": "staff", "2-HIGH": "senior", "3-MEDIUM": "mid", "5-LOW": "junior"}
STATUS = {"click": "queued", "view": "running", "purchase": "succeeded", "signup": "failed"}
VERDICT = {"view": "interested", "click": "not_interested", "purchase": "applied"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _case(column: str, values: dict[str, str], other: str | None):
    out = F.lit(other).cast("string")
    for k, v in values.items():
        out = F.when(F.col(column) == k, v).otherwise(out)
    return out


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, o = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "orders")
    rows = e.join(o, e.vec_id == o.o_orderkey)
    return rows.select(
        F.col("vec_id").alias("posting_id"), "embedding", F.col("o_orderdate").alias("first_seen_at"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed_at"),
        F.when(F.col("vec_id") % 13 != 0, F.lit(2)).alias("extraction_version"),
        _case("o_orderpriority", LEVELS, "unknown").alias("seniority"),
        F.when(F.col("o_orderstatus") == "O", "remote").otherwise("onsite").alias("remote_type"),
        F.when(F.col("vec_id") % 3 != 0, (F.col("vec_id") % 9).cast("double")).alias("min_years"),
        F.col("label").alias("source_id"),
    )


def posting_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per posting and skill name: lowest line, necessity and threshold of the name's first line."""
    l, p, e = (table(spark, sf_dir, t) for t in ("lineitem", "part", "embeddings"))
    rows = l.join(p, l.l_partkey == p.p_partkey).join(e.select("vec_id"), F.col("vec_id") == F.col("l_orderkey"))
    rows = rows.select(
        F.col("l_orderkey").alias("posting_id"), F.col("l_linenumber").alias("pos"), F.col("p_name").alias("name"),
        F.when(F.col("l_returnflag") == "A", "required").when(F.col("l_returnflag") == "R", "preferred").otherwise("unknown").alias("necessity"),
        F.when(F.col("l_linestatus") == "O", F.floor(F.col("l_quantity") / 10).cast("double")).alias("min_years"),
    )
    # Lines repeat within an order: the order of fields makes the choice the same everywhere.
    w = Window.partitionBy("posting_id", "name").orderBy("pos", "necessity", F.asc_nulls_first("min_years"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = posting_skills(spark, sf_dir).withColumn("evidence", F.lit(None).cast("string"))
    per = s.groupBy("posting_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "necessity", "min_years", "evidence"))).alias("r"))
    return per.select("posting_id", F.transform("r", lambda x: x.dropFields("pos")).alias("requirements"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 25 = 0").select(F.col("vec_id").alias("profile_id"), (F.col("vec_id") % 10).alias("user_id"), "embedding")


def profile_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, p, o, e = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders", "embeddings"))
    ids = e.filter("vec_id % 25 = 0").select(F.col("vec_id").alias("o_custkey"))
    rows = o.join(ids, "o_custkey").join(l, l.l_orderkey == o.o_orderkey).join(p, p.p_partkey == l.l_partkey)
    return rows.groupBy(F.col("o_custkey").alias("profile_id"), F.col("p_name").alias("name")).agg(F.max(F.floor(F.col("l_quantity") / 10).cast("double")).alias("years"))


def profiles_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile_skills(spark, sf_dir).groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("name", "years"))).alias("skills"))
    return profiles(spark, sf_dir).join(s, "profile_id", "left").withColumn("skills", F.coalesce("skills", F.array().cast("array<struct<name:string,years:double>>")))


def postings_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    empty = F.array().cast("array<struct<name:string,necessity:string,min_years:double,evidence:string>>")
    return postings(spark, sf_dir).join(requirements(spark, sf_dir), "posting_id", "left").withColumn("requirements", F.coalesce("requirements", empty))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(F.col("event_id").alias("job_id"), F.col("user_id").alias("batch_id"), F.col("ts").alias("created_at"), _case("event_type", STATUS, "dead").alias("status"), (k % 5).alias("attempts"), F.col("value").alias("latency_ms"), F.lit("posting").alias("kind"), F.concat_ws("-", "user_id", k).alias("dedupe_key"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin(*VERDICT))
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("match_id"), F.col("ts").alias("created_at"), _case("event_type", VERDICT, None).alias("verdict"))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources, their last order as last crawl and success."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_at"))
    return c.join(last, "c_custkey", "left").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("display_name"), (F.col("c_nationkey") != 3).alias("enabled"), (86400 * (1 + F.col("c_nationkey") * 20)).alias("crawl_interval_seconds"), F.col("last_at").alias("last_crawled_at"), F.col("last_at").alias("last_success_at"), (F.col("c_custkey") % 7).cast("int").alias("consecutive_failures"))


def source_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as postings of their customer."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("posting_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("source_id"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("company"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed_at"))


# --- the same for DuckDB ---------------------------------------------------------------

CASE_LEVEL = "CASE o.o_orderpriority WHEN '1-URGENT' THEN 'staff' WHEN '2-HIGH' THEN 'senior' WHEN '3-MEDIUM' THEN 'mid' WHEN '5-LOW' THEN 'junior' ELSE 'unknown' END"
SQL_POSTINGS = f"""postings AS (SELECT e.vec_id AS posting_id, e.embedding, o.o_orderdate AS first_seen_at,
  CASE WHEN o.o_orderstatus='F' THEN o.o_orderdate END AS closed_at, CASE WHEN e.vec_id % 13 = 0 THEN NULL ELSE 2 END AS extraction_version,
  {CASE_LEVEL} AS seniority, CASE WHEN o.o_orderstatus='O' THEN 'remote' ELSE 'onsite' END AS remote_type,
  CASE WHEN e.vec_id % 3 = 0 THEN NULL ELSE CAST(e.vec_id % 9 AS DOUBLE) END AS min_years, e.label AS source_id
  FROM embeddings e JOIN orders o ON o.o_orderkey = e.vec_id)"""
SQL_POSTING_SKILLS = """posting_skills AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY posting_id, name ORDER BY pos, necessity, min_years NULLS FIRST) AS rn
  FROM (SELECT l.l_orderkey AS posting_id, l.l_linenumber AS pos, p.p_name AS name,
  CASE l.l_returnflag WHEN 'A' THEN 'required' WHEN 'R' THEN 'preferred' ELSE 'unknown' END AS necessity,
  CASE WHEN l.l_linestatus='O' THEN CAST(floor(l.l_quantity/10) AS DOUBLE) END AS min_years
  FROM lineitem l JOIN part p ON p.p_partkey=l.l_partkey JOIN embeddings e ON e.vec_id=l.l_orderkey)) WHERE rn = 1)"""
SQL_PROFILES = "profiles AS (SELECT vec_id AS profile_id, vec_id % 10 AS user_id, embedding FROM embeddings WHERE vec_id % 25 = 0)"
SQL_PROFILE_SKILLS = """profile_skills AS (SELECT o.o_custkey AS profile_id, p.p_name AS name, max(CAST(floor(l.l_quantity/10) AS DOUBLE)) AS years
  FROM orders o JOIN lineitem l ON l.l_orderkey=o.o_orderkey JOIN part p ON p.p_partkey=l.l_partkey
  JOIN (SELECT vec_id FROM embeddings WHERE vec_id % 25 = 0) v ON v.vec_id=o.o_custkey GROUP BY 1,2)"""
SQL_JOBS = """jobs AS (SELECT event_id AS job_id, user_id AS batch_id, ts AS created_at,
  CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'succeeded' WHEN 'signup' THEN 'failed' ELSE 'dead' END AS status,
  CAST(json_extract_string(props,'$.k') AS INTEGER) % 5 AS attempts, value AS latency_ms, user_id || '-' || json_extract_string(props,'$.k') AS dedupe_key FROM events)"""
SQL_FEEDBACK = """feedback AS (SELECT event_id AS id, user_id AS match_id, ts AS created_at,
  CASE event_type WHEN 'view' THEN 'interested' WHEN 'click' THEN 'not_interested' WHEN 'purchase' THEN 'applied' END AS verdict
  FROM events WHERE event_type IN ('view','click','purchase'))"""
SQL_SOURCES = """sources AS (SELECT c.c_custkey AS source_id, c.c_name AS display_name, c.c_nationkey <> 3 AS enabled, 86400 * (1 + c.c_nationkey * 20) AS crawl_interval_seconds,
  l.last_at AS last_crawled_at, l.last_at AS last_success_at, CAST(c.c_custkey % 7 AS INTEGER) AS consecutive_failures
  FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_at FROM orders GROUP BY 1) l ON l.o_custkey = c.c_custkey)"""
SQL_SOURCE_POSTINGS = """source_postings AS (SELECT o_orderkey AS posting_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_custkey END AS source_id,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS company, CASE WHEN o_orderstatus='F' THEN o_orderdate END AS closed_at FROM orders)"""
SQL_RECALL = """recalled AS (SELECT * FROM (SELECT profile_id, posting_id, sim, row_number() OVER (PARTITION BY profile_id ORDER BY sim DESC, posting_id) AS rank
  FROM (SELECT p.profile_id, q.posting_id, round(list_inner_product(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS sim
  FROM profiles p, postings q WHERE q.closed_at IS NULL AND q.embedding IS NOT NULL AND q.extraction_version IS NOT NULL)) WHERE rank <= 200)"""
SQL_VERDICTS = """verdicts AS (SELECT k.profile_id, k.posting_id, s.pos, s.name, s.necessity, s.min_years, h.years, k.sim,
  CASE WHEN h.name IS NULL THEN 'missing' WHEN s.min_years IS NOT NULL AND (h.years IS NULL OR h.years < s.min_years) THEN 'partial' ELSE 'matched' END AS bucket,
  CASE WHEN s.necessity = 'required' THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / 3 END AS w
  FROM recalled k LEFT JOIN posting_skills s ON s.posting_id = k.posting_id LEFT JOIN profile_skills h ON h.profile_id = k.profile_id AND h.name = s.name)"""
SQL_SCORED = """scored AS (SELECT profile_id, posting_id, any_value(sim) AS sim,
  coalesce(sum(CASE WHEN name IS NULL THEN NULL ELSE w * CASE bucket WHEN 'matched' THEN 1.0 WHEN 'partial' THEN 0.5 ELSE 0.0 END END) / sum(CASE WHEN name IS NOT NULL THEN w END), 1.0) AS skill,
  count(name) FILTER (bucket = 'matched') AS matched, count(name) FILTER (bucket = 'partial') AS partial, count(name) FILTER (bucket = 'missing') AS missing,
  count(name) FILTER (bucket = 'missing' AND necessity = 'required') AS missing_required FROM verdicts GROUP BY 1, 2)"""
SQL_FEED = """feed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY round(final, 6) DESC, sim DESC, posting_id) AS feed_rank
  FROM (SELECT *, greatest(0.0, least(1.0, 0.6 * sim + 0.4 * skill)) AS final FROM scored)) WHERE feed_rank <= 50)"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


FEED_PARTS = (SQL_POSTINGS, SQL_PROFILES, SQL_POSTING_SKILLS, SQL_PROFILE_SKILLS, SQL_RECALL, SQL_VERDICTS, SQL_SCORED, SQL_FEED)

"""Table schemas and the checks that stand in for database constraints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PROFILE_EXTRACTION_VERSION, POSTING_EXTRACTION_VERSION = 3, 2

EXTRACTED_PROFILE = "skills array<struct<name:string,years:double,evidence:string,source:string>>, total_years_experience double, seniority string, education array<struct<institution:string,degree:string,field_of_study:string,graduation_year:int>>"
EXTRACTED_POSTING = "title string, company string, location string, remote_type string, seniority string, min_years_experience double, skills array<struct<name:string,necessity:string,min_years:double,evidence:string>>"
BREAKDOWN = (
    "semantic_score double, skill_score double, final_score double, skills array<struct<name:string,necessity:string,bucket:string,required_years:double,candidate_years:double,evidence:string>>, "
    "counts struct<matched:bigint,partial:bigint,missing:bigint,missing_required:bigint>, weights struct<semantic:double,skill:double>, extraction_failed boolean, "
    "seniority struct<profile_level:string,posting_level:string,steps:int,direction:string,candidate_years:double,required_years:double,years_gap:double>"
)
DISCOVERED = "external_id string, url string, title string, updated_at timestamp, content string"

TABLES: dict[str, str] = {
    "users": "user_id bigint, email string, password_hash string, is_admin boolean, created_at timestamp",
    "profiles": "profile_id bigint, user_id bigint, is_active boolean, original_filename string, raw_text string, skills array<struct<name:string,years:double,evidence:string,source:string>>, seniority string, years_experience decimal(4,1), extraction_version int, embedding array<float>, created_at timestamp",
    "sources": "source_id bigint, kind string, board_token string, display_name string, enabled boolean, crawl_interval_seconds int, last_crawled_at timestamp, last_success_at timestamp, consecutive_failures int",
    "postings": "posting_id bigint, canonical_key string, url string, content_hash string, raw_text string, extraction_version int, source_id bigint, source_updated_at timestamp, title string, company string, location string, remote_type string, seniority string, min_years decimal(4,1), embedding array<float>, first_seen_at timestamp, last_seen_at timestamp, closed_at timestamp",
    "ingest_jobs": "job_id bigint, kind string, dedupe_key string, profile_id bigint, source_id bigint, batch_id bigint, url string, url_hash string, title string, posting_id bigint, status string, attempts int, last_error string, created_at timestamp, updated_at timestamp",
    "url_batches": "batch_id bigint, user_id bigint, profile_id bigint, original_filename string, total_urls int, rejected_urls int, duplicate_urls int, created_at timestamp",
    "matches": f"match_id bigint, profile_id bigint, posting_id bigint, semantic_score float, skill_score float, final_score float, breakdown struct<{BREAKDOWN}>, origin string, scorer_version int, scored_at timestamp",
    "match_feedback": "id bigint, match_id bigint, verdict string, created_at timestamp",
}

# Vocabularies of the enumerated columns.
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("ingest_jobs", "status"): ("queued", "running", "succeeded", "failed", "dead"),
    ("sources", "kind"): ("greenhouse", "lever", "ashby", "workable", "smartrecruiters", "rippling", "breezy", "usajobs"),
    ("matches", "origin"): ("recommendation", "user_submission"),
    ("match_feedback", "verdict"): ("interested", "not_interested", "applied"),
    ("postings", "seniority"): ("junior", "mid", "senior", "staff", "unknown"),
    ("postings", "remote_type"): ("remote", "hybrid", "onsite", "unknown"),
}
UNIQUE: dict[str, tuple[tuple[tuple[str, ...], str], ...]] = {
    "users": ((("email",), "true"),),
    "profiles": ((("user_id",), "is_active"),),
    "sources": ((("kind", "board_token"), "true"),),
    "postings": ((("canonical_key",), "true"),),
    "ingest_jobs": ((("kind", "dedupe_key"), "status in ('queued', 'running')"),),
    "matches": ((("profile_id", "posting_id"), "true"),),
}
FOREIGN: tuple[tuple[str, str, str], ...] = (
    ("profiles", "user_id", "users"), ("postings", "source_id", "sources"), ("ingest_jobs", "profile_id", "profiles"), ("ingest_jobs", "source_id", "sources"),
    ("ingest_jobs", "batch_id", "url_batches"), ("ingest_jobs", "posting_id", "postings"), ("url_batches", "profile_id", "profiles"), ("matches", "profile_id", "profiles"),
    ("matches", "posting_id", "postings"), ("match_feedback", "match_id", "matches"),
)
KEYS = {"users": "user_id", "profiles": "profile_id", "sources": "source_id", "postings": "posting_id", "ingest_jobs": "job_id", "url_batches": "batch_id", "matches": "match_id"}


def schema_of(table: str) -> StructType:
    """Schema of a table of the catalog."""
    return StructType.fromDDL(TABLES[table])


def audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of uniqueness, vocabularies and references: rows (table, rule, key, n).  Tables not given are not checked."""
    found: list[DataFrame] = []
    text = lambda cols: F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols])
    row = lambda df, table, rule, key, n: df.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.alias("key"), n.cast("long").alias("n"))
    for name, df in tables.items():
        for cols, where in UNIQUE.get(name, ()):
            groups = df.filter(where).groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")
            found.append(row(groups, name, f"unique({', '.join(cols)})", text(cols), F.col("n")))
        for (table, col), allowed in ENUMS.items():
            if table == name and col in df.columns:
                bad = df.filter(F.col(col).isNotNull() & ~F.col(col).isin(*allowed)).groupBy(col).agg(F.count("*").alias("n"))
                found.append(row(bad, name, f"vocabulary({col})", F.col(col), F.col("n")))
        for table, col, target in FOREIGN:
            if table == name and target in tables and col in df.columns:
                key = KEYS[target]
                orphans = df.filter(F.col(col).isNotNull()).join(tables[target].select(F.col(key).alias(col)), col, "left_anti").groupBy(col).agg(F.count("*").alias("n"))
                found.append(row(orphans, name, f"reference({col})", F.col(col).cast("string"), F.col("n")))
    if not found:
        raise ValueError("none of the tables has a rule")
    return reduce(DataFrame.unionByName, found)


def parse_extraction(rows: DataFrame, raw: str, contract: str = EXTRACTED_POSTING, required: tuple[str, ...] = ("skills",), enums: dict[str, tuple[str, ...]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split rows by whether their JSON fits the contract: (good with ``extracted``, quarantine with a retryable ``reason``)."""
    parsed = F.from_json(F.col(raw), f"{contract}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    out = rows.withColumn("_x", parsed)
    checks: list[tuple[Column, str]] = [(F.col(raw).isNull(), "no output"), (F.col("_x").isNull() | F.col("_x._corrupt").isNotNull(), "malformed JSON")]
    checks += [(F.col(f"_x.{c}").isNull(), f"missing {c}") for c in required]
    checks += [(F.exists(F.col("_x.skills"), lambda s: s["name"].isNull()), "unnamed skill")]
    for col, allowed in (enums if enums is not None else {"seniority": ENUMS["postings", "seniority"], "remote_type": ENUMS["postings", "remote_type"]}).items():
        checks.append((F.col(f"_x.{col}").isNotNull() & ~F.col(f"_x.{col}").isin(*allowed), f"unknown {col}"))
    reason = reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(checks), F.lit(None).cast("string"))
    out = out.withColumn("reason", reason)
    good = out.filter("reason IS NULL").withColumn("extracted", F.col("_x").dropFields("_corrupt")).drop("_x", "reason")
    return good, out.filter("reason IS NOT NULL").drop("_x").withColumn("retryable", F.lit(True))

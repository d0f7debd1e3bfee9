"""Backfills with reports, seeding and purging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.seniority import seniority_from_title
from matchloom.operators.store import KEEP_OLD, upsert


def transitions(before: Column, after: Column, rows: DataFrame, top: int = 20) -> DataFrame:
    """Most common ``old -> new`` changes with their counts."""
    text = F.concat_ws(" -> ", F.coalesce(before, F.lit("null")), F.coalesce(after, F.lit("null")))
    return rows.filter(~before.eqNullSafe(after)).groupBy(text.alias("change")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "change").limit(top)


def backfill_report(rows: DataFrame, changed: DataFrame, before: str, after: str, key: str = "posting_id", extra: tuple[str, ...] = (), examples: int = 15) -> DataFrame:
    """What a backfill looks at and changes, for a dry run as well: one row with ``examined``, ``to_correct`` and the first ``examples`` changes by key.

    Examples hold the key, the value before and after, and the ``extra`` columns.
    """
    # The smallest keys are found per partition first, so no more than ``examples`` rows of each travel.
    first = changed.select(key, F.col(before).alias("before"), F.col(after).alias("after"), *extra).orderBy(key).limit(examples)
    shown = first.agg(F.array_sort(F.collect_list(F.struct(key, "before", "after", *extra))).alias("examples"))
    counts = rows.agg(F.count("*").alias("examined")).withColumn("_one", F.lit(1)), changed.agg(F.count("*").alias("to_correct")).withColumn("_one", F.lit(1))
    return counts[0].join(counts[1].hint("broadcast"), "_one").join(shown.withColumn("_one", F.lit(1)).hint("broadcast"), "_one").drop("_one")


def employer_names(postings: DataFrame, sources: DataFrame) -> DataFrame:
    """Postings with ``employer``: the display name of their source, else the stored company."""
    names = sources.select("source_id", F.col("display_name").alias("_board"))
    return postings.join(names, "source_id", "left").withColumn("employer", F.coalesce("_board", "company")).drop("_board")


def backfill_company(postings: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with board employers, changed rows, transition report).  Applying it twice changes nothing; for a dry run use the reports only."""
    rows = employer_names(postings, sources)
    changed = rows.filter(F.col("source_id").isNotNull() & ~F.col("company").eqNullSafe(F.col("employer")))
    fixed = rows.withColumn("company", F.when(F.col("source_id").isNotNull(), F.col("employer")).otherwise(F.col("company"))).select(*postings.columns)
    return fixed, changed, transitions(F.col("company"), F.col("employer"), changed)


def backfill_seniority(postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings with the level their title states, changed rows, transition report); titles that state none leave the row alone."""
    rows = postings.withColumn("_stated", seniority_from_title(F.col("title")))
    changed = rows.filter(F.col("_stated").isNotNull() & ~F.col("seniority").eqNullSafe(F.col("_stated")))
    fixed = rows.withColumn("seniority", F.coalesce("_stated", "seniority")).select(*postings.columns)
    return fixed, changed, transitions(F.col("seniority"), F.col("_stated"), changed)


def residue(postings: DataFrame) -> DataFrame:
    """Postings without a company, by whether a source is known."""
    return postings.filter("company IS NULL").groupBy(F.col("source_id").isNotNull().alias("has_source")).agg(F.count("*").alias("n"))


def seed_sources(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sources with seeds (kind, board_token, display_name, crawl_interval_seconds) merged: names and intervals follow the seeds, operational state stays, nothing is deleted."""
    rows = seeds.withColumn("enabled", F.lit(True)).withColumn("consecutive_failures", F.lit(0))
    return upsert(sources, rows, ["kind", "board_token"], {"enabled": KEEP_OLD, "consecutive_failures": KEEP_OLD, "source_id": KEEP_OLD})


def upsert_matches(matches: DataFrame, scored: DataFrame) -> DataFrame:
    """Matches with newly scored pairs: scores, explanation and generation replaced, the first origin kept."""
    return upsert(matches, scored.select(*[c for c in scored.columns if c in matches.columns and c != "match_id"]), ["profile_id", "posting_id"], {"origin": F.coalesce(F.col("old.origin"), F.col("new.origin")), "match_id": KEEP_OLD})


def purge(tables: dict[str, DataFrame], prefix: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without postings whose key starts with ``prefix``, nor their jobs, matches and feedback; and a report of rows removed per table."""
    gone = tables["postings"].filter(F.startswith("canonical_key", F.lit(prefix))).select("posting_id")
    out = dict(tables)
    out["postings"] = tables["postings"].filter(~F.startswith("canonical_key", F.lit(prefix)))
    for name in ("ingest_jobs", "matches"):
        if name in tables:
            out[name] = tables[name].join(gone, "posting_id", "left_anti").select(*tables[name].columns)
    if "match_feedback" in tables and "matches" in tables:
        lost = tables["matches"].join(gone, "posting_id", "left_semi").select("match_id")
        out["match_feedback"] = tables["match_feedback"].join(lost, "match_id", "left_anti").select(*tables["match_feedback"].columns)
    report = None
    for name in out:
        before, after = tables[name].agg(F.count("*").alias("before")), out[name].agg(F.count("*").alias("after"))
        one = before.crossJoin(after).select(F.lit(name).alias("table"), (F.col("before") - F.col("after")).alias("removed"))
        report = one if report is None else report.unionByName(one)
    return out, report

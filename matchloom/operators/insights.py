"""Skill gaps over the verdicts of stored matches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.classify import gap_severity
from matchloom.functions.skills import canonical_key, normalize_skill

TOP_GAPS = 12


def verdict_rows(matches: DataFrame) -> DataFrame:
    """One row per verdict of every match that names its skill."""
    return matches.select("profile_id", "posting_id", F.explode("breakdown.skills").alias("v")).select("profile_id", "posting_id", "v.name", "v.necessity", "v.bucket").filter(F.col("name").isNotNull())


def gap_counts(verdicts: DataFrame, *scope: str) -> DataFrame:
    """Counts per spelling: missing, partial, matched and blocking (missing and required)."""
    count = lambda c: F.count_if(c)
    return verdicts.groupBy(*scope, "name").agg(
        count(F.col("bucket") == "missing").alias("missing"),
        count(F.col("bucket") == "partial").alias("partial"),
        count(F.col("bucket") == "matched").alias("matched"),
        count((F.col("bucket") == "missing") & (F.col("necessity") == "required")).alias("blocking"),
    )


def fold_spellings(counts: DataFrame, *scope: str) -> DataFrame:
    """Spellings of one skill added up under a display name: fewest words, most frequent, most capitals, alphabetical; then its alias."""
    n = F.col("missing") + F.col("partial") + F.col("matched")
    capitals = F.length(F.regexp_replace("name", r"[^\p{Lu}]", ""))
    rank = F.struct(F.size(F.split("name", r"\s+")).alias("w"), (-n).alias("f"), (-capitals).alias("u"), F.col("name").alias("a"))
    folded = counts.withColumn("key", canonical_key(F.col("name"))).groupBy(*scope, "key").agg(*[F.sum(c).alias(c) for c in ("missing", "partial", "matched", "blocking")], F.min_by("name", rank).alias("skill"))
    return folded.withColumn("skill", normalize_skill(F.col("skill")))


def skill_gaps(verdicts: DataFrame, *scope: str, top: int = TOP_GAPS) -> DataFrame:
    """The ``top`` gaps of each scope, worst first.  Rows without a gap go, and the cut falls, after spellings are folded."""
    gaps = fold_spellings(gap_counts(verdicts, *scope), *scope).filter((F.col("missing") > 0) | (F.col("partial") > 0))
    order = [F.desc("blocking"), F.desc("missing"), F.desc("partial"), F.col("skill")]
    if not scope:
        return gaps.orderBy(*order).limit(top)
    w = Window.partitionBy(*scope).orderBy(*order)
    return gaps.withColumn("gap_rank", F.row_number().over(w)).filter(F.col("gap_rank") <= top)


def with_severity(gaps: DataFrame, analyzed: str = "analyzed") -> DataFrame:
    return gaps.withColumn("severity", gap_severity(F.col("blocking"), F.col(analyzed)))

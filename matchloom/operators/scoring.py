"""Skill scoring of (profile, posting) pairs and its explanation.

Requirements and candidate skills are arrays on the two sides of a pair, so a
pair is scored by expressions over one row; nothing is exploded and no join on
skill names is needed, however popular a skill is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.functions.seniority import seniority_delta
from matchloom.functions.skills import canonical_key, first_by, normalize_skill_items

# Weights, credits and the generation of the scorer.
SEMANTIC_WEIGHT, SKILL_WEIGHT = 0.6, 0.4
REQUIRED, PREFERRED = 1.0, 1.0 / 3.0
MATCHED, PARTIAL, MISSING = 1.0, 0.5, 0.0
SCORER_VERSION = 2


def requirement_weight(necessity: Column) -> Column:
    return F.when(necessity == "required", F.lit(REQUIRED)).otherwise(F.lit(PREFERRED))


def bucket_credit(bucket: Column) -> Column:
    return F.when(bucket == "matched", MATCHED).when(bucket == "partial", PARTIAL).otherwise(MISSING)


def bucket(present: Column, held_years: Column, required_years: Column) -> Column:
    """missing without the skill; partial if a stated threshold is not shown to be met; else matched."""
    short = required_years.isNotNull() & (held_years.isNull() | (held_years < required_years))
    return F.when(~F.coalesce(present, F.lit(False)), "missing").when(short, "partial").otherwise("matched")


def candidate_map(items: Column, normalized: bool = False) -> Column:
    """Map from canonical key to years of an array of (name, years); of equal keys the last wins, null years stay."""
    clean = items if normalized else normalize_skill_items(items)
    keyed = F.transform(F.coalesce(clean, F.array()), lambda s: F.struct(canonical_key(s["name"]).alias("key"), s["years"].cast("double").alias("value")))
    return F.map_from_entries(first_by(F.reverse(keyed), "key"))


def keyed_requirements(requirements: Column) -> Column:
    """Canonical requirements with their comparison ``key``; prepared once per posting, before pairs are formed."""
    return F.transform(F.coalesce(normalize_skill_items(requirements), F.array()), lambda r: r.withField("key", canonical_key(r["name"])))


def verdicts(keyed: Column, held: Column) -> Column:
    """Array of (name, necessity, bucket, required_years, candidate_years, evidence) in the order of the keyed requirements."""

    def judge(r: Column) -> Column:
        key = r["key"]
        years = F.element_at(held, key)
        return F.struct(
            r["name"].alias("name"),
            r["necessity"].alias("necessity"),
            bucket(F.map_contains_key(held, key), years, r["min_years"].cast("double")).alias("bucket"),
            r["min_years"].cast("double").alias("required_years"),
            years.alias("candidate_years"),
            r["evidence"].alias("evidence"),
        )

    return F.transform(keyed, judge)


def skill_score(found: Column) -> Column:
    """Weighted coverage of the verdicts; 1 if nothing is asked for."""
    weight = F.aggregate(found, F.lit(0.0), lambda s, v: s + requirement_weight(v["necessity"]))
    credit = F.aggregate(found, F.lit(0.0), lambda s, v: s + requirement_weight(v["necessity"]) * bucket_credit(v["bucket"]))
    return F.when(weight > 0, credit / weight).otherwise(F.lit(1.0))


def bucket_counts(found: Column) -> Column:
    count = lambda test: F.size(F.filter(found, test)).cast("long")

    def with_bucket(b: str) -> Column:
        return count(lambda v: v["bucket"] == b).alias(b)

    return F.struct(
        *[with_bucket(b) for b in ("matched", "partial", "missing")],
        count(lambda v: (v["bucket"] == "missing") & (v["necessity"] == "required")).alias("missing_required"),
    )


def blend(semantic: Column, skill: Column, semantic_weight: float = SEMANTIC_WEIGHT, skill_weight: float = SKILL_WEIGHT) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), semantic * semantic_weight + skill * skill_weight))


def build_breakdown(semantic: Column, found: Column, extraction_failed: Column, seniority: Column | None = None) -> Column:
    """Nested explanation of a score; scores are rounded half-even to six places."""
    skill = skill_score(found)
    return F.struct(
        F.bround(semantic, 6).alias("semantic_score"),
        F.bround(skill, 6).alias("skill_score"),
        F.bround(blend(semantic, skill), 6).alias("final_score"),
        found.alias("skills"),
        bucket_counts(found).alias("counts"),
        F.struct(F.lit(SEMANTIC_WEIGHT).alias("semantic"), F.lit(SKILL_WEIGHT).alias("skill")).alias("weights"),
        F.coalesce(extraction_failed, F.lit(False)).alias("extraction_failed"),
        (seniority if seniority is not None else seniority_delta(*[F.lit(None).cast("string")] * 2, *[F.lit(None).cast("double")] * 2)).alias("seniority"),
    )

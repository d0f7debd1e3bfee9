"""Levels: from titles, ranks and differences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that state a level, and the ladder.
NOT_A_LEVEL = r"(?iU)\bchief of staff\b"
STAFF = r"(?iU)\b(?:staff|principal|distinguished)\b"
SENIOR = r"(?iU)\b(?:senior|snr|sr)\b"
JUNIOR = r"(?iU)\b(?:junior|jr|intern(?:s|ship|ships)?|apprentice|trainee|new\s+grad(?:uate)?|entry[\s-]level|co-?op)\b"
LADDER = ("junior", "mid", "senior", "staff")


def seniority_from_title(title: Column) -> Column:
    """Level that a title states outright, strongest first; null if none."""
    text = F.regexp_replace(title, NOT_A_LEVEL, " ")
    return F.when(text.rlike(STAFF), "staff").when(text.rlike(SENIOR), "senior").when(text.rlike(JUNIOR), "junior")


def rank_of(level: Column) -> Column:
    """Place on the ladder from 0; null for unknown, other and null levels."""
    at = F.array_position(F.array(*[F.lit(x) for x in LADDER]), level)
    return F.when(at > 0, (at - 1).cast("int"))


def seniority_delta(profile_level: Column, posting_level: Column, candidate_years: Column, required_years: Column) -> Column:
    """Struct of both levels, steps between them, direction and years gap; levels and years are judged independently."""
    steps = rank_of(profile_level) - rank_of(posting_level)
    have, need = candidate_years.cast("double"), required_years.cast("double")
    return F.struct(
        profile_level.alias("profile_level"),
        posting_level.alias("posting_level"),
        steps.alias("steps"),
        F.when(steps.isNull(), "unknown").when(steps == 0, "match").when(steps < 0, "under").otherwise("over").alias("direction"),
        have.alias("candidate_years"),
        need.alias("required_years"),
        F.bround(have - need, 6).alias("years_gap"),
    )

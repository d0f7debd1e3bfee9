"""Feeds: building, reading, rescoring, and what users made of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.classify import percent, score_band
from matchloom.functions.seniority import seniority_delta
from matchloom.functions.vectors import cosine_of_units
from matchloom.operators import scoring
from matchloom.operators.recall import RECALL_LIMIT, FeedFilters, recall

FEED_SIZE = 50
# Vocabularies.
ORIGINS = ("recommendation", "user_submission")
VERDICTS = ("interested", "not_interested", "applied")


def one_of(value: str | None, allowed: tuple[str, ...], what: str) -> str | None:
    """``value`` if it is None or in the vocabulary; the error names the alternatives."""
    if value is not None and value not in allowed:
        raise ValueError(f"{what} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def score_pairs(pairs: DataFrame, profiles: DataFrame, postings: DataFrame) -> DataFrame:
    """``pairs`` (profile_id, posting_id, maybe semantic_score) with scores and breakdown.

    Profiles have ``skills`` (name, years) and may have embedding, seniority,
    years_experience; postings have ``requirements`` (name, necessity,
    min_years, evidence) and may have embedding, seniority, min_years,
    extraction_failed.  A missing vector on either side gives similarity 0.
    """
    left_cols, right_cols = set(profiles.columns), set(postings.columns)
    pick = lambda cols, name, kind: F.col(name).cast(kind) if name in cols else F.lit(None).cast(kind)
    left = profiles.select(
        "profile_id", scoring.candidate_map(F.col("skills")).alias("_held"), pick(left_cols, "seniority", "string").alias("_pl"), pick(left_cols, "years_experience", "double").alias("_py"),
        *([F.col("embedding").alias("_pe")] if "embedding" in left_cols and "semantic_score" not in pairs.columns else []),
    )
    right = postings.select(
        "posting_id", scoring.keyed_requirements(F.col("requirements")).alias("_asked"), pick(right_cols, "seniority", "string").alias("_ql"), pick(right_cols, "min_years", "double").alias("_qy"), pick(right_cols, "extraction_failed", "boolean").alias("_failed"),
        *([F.col("embedding").alias("_qe")] if "embedding" in right_cols and "semantic_score" not in pairs.columns else []),
    )
    rows = pairs.join(left, "profile_id").join(right, "posting_id")
    if "semantic_score" not in pairs.columns:
        both = {"_pe", "_qe"} <= set(rows.columns)
        rows = rows.withColumn("semantic_score", F.coalesce(cosine_of_units(F.col("_pe"), F.col("_qe")), F.lit(0.0)) if both else F.lit(0.0))
    rows = rows.withColumn("_found", scoring.verdicts(F.col("_asked"), F.col("_held")))
    rows = rows.withColumn("skill_score", scoring.skill_score(F.col("_found")))
    delta = seniority_delta(F.col("_pl"), F.col("_ql"), F.col("_py"), F.col("_qy"))
    return rows.select(
        *pairs.drop("semantic_score").columns,
        "semantic_score",
        "skill_score",
        scoring.blend(F.col("semantic_score"), F.col("skill_score")).alias("final_score"),
        scoring.build_breakdown(F.col("semantic_score"), F.col("_found"), F.col("_failed"), delta).alias("breakdown"),
    )


def rerank(scored: DataFrame, limit: int = FEED_SIZE, digits: int = 6) -> DataFrame:
    """Best ``limit`` rows per profile by final score, then similarity, then posting; ``feed_rank`` from 1."""
    w = Window.partitionBy("profile_id").orderBy(F.desc(F.bround("final_score", digits)), F.desc(F.bround("semantic_score", digits)), "posting_id")
    return scored.withColumn("feed_rank", F.row_number().over(w)).filter(F.col("feed_rank") <= limit)


def build_feed(profiles: DataFrame, postings: DataFrame, recall_limit: int = RECALL_LIMIT, feed_size: int = FEED_SIZE, filters: FeedFilters | None = None, scored_at: Column | None = None, nearest: Callable[..., DataFrame] = recall) -> DataFrame:
    """Feeds of all profiles in one job: recall, score, rerank, in the shape of ``matches`` (without match_id).

    ``nearest`` is :func:`recall`, or :func:`recall_cells` for catalogs too wide to compare in full.
    """
    near = nearest(profiles, postings, recall_limit, filters).drop("rank")
    ranked = rerank(score_pairs(near, profiles, postings), feed_size)
    return ranked.select(
        "profile_id", "posting_id", "semantic_score", "skill_score", "final_score", "breakdown", F.lit("recommendation").alias("origin"),
        F.lit(scoring.SCORER_VERSION).alias("scorer_version"), (scored_at if scored_at is not None else F.current_timestamp()).alias("scored_at"), "feed_rank",
    )


def rescore_sweep(matches: DataFrame, version: int = scoring.SCORER_VERSION) -> DataFrame:
    """Pairs scored by another generation of the scorer."""
    return matches.filter(~F.col("scorer_version").eqNullSafe(version)).select("profile_id", "posting_id")


def read_feed(matches: DataFrame, postings: DataFrame, owned: DataFrame, filters: FeedFilters | None = None, origin: str | None = None, include_closed: bool = False, limit: int = 25, scorer_version: int | None = None) -> DataFrame:
    """Feed rows of the owned profiles (rows with profile_id), best first within each profile.

    Ownership is joined before anything else.  Closed postings are hidden unless asked for.
    """
    one_of(origin, ORIGINS, "origin")
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    mine = matches.join(owned.select("profile_id").distinct(), "profile_id", "left_semi")
    if origin is not None:
        mine = mine.filter(F.col("origin") == origin)
    if scorer_version is not None:
        mine = mine.filter(F.col("scorer_version") == scorer_version)
    shown = postings if include_closed else postings.filter("closed_at IS NULL")
    shown = (filters or FeedFilters()).apply(shown)
    cols = [c for c in ("title", "company", "location", "url", "remote_type", "seniority", "min_years", "closed_at") if c in shown.columns]
    rows = mine.join(shown.select("posting_id", *cols), "posting_id")
    w = Window.partitionBy("profile_id").orderBy(F.desc("final_score"), "posting_id")
    rows = rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit)
    return rows.withColumn("band", score_band(F.col("final_score"))).withColumn("percent", percent(F.col("final_score")))


def with_breakdown_defaults(matches: DataFrame) -> DataFrame:
    """Flat columns of the breakdown; what older generations lack reads as 0, [], false or null."""
    b = F.col("breakdown")
    zero = lambda n: F.coalesce(b["counts"][n], F.lit(0).cast("long")).alias(f"{n}_count")
    return matches.select("*", *[zero(n) for n in ("matched", "partial", "missing", "missing_required")], F.coalesce(b["skills"], F.array()).alias("skill_verdicts"), F.coalesce(b["extraction_failed"], F.lit(False)).alias("extraction_failed"), b["seniority"].alias("seniority_fit"))


def latest_feedback(feedback: DataFrame, verdict: str | None = None, mode: str = "history") -> DataFrame:
    """One row per match, its latest verdict.

    ``history`` restricts to the verdict before picking the latest, so a match
    marked interested and later applied is found under both; ``current``
    restricts after.
    """
    one_of(verdict, VERDICTS, "verdict")
    if mode not in ("history", "current"):
        raise ValueError(f"mode must be history or current, not {mode!r}")
    rows = feedback.filter(F.col("verdict") == verdict) if verdict and mode == "history" else feedback
    last = rows.groupBy("match_id").agg(F.max_by(F.struct("id", "verdict", "created_at"), F.struct("created_at", "id")).alias("l")).select("match_id", "l.*")
    return last.filter(F.col("verdict") == verdict) if verdict and mode == "current" else last


def saved_matches(feedback: DataFrame, matches: DataFrame, owned: DataFrame, postings: DataFrame, verdict: str | None = None, mode: str = "history", limit: int = 50) -> DataFrame:
    """Tracker of the owned profiles: latest verdicts with match and posting, newest first."""
    mine = matches.join(owned.select("profile_id").distinct(), "profile_id", "left_semi").select("match_id", "profile_id", "posting_id", "final_score")
    scoped = feedback.join(mine.select("match_id"), "match_id", "left_semi")
    cols = [c for c in ("title", "company", "url", "closed_at") if c in postings.columns]
    rows = latest_feedback(scoped, verdict, mode).join(mine, "match_id").join(postings.select("posting_id", *cols), "posting_id")
    return rows.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def append_feedback(feedback: DataFrame, new: DataFrame) -> DataFrame:
    """Events added; repeats are kept, unknown verdicts rejected by the plan."""
    checked = new.withColumn("verdict", F.when(F.col("verdict").isin(*VERDICTS), F.col("verdict")).otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce("verdict", F.lit("null"))))))
    return feedback.unionByName(checked)


def feedback_funnel(feedback: DataFrame) -> DataFrame:
    """Verdict sequence of each match, how often it changed, and whether it ended in an application."""
    w = Window.partitionBy("match_id").orderBy("created_at", "id")
    steps = feedback.withColumn("changed", (F.lag("verdict").over(w) != F.col("verdict")).cast("int"))
    per = steps.groupBy("match_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "verdict"))).alias("s"), F.sum(F.coalesce("changed", F.lit(0))).alias("changes"), F.count("*").alias("n_events"))
    return per.select("match_id", F.transform("s", lambda x: x["verdict"]).alias("path"), "changes", "n_events", (F.element_at("s", -1)["verdict"] == "applied").alias("applied"))


def feed_currency(profiles: DataFrame, matches: DataFrame, version: int = scoring.SCORER_VERSION) -> DataFrame:
    """Per profile: already_current, profile_not_ready (no vector) or queued."""
    current = matches.filter((F.col("origin") == "recommendation") & (F.col("scorer_version") == version)).select("profile_id").distinct().withColumn("hit", F.lit(True))
    state = F.when(F.col("hit"), "already_current").when(F.col("embedding").isNull(), "profile_not_ready").otherwise("queued")
    return profiles.join(current, "profile_id", "left").select("profile_id", state.alias("state"))


def scorer_generations(matches: DataFrame) -> DataFrame:
    """How many scorer generations a profile's feed mixes."""
    return matches.groupBy("profile_id").agg(F.array_sort(F.collect_set("scorer_version")).alias("versions")).withColumn("mixed", F.size("versions") > 1)


def match_totals(matches: DataFrame, owned: DataFrame, profile_id: int | None = None) -> DataFrame:
    """Matches analysed per owner (rows of ``owned``: user_id, profile_id), or of one profile."""
    scope = owned if profile_id is None else owned.filter(F.col("profile_id") == profile_id)
    return scope.join(matches.select("profile_id", "posting_id"), "profile_id", "left").groupBy("user_id").agg(F.count("posting_id").alias("analyzed"))

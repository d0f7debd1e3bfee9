"""Profiles: which one is active, and what goes when one is deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.skills import normalize_skill_items


def activate(profiles: DataFrame, chosen: DataFrame) -> DataFrame:
    """Exactly the chosen profile (user_id, profile_id) of each owner is active; owners without a choice are untouched."""
    pick = chosen.select("user_id", F.col("profile_id").alias("_chosen"))
    rows = profiles.join(pick, "user_id", "left")
    return rows.withColumn("is_active", F.when(F.col("_chosen").isNull(), F.col("is_active")).otherwise(F.col("profile_id") == F.col("_chosen"))).select(*profiles.columns)


def add_profiles(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """Profiles with new ones added; the first of an owner without any becomes active, others do not."""
    owners = profiles.select("user_id").distinct().withColumn("_has", F.lit(True))
    w = Window.partitionBy("user_id").orderBy("created_at", "profile_id")
    rows = new.join(owners, "user_id", "left").withColumn("is_active", F.col("_has").isNull() & (F.row_number().over(w) == 1)).drop("_has")
    return profiles.unionByName(rows.select(*profiles.columns))


def promote_survivors(survivors: DataFrame) -> DataFrame:
    """Owners left without an active profile get their newest one."""
    any_active = Window.partitionBy("user_id")
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("profile_id"))
    rows = survivors.withColumn("_any", F.max("is_active").over(any_active)).withColumn("_rn", F.row_number().over(newest))
    return rows.withColumn("is_active", F.col("is_active") | (~F.col("_any") & (F.col("_rn") == 1))).select(*survivors.columns)


def delete_profiles(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Tables after deleting profiles (profile_id): their jobs, batches, matches and the matches' feedback go too; survivors are promoted."""
    ids = gone.select("profile_id").distinct()
    out = dict(tables)
    for name in ("ingest_jobs", "url_batches", "matches"):
        if name in tables:
            out[name] = tables[name].join(ids, "profile_id", "left_anti").select(*tables[name].columns)
    if "match_feedback" in tables:
        lost = tables["matches"].join(ids, "profile_id", "left_semi").select("match_id")
        out["match_feedback"] = tables["match_feedback"].join(lost, "match_id", "left_anti").select(*tables["match_feedback"].columns)
    out["profiles"] = promote_survivors(tables["profiles"].join(ids, "profile_id", "left_anti").select(*tables["profiles"].columns))
    return out


def null_dangling(rows: DataFrame, column: str, target: DataFrame, key: str) -> DataFrame:
    """``column`` set to null where it refers to no row of ``target``."""
    known = target.select(F.col(key).alias(column)).distinct().withColumn("_known", F.lit(True))
    return rows.join(known, column, "left").withColumn(column, F.when(F.col("_known"), F.col(column))).select(*rows.columns)


def summary(profiles: DataFrame) -> DataFrame:
    """Number of canonical skills and characters per profile, newest first within each owner."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("profile_id"))
    return profiles.select("user_id", "profile_id", "is_active", F.size(normalize_skill_items(F.coalesce("skills", F.array()))).alias("skill_count"), F.length(F.coalesce("raw_text", F.lit(""))).alias("characters"), F.row_number().over(w).alias("position"))

"""Constraints checked while tables are written: one scan a table.

Vocabulary rules are metrics observed by the write itself.  What the key rules
need of a table, its key values, comes from the rows just written, column by
column; the values of all tables and rules meet in one shuffle, counted before
it.  Only rules that the observed metrics show broken are looked at further.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from matchloom.schemas import ENUMS, FOREIGN, KEYS, UNIQUE


def _text(columns: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def _claims(name: str, columns: list[str], tables: set[str]) -> list[Column]:
    """What a row says about keys: (table, rule, key, role); as a holder of a unique key, as a reference, or as a reference's target."""
    out: list[Column] = []
    claim = lambda when, table, rule, key, role: F.when(when, F.struct(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.alias("key"), F.lit(role).alias("role")))
    for cols, where in UNIQUE.get(name, ()):
        out.append(claim(F.expr(where), name, f"unique({', '.join(cols)})", _text(cols), "holds"))
    for table, col, target in FOREIGN:
        rule = f"reference({col})"
        if table == name and target in tables and col in columns:
            out.append(claim(F.col(col).isNotNull(), table, rule, F.col(col).cast("string"), "refers"))
        if target == name and table in tables and KEYS[name] in columns:
            out.append(claim(F.col(KEYS[name]).isNotNull(), table, rule, F.col(KEYS[name]).cast("string"), "is"))
    return out


def write_audited(tables: dict[str, DataFrame], folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Write the tables under ``folder``; returns them as written, and the violations: rows (table, rule, key, n).

    The rules are those of :func:`matchloom.schemas.audit`, with the same rows.
    Each input is computed once.  References are checked between the tables
    given.
    """
    if not any(n in UNIQUE or any(n == t for t, _ in ENUMS) or any(n == t for t, _, _ in FOREIGN) for n in tables):
        raise ValueError("none of the tables has a rule")
    made: dict[str, DataFrame] = {}
    found: list[DataFrame] = []
    claims: list[DataFrame] = []
    for name, df in tables.items():
        spark = df.sparkSession
        rules = [(col, allowed) for (table, col), allowed in ENUMS.items() if table == name and col in df.columns]
        bad = {col: F.col(col).isNotNull() & ~F.col(col).isin(*allowed) for col, allowed in rules}
        seen = Observation()
        watched = df.observe(seen, F.count("*").alias("rows"), *[F.count_if(c).alias(col) for col, c in bad.items()])
        watched.write.parquet(f"{folder}/{name}")
        made[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        counts = seen.get
        for col, c in bad.items():
            if counts[col]:
                values = made[name].filter(c).groupBy(col).agg(F.count("*").alias("n"))
                found.append(values.select(F.lit(name).alias("table"), F.lit(f"vocabulary({col})").alias("rule"), F.col(col).alias("key"), F.col("n").cast("long").alias("n")))
        said = _claims(name, df.columns, set(tables))
        if said:
            each = made[name].select(F.explode(F.array_compact(F.array(*said))).alias("c")).select("c.*")
            claims.append(each)
    if claims:
        n = lambda role: F.count_if(F.col("role") == role)
        keys = reduce(DataFrame.unionByName, claims).groupBy("table", "rule", "key").agg(n("holds").alias("h"), n("refers").alias("r"), n("is").alias("i"))
        broken = keys.filter("h > 1 or r > 0 and i = 0")
        found.append(broken.select("table", "rule", "key", F.when(F.col("h") > 1, F.col("h")).otherwise(F.col("r")).alias("n")))
    if not found:
        spark = next(iter(tables.values())).sparkSession
        return made, spark.createDataFrame([], "table string, rule string, key string, n long")
    return made, reduce(DataFrame.unionByName, found)


__all__ = ["write_audited"]

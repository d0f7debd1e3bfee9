"""SQL names for the library's functions, and pluggable extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from matchloom.functions.urls import canonical_url

# Fixed values live in the Column functions; SQL users get them as temporary SQL functions built from the same parts.


def register(spark: SparkSession) -> list[str]:
    """Make normalize_url, canonical_key, normalize_skill, seniority_from_title, content_hash, cosine and blend callable from SQL."""
    from matchloom.functions import seniority as s
    from matchloom.functions import skills as k
    from matchloom.functions import text as t

    q = ", ".join(f"'{x}'" for x in k.QUALIFIERS)
    table = lambda m: "map(" + ", ".join(f"'{a}', '{b}'" for a, b in m.items()) + ")"
    spaces = "".join(f"\\u{ord(c):04x}" for c in t.SPACES)
    strip = lambda c: f"trim(BOTH '{spaces}' FROM {c})"
    tokens = f"filter(split(lower({strip('name')}), '[^a-z0-9+#.]+'), x -> x <> '')"
    telling = f"filter({tokens}, x -> x NOT IN ({q}))"
    parts = {
        "canonical_key(name STRING) RETURNS STRING": f"array_join(CASE WHEN size({telling}) > 0 THEN {telling} ELSE {tokens} END, '')",
        "normalize_skill(name STRING) RETURNS STRING": f"CASE WHEN {strip('name')} = '' THEN '' ELSE coalesce(element_at({table(k.ALIASES)}, lower({strip('name')})), element_at({table(k.ALIAS_KEYS)}, canonical_key({strip('name')})), {strip('name')}) END",
        "seniority_from_title(title STRING) RETURNS STRING": "CASE "
        + " ".join(f"WHEN rlike(regexp_replace(title, r'{s.NOT_A_LEVEL}', ' '), r'{p}') THEN '{v}'" for p, v in ((s.STAFF, "staff"), (s.SENIOR, "senior"), (s.JUNIOR, "junior")))
        + " END",
        "content_hash(body STRING) RETURNS STRING": f"sha2(array_join(filter(transform(split(body, r'{t.LINE_BREAK}'), l -> {strip('l')}), l -> l <> ''), '\\n'), 256)",
        "cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>) RETURNS DOUBLE": "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)",
        "blend(semantic DOUBLE, skill DOUBLE) RETURNS DOUBLE": "greatest(0D, least(1D, 0.6D * semantic + 0.4D * skill))",
    }
    for head, body in parts.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    normalize = F.pandas_udf(_urls, StringType())
    spark.udf.register("normalize_url", normalize)
    return [h.split("(")[0] for h in parts] + ["normalize_url"]


def _urls(urls: pd.Series) -> pd.Series:
    return urls.map(canonical_url)


def register_url_table_function(spark: SparkSession) -> None:
    """``parse_url_list(text, cap)`` as a table function: line_no, url, outcome."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="line_no int, url string, outcome string")
    class ParseUrlList:
        def eval(self, text: str, cap: int) -> Iterator[tuple]:
            seen: set[str] = set()
            for n, line in enumerate((text or "").removeprefix("﻿").splitlines()):
                if not line.strip():
                    continue
                url = canonical_url(line)
                if url is None:
                    yield n, None, "rejected"
                elif url in seen:
                    yield n, url, "duplicate"
                else:
                    seen.add(url)
                    yield n, url, "accepted" if len(seen) <= cap else "over_cap"

    spark.udtf.register("parse_url_list", ParseUrlList)


Extractor = Callable[[list[str]], list[str]]


def extract(rows: DataFrame, key: str, text: str, make_extractor: Callable[[], Extractor], limit: int) -> DataFrame:
    """Rows (key, raw) of a caller's extractor, text in, JSON out, made once per task; texts are cut to ``limit`` characters."""

    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = make_extractor()
        for t in batches:
            yield pd.Series(f([(x or "")[:limit] for x in t]))

    return rows.select(F.col(key), run(F.col(text)).alias("raw"))

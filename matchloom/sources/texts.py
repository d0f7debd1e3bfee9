"""URL lists and raw pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import LINE_BREAK, html_to_text, strip


def url_lists(spark: SparkSession, path: str) -> DataFrame:
    """Lines of list files, one batch per file: path, line_no, line.  A byte-order mark and CRLF are tolerated, blank lines left out."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return pasted_lines(raw, "path", "value")


def pasted_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Lines of a text column: key, line_no, line."""
    bare = F.regexp_replace(F.col(text), r"^\x{FEFF}", "")
    out = rows.select(F.col(key), F.posexplode(F.split(bare, LINE_BREAK)).alias("line_no", "line"))
    return out.filter(strip(F.col("line")) != "")


def page_texts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Pages with the text of their HTML; ``failure`` is 'permanent' where there is none."""
    rows = pages.withColumn("text", html_to_text(F.col(html)))
    return rows.withColumn("failure", F.when(F.coalesce(F.length(strip(F.col("text"))), F.lit(0)) == 0, "permanent"))


def non_empty_pages(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    return page_texts(pages, url, html).filter("failure IS NULL").drop("failure")


def seed_list(spark: SparkSession, path: str) -> DataFrame:
    """Sources to seed from CSV with a header: kind, board_token, display_name, crawl_interval_seconds (a day if absent)."""
    rows = spark.read.schema("kind string, board_token string, display_name string, crawl_interval_seconds int").option("header", True).csv(path)
    return rows.withColumn("crawl_interval_seconds", F.coalesce("crawl_interval_seconds", F.lit(86_400)))



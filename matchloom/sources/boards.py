"""Board listings: landed JSON payloads of eight kinds, unified into one frame.

A payload file lies under ``<root>/kind=<kind>/board=<token>/`` and holds one
answer of the board's API (a page of it, where boards are paged).  Payloads
are read with explicit schemas; what does not fit them is reported by
:func:`pages`, and its source counts as not wholly read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import flatten_text, html_to_text, html_unescape, iso_timestamp

Adapter = Callable[[DataFrame], DataFrame]
_UNIFIED = ("board_token", "external_id", "url", "title", "updated_at", "content")


def _present(c: Column) -> Column:
    """The value, or null if blank."""
    return F.when(c != "", c)


def _rows(payloads: DataFrame, item_schema: str, *paths: str) -> DataFrame:
    """One row per item of the arrays at the given paths ('$' is a bare list); missing arrays give none."""
    found = F.coalesce(*[F.from_json(F.col("body") if p == "$" else F.get_json_object("body", p), f"array<struct<{item_schema}>>") for p in paths])
    return payloads.select("board_token", "page_no", F.explode(found).alias("j"))


def _unify(rows: DataFrame, external_id: Column, url: Column, title: Column, updated: Column | None = None, content: Column | None = None) -> DataFrame:
    out = rows.select(
        "board_token",
        _present(external_id.cast("string")).alias("external_id"),
        _present(url).alias("url"),
        title.alias("title"),
        (updated if updated is not None else F.lit(None)).cast("timestamp").alias("updated_at"),
        (_present(content) if content is not None else F.lit(None)).cast("string").alias("content"),
    )
    return out.filter("external_id IS NOT NULL AND url IS NOT NULL")


def greenhouse(p: DataFrame) -> DataFrame:
    """Escaped HTML: references are decoded before the markup is removed."""
    r = _rows(p, "id string, absolute_url string, title string, updated_at string, content string", "$.jobs")
    return _unify(r, F.col("j.id"), F.col("j.absolute_url"), F.col("j.title"), iso_timestamp(F.col("j.updated_at")), html_to_text(html_unescape(F.col("j.content"))))


def lever(p: DataFrame) -> DataFrame:
    """A bare list of plain-text parts; no change signal."""
    r = _rows(p, "id string, hostedUrl string, text string, descriptionPlain string, additionalPlain string", "$")
    body = F.concat_ws("\n\n", *[_present(F.col(f"j.{c}")) for c in ("text", "descriptionPlain", "additionalPlain")])
    return _unify(r, F.col("j.id"), F.col("j.hostedUrl"), F.col("j.text"), None, body)


def ashby(p: DataFrame) -> DataFrame:
    """Unlisted jobs are left out, jobs that do not say stay."""
    r = _rows(p, "id string, jobUrl string, title string, isListed boolean, descriptionPlain string, descriptionHtml string", "$.jobs").filter(F.coalesce("j.isListed", F.lit(True)))
    return _unify(r, F.col("j.id"), F.col("j.jobUrl"), F.col("j.title"), None, F.coalesce(_present(F.col("j.descriptionPlain")), html_to_text(F.col("j.descriptionHtml"))))


def workable(p: DataFrame) -> DataFrame:
    r = _rows(p, "shortcode string, url string, title string, description string, requirements string, benefits string", "$.jobs")
    body = F.concat_ws("\n", *[_present(F.col(f"j.{c}")) for c in ("description", "requirements", "benefits")])
    return _unify(r, F.col("j.shortcode"), F.col("j.url"), F.col("j.title"), None, html_to_text(body))


def smartrecruiters(p: DataFrame) -> DataFrame:
    """Paged; the public URL is put together where it is absent; no content inline."""
    r = _rows(p, "id string, postingUrl string, name string, releasedDate string", "$.content")
    url = F.coalesce(_present(F.col("j.postingUrl")), F.concat(F.lit("https://jobs.smartrecruiters.com/"), F.col("board_token"), F.lit("/"), F.col("j.id")))
    return _unify(r, F.col("j.id"), url, F.col("j.name"), iso_timestamp(F.col("j.releasedDate")))


def rippling(p: DataFrame) -> DataFrame:
    r = _rows(p, "uuid string, url string, name string", "$.items", "$.jobs", "$")
    return _unify(r, F.col("j.uuid"), F.col("j.url"), F.col("j.name"))


def breezy(p: DataFrame) -> DataFrame:
    r = _rows(p, "id string, url string, name string, published_date string", "$")
    return _unify(r, F.col("j.id"), F.col("j.url"), F.col("j.name"), iso_timestamp(F.col("j.published_date")))


def usajobs(p: DataFrame) -> DataFrame:
    """Nested items; five detail fields, each a string or a list."""
    fields = ("JobSummary", "MajorDuties", "Requirements", "Qualifications", "Evaluations")
    details = ", ".join(f"{f}: string" for f in fields)
    item = f"MatchedObjectId string, MatchedObjectDescriptor struct<PositionID: string, PositionURI: string, PositionTitle: string, PublicationStartDate: string, UserArea: struct<Details: struct<{details}>>>"
    r = _rows(p, item, "$.SearchResult.SearchResultItems")
    d = "j.MatchedObjectDescriptor"
    body = F.concat_ws("\n\n", *[flatten_text(F.col(f"{d}.UserArea.Details.{f}")) for f in fields])
    return _unify(r, F.coalesce(_present(F.col("j.MatchedObjectId")), F.col(f"{d}.PositionID")), F.col(f"{d}.PositionURI"), F.col(f"{d}.PositionTitle"), iso_timestamp(F.col(f"{d}.PublicationStartDate")), html_to_text(body))


#: Kinds of boards; extend it to add one.
ADAPTERS: dict[str, Adapter] = {
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workable": workable,
    "smartrecruiters": smartrecruiters, "rippling": rippling, "breezy": breezy, "usajobs": usajobs,
}
#: Where each kind keeps its items, for the shape check.
_SHAPES = {
    "greenhouse": ("$.jobs",), "lever": ("$",), "ashby": ("$.jobs",), "workable": ("$.jobs",), "smartrecruiters": ("$.content",),
    "rippling": ("$.items", "$.jobs", "$"), "breezy": ("$",), "usajobs": ("$.SearchResult.SearchResultItems",),
}


def register_board(kind: str, adapter: Adapter, *shape: str) -> None:
    ADAPTERS[kind] = adapter
    _SHAPES[kind] = shape or ("$",)


def pack(bodies: DataFrame, root: str) -> None:
    """Land payloads (kind, board_token, page_no, body) many to a file, where a file for each would be too many."""
    bodies.select("kind", "board_token", F.col("page_no").cast("int").alias("page_no"), "body").repartition("kind", F.pmod(F.xxhash64("board_token"), F.lit(32))).write.mode("append").partitionBy("kind").parquet(root)


def payloads(spark: SparkSession, root: str, kind: str, packed: bool = False) -> DataFrame:
    """Whole payload files of one kind: board_token, page_no (from the file name, 1 if it has none), body; ``packed`` ones are those of :func:`pack`."""
    if packed:
        return spark.read.schema("kind string, board_token string, page_no int, body string").parquet(root).filter(F.col("kind") == kind).select("board_token", "page_no", "body")
    raw = spark.read.text(f"{root}/kind={kind}", wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("body"), F.col("_metadata.file_path").alias("path"))
    number = F.regexp_extract(F.substring_index("path", "/", -1), r"(\d+)\D*$", 1)
    return raw.select(F.regexp_extract("path", r"board=([^/]+)/", 1).alias("board_token"), F.coalesce(F.try_to_number(number, F.lit("999999999")).cast("int"), F.lit(1)).alias("page_no"), "body")


def enumerate_board(kind: str, bodies: DataFrame) -> DataFrame:
    """Unified rows of one kind's payloads.  An unknown kind is an error."""
    if kind not in ADAPTERS:
        raise ValueError(f"unknown board kind {kind!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[kind](bodies).select(F.lit(kind).alias("kind"), *_UNIFIED)


def enumerate_all(spark: SparkSession, root: str, kinds: list[str] | None = None, packed: bool = False) -> DataFrame:
    """Unified rows of all kinds under ``root``."""
    out = None
    for kind in kinds or list(ADAPTERS):
        rows = enumerate_board(kind, payloads(spark, root, kind, packed))
        out = rows if out is None else out.unionByName(rows)
    return out


def _items(kind: str) -> Column:
    """Number of items of a payload of this kind, null where its list is missing."""
    if kind not in _SHAPES:
        raise ValueError(f"unknown board kind {kind!r}")
    return F.coalesce(*[F.json_array_length(F.col("body") if p == "$" else F.get_json_object("body", p)) for p in _SHAPES[kind]])


def _page_rows(bodies: DataFrame, kind: Column, items: Column) -> DataFrame:
    return bodies.select(kind.alias("kind"), "board_token", "page_no", F.coalesce(items, F.lit(0)).alias("n_items"), F.get_json_object("body", "$.totalFound").cast("int").alias("total_found"), items.isNull().alias("corrupt"))


def pages(kind: str, bodies: DataFrame) -> DataFrame:
    """One row per payload for the completeness check: kind, board_token, page_no, n_items, total_found, corrupt."""
    return _page_rows(bodies, F.lit(kind), _items(kind))


def pages_of_kinds(bodies: DataFrame, kinds: Iterable[str] | None = None) -> DataFrame:
    """:func:`pages` for payloads with their kind in a column, read once for all kinds; those of other kinds are left out."""
    alike: dict[tuple[str, ...], list[str]] = {}
    for kind in ADAPTERS if kinds is None else kinds:
        alike.setdefault(_SHAPES.get(kind, (kind,)), []).append(kind)
    items = reduce(lambda c, same: c.when(F.col("kind").isin(same), _items(same[0])), alike.values(), F)
    return _page_rows(bodies.filter(F.col("kind").isin(sum(alike.values(), []))), F.col("kind"), items)

"""Catalog of postings: crawl decisions, ingest behind a content-hash gate, closing, precedence of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.seniority import seniority_from_title
from matchloom.functions.text import content_hash
from matchloom.functions.urls import canonical_key_for_url
from matchloom.operators.ranks import WINDOW_ROWS, largest_group, numbered
from matchloom.operators.shared import hinted, written
from matchloom.operators.store import COALESCE_NEW, KEEP_OLD, upsert
from matchloom.schemas import POSTING_EXTRACTION_VERSION

SHORTEST_CONTENT = 200
SMART_PAGE_CAP, USA_PAGE_CAP, USA_PAGE = 50, 40, 250


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def due_sources(sources: DataFrame, now: Column, failure_limit: int = 5) -> DataFrame:
    """Sources to crawl at ``now``, never crawled ones first, then the longest waiting."""
    waiting = F.col("last_crawled_at").isNull() | (F.col("last_crawled_at") < now - F.make_dt_interval(secs=F.col("crawl_interval_seconds")))
    return sources.filter(F.col("enabled") & (F.col("consecutive_failures") < failure_limit) & waiting).orderBy(F.asc_nulls_first("last_crawled_at"), "source_id")


def keyed(discovered: DataFrame, one_per_key: bool = True) -> DataFrame:
    """Enumerated rows with their catalog key and content hash; of rows that share a key the last external id stays."""
    rows = discovered.withColumn("canonical_key", canonical_key_for_url(F.col("url"))).withColumn("new_hash", content_hash(F.col("content")))
    if not one_per_key:
        return rows
    w = Window.partitionBy("canonical_key").orderBy(F.desc_nulls_last("updated_at"), F.desc("external_id"))
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def crawl_actions(found: DataFrame, catalog: DataFrame, version: int = POSTING_EXTRACTION_VERSION) -> DataFrame:
    """Decision per enumerated row against the catalog: ``action`` and ``gate_hit``.

    Inline content of at least 200 characters is ingested (``gate_hit`` says
    whether hash and extraction are current); shorter content is only
    heartbeaten; without content an unseen, empty or newer posting is fetched
    and any other skipped as unchanged.
    """
    known = catalog.select("canonical_key", F.lit(True).alias("seen"), F.col("content_hash").alias("old_hash"), F.col("extraction_version").alias("old_version"), F.col("source_updated_at").alias("old_updated"), (F.length("raw_text") > 0).alias("has_text"))
    rows = found.join(known, "canonical_key", "left")
    size = F.length("content")
    needs = F.col("seen").isNull() | ~F.coalesce("has_text", F.lit(False)) | F.col("updated_at").isNull() | F.col("old_updated").isNull() | (F.col("updated_at") > F.col("old_updated"))
    action = F.when(size >= SHORTEST_CONTENT, "ingest").when(size > 0, "too_short").when(needs, "fetch").otherwise("skip")
    gate = (action == "ingest") & F.coalesce(F.col("new_hash") == F.col("old_hash"), F.lit(False)) & F.col("old_version").eqNullSafe(version)
    return rows.select(*found.columns, action.alias("action"), gate.alias("gate_hit"), F.col("seen").isNotNull().alias("known"))


def merge_crawl(catalog: DataFrame, actions: DataFrame, now: Column, companies: DataFrame | None = None) -> DataFrame:
    """Catalog after a crawl: ingested rows merged behind the gate, everything else that was seen heartbeaten.

    A gate miss replaces text and hash and clears the extraction version.  All
    rows seen are reopened.  Title and level come from the listing if it
    states them; company from ``companies`` (source_id, company) first.
    """
    seen = actions.filter("action = 'ingest' or known")
    if companies is not None:
        seen = seen.join(F.broadcast(companies.select("source_id", F.col("company").alias("_board"))), "source_id", "left")
    else:
        seen = seen.withColumn("_board", F.lit(None).cast("string"))
    ingest = (F.col("action") == "ingest") & ~F.col("gate_hit")
    blank = lambda kind: F.lit(None).cast(kind)
    updates = seen.select(
        "canonical_key",
        "url",
        F.when(ingest, F.col("new_hash")).otherwise(blank("string")).alias("content_hash"),
        F.when(ingest, F.col("content")).otherwise(blank("string")).alias("raw_text"),
        ingest.alias("_replaced"),
        "source_id",
        F.col("updated_at").alias("source_updated_at"),
        blank_to_null(F.col("title")).alias("title"),
        F.col("_board").alias("company"),
        seniority_from_title(F.col("title")).alias("seniority"),
        now.alias("first_seen_at"),
        now.alias("last_seen_at"),
    )
    rules = {
        "url": KEEP_OLD, "content_hash": COALESCE_NEW, "raw_text": COALESCE_NEW, "source_id": COALESCE_NEW, "source_updated_at": COALESCE_NEW, "title": COALESCE_NEW,
        "company": COALESCE_NEW, "seniority": COALESCE_NEW, "first_seen_at": KEEP_OLD,
        "extraction_version": F.when(F.coalesce(F.col("new._replaced"), F.lit(False)), F.lit(None).cast("int")).otherwise(F.col("old.extraction_version")),
        "closed_at": F.lit(None).cast("timestamp"),
    }
    return upsert(catalog, updates, ["canonical_key"], rules)


def merge_fetched(catalog: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """Pages fetched one by one (url, raw_text and maybe source_id, company, title, updated_at) merged by the same rules."""
    cols = set(fetched.columns)
    pick = lambda c, kind: F.col(c).cast(kind) if c in cols else F.lit(None).cast(kind)
    rows = fetched.select("url", F.col("raw_text").alias("content"), pick("source_id", "long").alias("source_id"), pick("title", "string").alias("title"), pick("company", "string").alias("company"), pick("updated_at", "timestamp").alias("updated_at"), F.lit("").alias("external_id"))
    rows = keyed(rows)
    known = catalog.select("canonical_key", F.col("content_hash").alias("_old"), F.lit(True).alias("_k"))
    rows = rows.join(known, "canonical_key", "left")
    changed = ~F.coalesce(F.col("new_hash") == F.col("_old"), F.lit(False))
    updates = rows.select("canonical_key", "url", F.col("new_hash").alias("content_hash"), F.col("content").alias("raw_text"), "source_id", F.col("updated_at").alias("source_updated_at"), blank_to_null(F.col("title")).alias("title"), blank_to_null(F.col("company")).alias("company"), seniority_from_title(F.col("title")).alias("seniority"), now.alias("first_seen_at"), now.alias("last_seen_at"), changed.alias("_replaced"))
    rules = {
        "source_id": COALESCE_NEW, "source_updated_at": COALESCE_NEW, "title": COALESCE_NEW, "company": COALESCE_NEW, "seniority": COALESCE_NEW, "first_seen_at": KEEP_OLD,
        "extraction_version": F.when(F.coalesce(F.col("new._replaced"), F.lit(False)), F.lit(None).cast("int")).otherwise(F.col("old.extraction_version")),
        "closed_at": F.lit(None).cast("timestamp"),
    }
    return upsert(catalog, updates, ["canonical_key"], rules)


def completeness(pages: DataFrame) -> DataFrame:
    """Which (source_id, crawl_id) were read whole, from one row per page: kind, page_no, n_items, total_found, corrupt.

    No page may be corrupt, and a paged walk must have ended by its own rule, not by the cap on pages.
    """
    last = F.max_by(F.struct("n_items", "total_found", "page_no"), "page_no")
    per = pages.groupBy("source_id", "crawl_id", "kind").agg(F.max(F.coalesce("corrupt", F.lit(False))).alias("corrupt"), last.alias("l"), F.sum("n_items").alias("n"), F.count("*").alias("pages"))
    ended = (
        F.when(F.col("kind") == "smartrecruiters", (F.col("l.n_items") == 0) | (F.col("n") >= F.coalesce("l.total_found", F.lit(0))))
        .when(F.col("kind") == "usajobs", F.col("l.n_items") < USA_PAGE)
        .otherwise(F.lit(True))
    )
    return per.select("source_id", "crawl_id", (~F.col("corrupt") & ended).alias("complete"))


def close_missing(catalog: DataFrame, seen_keys: DataFrame, complete_sources: DataFrame, now: Column) -> DataFrame:
    """Open postings of wholly read sources that the crawl did not list get a tombstone; nothing is deleted."""
    done = F.broadcast(complete_sources.select("source_id").distinct().withColumn("_done", F.lit(True)))
    rows = catalog.join(seen_keys.select("canonical_key").distinct().withColumn("_seen", F.lit(True)), "canonical_key", "left").join(done, "source_id", "left")
    gone = F.col("closed_at").isNull() & F.col("_done").isNotNull() & F.col("_seen").isNull()
    return rows.withColumn("closed_at", F.when(gone, now).otherwise(F.col("closed_at"))).select(*catalog.columns)


def crawl_summary(actions: DataFrame, *by: str) -> DataFrame:
    """Counts per crawl and the gate's hit rate (four places, 0 without ingests)."""
    is_ = lambda a: F.count_if(F.col("action") == a)
    hits, misses = F.count_if("gate_hit"), F.count_if((F.col("action") == "ingest") & ~F.col("gate_hit"))
    rate = F.when(hits + misses > 0, F.bround(hits / (hits + misses), 4)).otherwise(0.0)
    return actions.groupBy(*by).agg(F.count("*").alias("enumerated"), is_("ingest").alias("ingested"), is_("fetch").alias("enqueued"), is_("skip").alias("unchanged"), is_("too_short").alias("too_short"), hits.alias("gate_hits"), misses.alias("gate_misses"), rate.alias("hit_rate"))


def merge_extraction(postings: DataFrame, extracted: DataFrame, version: int = POSTING_EXTRACTION_VERSION) -> DataFrame:
    """Postings after extraction (posting_id, struct ``extracted``): board values and stated levels win over extracted ones, those over old ones."""
    rows = postings.join(extracted.select("posting_id", "extracted"), "posting_id", "left")
    x = lambda c: blank_to_null(F.col(f"extracted.{c}"))
    hit = F.col("extracted").isNotNull()
    board = F.col("source_id").isNotNull()
    company = F.when(board & F.col("company").isNotNull(), F.col("company")).otherwise(F.coalesce(x("company"), F.col("company")))
    title = F.coalesce(x("title"), F.col("title"))
    merged = {
        "title": title,
        "company": company,
        "location": F.coalesce(x("location"), F.col("location")),
        "remote_type": F.coalesce(x("remote_type"), F.col("remote_type")),
        "seniority": F.coalesce(seniority_from_title(F.col("title")), x("seniority"), F.col("seniority")),
        "min_years": F.coalesce(F.col("extracted.min_years_experience").cast("decimal(4,1)"), F.col("min_years").cast("decimal(4,1)")),
        "extraction_version": F.lit(version),
    }
    return rows.select(*[F.when(hit, merged[c]).otherwise(F.col(c)).alias(c) if c in merged else F.col(c) for c in postings.columns])


def stale_extractions(rows: DataFrame, version: int) -> DataFrame:
    """Rows never extracted, or by another version."""
    return rows.filter(~F.col("extraction_version").eqNullSafe(version))


def needs_preparation(postings: DataFrame, limit: int | None = None, version: int = POSTING_EXTRACTION_VERSION) -> DataFrame:
    """Open postings without a current extraction or an embedding, in order of identifiers."""
    rows = postings.filter(F.col("closed_at").isNull() & (F.col("embedding").isNull() | ~F.col("extraction_version").eqNullSafe(version))).orderBy("posting_id")
    return rows if limit is None else rows.limit(limit)


def disallowed(frontier: DataFrame, rules: DataFrame) -> DataFrame:
    """Frontier rows (host, path) their host forbids; of the rules (host, seq, allow, prefix) the first that fits counts, none allows.

    A path is looked up by its beginnings of the lengths that the host's rules
    have, so it meets the rules that fit and no others, however many a host
    has.  Rules are read twice.
    """
    known = rules.filter("host IS NOT NULL AND prefix IS NOT NULL").groupBy("host", "prefix").agg(F.min_by("allow", "seq").alias("allow"), F.min("seq").alias("seq"))
    lengths = written(rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths")))
    pieces = frontier.select("url", "host", "path").join(hinted(lengths), "host")
    pieces = pieces.select("url", "host", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("prefix"))
    first = pieces.join(written(known).hint("merge"), ["host", "prefix"]).groupBy("url").agg(F.min_by("allow", "seq").alias("allow"))
    return first.filter(~F.col("allow")).select("url")


def allowed(frontier: DataFrame, rules: DataFrame) -> DataFrame:
    return frontier.join(disallowed(frontier, rules).hint("merge"), "url", "left_anti")


def pace(frontier: DataFrame, t0: Column, rate: float = 1.0, burst: int = 3, most_wait: float = 10.0, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Start time of each request of a batch that is ready at ``t0``: the k-th of a host waits max(0, (k - burst) / rate) seconds.

    Hosts of more than ``window_rows`` requests are numbered over sorted
    ranges, so that they do not meet in one task.
    """
    if largest_group(frontier, ["host"]) > window_rows:
        placed = numbered(frontier, ["host"], ["url"], "_k")
    else:
        placed = frontier.withColumn("_k", F.row_number().over(Window.partitionBy("host").orderBy("url")))
    wait = F.greatest(F.lit(0.0), (F.col("_k") - burst) / rate)
    placed = placed.withColumn("wait_s", wait).drop("_k")
    return placed.withColumn("starts_at", (t0.cast("timestamp").cast("double") + F.col("wait_s")).cast("timestamp")).withColumn("released", F.col("wait_s") > most_wait)

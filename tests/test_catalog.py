import pytest
from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.operators import catalog, jobs, maintenance, ops, profiles, store

LONG = "word " * 60


def now():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


def empty(spark, table):
    return spark.createDataFrame([], schemas.schema_of(table))


def found(spark, rows):
    return spark.createDataFrame(rows, "source_id long, external_id string, url string, title string, updated_at timestamp, content string")


def crawl(spark, cat, rows, companies=None):
    acts = catalog.crawl_actions(catalog.keyed(found(spark, rows)), cat)
    return acts, catalog.merge_crawl(cat, acts, now(), companies)


def state(df):
    return {r.url: r for r in df.collect()}


def test_two_crawls(spark):
    rows = [(1, "a", "https://e.com/a/", "Senior Dev", None, LONG), (1, "b", "https://e.com/b", None, None, "short"), (1, "c", "https://e.com/c", "Dev", None, None)]
    companies = spark.createDataFrame([(1, "Acme")], "source_id long, company string")
    acts, cat = crawl(spark, empty(spark, "postings"), rows, companies)
    assert {r.external_id: r.action for r in acts.collect()} == {"a": "ingest", "b": "too_short", "c": "fetch"}
    s = state(cat)
    assert set(s) == {"https://e.com/a/"}
    a = s["https://e.com/a/"]
    assert (a.seniority, a.company, a.extraction_version, a.closed_at) == ("senior", "Acme", None, None)
    extracted = spark.createDataFrame([(None,)], "x string").limit(0)
    assert extracted.count() == 0
    cat = cat.withColumn("extraction_version", F.lit(2)).withColumn("posting_id", F.lit(1).cast("long"))
    acts, again = crawl(spark, cat, rows, companies)
    assert {r.external_id: r.gate_hit for r in acts.collect()}["a"] is True
    assert sorted(map(str, again.collect())) == sorted(map(str, crawl(spark, again, rows, companies)[1].collect()))
    changed = [(1, "a", "https://e.com/a", "Dev", None, LONG + "more")]
    acts, cat2 = crawl(spark, again, changed, companies)
    a = cat2.first()
    assert a.extraction_version is None and a.raw_text.endswith("more") and a.seniority == "senior" and a.title == "Dev"
    summary = catalog.crawl_summary(acts).first()
    assert (summary.enumerated, summary.gate_misses, summary.hit_rate) == (1, 1, 0.0)


def test_shrunk_content_is_heartbeaten_not_closed(spark):
    _, cat = crawl(spark, empty(spark, "postings"), [(1, "a", "https://e.com/a", "T", None, LONG)])
    cat = cat.withColumn("last_seen_at", F.lit("2020-01-01").cast("timestamp"))
    acts, after = crawl(spark, cat, [(1, "a", "https://e.com/a", "T", None, "tiny")])
    done = spark.createDataFrame([(1,)], "source_id long")
    r = catalog.close_missing(after, acts, done, now()).first()
    assert r.closed_at is None and r.raw_text == LONG and str(r.last_seen_at) == "2024-03-01 00:00:00"


def test_closing_needs_a_whole_listing_and_reopens(spark):
    _, cat = crawl(spark, empty(spark, "postings"), [(1, "a", "https://e.com/a", "T", None, LONG), (2, "b", "https://f.com/b", "T", None, LONG)])
    pages = spark.createDataFrame([(1, 9, "greenhouse", 1, 0, None, False), (2, 9, "smartrecruiters", 1, 100, 250, False)], "source_id long, crawl_id long, kind string, page_no int, n_items int, total_found int, corrupt boolean")
    ok = {r.source_id: r.complete for r in catalog.completeness(pages).collect()}
    assert ok == {1: True, 2: False}
    seen = spark.createDataFrame([], "canonical_key string")
    closed = catalog.close_missing(cat, seen, catalog.completeness(pages).filter("complete"), now())
    s = state(closed)
    assert s["https://e.com/a"].closed_at is not None and s["https://f.com/b"].closed_at is None
    _, back = crawl(spark, closed, [(1, "a", "https://e.com/a", "T", None, LONG)])
    assert state(back)["https://e.com/a"].closed_at is None


def test_fetched_pages_follow_the_same_rules(spark):
    _, cat = crawl(spark, empty(spark, "postings"), [(1, "a", "https://e.com/a", "Senior T", None, LONG)])
    cat = cat.withColumn("extraction_version", F.lit(2)).withColumn("closed_at", now())
    same = catalog.merge_fetched(cat, spark.createDataFrame([("https://e.com/a/?ref=1", LONG)], "url string, raw_text string"), now()).first()
    assert same.extraction_version == 2 and same.closed_at is None and same.seniority == "senior"
    new = catalog.merge_fetched(cat, spark.createDataFrame([("https://e.com/a", "other")], "url string, raw_text string"), now()).first()
    assert new.extraction_version is None and new.raw_text == "other"


def test_merge_extraction_precedence(spark):
    p = spark.createDataFrame([(1, 5, "Senior Dev", "Board Co", None, None, None, None, None), (2, None, "Dev", "Old Co", None, None, "mid", 3.0, None)], "posting_id long, source_id long, title string, company string, location string, remote_type string, seniority string, min_years double, extraction_version int")
    x = spark.createDataFrame([(1, ("X", "Extracted Co", "Rome", "remote", "junior", None)), (2, ("", "Extracted Co", "", "", "staff", 2.0))], "posting_id long, extracted struct<title:string,company:string,location:string,remote_type:string,seniority:string,min_years_experience:double>")
    r = {v.posting_id: v for v in catalog.merge_extraction(p, x).collect()}
    assert (r[1].title, r[1].company, r[1].location, r[1].seniority, r[1].extraction_version) == ("X", "Board Co", "Rome", "senior", 2)
    assert (r[2].title, r[2].company, r[2].seniority, float(r[2].min_years)) == ("Dev", "Extracted Co", "staff", 2.0)
    assert catalog.stale_extractions(p, 2).count() == 2


def test_due_sources(spark):
    rows = [(1, True, "2024-02-27", 86400, 0), (2, True, None, 86400, 0), (3, False, None, 86400, 0), (4, True, "2024-02-20", 86400, 5), (5, True, "2024-02-29", 86400, 0)]
    s = spark.createDataFrame(rows, "source_id long, enabled boolean, t string, crawl_interval_seconds int, consecutive_failures int").withColumn("last_crawled_at", F.col("t").cast("timestamp"))
    assert [r.source_id for r in catalog.due_sources(s, now()).collect()] == [2, 1]


def test_robots_and_pacing(spark):
    f = spark.createDataFrame([("u1", "e.com", "/jobs/1"), ("u2", "e.com", "/private/x"), ("u3", "f.com", "/private")], "url string, host string, path string")
    rules = spark.createDataFrame([("e.com", 1, True, "/private/x"), ("e.com", 2, False, "/private"), ("e.com", 3, False, "/jobs")], "host string, seq int, allow boolean, prefix string")
    assert {r.url for r in catalog.allowed(f, rules).collect()} == {"u2", "u3"}
    many = spark.range(6).select(F.lit("e.com").alias("host"), F.col("id").alias("url"))
    assert sorted(r.wait_s for r in catalog.pace(many, now()).collect()) == [0, 0, 0, 1, 2, 3]


def test_upsert_rules(spark):
    old = spark.createDataFrame([(1, "a", "x", 1), (2, "b", "y", 1)], "k int, r string, c string, n int")
    new = spark.createDataFrame([(2, "B", None, 5), (3, "C", "z", 5)], "k int, r string, c string, n int")
    got = store.upsert(old, new, ["k"], {"c": store.COALESCE_NEW, "n": F.coalesce("old.n", F.lit(0)) + F.col("new.n")})
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", "x", 1), (2, "B", "y", 6), (3, "C", "z", 5)]
    with pytest.raises(ValueError, match="unknown rule"):
        store.upsert(old, new, ["k"], {"c": "guess"})


def test_snapshot_store(spark, tmp_path):
    s = store.SnapshotStore(spark, str(tmp_path))
    with pytest.raises(FileNotFoundError):
        s.read("t")
    first = s.write("t", spark.range(3).withColumn("v", F.lit("a")))
    s.upsert("t", spark.createDataFrame([(2, "b"), (9, "c")], "id long, v string"), ["id"], {})
    assert {(r.id, r.v) for r in s.read("t").collect()} == {(0, "a"), (1, "a"), (2, "b"), (9, "c")} and first.count() == 3
    s.append("t", spark.createDataFrame([(10, "d")], "id long, v string"))
    assert s.read("t").count() == 5


def test_batches(spark):
    text = ["https://E.com/1", "", "https://e.com/1?ref=x", "prose here", "https://e.com/2", "https://e.com/3"]
    lines = spark.createDataFrame([(7, n, t) for n, t in enumerate(text)], "batch_id long, line_no int, line string")
    assert [r.outcome for r in jobs.parse_url_lines(lines, 2).orderBy("line_no").collect()] == ["accepted", "duplicate", "rejected", "accepted", "over_cap"]
    b = spark.createDataFrame([(7, 1, 3)], "batch_id long, user_id long, profile_id long")
    none = empty(spark, "ingest_jobs")
    counts, new = jobs.create_batches(lines, b, none, 2)
    assert counts.first().asDict() == {"batch_id": 7, "user_id": 1, "profile_id": 3, "total_urls": 2, "rejected_urls": 2, "duplicate_urls": 1}
    running = new.limit(1).withColumn("status", F.lit("running"))
    assert jobs.create_batches(lines, b, running, 2)[0].first().total_urls == 1
    assert jobs.create_batches(lines, b, new.withColumn("status", F.lit("succeeded")), 2)[0].first().total_urls == 2
    existing, insert = jobs.split_submitted(new, new.withColumn("job_id", F.lit(1)).withColumn("created_at", now()))
    assert (existing.count(), insert.count()) == (2, 0)


def test_job_failure_and_requeue(spark):
    j = spark.createDataFrame([(1, "running", 1, 5), (2, "running", 4, None), (3, "running", 1, None), (4, "succeeded", 1, None)], "job_id long, status string, attempts int, batch_id long").withColumn("last_error", F.lit(None).cast("string")).withColumn("updated_at", F.lit(None).cast("timestamp"))
    bad = spark.createDataFrame([(1, "x" * 3000, False), (2, "t", False), (3, "404", True)], "job_id long, error string, permanent boolean")
    f = jobs.fail(j, bad, now())
    r = {x.job_id: x for x in f.collect()}
    assert [r[k].status for k in (1, 2, 3, 4)] == ["failed", "dead", "dead", "succeeded"] and len(r[1].last_error) == 2000
    good, refused = jobs.requeue(f, spark.createDataFrame([(1,), (2,), (4,), (9,)], "job_id long"), now())
    assert {(x.job_id, x.queue, x.attempts) for x in good.collect()} == {(1, "ingest", 0), (2, "interactive", 0)}
    assert {(x.job_id, x.reason) for x in refused.collect()} == {(4, "job is succeeded"), (9, "no such job")}


def test_lifecycle_ignores_replays(spark):
    e = [(1, 1, "started", "2024-01-01", None, None, None), (1, 2, "failed", "2024-01-01", "t", False, None), (1, 3, "started", "2024-01-01", None, None, None), (1, 4, "succeeded", "2024-01-01", None, None, 77), (1, 5, "started", "2024-01-02", None, None, None), (2, 1, "started", "2024-01-01", None, None, None), (2, 2, "failed", "2024-01-01", "t", False, None)]
    ev = spark.createDataFrame(e, "job_id long, seq long, event string, ts string, error string, permanent boolean, posting_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    r = {x.job_id: x for x in jobs.fold_lifecycle(ev, 0.0).collect()}
    assert (r[1].status, r[1].attempts, r[1].last_error, r[1].posting_id) == ("succeeded", 2, None, 77)
    assert r[2].status == "failed" and str(r[2].next_attempt_at) == "2024-01-01 00:00:10"


def test_profiles(spark):
    p = spark.createDataFrame([(1, 1, True, "2024-01-01"), (2, 1, False, "2024-01-02"), (3, 1, False, "2024-01-02"), (4, 2, True, "2024-01-01")], "profile_id long, user_id long, is_active boolean, t string").withColumn("created_at", F.col("t").cast("timestamp")).drop("t")
    gone = spark.createDataFrame([(1,)], "profile_id long")
    m = spark.createDataFrame([(100, 1), (101, 4)], "match_id long, profile_id long")
    fb = spark.createDataFrame([(1, 100), (2, 101)], "id long, match_id long")
    out = profiles.delete_profiles({"profiles": p, "matches": m, "match_feedback": fb}, gone)
    assert {r.profile_id for r in out["profiles"].filter("is_active").collect()} == {3, 4}
    assert [r.match_id for r in out["matches"].collect()] == [101] and [r.id for r in out["match_feedback"].collect()] == [2]
    a = profiles.activate(p, spark.createDataFrame([(1, 2)], "user_id long, profile_id long"))
    assert {r.profile_id for r in a.filter("is_active").collect()} == {2, 4}
    new = spark.createDataFrame([(8, 9), (9, 9), (10, 1)], "profile_id long, user_id long").withColumn("created_at", now())
    assert {r.profile_id for r in profiles.add_profiles(p, new).filter("is_active").collect()} == {1, 4, 8}
    assert profiles.null_dangling(m, "profile_id", p.filter("profile_id <> 4"), "profile_id").filter("profile_id is null").count() == 1


def test_source_attempts_and_health(spark):
    s = spark.createDataFrame([(1, "A", None, 3), (2, "B", "2024-02-28", 0)], "source_id long, display_name string, t string, consecutive_failures int").select("source_id", "display_name", F.col("t").cast("timestamp").alias("last_crawled_at"), F.col("t").cast("timestamp").alias("last_success_at"), "consecutive_failures", F.lit(86400).alias("crawl_interval_seconds"))
    log = spark.createDataFrame([(1, "2024-02-29", False), (1, "2024-02-28", False), (2, "2024-02-29", True), (2, "2024-03-01", False)], "source_id long, t string, ok boolean").select("source_id", F.col("t").cast("timestamp").alias("ts"), "ok")
    r = {x.source_id: x for x in ops.fold_attempts(s, log).collect()}
    assert (r[1].consecutive_failures, r[1].last_success_at, r[2].consecutive_failures) == (5, None, 1)
    h = {x.source_id: x for x in ops.source_health(ops.fold_attempts(s, log), spark.createDataFrame([(1, None)], "source_id long, closed_at timestamp"), now()).collect()}
    assert (h[1].open_postings, h[1].is_stale, h[1].circuit_open, h[1].age) == (1, True, True, "never")
    assert (h[2].open_postings, h[2].is_stale, h[2].circuit_open) == (0, False, False)


def test_audit(spark):
    p = spark.createDataFrame([(1, "k", 9, "senior"), (2, "k", None, "boss")], "posting_id long, canonical_key string, source_id long, seniority string")
    s = spark.createDataFrame([(1, "lever", "t")], "source_id long, kind string, board_token string")
    got = {(r.rule, r.key, r.n) for r in schemas.audit({"postings": p, "sources": s}).collect()}
    assert got == {("unique(canonical_key)", "k", 2), ("vocabulary(seniority)", "boss", 1), ("reference(source_id)", "9", 1)}


def test_extraction_contract(spark):
    rows = ['{"title": "T", "seniority": "senior", "skills": [{"name": "Go", "necessity": "required"}]}', '{"title": 1, "skills": [}', '{"title": "T"}', '{"skills": [{"necessity": "required"}]}', '{"skills": [], "seniority": "boss"}', None]
    good, bad = schemas.parse_extraction(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string"), "raw")
    assert [r.i for r in good.collect()] == [0] and good.first().extracted.skills[0].name == "Go"
    assert {r.i: r.reason for r in bad.collect()} == {1: "malformed JSON", 2: "missing skills", 3: "unnamed skill", 4: "unknown seniority", 5: "no output"}


def test_backfills_and_purge(spark):
    p = spark.createDataFrame([(1, "url:a", 5, "Old", "Senior X", "mid"), (2, "load:b", None, "Own", "X", None), (3, "load:c", 5, "Board", None, None)], "posting_id long, canonical_key string, source_id long, company string, title string, seniority string")
    s = spark.createDataFrame([(5, "Board")], "source_id long, display_name string")
    fixed, changed, report = maintenance.backfill_company(p, s)
    assert {r.posting_id: r.company for r in fixed.collect()} == {1: "Board", 2: "Own", 3: "Board"}
    assert [(r.change, r.n) for r in report.collect()] == [("Old -> Board", 1)] and changed.count() == 1
    assert maintenance.backfill_company(fixed, s)[1].count() == 0
    assert maintenance.backfill_seniority(p)[1].count() == 1
    m = spark.createDataFrame([(1, 1), (2, 2)], "match_id long, posting_id long")
    out, removed = maintenance.purge({"postings": p, "matches": m}, "load:")
    assert out["matches"].count() == 1 and {(r.table, r.removed) for r in removed.collect()} == {("postings", 2), ("matches", 1)}


def test_seeding_keeps_operational_state(spark):
    s = spark.createDataFrame([(1, "lever", "t", "Old", False, 10, 4)], "source_id long, kind string, board_token string, display_name string, enabled boolean, crawl_interval_seconds int, consecutive_failures int")
    seeds = spark.createDataFrame([("lever", "t", "New", 20), ("ashby", "u", "U", 30)], "kind string, board_token string, display_name string, crawl_interval_seconds int")
    r = {x.kind: x for x in maintenance.seed_sources(s, seeds).collect()}
    assert (r["lever"].display_name, r["lever"].enabled, r["lever"].consecutive_failures, r["lever"].crawl_interval_seconds) == ("New", False, 4, 20) and r["ashby"].enabled

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import catalog, embed
from matchloom.plans import boards as plans
from matchloom.plans.boards import board_pages
from matchloom.sources import board_source, boards, texts
from matchloom.streaming import flows

PAYLOADS = {
    "greenhouse": {"jobs": [{"id": 1, "absolute_url": "https://g/1", "title": "T", "updated_at": "2024-01-02T03:04:05-01:00", "content": "&lt;p&gt;Hello &amp;amp; bye&lt;/p&gt;"}, {"id": 2}, {"id": 3, "absolute_url": "https://g/3", "content": None}]},
    "lever": [{"id": "a", "hostedUrl": "https://l/a", "text": "T", "descriptionPlain": "", "additionalPlain": "More"}, {"id": "b"}],
    "ashby": {"jobs": [{"id": "a", "jobUrl": "https://a/a", "title": "T", "isListed": False}, {"id": "b", "jobUrl": "https://a/b", "descriptionHtml": "<p>x</p>"}, {"id": "c", "jobUrl": "https://a/c", "isListed": True, "descriptionPlain": "plain"}]},
    "workable": {"jobs": [{"shortcode": "S", "url": "https://w/S", "title": "T", "description": "<p>a</p>", "benefits": "<p>b</p>"}]},
    "smartrecruiters": {"totalFound": 2, "content": [{"id": "9", "name": "N", "releasedDate": "2024-01-01"}, {"id": "8", "name": "M", "postingUrl": "https://s/8"}]},
    "rippling": {"items": [{"uuid": "u", "url": "https://r/u", "name": "N"}]},
    "breezy": [{"id": "z", "url": "https://b/z", "name": "N", "published_date": "2024-05-05T00:00:00Z"}],
    "usajobs": {"SearchResult": {"SearchResultItems": [{"MatchedObjectDescriptor": {"PositionID": "P", "PositionURI": "https://u/P", "PositionTitle": "N", "PublicationStartDate": "2024-01-01", "UserArea": {"Details": {"JobSummary": "Sum", "MajorDuties": ["d1", "d2"]}}}}]}},
}


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    root = tmp_path_factory.mktemp("landing")
    for kind, body in PAYLOADS.items():
        d = root / f"kind={kind}" / "board=acme"
        d.mkdir(parents=True)
        (d / "page-1.json").write_text(json.dumps(body))
    return str(root)


def test_all_boards(spark, landing):
    rows = {(r.kind, r.external_id): r for r in boards.enumerate_all(spark, landing).collect()}
    assert set(rows) == {("greenhouse", "1"), ("greenhouse", "3"), ("lever", "a"), ("ashby", "b"), ("ashby", "c"), ("workable", "S"), ("smartrecruiters", "9"), ("smartrecruiters", "8"), ("rippling", "u"), ("breezy", "z"), ("usajobs", "P")}
    g = rows["greenhouse", "1"]
    assert g.content == "Hello & bye" and str(g.updated_at) == "2024-01-02 04:04:05" and rows["greenhouse", "3"].content is None
    assert rows["lever", "a"].content == "T\n\nMore" and rows["ashby", "b"].content == "x" and rows["ashby", "c"].content == "plain"
    assert rows["workable", "S"].content == "a\nb" and rows["smartrecruiters", "9"].url == "https://jobs.smartrecruiters.com/acme/9"
    assert rows["usajobs", "P"].content == "Sum\nd1\nd2" and rows["breezy", "z"].updated_at is not None


def test_shapes_and_unknown_kinds(spark):
    bodies = spark.createDataFrame([("t", 1, '{"jobs": [1, 2]}'), ("u", 1, '{"error": 1}'), ("v", 1, "[]")], "board_token string, page_no int, body string")
    assert {r.board_token: (r.n_items, r.corrupt) for r in boards.pages("greenhouse", bodies).collect()} == {"t": (2, False), "u": (0, True), "v": (0, True)}
    assert {r.board_token: r.corrupt for r in boards.pages("rippling", bodies).collect()} == {"t": False, "u": True, "v": False}
    with pytest.raises(ValueError, match="greenhouse"):
        boards.enumerate_board("other", bodies)
    boards.register_board("own", boards.breezy)
    assert boards.enumerate_board("own", bodies).count() == 0
    del boards.ADAPTERS["own"]


def test_pages_of_kinds_equal_pages_of_each(spark):
    rows = [(kind, board, 1, body) for kind, good in PAYLOADS.items() for board, body in (("a", json.dumps(good)), ("b", json.dumps(good)[:30]), ("c", '{"error": 1}'), ("d", None))]
    bodies = spark.createDataFrame([*rows, ("other", "a", 1, "[1]"), (None, "a", 1, "[1]")], "kind string, board_token string, page_no int, body string")
    each = [r for kind in PAYLOADS for r in boards.pages(kind, bodies.filter(F.col("kind") == kind)).collect()]
    assert sorted(each, key=str) == sorted(boards.pages_of_kinds(bodies).collect(), key=str) and len(each) == len(rows)
    assert {r.kind for r in boards.pages_of_kinds(bodies, ["lever", "usajobs"]).collect()} == {"lever", "usajobs"}
    with pytest.raises(ValueError, match="other"):
        boards.pages_of_kinds(bodies, ["lever", "other"])


def test_orders_are_dealt_once_for_all_kinds(spark, tmp_path, capsys):
    spark.range(500).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "'O' AS o_orderstatus", "timestamp'2024-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    found = board_pages(spark, str(tmp_path))
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("FileScan") == plan.count("Exchange") == 1
    assert {(r.kind, r.board_token, r.n_items) for r in found.collect()} == {(k, f"b{n}", 100 if n else 0) for k in PAYLOADS for n in range(5)}


def test_url_lists_and_pages(spark, tmp_path):
    (tmp_path / "l.txt").write_bytes(b"\xef\xbb\xbfhttps://e.com/1\r\n\r\nhttps://e.com/2\n")
    assert [r.line for r in texts.url_lists(spark, str(tmp_path / "l.txt")).orderBy("line_no").collect()] == ["https://e.com/1", "https://e.com/2"]
    p = spark.createDataFrame([("u", "<p>x</p>"), ("v", "<nav>x</nav>"), ("w", None)], "url string, html string")
    assert [r.url for r in texts.non_empty_pages(p).collect()] == ["u"]
    assert {r.url: r.failure for r in texts.page_texts(p).collect()} == {"u": None, "v": "permanent", "w": "permanent"}
    (tmp_path / "s.csv").write_text("kind,board_token,display_name,crawl_interval_seconds\nlever,t,T,\n")
    assert texts.seed_list(spark, str(tmp_path / "s.csv")).first().crawl_interval_seconds == 86400


def test_chunks():
    assert embed.chunk("") == [] == embed.chunk(None)
    assert embed.chunk("a b\n\nc d", budget=10) == ["a b\nc d"]
    assert embed.chunk("a b c d e", budget=2, overlap=0) == ["a b", "c d", "e"]
    assert embed.chunk("a b\nc\nd e", budget=3, overlap=1) == ["a b\nc", "c\nd e"]
    for c in embed.chunk("\n".join("w" * (i % 7) + " x y z" for i in range(200)), budget=20, overlap=5):
        assert embed.words_in(c) <= 20


def test_embedding_is_pooled_to_unit_length(spark):
    d = spark.createDataFrame([(1, "go rust " * 300), (2, ""), (3, None), (4, "python")], "id int, t string")
    r = {x.id: x for x in embed.embed(d, "id", "t").collect()}
    assert r[1].n_chunks > 1 and abs(np.linalg.norm(r[1].embedding) - 1) < 1e-5 and r[2].embedding is None and r[3].n_chunks == 0
    v = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 1, [0.0, 1.0]), (2, 0, [1.0, 0.0]), (2, 1, [-1.0, 0.0])], "id int, chunk_no int, embedding array<float>")
    p = {x.id: [round(y, 4) for y in x.embedding] for x in embed.pool_vectors(v, "id").collect()}
    assert p == {1: [0.7071, 0.7071], 2: [1.0, 0.0]}
    assert embed.chunks(d.filter("id = 4"), "id", "t").select(F.col("chunk")).first().chunk == "python"


def page(spark, path, kind, board, number, body):
    df = spark.createDataFrame([(board, number, body)], "board_token string, page_no int, body string")
    board_source.land(df, kind, path)


def test_board_source_reads_pages_and_goes_on_by_board(spark, tmp_path):
    root, out, log = (str(tmp_path / x) for x in ("in", "out", "log"))
    board_source.register(spark)
    smart = lambda *ids: json.dumps({"totalFound": 3, "content": [{"id": i, "name": f"N{i}"} for i in ids]})
    page(spark, root, "smartrecruiters", "a", 1, smart("1", "2"))
    page(spark, root, "breezy", "x", 1, json.dumps(PAYLOADS["breezy"]))
    read = spark.read.format("boards").load(root)
    assert read.rdd.getNumPartitions() == 2
    assert {(r.kind, r.board_token, r.external_id) for r in board_source.listings(spark, root).collect()} == {("smartrecruiters", "a", "1"), ("smartrecruiters", "a", "2"), ("breezy", "x", "z")}
    assert spark.read.format("boards").option("together", 5).load(root).rdd.getNumPartitions() == 1
    assert {r.kind for r in spark.read.format("boards").option("kinds", "breezy").load(root).collect()} == {"breezy"}

    def drain():
        q = spark.readStream.format("boards").load(root).writeStream.format("parquet").option("checkpointLocation", log).trigger(availableNow=True).start(out)
        q.awaitTermination()
        return sorted((r.kind, r.board_token, r.page_no) for r in spark.read.parquet(out).collect())

    first = drain()
    assert first == [("breezy", "x", 1), ("smartrecruiters", "a", 1)]
    page(spark, root, "smartrecruiters", "b", 2, smart("9"))  # waits for page 1
    page(spark, root, "smartrecruiters", "a", 2, smart("3"))
    assert drain() == sorted([*first, ("smartrecruiters", "a", 2)])
    page(spark, root, "smartrecruiters", "b", 1, smart("7", "8"))
    assert drain() == sorted([*first, ("smartrecruiters", "a", 2), ("smartrecruiters", "b", 1), ("smartrecruiters", "b", 2)])
    walks = board_source.walked(spark.read.format("boards").load(root)).withColumn("crawl_id", F.lit(1))
    assert {r.source_id: r.complete for r in catalog.completeness(walks).collect()} == {"breezy/x": True, "smartrecruiters/a": True, "smartrecruiters/b": True}
    with pytest.raises(Exception, match="path"):
        spark.read.format("boards").load().count()


def test_pages_of_many_boards_share_files_and_the_last_answer_counts(spark, tmp_path):
    root = str(tmp_path / "in")
    board_source.register(spark)
    bodies = spark.range(3000).select(F.concat(F.lit("b"), (F.col("id") % 1000).cast("string")).alias("board_token"), (F.col("id") / 1000).cast("int").alias("page_no"), F.concat(F.lit("old\n"), F.col("id").cast("string")).alias("body")).withColumn("page_no", F.col("page_no") + 1)
    board_source.land(bodies, F.when(F.substring("board_token", 2, 9).cast("int") % 2 == 0, "lever").otherwise("breezy"), root)
    assert len(list((tmp_path / "in").rglob("*.parquet"))) <= 2 * board_source.SHELVES
    page(spark, root, "lever", "b4", 2, "new")
    got = {(r.kind, r.board_token, r.page_no): r.body for r in spark.read.format("boards").load(root).collect()}
    assert len(got) == 3000 and got.pop(("lever", "b4", 2)) == "new" and got["breezy", "b7", 3] == "old\n2007"
    (next((tmp_path / "in").glob("landing=*")) / "_SUCCESS").unlink()  # as if it were still being written
    assert spark.read.format("boards").load(root).count() in (1, 3000)


def test_a_stream_deals_shelves_not_boards(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")
    board_source.register(spark)
    bodies = spark.range(4000).select(F.concat(F.lit("b"), F.floor(F.col("id") / 2).cast("string")).alias("board_token"), (F.col("id") % 2 + 1).cast("int").alias("page_no"), F.lit("[]").alias("body"))
    board_source.land(bodies, "lever", root)
    reader = board_source.BoardStreamReader({"path": root})
    start, end = reader.initialOffset(), reader.latestOffset()
    assert len(json.dumps(end)) < 200 and len(reader.partitions(start, end)) <= board_source.SHELVES
    q = spark.readStream.format("boards").load(root).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    assert spark.read.parquet(out).distinct().count() == 4000 and len(list((tmp_path / "out").glob("*.parquet"))) <= board_source.SHELVES


def test_files_and_tasks_of_walks_do_not_grow_with_boards(spark, tmp_path, monkeypatch):
    spark.range(80_000).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority", "'O' AS o_orderstatus", "timestamp'2024-01-01' AS o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(plans, "shared_folder", lambda _: str(tmp_path / "in"))
    monkeypatch.setattr(flows, "shared_folder", lambda _: str(tmp_path / "read"))
    found = plans.board_walks(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found)) == sorted((f"smartrecruiters/b{n}", 2, False) for n in range(4, 800, 8))
    landed, read = (sum(not f.name.startswith(("_", ".")) for f in (tmp_path / x).rglob("*-*.*")) for x in ("in", "read/out"))
    assert 0 < landed <= 32 and 0 < read <= 32  # of 100 boards and 200 pages


def test_packed_payloads_share_files(spark, tmp_path):
    rows = [(kind, f"t{n}", 1, json.dumps(body)) for kind, body in PAYLOADS.items() for n in range(100)]
    boards.pack(spark.createDataFrame(rows, "kind string, board_token string, page_no int, body string"), str(tmp_path / "in"))
    assert len(list((tmp_path / "in").rglob("*.parquet"))) <= 32 * len(PAYLOADS) < len(rows)
    got = boards.enumerate_all(spark, str(tmp_path / "in"), packed=True)
    assert got.count() == 100 * 11 and got.select("kind", "board_token").distinct().count() == 800

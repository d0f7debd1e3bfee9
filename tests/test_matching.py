import math

import pytest
from pyspark.sql import functions as F

from matchloom.operators import feed, insights, maintenance, recall, scoring

SKILLS = "array<struct<name:string,years:double>>"
REQ = "array<struct<name:string,necessity:string,min_years:double,evidence:string>>"


def need(name, necessity="required", years=None):
    return (name, necessity, years, None)


def score(spark, requirements, held):
    df = spark.createDataFrame([(requirements, held)], f"r {REQ}, h {SKILLS}")
    v = scoring.verdicts(scoring.keyed_requirements(F.col("r")), scoring.candidate_map(F.col("h")))
    r = df.select(v.alias("v")).select("v", scoring.skill_score(F.col("v")).alias("s"), scoring.bucket_counts(F.col("v")).alias("c")).first()
    return r.s, [x.bucket for x in r.v], r.c


def test_score_order(spark):
    full, partial, missing = (score(spark, [need("Python", years=3.0), need("Go")], h)[0] for h in ([("python3", 5.0), ("golang", None)], [("Python", 1.0), ("Go", 1.0)], [("Rust", 9.0)]))
    assert full == 1.0 > partial > missing == 0.0
    assert score(spark, [], [("Go", 1.0)])[0] == 1.0


def test_buckets(spark):
    s, buckets, counts = score(spark, [need("A", years=2.0), need("B", "preferred"), need("C", years=1.0), need("D"), need("Integrity")], [("a", 2.0), ("c", None), ("B", 0.0)])
    assert buckets == ["matched", "matched", "partial", "missing"]
    assert math.isclose(s, (1 + 1 / 3 + 0.5) / (3 + 1 / 3))
    assert counts.asDict() == {"matched": 2, "partial": 1, "missing": 1, "missing_required": 1}


def test_of_equal_candidate_keys_the_last_counts(spark):
    assert score(spark, [need("ML Ops", years=3.0)], [("ml-ops", 5.0), ("ML ops", 1.0)])[1] == ["partial"]


def postings(spark):
    rows = [
        (1, [1.0, 0.0], None, 2, "remote", "senior", 2.0, 7), (2, [0.8, 0.6], None, 2, "onsite", "junior", 8.0, 7), (3, [0.6, 0.8], None, 2, None, None, None, 7),
        (4, [1.0, 0.0], "2024-01-01", 2, "remote", "senior", 1.0, 7), (5, None, None, 2, "remote", "senior", 1.0, 7), (6, [1.0, 0.0], None, None, "remote", "senior", 1.0, 7),
    ]
    df = spark.createDataFrame(rows, "posting_id long, embedding array<float>, closed_at string, extraction_version int, remote_type string, seniority string, min_years double, source_id long")
    return df.withColumn("closed_at", F.col("closed_at").cast("timestamp")).withColumn("requirements", F.array(F.struct(F.lit("Go").alias("name"), F.lit("required").alias("necessity"), F.lit(None).cast("double").alias("min_years"), F.lit(None).cast("string").alias("evidence"))))


def profiles(spark):
    return spark.createDataFrame([(10, 1, [1.0, 0.0], [("golang", 2.0)]), (11, 1, None, []), (12, 2, [0.0, 1.0], [])], f"profile_id long, user_id long, embedding array<float>, skills {SKILLS}")


def test_recall_guards_and_filters(spark):
    r = recall.recall(profiles(spark), postings(spark))
    assert [(x.posting_id, round(x.semantic_score, 4)) for x in r.filter("profile_id = 10").orderBy("rank").collect()] == [(1, 1.0), (2, 0.8), (3, 0.6)]
    ids = lambda f: {x.posting_id for x in recall.recall(profiles(spark), postings(spark), filters=f).collect()}
    assert ids(recall.FeedFilters(remote_only=True)) == {1}
    assert ids(recall.FeedFilters(seniority=("junior", "senior"))) == {1, 2}
    assert ids(recall.FeedFilters(max_min_years=5)) == {1, 3}
    assert recall.FeedFilters().is_empty and not recall.FeedFilters(remote_only=True).is_empty


def test_recall_forms_agree_over_blocks(spark):
    q = spark.range(300).select(F.col("id").alias("posting_id"), F.array(*[F.sin(F.col("id") * k).cast("float") for k in range(1, 9)]).alias("embedding"), F.lit(None).cast("timestamp").alias("closed_at"), F.lit(2).alias("extraction_version"))
    p = spark.range(7).select(F.col("id").alias("profile_id"), F.array(*[F.cos(F.col("id") * k).cast("float") for k in range(1, 9)]).alias("embedding"))
    key = lambda df: sorted((r.profile_id, r.rank, r.posting_id) for r in df.collect())
    exact = key(recall.recall(p, q, 20))
    assert exact == key(recall.recall(p, q, 20, block_rows=50)) == key(recall.recall_sql_form(p, q, 20))
    found = recall.recall_at_k(recall.recall(p, q, 20), recall.recall_cells(p, q, 20, cells=8)).first()
    assert found.recall >= 0.9


def test_recall_plan_limits_groups_early(spark, capsys):
    recall.recall_sql_form(profiles(spark), postings(spark)).explain()
    assert capsys.readouterr().out.count("WindowGroupLimit") >= 2


def test_feed_and_reading(spark):
    m = feed.build_feed(profiles(spark), postings(spark), scored_at=F.lit("2024-01-02").cast("timestamp"))
    rows = {(r.profile_id, r.posting_id): r for r in m.collect()}
    assert round(rows[10, 1].final_score, 6) == 1.0 and rows[10, 1].breakdown.counts.matched == 1
    assert rows[12, 1].breakdown.counts.missing_required == 1 and (11, 1) not in rows
    mine = spark.createDataFrame([(10,)], "profile_id long")
    assert [(r.posting_id, r.position, r.band) for r in feed.read_feed(m, postings(spark), mine, limit=2).orderBy("position").collect()] == [(1, 1, "high"), (2, 2, "high")]
    with pytest.raises(ValueError, match="recommendation"):
        feed.read_feed(m, postings(spark), mine, origin="x")
    with pytest.raises(ValueError, match="between 1 and 100"):
        feed.read_feed(m, postings(spark), mine, limit=0)
    assert feed.with_breakdown_defaults(m).filter("matched_count = 1").count() == 3
    assert {r.profile_id: r.state for r in feed.feed_currency(profiles(spark), m).collect()} == {10: "already_current", 11: "profile_not_ready", 12: "already_current"}
    assert feed.rescore_sweep(m.withColumn("scorer_version", F.lit(1))).count() == m.count() and feed.rescore_sweep(m).count() == 0
    assert not any(r.mixed for r in feed.scorer_generations(m).collect())


def test_rescoring_keeps_the_origin_and_is_idempotent(spark):
    m = feed.build_feed(profiles(spark), postings(spark), scored_at=F.lit("2024-01-02").cast("timestamp")).withColumn("match_id", F.monotonically_increasing_id()).withColumn("origin", F.lit("user_submission"))
    pairs = m.select("profile_id", "posting_id").unionByName(spark.createDataFrame([(12, 5)], "profile_id long, posting_id long"))
    scored = feed.score_pairs(pairs, profiles(spark), postings(spark)).withColumn("origin", F.lit("recommendation")).withColumn("scorer_version", F.lit(2)).withColumn("scored_at", F.lit("2024-02-02").cast("timestamp"))
    once = maintenance.upsert_matches(m.drop("feed_rank"), scored)
    twice = maintenance.upsert_matches(once, scored)
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect()))
    origins = {(r.profile_id, r.posting_id): r.origin for r in once.collect()}
    assert origins[12, 5] == "recommendation" and origins[10, 1] == "user_submission"
    assert once.filter("posting_id = 5").first().semantic_score == 0.0


def test_feedback(spark):
    fb = spark.createDataFrame([(1, 5, "interested", "2024-01-01"), (2, 5, "applied", "2024-01-02"), (3, 6, "interested", "2024-01-01"), (4, 6, "interested", "2024-01-01")], "id long, match_id long, verdict string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    assert {(r.match_id, r.id) for r in feed.latest_feedback(fb).collect()} == {(5, 2), (6, 4)}
    assert {(r.match_id, r.id) for r in feed.latest_feedback(fb, "interested").collect()} == {(5, 1), (6, 4)}
    assert {(r.match_id, r.id) for r in feed.latest_feedback(fb, "interested", mode="current").collect()} == {(6, 4)}
    f = {r.match_id: r for r in feed.feedback_funnel(fb).collect()}
    assert f[5].path == ["interested", "applied"] and f[5].applied and f[5].changes == 1 and f[6].changes == 0
    assert feed.append_feedback(fb, fb).count() == 8
    with pytest.raises(Exception, match="unknown verdict"):
        feed.append_feedback(fb, fb.withColumn("verdict", F.lit("maybe"))).collect()
    with pytest.raises(ValueError, match="interested, not_interested, applied"):
        feed.latest_feedback(fb, "maybe")


def test_gaps_fold_spellings_before_cutting(spark):
    v = spark.createDataFrame([("GraphQL API", "required", "missing"), ("graphql", "preferred", "missing"), ("graphql", "required", "partial"), ("Rust", "required", "matched"), ("Go", "required", "missing"), (None, "required", "missing")], "name string, necessity string, bucket string").withColumn("profile_id", F.lit(1)).filter("name is not null")
    got = [(r.skill, r.missing, r.partial, r.matched, r.blocking) for r in insights.skill_gaps(v).collect()]
    assert got == [("GraphQL", 2, 1, 0, 1), ("Go", 1, 0, 0, 1)]
    per = insights.skill_gaps(v, "profile_id", top=1).collect()
    assert len(per) == 1 and per[0].skill == "GraphQL"
    assert [r.severity for r in insights.with_severity(insights.skill_gaps(v).withColumn("analyzed", F.lit(4))).collect()] == ["medium", "medium"]


def test_recall_in_small_parts_is_the_same(spark, monkeypatch):
    """A task holds parts of a block's similarities at once, whichever way blocks are formed."""
    import numpy as np
    import pyarrow as pa

    from matchloom.operators import recall as r

    rng = np.random.default_rng(3)
    vectors = lambda n: pa.array(rng.normal(size=(n, 8)).astype(np.float32).tolist(), pa.list_(pa.float32()))
    left = pa.table({"profile_id": np.arange(50), "embedding": vectors(50)})
    right = pa.table({"posting_id": rng.permutation(300), "embedding": vectors(300)})
    whole = r._best_of_block(20)(left, right)
    monkeypatch.setattr(r, "CELLS", 7 * 300)
    seen = []
    cut = r.slices
    monkeypatch.setattr(r, "slices", lambda n, m: (seen.append(s) or s for s in cut(n, m)))
    parts = r._best_of_block(20)(left, right)
    assert parts.column("posting_id").equals(whole.column("posting_id")) and len(seen) == 8
    assert np.allclose(parts.column("semantic_score"), whole.column("semantic_score"))
    assert max(s.stop - s.start for s in seen) * 300 <= r.CELLS
    sim = r._matrix(left.column("embedding")) @ r._matrix(right.column("embedding")).T
    best = right.column("posting_id").to_numpy()[np.argsort(-sim, axis=1)[:, :20]]
    assert np.array_equal(np.array(whole.column("posting_id")).reshape(50, 20), best)

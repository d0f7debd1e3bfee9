"""Kept distinct counts, and constraints checked during the write."""

from pyspark.sql import functions as F

from matchloom import schemas
from matchloom.operators import audit
from matchloom.operators.buckets import BucketStore
from matchloom.operators.sketches import DistinctCounts, estimated, merged, sketched


def test_sketches_merge_and_stay_near(spark, tmp_path):
    rows = spark.range(40_000).select((F.col("id") % 4).alias("snapshot"), (F.col("id") % 2).alias("side"), (F.col("id") % 7001).alias("v"))
    kept = DistinctCounts(BucketStore(spark, str(tmp_path)), "t", ["side"])
    for s in (0, 1, 2, 3, 2):
        kept.add(rows.filter(F.col("snapshot") == s), "v")
    (total,) = kept.counts().collect()
    assert total.rows == 40_000 and abs(total.distinct - 7001) < 0.03 * 7001
    want = {r.side: r.n for r in rows.groupBy("side").agg(F.count_distinct("v").alias("n")).collect()}
    got = {r.side: r.distinct for r in kept.counts("side").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - n) < 0.03 * n for k, n in want.items())
    assert kept.counts("snapshot", "side").count() == 4
    few = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("b", None)], "g string, v int")
    assert {(r.g, r.distinct, r.rows) for r in estimated(merged(sketched(few, ["g"], "v"), ["g"])).collect()} == {("a", 1, 3), ("b", 0, 1)}


def frames(spark, tidy):
    bad = [] if tidy else [(3, 8, "p1", "queued", 99), (4, 8, "p1", "running", 1), (5, None, "x", "lost", None), (6, None, "x", "lost", 1), (7, 9, "p1", "failed", 98), (8, 9, "q", "queued", 99)]
    jobs = spark.createDataFrame([(1, None, "p0", "queued", 1), (2, None, "p1", "succeeded", None), *bad], "job_id long, profile_id long, dedupe_key string, status string, batch_id long").withColumn("kind", F.lit("posting"))
    return {"ingest_jobs": jobs, "url_batches": spark.createDataFrame([(1,), (2,)], "batch_id long"), "profiles": spark.createDataFrame([(8, 5, True), (7, 5, not tidy), (6, None, False)], "profile_id long, user_id long, is_active boolean")}


def test_one_scan_audit_equals_the_audit_by_rules(spark, tmp_path):
    for tidy in (True, False):
        tables = frames(spark, tidy)
        made, found = audit.write_audited(tables, str(tmp_path / str(tidy)))
        want = sorted(map(tuple, schemas.audit(tables).collect()))
        assert sorted(map(tuple, found.collect())) == want and bool(want) == (not tidy)
        assert {n: df.count() for n, df in made.items()} == {n: df.count() for n, df in tables.items()}


def test_inputs_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    jobs = frames(spark, False)["ingest_jobs"].coalesce(1)
    audit.write_audited({"ingest_jobs": jobs.mapInArrow(count, jobs.schema)}, str(tmp_path))[1].collect()
    assert seen.value == jobs.count()

"""The recall index against exact recall."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import index, recall
from matchloom.operators.store import SnapshotStore

SCHEMA = "posting_id long, embedding array<float>, closed_at timestamp, extraction_version int, remote_type string, seniority string, min_years double"


def vectors(rng, n, dim=24, groups=40, spread=0.35, centres=None):
    centres = rng.normal(size=(groups, dim)) if centres is None else centres
    x = centres[rng.integers(len(centres), size=n)] + spread * rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True), centres


def postings(spark, x, first=0, closed=lambda i: False, remote=lambda i: True):
    rows = [(first + i, v.astype(np.float32).tolist(), None, 2, "remote" if remote(first + i) else "onsite", "senior", None) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("closed_at", F.when(F.col("posting_id").isin([first + i for i in range(len(x)) if closed(first + i)]), F.current_timestamp()))


def profiles(spark, x):
    return spark.createDataFrame([(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)], "profile_id long, embedding array<float>")


def test_clustered_vectors_need_few_cells_and_products(spark, tmp_path):
    rng = np.random.default_rng(1)
    x, centres = vectors(rng, 12_000)
    y, _ = vectors(rng, 40, centres=centres)
    q, p = postings(spark, x[:10_000]).repartition(4).cache(), profiles(spark, y)
    known = index.RecallIndex(SnapshotStore(spark, str(tmp_path)))
    book = known.create(q, p, limit=100, cells=32, parts=8)
    assert book.probes < 32 / 3
    assert book.multiplications(10_000, index.RERANK * 100) < 1000
    exact, found = recall.recall(p, q, 100), known.search(p, q, 100)
    assert recall.recall_at_k(exact, found).first()["recall"] >= 0.9
    assert found.groupBy("profile_id").agg(F.max("rank").alias("m"), F.count("*").alias("n")).filter("m <> 100 or n <> 100").count() == 0
    # Scores are exact, and found rows stand in the exact order.
    both = found.join(exact.withColumnRenamed("semantic_score", "s"), ["profile_id", "posting_id"])
    assert both.filter(F.abs(F.col("s") - F.col("semantic_score")) > 2e-6).count() == 0

    # Later postings are coded with the same book.
    later = postings(spark, x[10_000:], 10_000)
    everything = q.unionByName(later).cache()
    known.append(everything)
    again = known.book()
    assert np.array_equal(again.centres, book.centres) and np.array_equal(again.words, book.words) and again.probes == book.probes
    assert known.codes().count() == 12_000 and known.codes().select("posting_id").distinct().count() == 12_000
    assert recall.recall_at_k(recall.recall(p, everything, 100), known.search(p, everything, 100)).first()["recall"] >= 0.9


def test_filters_and_closed_postings_take_no_places(spark, tmp_path):
    rng = np.random.default_rng(2)
    x, _ = vectors(rng, 600, groups=5)
    q = postings(spark, x, closed=lambda i: i % 3 == 0, remote=lambda i: i % 2 == 0)
    p = profiles(spark, x[:5])
    known = index.RecallIndex(SnapshotStore(spark, str(tmp_path)))
    known.create(q, cells=4, parts=6)
    filters = recall.FeedFilters(remote_only=True)
    exact = {(r.profile_id, r.posting_id) for r in recall.recall(p, q, 50, filters).collect()}
    found = {(r.profile_id, r.posting_id) for r in known.search(p, q, 50, filters, block_rows=20).collect()}
    assert len(found) == len(exact) == 250 and len(found & exact) > 240
    assert all(j % 3 and j % 2 == 0 for _, j in found)


def test_changed_vectors_are_coded_anew(spark, tmp_path):
    rng = np.random.default_rng(3)
    x, _ = vectors(rng, 300, groups=3)
    known = index.RecallIndex(SnapshotStore(spark, str(tmp_path)))
    known.create(postings(spark, x), cells=3, parts=6)
    moved = postings(spark, -x[:10])
    known.replace(moved)
    cell, code = known.book().encode(-x[:10].astype(np.float32).astype(float))
    got = {r.posting_id: (r.cell, bytes(r.code)) for r in known.codes().filter("posting_id < 10").collect()}
    assert got == {i: (c, z.tobytes()) for i, (c, z) in enumerate(zip(cell.tolist(), code))} and known.codes().count() == 300


def test_odd_sizes(spark, tmp_path):
    """Dimensions that the parts do not divide, fewer postings than words, one cell, no postings."""
    x, _ = vectors(np.random.default_rng(4), 5, dim=7, groups=1)
    q = postings(spark, x)
    known = index.RecallIndex(SnapshotStore(spark, str(tmp_path)))
    known.create(q, profiles(spark, x[:2]), limit=3, cells=1, parts=3)
    assert known.search(profiles(spark, x[:2]), q, 3).count() == 6
    assert known.search(profiles(spark, x[:2]), q.limit(0), 3).count() == 0
    with pytest.raises(ValueError, match="no embedded posting"):
        index.fit(q.limit(0))


def test_vectors_without_structure_get_the_comparisons_they_need(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, p = postings(spark, x, closed=lambda i: i % 2 == 0).repartition(4).cache(), profiles(spark, x[:300])
    known = index.RecallIndex(SnapshotStore(spark, str(tmp_path)))
    book = known.create(q, p, words=16)  # coarse words: three times the rows wanted are too few
    assert book.rerank > index.RERANK and known.book().rerank == book.rerank
    assert recall.recall_at_k(recall.recall(p, q), known.search(p, q)).first()["recall"] >= 0.9

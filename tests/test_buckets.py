"""Bucketed tables: what an update writes, crashes, two writers, vacuum."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from matchloom.operators.buckets import BucketStore, ConflictError
from matchloom.operators.store import COALESCE_NEW


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def content(s, version=None):
    return {r.k: r.v for r in s.read("t", version).collect()}


@pytest.fixture
def made(spark, tmp_path):
    s = BucketStore(spark, str(tmp_path))
    s.create("t", rows(spark, *[(k, "old") for k in range(200)], (None, "null")), ["k"], 16)
    return s


def written(tmp_path):
    return {f.relative_to(tmp_path): f.stat().st_size for f in Path(tmp_path).rglob("part-*.parquet")}


def test_updates_write_their_buckets_only(spark, made, tmp_path):
    before = written(tmp_path)
    assert made.upsert("t", rows(spark, (3, "new"), (1000, "added"), (None, "n2")), {}) == 2
    new = {f: n for f, n in written(tmp_path).items() if f not in before}
    assert 1 <= len(new) <= 3 and sum(new.values()) < sum(before.values()) / 3
    want = {k: "old" for k in range(200)} | {3: "new", 1000: "added", None: "n2"}
    assert content(made) == want and len(content(made, 1)) == 201 and content(made, 1)[3] == "old"
    made.upsert("t", rows(spark, (3, None)), {"v": COALESCE_NEW})
    assert content(made) == want


def test_buckets_may_become_empty(spark, tmp_path):
    s = BucketStore(spark, str(tmp_path))
    s.create("t", rows(spark), ["k"], 4)
    assert content(s) == {} and s.manifest("t").folders == {}
    s.upsert("t", rows(spark, (1, "a"), (2, "b")), {})
    s.update("t", rows(spark, (1, "")), lambda current: current.filter("k <> 1"))
    assert content(s) == {2: "b"}
    assert s.update("t", rows(spark), lambda current: current) == 4 and content(s) == {2: "b"}
    with pytest.raises(FileExistsError):
        s.create("t", rows(spark), ["k"])
    with pytest.raises(ValueError, match="buckets"):
        s.update("t", rows(spark, (1, "")), lambda current: rows(spark, *[(k, "x") for k in range(50)]))


def test_a_crash_before_the_commit_leaves_the_version_before(spark, made, monkeypatch):
    def crash(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(made, "_commit", crash)
        with pytest.raises(RuntimeError, match="lost"):
            made.upsert("t", rows(spark, (3, "new")), {})
    assert made.version("t") == 1 and content(made)[3] == "old"
    assert made.vacuum("t", grace_s=0) >= 1  # the folder that nothing names
    made.upsert("t", rows(spark, (3, "new")), {})
    assert content(made)[3] == "new"


def test_two_writers(spark, made):
    """Another writer commits while an update runs: first in other buckets, then in the same one."""
    m = made.manifest("t")
    place = {r.k: r.b for r in spark.range(200).toDF("k").select("k", made.bucket_of(m).alias("b")).collect()}
    far = next(k for k in range(200) if place[k] != place[3])
    other, runs = BucketStore(spark, made.root), []

    def slow(key, value):
        def merge(current):
            runs.append(key)
            if len(runs) == 1:
                other.upsert("t", rows(spark, (key, value)), {})
            return current.withColumn("v", F.when(F.col("k") == 3, F.concat("v", F.lit("+"))).otherwise(F.col("v")))

        return merge

    assert made.update("t", rows(spark, (3, "")), slow(far, "far")) == 3 and len(runs) == 1  # only rebased
    assert content(made)[3] == "old+" and content(made)[far] == "far"
    runs.clear()
    assert made.update("t", rows(spark, (3, "")), slow(3, "theirs")) == 5 and len(runs) == 2  # computed again
    assert content(made)[3] == "theirs+"

    def beaten(current):
        other.upsert("t", rows(spark, (3, "again")), {})
        return current

    with pytest.raises(ConflictError):
        BucketStore(spark, made.root, attempts=2).update("t", rows(spark, (3, "")), beaten)


def test_batches_count_once(spark, made):
    add = lambda current: current.withColumn("v", F.concat("v", F.lit("+")))
    for batch in (0, 0, 1, 0, 1):
        made.update("t", rows(spark, (3, "")), add, "stream", batch)
    assert content(made)[3] == "old++" and made.version("t") == 3
    made.update("t", rows(spark, (3, "")), add, "another", 0)
    assert content(made)[3] == "old+++"


def test_vacuum_keeps_what_versions_name(spark, made, tmp_path):
    for n in range(4):
        made.upsert("t", rows(spark, (n, f"v{n}")), {})
    want, size = content(made), len(written(tmp_path))
    assert made.vacuum("t", keep=2) == 0  # all folders are young
    assert made.vacuum("t", keep=2, grace_s=-1) > 0 and made.versions("t") == [4, 5]
    assert content(made) == want and content(made, 4)[3] == "old" and len(written(tmp_path)) < size

"""Maintained feeds equal feeds built from scratch."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators.buckets import BucketStore
from matchloom.operators.feed import build_feed
from matchloom.operators.feed_state import FeedState

POSTING = "posting_id long, embedding array<double>, closed_at string, extraction_version int, remote_type string, seniority string, min_years double, requirements array<struct<name:string,necessity:string,min_years:double,evidence:string>>"
PROFILE = "profile_id long, embedding array<double>, skills array<struct<name:string,years:double>>"
SKILLS = ["python", "sql", "rust", "spark", "go", "java"]
def AT():
    return F.lit("2024-01-01").cast("timestamp")



def unit(rng):
    v = np.round(rng.normal(size=6), 3)
    return (v / np.linalg.norm(v)).tolist()


class World:
    def __init__(self, seed):
        self.rng, self.r = np.random.default_rng(seed), random.Random(seed)
        self.postings = {i: self.posting() for i in range(60)}
        self.profiles = {i: self.profile() for i in range(12)}

    def posting(self):
        asked = [(s, self.r.choice(["required", "preferred"]), self.r.choice([None, 2.0]), None) for s in self.r.sample(SKILLS, 3)]
        return [unit(self.rng), None, 2, "remote", "mid", None, asked]

    def profile(self):
        return [unit(self.rng), [(s, float(self.r.randint(0, 5))) for s in self.r.sample(SKILLS, 3)]]

    def frames(self, spark):
        q = spark.createDataFrame([(i, *v) for i, v in self.postings.items()], POSTING)
        return spark.createDataFrame([(i, *v) for i, v in self.profiles.items()], PROFILE), q.withColumn("closed_at", F.col("closed_at").cast("timestamp"))


def compared(df):
    return sorted((r.profile_id, r.feed_rank, r.posting_id, round(r.semantic_score, 5), round(r.skill_score, 6), round(r.final_score, 5), str(r.breakdown.counts)) for r in df.collect())


@pytest.mark.parametrize("seed", [1])
def test_equals_a_full_rebuild(spark, tmp_path, seed):
    w = World(seed)
    state = FeedState(BucketStore(spark, str(tmp_path)), recall_limit=12, feed_size=8, reserve=3, buckets=4)
    state.build(*w.frames(spark), scored_at=AT())
    recalled = []

    def step(changed, people=()):
        p, q = w.frames(spark)
        ids = spark.createDataFrame([(i,) for i in changed], "posting_id long")
        who = spark.createDataFrame([(i,) for i in people], "profile_id long")
        recalled.append(state.refresh(p, q, ids, who, scored_at=AT()))
        want = build_feed(p, q, 12, 8, scored_at=AT())
        assert compared(state.matches()) == compared(want)

    step([])
    assert recalled[-1]["touched"] == 0
    w.postings |= {100 + i: w.posting() for i in range(4)}  # some come
    step(range(100, 104))
    assert recalled[-1]["recalled"] == 0
    w.postings[101][6] = [("sql", "required", 5.0, None)]  # another requirement, the same vector
    w.postings[7][0] = unit(w.rng)  # another vector
    step([101, 7])
    closed = [i for i in w.postings if i % 3 == 0]
    for i in closed:
        w.postings[i][1] = "2024-02-02"
    step(closed)  # lists fall short
    assert recalled[-1]["recalled"] > 0
    for i in closed[::2]:
        w.postings[i][1] = None
    del w.postings[closed[1]], w.postings[1]
    w.profiles[3], w.profiles[50] = w.profile(), w.profile()
    del w.profiles[4]
    step([*closed[::2], closed[1], 1], [3, 50, 4])


def test_fewer_postings_than_places(spark, tmp_path):
    w = World(3)
    w.postings = {i: v for i, v in w.postings.items() if i < 5}
    state = FeedState(BucketStore(spark, str(tmp_path)), recall_limit=12, feed_size=8, reserve=3, buckets=2)
    state.build(*w.frames(spark), scored_at=AT())
    for changed in ([0, 1], [0, 1, 2, 3, 4], [200 + i for i in range(30)]):
        for i in changed:
            if i < 5 and w.postings[i][1] is None:
                w.postings[i][1] = "2024-02-02"
            elif i >= 200:
                w.postings[i] = w.posting()
        p, q = w.frames(spark)
        state.refresh(p, q, spark.createDataFrame([(i,) for i in changed], "posting_id long"), scored_at=AT())
        assert compared(state.matches()) == compared(build_feed(p, q, 12, 8, scored_at=AT()))


def test_untouched_buckets_are_not_written(spark, tmp_path):
    w = World(4)
    state = FeedState(BucketStore(spark, str(tmp_path)), recall_limit=12, feed_size=8, reserve=3, buckets=8)
    state.build(*w.frames(spark), scored_at=AT())
    before = state.store.manifest("feeds").folders
    w.profiles[5][1] = [("go", 9.0)]
    p, q = w.frames(spark)
    assert state.refresh(p, q, spark.createDataFrame([], "posting_id long"), spark.createDataFrame([(5,)], "profile_id long"), scored_at=AT())["touched"] == 1
    after = state.store.manifest("feeds").folders
    assert sum(before[k] != after[k] for k in before) == 1
    assert compared(state.matches()) == compared(build_feed(p, q, 12, 8, scored_at=AT()))

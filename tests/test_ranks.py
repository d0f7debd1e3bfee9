"""Ranks, running sums and order statistics over sorted ranges against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from matchloom.operators import catalog, jobs, ops, ranks


def grouped(rows):
    out = defaultdict(list)
    for g, v, i in rows:
        out[g].append((v is not None, v or 0, i))
    return {g: sorted(x) for g, x in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    groups = ["hot"] * 200 + [None] * 60 + [f"g{k}" for k in range(40)]
    return [(rng.choice(groups), rng.choice([None, *range(5)]), i) for i in range(900)]


def test_numbers_equal_sorting(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = {r.i: (r.rank, r.n) for r in ranks.numbered(df, ["g"], ["v", "i"], total="n").collect()}
    assert got == {x[2]: (k + 1, len(xs)) for xs in grouped(rows).values() for k, x in enumerate(xs)}
    assert {r.i: r.rank for r in ranks.numbered(df, [], ["i"]).collect()} == {i: i + 1 for i in range(900)}
    assert ranks.numbered(df.limit(0), ["g"], ["v"]).count() == 0


def test_running_sums_equal_adding(spark, rows):
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    want, total = {}, defaultdict(int)
    for g, v, i in rows:
        total[g] += v or 0
        want[i] = total[g]
    assert {r.i: r.s for r in ranks.running_sum(df, ["g"], ["i"], "v", "s").collect()} == want


@pytest.mark.parametrize("by", [["g"], []])
def test_selected_ranks_equal_indexing(spark, rows, by):
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    n = F.col("n")
    got = {r.g if by else "": (r.n, r.low, r.last) for r in ranks.selected(df, by, "v", {"low": F.floor((n + 1) / 2), "last": n}).collect()}
    want = {}
    for g, xs in grouped([(g if by else "", v, i) for g, v, i in rows]).items():
        v = [x[1] for x in xs if x[0]]
        if v:
            want[g] = (len(v), v[(len(v) + 1) // 2 - 1], v[-1])
    assert got == want


def test_latency_of_one_group_of_all_rows(spark):
    rng = random.Random(2)
    v = [rng.random() for _ in range(997)]
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "ms double").repartition(5)
    r, plain = ops.latency_summary(df, "ms", window_rows=10).first(), ops.latency_summary(df, "ms").first()
    s = sorted(v)
    assert r[:1] + r[2:] == plain[:1] + plain[2:] and (r.n, r.p50, r.p95, r.p99) == (997, s[498], s[int(997 * 0.95) - 1], s[int(997 * 0.99) - 1]) and abs(r.mean - sum(v) / 997) < 1e-9


def test_large_batches_and_hosts_give_the_same_rows(spark):
    rng = random.Random(3)
    lines = [(b, k, rng.choice(["https://e.com/%d" % rng.randrange(30), "ftp://no", " ", "https://e.com/hot"])) for b in (1, 2, None) for k in range(150)]
    df = spark.createDataFrame(lines, "batch_id long, line_no long, line string").repartition(5)
    plain, split = (jobs.parse_url_lines(df, 12, window_rows=n) for n in (1 << 20, 10))
    cols = sorted(plain.columns)
    assert sorted(map(str, plain.select(*cols).collect())) == sorted(map(str, split.select(*cols).collect()))
    f = spark.createDataFrame([(rng.choice(["hot", "hot", "a", "b"]), "u%04d" % k) for k in range(300)], "host string, url string").repartition(5)
    at = F.lit("2024-01-01")
    assert sorted(catalog.pace(f, at).select("url", "wait_s", "released").collect()) == sorted(catalog.pace(f, at, window_rows=10).select("url", "wait_s", "released").collect())


def test_rules_of_hosts_equal_trying_all(spark):
    rng = random.Random(4)
    path = lambda n: "/" + "".join(rng.choices("ab/", k=rng.randint(0, n)))
    rules = [(h, s, rng.random() < 0.4, rng.choice(["", path(5), path(5)])) for h in ("x", "y") for s in range(300)] + [("z", 0, False, "/"), ("x", 300, True, None)]
    front = [("u%d" % k, rng.choice(["x", "y", "z", "free", None]), path(9)) for k in range(400)]
    want = set()
    for u, h, p in front:
        first = next((a for rh, _, a, prefix in rules if rh == h and prefix is not None and p.startswith(prefix)), True)
        want |= {u} if first else set()
    f = spark.createDataFrame(front, "url string, host string, path string")
    assert {r.url for r in catalog.allowed(f, spark.createDataFrame(rules, "host string, seq int, allow boolean, prefix string")).collect()} == want

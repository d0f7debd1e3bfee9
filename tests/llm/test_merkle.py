"""The manifest against a plain recursive tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from matchloom.llm import merkle

SCHEMA = "grp string, doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, add=0):
    values = (r[1], r[2], r[3], None if r[4] is None else r[4] + add, r[5])
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(digests, fanout):
    """Root, and the siblings of each leaf as (place, others) a level."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), digests
    while len(level) > 1:
        for w, k in zip(ways, at):
            run = level[k - k % fanout : k - k % fanout + fanout]
            w.append((k % fanout, run[: k % fanout] + run[k % fanout + 1 :]))
        at = [k // fanout for k in at]
        level = [H(*level[k : k + fanout]) for k in range(0, len(level), fanout)]
    return level[0], ways


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[1] is not None, r[1] or 0, leaf(r)))
        trees[g] = plain_tree([leaf(r) for r in groups[g]], fanout)
    root, tops = plain_tree([trees[g][0] for g in order], fanout)
    out = []
    for g, top in zip(order, tops):
        for r, way in zip(groups[g], trees[g][1]):
            steps = way + top
            bad = r[1] is not None and zlib.crc32(str(r[1]).encode()) % 7 == 0
            h = leaf(r, int(bad))
            for place, others in steps:
                h = H(*others[:place], h, *others[place:])
            out.append((r[1], leaf(r), trees[g][0], root, H(*(x for _, o in steps for x in o)), h, h == root))
    return out


def rows(n):
    langs = [None, "en", "en", "en", "de", "é", ""]
    return [("other", k * 37 % 1000, None if k % 11 == 0 else f"s{k % 3}", langs[k % 7], None if k % 5 == 0 else k, [None, "", "é ü" * (k % 9)][k % 3]) for k in range(n)]


@pytest.mark.parametrize("fanout,block", [(2, 4), (2, 1), (3, 3), (2, 4096), (5, 30)])
def test_equals_plain_tree(spark, fanout, block):
    data = rows(203) + [("x", None, "s", "en", 1, "a"), ("x", None, "s", None, 1, "a")] + [("x", 5, "s", "en", 2, "twice")] * 3
    data += [("x", 100_000 + k, "s", "one" if k == 0 else "many", 1, "t") for k in range(30)]
    df = spark.createDataFrame(data, SCHEMA).repartition(6)
    got = merkle.manifest(df, claim=merkle.tampered, fanout=fanout, block_leaves=block)
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(brute(data, fanout), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_small_tables(spark, n):
    data = [("x", k, "s", "en", 1, "t") for k in range(n)]
    got = merkle.manifest(spark.createDataFrame(data, SCHEMA), claim=merkle.tampered, block_leaves=2, with_proof=True)
    assert sorted(tuple(r)[:7] for r in got.collect()) == sorted(brute(data, 2))
    if n == 1:
        assert got.first().proof == [] and got.first().leaf == got.first().root


def test_untampered_rows_verify_and_an_empty_table_is_empty(spark):
    df = spark.createDataFrame(rows(50), SCHEMA)
    assert merkle.manifest(df).filter(~F.col("verified")).count() == 0
    assert merkle.manifest(df.limit(0)).count() == 0

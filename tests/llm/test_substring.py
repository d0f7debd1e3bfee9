"""Removal of shared passages against brute force over all windows."""

import hashlib
import random
import re

import numpy as np
import pytest

from matchloom.llm import substring
from matchloom.llm.common import WORD_PATTERN

WORD = re.compile(WORD_PATTERN)


def brute(rows, window=50):
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1) if i is not None else ():
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = []
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - window + 1) if i is not None else ():
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def corpus(rng, n, vocabulary):
    """Texts that share passages in part, with edits, runs, alternations and repeats within one text."""
    pool = [[rng.choice(vocabulary) for _ in range(rng.randint(20, 160))] for _ in range(12)]
    pool += [["a"] * 90, ["a", "b"] * 60, ["x", "y", "z"] * 40, ["a"] * 49 + ["c"]]
    out = []
    for _ in range(n):
        t = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            a, b = sorted((rng.randrange(len(p) + 1), rng.randrange(len(p) + 1))) if rng.random() < 0.5 else (0, len(p))
            t += p[a:b]
            if rng.random() < 0.3 and t:
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.4:
                t += [rng.choice(vocabulary) for _ in range(rng.randint(1, 70))]
        out.append("".join(w + rng.choice([" ", "  ", "\n", "\t "]) for w in t))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_equal_windows_have_equal_anchors(seed):
    rng = random.Random(seed)
    texts = [substring.normalise(t.encode()) for t in corpus(rng, 40, ["w%d" % k for k in range(30)])]
    seen = {}
    for _, _, data, start, end, piece in substring._pieces(texts, 50):
        first, name, at = substring.anchors(substring.word_names(np.frombuffer(data, np.uint8), start, end), piece)
        for s, x, p in zip(first, name, at):
            assert s <= p < s + 50
            assert seen.setdefault(data[start[s] : end[s + 49]], (x, p - s)) == (x, p - s)
    assert len(seen) > 500


@pytest.mark.parametrize("seed,vocabulary", [(0, 2000), (1, 40), (2, 3)])
def test_words_removed_equal_brute_force(spark, seed, vocabulary):
    rng = random.Random(seed)
    texts = corpus(rng, 120, ["w%d" % k for k in range(vocabulary)])
    ids = rng.sample(range(1000), len(texts))
    rows = [*zip(ids, texts), (ids[0], texts[1]), (ids[2], texts[2]), (None, texts[3]), (None, texts[3]), (2000, None), (2001, ""), (2002, " \n "), (2003, "É ü   x"), (-5, texts[7])]
    df = spark.createDataFrame([(t, "other", 1, i) for i, t in rows], "text string, row string, low int, doc_id long").repartition(5)
    got = substring.remove_repeats(df, with_text=True).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r[:4]) for r in got), key=key) == sorted(brute(rows), key=key)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert sum(r.n_removed for r in got) > 1000


def test_anchor_with_many_documents_spreads_over_partitions(spark):
    """One passage in every text, so that its anchors pass the borders of sorted partitions."""
    rng = random.Random(5)
    passage = " ".join("p%d" % k for k in range(75))
    rows = [(k, " ".join("u%d" % rng.randrange(10**6) for _ in range(3)) + " " + passage + " v%d" % rng.randrange(10**6)) for k in range(300)]
    rows += [(1000 + k, passage) for k in range(200)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(brute(rows))


def test_long_texts_are_parsed_in_pieces(spark, monkeypatch):
    rng = random.Random(3)
    a = ["w%d" % rng.randrange(10**5) for _ in range(3000)]
    texts = [" ".join(a[:2000]), " ".join(["q"] + a[500:] + a[:100]), " ".join(a)]
    rows = list(enumerate(texts))
    want = brute(rows)
    monkeypatch.setattr(substring, "PIECE_WORDS", 300)
    got = []
    base = [substring.normalise(t.encode()) for t in texts]
    seen = set()
    for text, offset, data, start, end, piece in substring._pieces(base, 50):
        first, name, at = substring.anchors(substring.word_names(np.frombuffer(data, np.uint8), start, end), piece)
        for s in first.tolist():
            p = piece[s]
            k = s - int(np.searchsorted(piece, p)) + offset[p]
            seen.add((text[p], k))
            got.append(data[start[s] : end[s + 49]] == " ".join(texts[text[p]].split()[k : k + 50]).encode())
    assert all(got) and seen == {(i, k) for i, t in rows for k in range(len(t.split()) - 49)} and len(got) == len(seen)
    assert [r[1] for r in want] == [2000, 2601, 3000]


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []

"""Alignment of two tokenizers against encoding and comparing whole texts."""

import hashlib
import random
from collections import Counter, defaultdict
from functools import lru_cache

import pytest
from tokenizers import Tokenizer

from matchloom.llm import alignment

A, B = (f"{alignment.TOKENIZER_DIR}/{f}" for f in (alignment.A_FILE, alignment.B_FILE))
TEXTS = [
    "Plain words, and more words.", " starts with a space", "  two  and   three spaces ", "tabs\tand\nlines\n  indented\r\n\r\n x", "it's I'll WE'RE don't",
    "<|endoftext|> and <s> </s> <unk> <0x41> plain", "ünïcödé žluťoučký 漢字かな 🙂🙂 é", "a▁b with its mark", "  nbsp 　 wide   x", "nul \x00 inside", "1234567 3.14 $5", "a" * 300, "aaaa " * 30, " ", "\n", "ﬁ ligature ﬁ Å",
    "x​ y ﻿ z", "...!!! ??? -- __init__ (a) [b]", "́ start", "naïve  x", "",
]


@pytest.fixture(scope="module")
def v():
    return alignment.vocabularies(A, B)


@lru_cache
def json_tokenizer():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t


def whole(v, text):
    """Tokens of the whole text at once: groups, links."""
    data = (" " + text).encode() if text else b""
    if not data:
        return [], [], [], []
    a = json_tokenizer().encode(" " + text, add_special_tokens=False).ids
    b = v.b.encode(text)
    if b"".join(v.a_bytes[k] for k in a) != data or b"".join(v.b_bytes[k] for k in b) != data:
        return [], [], [], []
    spans = lambda ids, names: [(sum(len(names[x]) for x in ids[:i]), sum(len(names[x]) for x in ids[: i + 1])) for i in range(len(ids))]
    sa, sb = spans(a, v.a_bytes), spans(b, v.b_bytes)
    links = [(a[i], b[j]) for i, x in enumerate(sa) for j, y in enumerate(sb) if x[0] < y[1] and y[0] < x[1]]
    groups, ga, gb = [], [], []
    ends = {x[1] for x in sa} & {y[1] for y in sb}
    for e in sorted(ends):
        ga = [a[i] for i, x in enumerate(sa) if x[1] <= e and x[0] >= (groups[-1][0] if groups else 0)]
        gb = [b[j] for j, y in enumerate(sb) if y[1] <= e and y[0] >= (groups[-1][0] if groups else 0)]
        groups.append((e, ",".join(map(str, ga)) + "|" + ",".join(map(str, gb))))
    return a, b, [g for _, g in groups], links


def brute(v, rows):
    made = [whole(v, t or "") for _, t in rows]
    count = Counter(p for *_, links in made for p in set(links))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    return [
        (i, len(a), len(b), len(g), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if a else "")
        for (i, _), (a, b, g, links) in zip(rows, made)
    ]


def texts(rng, n):
    words = ["".join(rng.choices("abcdeinrstuüß", k=rng.randint(1, 9))) for _ in range(60)] + TEXTS
    return ["".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\n", " \n ", ", "]) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_identity_map(v):
    assert all(j < 0 or v.b_bytes[j] == v.a_bytes[i] for i, j in enumerate(v.identity)) and (v.identity >= 0).sum() > 10_000
    assert v.cuts and b"".join(v.a_bytes[:256]) and len(set(v.a_bytes[:256])) == 256


def aligned(v, m, some):
    counts, groups, doc, pairs, times = alignment.align(v, m.encode(some))
    links = [Counter() for _ in some]
    for d, p, n in zip(doc.tolist(), pairs.tolist(), times.tolist()):
        links[d][divmod(p, v.b_size)] += n
    return [(*c, g, x) for *c, g, x in zip(*(c.tolist() for c in counts), groups, links)]


def plain(v, t):
    a, b, groups, links = whole(v, t)
    return len(a), len(b), len(groups), len(links), ";".join(groups), Counter(links)


def test_pieces_equal_whole_texts(v):
    some = TEXTS + texts(random.Random(7), 300)
    for t, got in zip(some, aligned(v, alignment.Memory(v), some)):
        assert got == plain(v, t), t


@pytest.mark.parametrize("limit", [1 << 20, 40, 0])
def test_documents_equal_brute_force(spark, v, limit, monkeypatch):
    rng = random.Random(limit)
    rows = list(enumerate(TEXTS + texts(rng, 60))) + [(3, TEXTS[0]), (None, TEXTS[0]), (70, None)]
    df = spark.createDataFrame([(t, 1, 2, i) for i, t in rows], "text string, n int, a int, doc_id long").repartition(4)
    got = alignment.align_documents(df, broadcast_pairs=limit).collect()
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(v, rows), key=key)


def test_memory_is_bounded(v, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 20)
    m = alignment.Memory(v)
    for t in texts(random.Random(1), 40):
        assert aligned(v, m, [t]) == [plain(v, t)]
    assert all(len(p) <= alignment.LONGEST for p in m.known)


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0

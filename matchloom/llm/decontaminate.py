"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text are replaced by typed placeholders, runs of
``k`` template tokens are hashed, and documents' windows are hash-joined to the
benchmark's.  Windows of fewer than two literal tokens, such as those of a table
of numbers, are hashed with their values instead, so they match copies only.
Windows at one alignment must fill the placeholders consistently:
one benchmark value stands for the document value that it has in more than half
of its places, or for itself; windows with another value are left out, the rest
of the alignment counts.  So an item is found when it is copied, in part or
whole, and when it is asked again with other numbers, equal ones included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import ALNUM, cut, gram_hashes, slices, slot_of, text_bytes, without_ids, word_hashes

K = 8
SHORTEST = 4
BITS = 22
#: A window needs so many tokens that are no placeholders to match other values than its own.
LITERALS = 2
#: Windows of a benchmark up to this many rows are broadcast (counted first); larger ones are joined by shuffle.
BROADCAST_WINDOWS = 500_000
# Unit names and symbols.
UNITS = frozenset(
    b"mm cm m km inch inches ft feet foot yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur percent degree degrees meter meters metre metres kilometer kilometers kilometre kilometres hz khz mhz ghz w kw kwh v volt volts watt watts joule joules newton newtons mph kmh km2 m2 m3".split()
)
_NUMBER = re.compile(rb"\d+(?:[.,:/]\d+)*")
#: A capitalised word inside a sentence, with those that follow it.
_NAME = re.compile(rb"(?<=[a-z0-9,;] )[A-Z][a-z]+(?: [A-Z][a-z]+)*")
_UNIT = re.compile(rb"[ ]?([A-Za-z]+\d?|%)")
_BARE = np.uint64(0x6261726500000001)
_TYPES = np.array([0x6E756D6265720001, 0x6E616D6500000001, 0x756E697400000001], np.uint64)


def template(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, str], np.ndarray]:
    """Template tokens of several texts: hashes, text index, byte start, the values of the placeholders by token position, and hashes of tokens and values."""
    h, row, start, end = word_hashes(texts, ALNUM)
    data = b"\n".join(texts) + b"\n"
    keep = np.ones(len(h), bool)
    slots: dict[int, str] = {}
    values = h.copy()
    spans = [(m.start(), m.end(), 0) for m in _NUMBER.finditer(data)] + [(m.start(), m.end(), 1) for m in _NAME.finditer(data)]
    for a, b, kind in sorted(spans):
        i, j = np.searchsorted(start, a), np.searchsorted(start, b)
        unit = None
        if i >= len(start) or start[i] != a:
            # The number ends or continues a word: only digits with a unit behind them are a number.
            if i == 0 or start[i - 1] < a:
                continue
        if kind == 0:
            m = _UNIT.match(data, b)
            if m and m[1].lower() in UNITS:
                unit = m
            if j == 0 or end[j - 1] > b and not (unit and end[j - 1] == m.end(1) and m.start(1) == b):
                continue
        h[i] = _TYPES[kind]
        keep[i + 1 : j] = False
        slots[int(i)] = data[a:b].decode(errors="replace").lower()
        values[i] = xxhash.xxh3_64_intdigest(data[a:b].lower())
        if unit is not None and unit.start(1) > b and unit[1] != b"%":
            u = np.searchsorted(start, unit.start(1))
            if u < len(start) and start[u] == unit.start(1) and end[u] == unit.end(1):
                h[u] = _TYPES[2]
                slots[int(u)] = unit[1].decode().lower()
    if keep.all():
        return h, row, start, slots, values
    place = np.cumsum(keep) - 1
    return h[keep], row[keep], start[keep], {int(place[i]): v for i, v in slots.items() if keep[i]}, values[keep]


def windows(texts: list[bytes], lengths: Iterable[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict[int, str], np.ndarray]]:
    """For each window length: length, hashes, text index, first token, placeholders, tokens before each text."""
    h, row, _, slots, values = template(texts)
    literal = np.ones(len(h), np.int64)
    literal[list(slots)] = 0
    literals = np.concatenate([[0], np.cumsum(literal)])
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    for k in lengths:
        g = gram_hashes(h, k)
        at = np.arange(len(g))
        bare = literals[at + k] - literals[at] < min(LITERALS, k)
        if bare.any():
            g = np.where(bare, gram_hashes(values, k) ^ _BARE, g)
        ok = row[at] == row[at + k - 1] if len(g) else np.zeros(0, bool)
        yield k, g[ok] + np.uint64(k), row[at[ok]], at[ok], slots, first


def _window_rows(b_ids: pa.Array, texts: list[bytes], lengths: Iterable[int], wanted: np.ndarray | None, only_own: bool) -> pa.RecordBatch:
    take, hs, ats, ks, ns, slot_rows = [], [], [], [], [], []
    for k, g, row, at, slots, first in windows(texts, lengths):
        size = np.diff(first)
        hit = np.ones(len(g), bool) if k >= SHORTEST else size[row] == k  # the shortest items match whole texts only
        if only_own:  # a benchmark item has windows of K tokens, or one of its own length if it is shorter
            hit = np.minimum(size[row], K) == k
        if wanted is not None:
            s = slot_of(g.view(np.int64), BITS)
            hit &= ((wanted[s >> 5] >> (s & 31).astype(np.uint32)) & 1).astype(bool)
        row, at, g = row[hit], at[hit], g[hit]
        take.append(row)
        hs.append(g.view(np.int64))
        ats.append(at - first[row])
        ks.append(np.full(len(g), k))
        ns.append(size[row])
        slot_rows += [[f"{j}={slots[i + j]}" for j in range(k) if i + j in slots] if slots else [] for i in at.tolist()]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [b_ids.take(pa.array(cat(take).astype(np.int64))), pa.array(cat(hs), pa.int64()), pa.array(cat(ats), pa.int64()), pa.array(cat(ns), pa.int64()), pa.array(slot_rows, pa.list_(pa.string()))],
        ["id", "h", "at", "n", "slots"],
    )


def _hashed(df: DataFrame, key: str, text: str, lengths: list[int], wanted: np.ndarray | None, only_own: bool) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            yield _window_rows(b.column(0), text_bytes(b.column(1)), lengths, wanted, only_own)

    return df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, h long, at long, n long, slots array<string>")


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each alignment the windows that fit, by their place in the item, and the number of different bindings in them."""
    for batch in batches:
        ats, n_slots = [], []
        for windows in batch.column(3).to_pylist():
            votes: dict[str, Counter[str]] = {}
            for _, a, b in {(p["at"], p["a"], p["b"]) for w in windows for p in w["bindings"]}:
                votes.setdefault(a, Counter())[b] += 1
            good = {(a, b) for a, c in votes.items() for b, n in c.items() if a == b or 2 * n > c.total()}
            fit = [w for w in windows if all((p["a"], p["b"]) in good for p in w["bindings"])]
            ats.append([w["item_at"] for w in fit])
            n_slots.append(len({(p["a"], p["b"]) for w in fit for p in w["bindings"]}))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ats, pa.list_(pa.int64())), pa.array(n_slots, pa.int64())], ["doc_id", "item_id", "item_windows", "ats", "n_slots"])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5, run: int = 13) -> DataFrame:
    """Pairs of document and benchmark item: ``doc_id``, ``item_id``, ``matched``, ``item_windows``, ``coverage``, ``n_slots``.

    A pair is reported if windows with consistent placeholders cover at least
    ``share`` of the item's windows, or ``run`` windows.  Items of fewer than
    ``K`` template tokens have one window, of all their tokens; below
    ``SHORTEST`` tokens an item matches documents that consist of it alone.
    Null texts count as empty, and empty items match nothing; repeated rows of
    an identifier are one document; rows without an identifier are reported
    under null.  Other columns are ignored.  Empty tables give no pairs.
    """
    from matchloom.llm.common import id_bitmap

    items = cut(_hashed(benchmark, item_id, item_text, list(range(1, K + 1)), None, True).distinct())
    wanted = id_bitmap(items.select("h"), BITS)
    lengths = sorted({min(r[0], K) for r in items.select(F.least("n", F.lit(K)).alias("k")).distinct().collect()}) or [K]
    found = _hashed(docs, doc_id, text, lengths, wanted, False).select(F.col("id").alias("doc_id"), "h", F.col("at").alias("doc_at"), F.col("slots").alias("doc_slots"))
    side = items.select(F.col("id").alias("item_id"), "h", F.col("at").alias("item_at"), F.greatest(F.col("n") - (K - 1), F.lit(1)).alias("item_windows"), F.col("slots").alias("item_slots"))
    side = F.broadcast(side) if items.count() <= BROADCAST_WINDOWS else side.hint("merge")
    pairs = found.join(side, "h").filter(F.size("doc_slots") == F.size("item_slots")).withColumn("shift", F.col("doc_at") - F.col("item_at"))
    value = lambda x: F.substring_index(x, "=", -1)
    place = lambda x: F.col("item_at") + F.substring_index(x, "=", 1).cast("long")
    binding = F.transform(F.arrays_zip("item_slots", "doc_slots"), lambda z: F.struct(place(z["item_slots"]).alias("at"), value(z["item_slots"]).alias("a"), value(z["doc_slots"]).alias("b")))
    aligned = pairs.groupBy("doc_id", "item_id", "item_windows", "shift").agg(F.collect_set(F.struct("item_at", binding.alias("bindings"))).alias("windows"))
    settled = aligned.select("doc_id", "item_id", "item_windows", "windows").mapInArrow(_settled, "doc_id long, item_id long, item_windows long, ats array<long>, n_slots long")
    per = settled.groupBy("doc_id", "item_id", "item_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("ats")))).cast("long").alias("matched"), F.max("n_slots").alias("n_slots")).filter("matched > 0")
    return per.withColumn("coverage", F.col("matched") / F.col("item_windows")).filter((F.col("coverage") >= share) | (F.col("matched") >= run)).select("doc_id", "item_id", "matched", "item_windows", "coverage", "n_slots")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: object) -> DataFrame:
    """``docs`` without the documents that :func:`contaminated` reports.

    All columns stay, whatever their names.  Null and empty texts stay, and so
    do rows without an identifier; repeated rows of one identifier go or stay
    together.  An empty table, or an empty benchmark, changes nothing.
    """
    return without_ids(docs, cut(contaminated(docs, benchmark, doc_id, text, **options).select(F.col("doc_id").alias(doc_id)).distinct()), doc_id)



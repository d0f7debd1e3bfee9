"""Removal of long passages that an earlier document has too, by recompression.

Every text is parsed bottom-up into symbols: words first, then, round by
round, runs of one symbol and pairs of neighbours become new symbols.  Names
are 64-bit mixes of what they stand for, and which symbols pair is a bit of
the name, so every executor names equal runs and pairs alike.  Where a round
joins symbols depends on the symbols alone; thus of two equal windows of words
all symbols agree but for some at both ends, and which ones these are (`popped`
ones, which the surroundings might have joined otherwise) depends on the
window alone.  Each window is filed under its first unpopped symbol of the
highest round that leaves it one: its anchor.  Equal windows have equal
anchors, whatever surrounds them.

Consecutive windows with one anchor make a segment.  Segments are sorted by
(anchor, digest of their words, document); anchors of one document only are
done with.  Where all segments of an anchor agree, the first document has the
windows of all.  Only where they differ, mostly at the ends of shared
passages, their windows are compared one by one, by 128-bit digests of whole
words.  Colliding names thus cost time, never rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import NOT_SPACE, ensure_checkpoint_dir, id_bitmap, maybe_members, mix64, remove_folder, shuffle_parts, slices, text_bytes

WINDOW = 50
#: Words of a text that are parsed together; longer texts are parsed in overlapping pieces.
PIECE_WORDS = 1 << 17
#: Rounds of naming: runs (R) and pairs (P).  Each round pops up to a symbol at both ends of a window, a whole run with R.
ROUNDS = "RPPRP"
#: Anchors of at least so many words are equally good.
LONG = 5

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_K = [np.uint64(k | 1) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_ODD = [np.uint64(k | 1) for k in (0x8CB92BA72F3D8DD7, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_BASE = 0xA0761D6478BD642F
_POWERS: dict[str, np.ndarray] = {}


def normalise(text: bytes) -> bytes:
    """The words of a text, joined by one space."""
    return _SPACES.sub(b" ", text).strip(b" ")


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 21), base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_names(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name of each word, from one running sum over all bytes."""
    up, down = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(raw.astype(np.uint64) * _K[0]) * up)])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def anchors(words: np.ndarray, piece: np.ndarray, window: int = WINDOW, rounds: str = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window within a piece: its first word, the name of its anchor, and the anchor's first word.

    ``words`` are the names of the words of all pieces, ``piece`` the number of
    the piece that each belongs to.
    """
    n = len(words)
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(piece[: n - window + 1] == piece[window - 1 :])
    name, at = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    symbol, begin, part = words, np.arange(n), piece
    alive, low, high = first, first, first + window - 1
    levels = [(symbol, begin, alive, low, high)]
    for k, kind in enumerate(rounds):
        inner = part[1:] == part[:-1]
        if kind == "R":
            joined = np.concatenate([[False], inner & (symbol[1:] == symbol[:-1])])
        else:
            right = ((symbol * _ODD[k]) >> np.uint64(63)).astype(bool)
            joined = np.concatenate([[False], inner & ~right[:-1] & right[1:]])
            keep = low + right[low] <= high - ~right[high]
            alive, low, high = alive[keep], low[keep], high[keep]
            low, high = low + right[low], high - ~right[high]
        heads = np.flatnonzero(~joined)
        to = np.cumsum(~joined) - 1
        if kind == "R":
            low, high = to[low] + 1, to[high] - 1
            size = np.diff(np.append(heads, len(symbol)))
            symbol = symbol[heads]
            long = np.flatnonzero(size > 1)
            symbol[long] = mix64(symbol[long] * _ODD[k] + size[long].astype(np.uint64))
        else:
            low, high = to[low], to[high]
            pair = np.flatnonzero(joined[np.minimum(heads + 1, len(symbol) - 1)])
            pair = pair[heads[pair] + 1 < len(joined)]
            second = symbol[heads[pair] + 1]
            symbol = symbol[heads]
            symbol[pair] = mix64(symbol[pair] * _K[1] + mix64(second * _K[3]))
        begin, part = begin[heads], part[heads]
        keep = low <= high
        alive, low, high = alive[keep], low[keep], high[keep]
        levels.append((symbol, begin, alive, low, high))
    done = np.zeros(n, bool)
    for k in range(len(levels) - 1, -1, -1):
        symbol, begin, alive, low, high = levels[k]
        new = ~done[alive]
        alive, low, high = alive[new], low[new], high[new]
        if not len(alive):
            continue
        best = _first_least(_rank(symbol, begin), low, high)
        name[alive], at[alive] = mix64(symbol[best] + np.uint64(k)), begin[best]
        done[alive] = True
    return first, name[first], at[first]


def _rank(symbol: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Long symbols first, among them those with the least hash."""
    size = np.minimum(np.diff(begin, append=begin[-1] + 1), LONG)
    return ((LONG - size).astype(np.uint64) << np.uint64(60)) | (mix64(symbol) >> np.uint64(4))


def _first_least(rank: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the least rank in each range, the first on ties."""
    best = np.zeros(len(low), np.int64)
    size = high - low + 1
    place, span = np.arange(len(rank)), 1
    while True:
        now = np.flatnonzero((size >= span) & (size < 2 * span))
        if len(now):
            x, y = place[low[now]], place[high[now] - span + 1]
            best[now] = np.where(rank[y] < rank[x], y, x)
        if not (size >= 2 * span).any():
            return best
        x, y = place[:-span], place[span:]
        place = np.concatenate([np.where(rank[y] < rank[x], y, x), place[-span:]])
        span *= 2


def _pieces(texts: list[bytes], window: int) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Normalised texts, or overlapping pieces of long ones, several at once.

    Yields the text's index and first word of each piece, their bytes, and
    start, end and piece of every word.
    """
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def pack() -> tuple:
        data = b"\n".join(p[2] for p in held) + b"\n"
        raw = np.frombuffer(data, np.uint8)
        gap = np.flatnonzero(~NOT_SPACE[raw])
        start, end = np.concatenate([[0], gap[:-1] + 1]), gap
        stops = np.cumsum([len(p[2]) + 1 for p in held])
        return [p[0] for p in held], [p[1] for p in held], data, start, end, np.searchsorted(stops, start, "right")

    for k, t in enumerate(texts):
        if not t:
            continue
        if len(t) <= 4 * PIECE_WORDS:
            cuts = [(0, t)]
        else:
            gaps = np.concatenate([[-1], np.flatnonzero(np.frombuffer(t, np.uint8) == 32), [len(t)]])
            n = len(gaps) - 1
            cuts = ((a, t[gaps[a] + 1 : gaps[min(n, a + PIECE_WORDS + window - 1)]]) for a in range(0, max(1, n - window + 1), PIECE_WORDS))
        for a, piece in cuts:
            held.append((k, a, piece))
            size += len(piece)
            if size > 4 * PIECE_WORDS:
                yield pack()
                held, size = [], 0
    if held:
        yield pack()


def _segments(window: int):
    names = ["anchor", "digest", "doc_id", "row", "low", "high"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2, 1 << 22):
            rows, ids = b.column(0), b.column(1)
            for text, offset, data, start, end, piece in _pieces(text_bytes(b.column(2)), window):
                first, name, at = anchors(word_names(np.frombuffer(data, np.uint8), start, end), piece, window)
                if not len(first):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (at[1:] != at[:-1]) | (np.diff(first) != 1)]))
                low, high = first[new], first[np.append(new[1:], len(first)) - 1]
                digest = np.fromiter(map(xxhash.xxh3_64_intdigest, map(data.__getitem__, map(slice, start[low].tolist(), end[high + window - 1].tolist()))), np.uint64, len(low))
                # Words count from the start of their text.
                shift = np.array(offset)[piece[low]] - np.searchsorted(piece, piece[low])
                take = pa.array(np.array(text)[piece[low]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name[new].view(np.int64)), pa.array(digest.view(np.int64)), ids.take(take), rows.take(take), pa.array((low + shift).astype(np.int32)), pa.array((high + shift).astype(np.int32))], names
                )

    return run


_SHARED = "anchor long, digest long, doc_id long, row long, low int, high int, m long, z long, head boolean, mixed boolean, shared boolean, a_low long, a_high long, edge boolean, part int, place int"


def _shared_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over segments in order of (anchor, digest, document): those whose anchor several documents have.

    ``m`` and ``z`` are the smallest and largest document of the segment's
    words, ``mixed`` whether the anchor has segments of other words, ``head``
    the first segment of its words.  Anchors at the ends of a partition may go
    on in the next one; their segments all stay and are marked ``edge``.
    """
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _SHARED.split(", ")]
    held: list[pa.RecordBatch] = []
    begun = False

    def flush(table: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal begun
        anchor, digest, ids = (table.column(i).to_numpy() for i in range(3))
        n = len(anchor)
        a_head = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        d_head = a_head | np.concatenate([[True], digest[1:] != digest[:-1]])
        a, d = np.cumsum(a_head) - 1, np.cumsum(d_head) - 1
        a_at, d_at = np.flatnonzero(a_head), np.flatnonzero(d_head)
        m, z = np.minimum.reduceat(ids, d_at), np.maximum.reduceat(ids, d_at)
        a_low, a_high = np.minimum.reduceat(ids, a_at), np.maximum.reduceat(ids, a_at)
        mixed = np.bincount(a[d_at], minlength=len(a_at)) > 1
        shared = a_low < a_high
        edge = np.zeros(len(a_at), bool)
        edge[0] |= not begun
        edge[-1] |= last
        begun = True
        keep = np.flatnonzero((shared | edge)[a])
        # Summaries for the borders: the first and the last kind of words of an anchor at the edge.
        place = np.full(n, -1, np.int32)
        for k in {0, len(a_at) - 1} & set(np.flatnonzero(edge).tolist()):
            rows = d_at[a[d_at] == k]
            place[[rows[0], rows[-1]]] = k > 0
        out = [table.column(i).combine_chunks().take(pa.array(keep)) for i in range(6)]
        out += [pa.array(x[keep]) for x in (m[d], z[d], d_head, mixed[a], shared[a], a_low[a], a_high[a], edge[a])]
        out += [pa.array(np.where(place >= 0, part, -1)[keep].astype(np.int32)), pa.array(place[keep])]
        for b in pa.Table.from_arrays(out, names).to_batches(max_chunksize=1 << 16):
            yield b

    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.num_rows
        if size < 1 << 18:
            continue
        table = pa.Table.from_batches(held)
        anchor = table.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1]))
        if cut:
            yield from flush(table.slice(0, cut), False)
            held = table.slice(cut).to_batches()
            size -= cut
    if held:
        yield from flush(pa.Table.from_batches(held), True)


def _pair(anchor: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return mix64(anchor.view(np.uint64) * _K[0] + digest.view(np.uint64) * _K[1])


def _borders(ends: pa.Table) -> tuple[np.ndarray, ...]:
    """Of the anchors at partition borders: anchor, smallest and largest document, whether words differ; of their words: sorted keys, anchor, digest, smallest and largest document."""
    anchor, digest, m, z, low, high, mixed = (c.to_numpy() for c in ends.columns)
    names, at = np.unique(anchor, return_inverse=True)
    a_low, a_high = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(a_low, at, low)
    np.maximum.at(a_high, at, high)
    d_low, d_high, a_mixed = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min), np.zeros(len(names), bool)
    np.minimum.at(d_low, at, digest)
    np.maximum.at(d_high, at, digest)
    np.logical_or.at(a_mixed, at, mixed.astype(bool))
    words, first, of = np.unique(np.stack([anchor, digest], 1), axis=0, return_index=True, return_inverse=True) if len(anchor) else (np.zeros((0, 2), np.int64), np.zeros(0, int), np.zeros(0, int))
    w_m, w_z = np.full(len(words), np.iinfo(np.int64).max), np.full(len(words), np.iinfo(np.int64).min)
    np.minimum.at(w_m, of.ravel(), m)
    np.maximum.at(w_z, of.ravel(), z)
    key = _pair(np.ascontiguousarray(words[:, 0]), np.ascontiguousarray(words[:, 1]))
    order = np.argsort(key)
    return names, a_low, a_high, a_mixed | (d_low < d_high), key[order], words[order, 0], words[order, 1], w_m[order], w_z[order]


_FOUND = "anchor long, digest long, doc_id long, row long, low int, high int, m long, z long, head boolean, mixed boolean"


def _settled(borders):
    """Segments whose anchor several documents have, with what the borders tell of those that go on in other partitions."""
    names = [x.split()[0] for x in _FOUND.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors_, low, high, differ, keys, k_anchor, k_digest, w_m, w_z = borders.value
        for b in batches:
            edge = np.asarray(b.column("edge").to_numpy(zero_copy_only=False), bool)
            keep = np.asarray(b.column("shared").to_numpy(zero_copy_only=False), bool).copy()
            mixed = np.asarray(b.column("mixed").to_numpy(zero_copy_only=False), bool).copy()
            m, z = b.column("m").to_numpy().copy(), b.column("z").to_numpy().copy()
            e = np.flatnonzero(edge)
            if len(e):
                anchor, digest = b.column("anchor").to_numpy()[e], b.column("digest").to_numpy()[e]
                at = np.searchsorted(anchors_, anchor)
                keep[e], mixed[e] = low[at] < high[at], differ[at]
                key = _pair(anchor, digest)
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                same = (k_anchor[k] == anchor) & (k_digest[k] == digest)  # other words lie in one partition only
                m[e[same]], z[e[same]] = w_m[k[same]], w_z[k[same]]
            out = [b.column(n) for n in names[:6]] + [pa.array(m), pa.array(z), b.column("head"), pa.array(mixed)]
            yield pa.RecordBatch.from_arrays(out, names).filter(pa.array(keep))

    return run


def _windows(window: int):
    names = ["w1", "w2", "anchor", "digest", "off", "m", "z"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 0, 1 << 22):
            out: list[list] = [[] for _ in names]
            for t, asked in zip(text_bytes(b.column(0)), b.column(1).to_pylist()):
                gaps = np.concatenate([[-1], np.flatnonzero(np.frombuffer(t, np.uint8) == 32), [len(t)]]).tolist()
                for q in asked:
                    for k in range(q["low"], q["high"] + 1):
                        h = xxhash.xxh3_128_digest(t[gaps[k] + 1 : gaps[k + window]])
                        row = (int.from_bytes(h[:8], "big", signed=True), int.from_bytes(h[8:], "big", signed=True), q["anchor"], q["digest"], k - q["low"], q["m"], q["z"])
                        for c, v in zip(out, row):
                            c.append(v)
                if len(out[0]) > 1 << 17:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "off" else pa.int64()) for c, n in zip(out, names)], names)
                    out = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "off" else pa.int64()) for c, n in zip(out, names)], names)

    return run


def kept_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Words of a normalised text, how many the spans (first word, word after the last) cover, and the others joined by one space."""
    gaps = np.concatenate([[-1], np.flatnonzero(np.frombuffer(text, np.uint8) == 32), [len(text)]])
    n = len(gaps) - 1 if text else 0
    out, at, removed = [], 0, 0
    for a, z in sorted(spans):
        if a > at:
            out.append(text[gaps[at] + 1 : gaps[a]])
        removed += max(0, z - max(a, at))
        at = max(at, z)
    if at < n:
        out.append(text[gaps[at] + 1 :])
    return n, removed, b" ".join(out)


def _result(window: int, with_text: bool):
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *(["kept"] if with_text else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 22):
            made = [kept_words(t, [(s["a"], s["z"]) for s in spans or ()]) for t, spans in zip(text_bytes(b.column(1)), b.column(2).to_pylist())]
            n, removed, kept = zip(*made)
            cols = [b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array([k.decode() for k in kept], pa.string())] if with_text else [])], names)

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and, if wanted, ``kept``.

    A word goes if a window of ``window`` consecutive words that covers it also
    starts in a document with a smaller identifier; windows are judged on the
    input.  Null texts count as empty; texts without words keep nothing, those
    shorter than the window keep everything.  Rows without identifier keep
    everything and are never the earlier document; rows that share an
    identifier are one document, so they do not remove each other's words.
    Texts of any length are parsed in pieces of bounded size.  Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/substring-{uuid.uuid4().hex}"

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    def norm(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1, 1 << 22):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([normalise(t) for t in text_bytes(b.column(1))], pa.binary())], ["doc_id", "words"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base = written(rows.mapInArrow(norm, "doc_id long, words binary").select(F.monotonically_increasing_id().alias("row"), "doc_id", "words"), "texts")
    known = base.filter(F.col("doc_id").isNotNull()).select("row", "doc_id", "words")
    segments = written(known.mapInArrow(_segments(window), "anchor long, digest long, doc_id long, row long, low int, high int"), "segments")

    order = ["anchor", "digest", "doc_id", "row", "low"]
    sorted_ = segments.repartitionByRange(shuffle_parts(spark), *order).sortWithinPartitions(*order)
    near = written(sorted_.mapInArrow(_shared_anchors, _SHARED), "shared")
    # Anchors at partition borders: two anchors a partition, two kinds of words an anchor at most.
    ends = near.filter("part >= 0").select("anchor", "digest", "m", "z", "a_low", "a_high", "mixed").toArrow()
    found = written(near.mapInArrow(_settled(spark.sparkContext.broadcast(_borders(ends))), _FOUND), "found")
    remove_folder(spark, f"{folder}/shared")

    asked = found.filter("mixed and head").groupBy("row").agg(F.collect_list(F.struct("low", "high", "anchor", "digest", "m", "z")).alias("asked"))
    asked = written(asked, "asked")
    windows = written(_texts_of(known, asked).select("words", "asked").mapInArrow(_windows(window), "w1 long, w2 long, anchor long, digest long, off int, m long, z long"), "windows")
    least = written(windows.groupBy("w1", "w2").agg(F.min("m").alias("least"), F.max("z").alias("most")).filter("least < most").drop("most"), "least")
    held = windows.join(least.hint("merge"), ["w1", "w2"]).filter("least < z").groupBy("anchor", "digest").agg(F.collect_set(F.struct("off", "least")).alias("held"))
    held = written(held, "held")
    single = found.filter("mixed").select("anchor", "digest", "doc_id", "row", "low").join(held.hint("merge"), ["anchor", "digest"])
    single = single.select("row", F.explode(F.expr("transform(filter(held, h -> h.least < doc_id), h -> struct(low + h.off AS a, low + h.off + %d AS z))" % window)).alias("span"))
    whole = found.filter("not mixed and m < doc_id").select("row", F.struct(F.col("low").alias("a"), (F.col("high") + window).alias("z")).alias("span"))
    spans = written(whole.unionByName(single).groupBy("row").agg(F.collect_list("span").alias("spans")), "spans")
    for name in ("segments", "found", "asked", "windows", "least", "held"):
        remove_folder(spark, f"{folder}/{name}")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else "")
    ours = id_bitmap(spans.select("row"))
    clean = _rows_of(base, ours, False).withColumn("spans", F.lit(None).cast("array<struct<a:int,z:int>>"))
    torn = _rows_of(base, ours, True).join(spans.hint("merge"), "row", "left")
    return clean.unionByName(torn).select("doc_id", "words", "spans").mapInArrow(_result(window, with_text), schema)


def _rows_of(base: DataFrame, ids, inside: bool) -> DataFrame:
    """Rows whose number may be (or cannot be) among those of the bitmap; a false alarm only travels further."""
    shared = base.sparkSession.sparkContext.broadcast(ids)
    at = base.columns.index("row")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_members(b.column(at), shared.value) == inside))

    return base.mapInArrow(run, base.schema)


def _texts_of(base: DataFrame, asked: DataFrame) -> DataFrame:
    """Texts of the rows that are asked for, with what is asked."""
    return _rows_of(base, id_bitmap(asked.select("row")), True).join(asked.hint("merge"), "row")

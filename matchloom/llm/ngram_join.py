"""Near-duplicate documents by a grouped prefix join on word shingles.

Every document becomes a set of hashed shingles; equal sets form one class.
All sets are ordered by one global order, rare shingles first, and two sets of
Jaccard similarity ``t`` or more share a shingle among the first
``n - ceil(t n) + 1`` of each (the prefix).  Classes with identical prefixes
and sizes form one group, which posts its prefix once.

Group pairs are filtered before members are looked at.  Sets of sizes ``n``
and ``m`` that link share at least ``need = ceil(t (n + m) / (1 + t))``
shingles, so each misses few of the other's, and for any ``l`` their first
``l`` common shingles stand among the first ``n - need + l`` and
``m - need + l``.  A group pair survives if it shares ``l`` shingles there.
Survivors are expanded to their classes, whose whole sets are compared.

Members of a large group of near copies would all survive with each other.
Therefore each posting list first compares its groups with one leader per size
band, and each group its classes with its first one.  What these links join is
one part.  The second step takes all other pairs: within a list, those of
groups in different parts, where only the rows outside the list's largest part
look for partners.  A pair within a part cannot change the result, so no link
is lost, and copies cost one comparison each instead of all pairs.

The order puts shingles that occur often last.  Occurrences are counted for
all shingles of all documents, in a space of 2**32 values; any global order
gives the same result, so collisions there cost time only.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import cut, gram_hashes, id_bitmap, maybe_members, mix64, shuffle_parts, slices, text_bytes, without_ids, word_hashes

K = 5
THRESHOLD = Fraction(3, 4)
#: Shingles seen this often go behind the others.
FREQUENT = 32
#: Edges that one task can hold with ease.
EDGES_PER_PARTITION = 100_000
#: Posting lists of shingles seen more than FREQUENT * 2**SALT_FROM times are dealt over several tasks.
SALT_FROM = 10
#: The table of frequent shingles is broadcast; the bound on its rows is kept by raising FREQUENT in steps of two.
FREQUENT_ROWS = 1 << 21


# --- sets ---------------------------------------------------------------------------


def shingle_sets(texts: list[bytes], k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of several texts, ascending within each, and the start of each text's part."""
    h, row, _, _ = word_hashes(texts)
    first = np.searchsorted(row, np.arange(len(texts) + 1))
    g = gram_hashes(h, k)
    at = np.arange(len(g))
    ok = row[at] == row[at + k - 1] if len(g) else np.zeros(0, bool)
    values, owner = g[ok], row[at[ok]]
    short = [(i, first[i], first[i + 1]) for i in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))]
    if short:
        extra = np.array([gram_hashes(h[a:b], b - a)[0] + np.uint64(b - a) for _, a, b in short], np.uint64)
        values, owner = np.concatenate([values, extra]), np.concatenate([owner, [i for i, _, _ in short]])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def prefix_length(n: int) -> int:
    return n - -(-n * THRESHOLD.numerator // THRESHOLD.denominator) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two ascending sets link."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * THRESHOLD.denominator >= THRESHOLD.numerator * (len(a) + len(b) - both)


def _set_keys(values: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(values ^ np.uint64(c)))]) for c in (0x5BD1E9955BD1E995, 0xC2B2AE3D27D4EB4F)]
    return tuple((t[start[1:]] - t[start[:-1]]).view(np.int64) for t in total)


# --- how often shingles occur --------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """32-bit values, byte plane by byte plane (the high planes are near zero and compress away)."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def frequent_shingles(rows: DataFrame, k: int, least: int, most_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Low 32 bits of the frequent shingles, ascending, and their levels (1: ``least`` to twice that, and so on)."""
    ranges = 1 << max(4, (4 * shuffle_parts(rows.sparkSession) - 1).bit_length())
    shift = np.uint32(32 - (ranges.bit_length() - 1))

    def collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            v, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            part, at = np.unique(v >> shift, return_index=True)
            values = [_pack(np.diff(x, prepend=np.uint32(0))) for x in np.split(v, at[1:])]
            counts = [_pack(x) for x in np.split(n, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(values, pa.binary()), pa.array(counts, pa.binary())], ["part", "values", "counts"])

        for b in slices(batches, 0):
            values, _ = shingle_sets(text_bytes(b.column(0)), k)
            held.append((values & np.uint64(0xFFFFFFFF)).astype(np.uint32))
            if sum(map(len, held)) > 2_000_000:
                yield flush()
        if held:
            yield flush()

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One range of the 2**32 values; ranges grow in number with the shuffle partitions.
        values, counts = [], []
        for b in batches:
            values += [np.cumsum(_unpack(x), dtype=np.uint32) for x in b.column(1).to_pylist()]
            counts += [_unpack(x) for x in b.column(2).to_pylist()]
        v = np.concatenate(values)
        order = np.argsort(v, kind="stable")
        v, n = v[order], np.concatenate(counts)[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.add.reduceat(n, first)
        big = n >= least
        yield pa.RecordBatch.from_arrays([pa.array(v[first][big].astype(np.int64)), pa.array(np.floor(np.log2(n[big] / least)).astype(np.int32) + 1)], ["value", "level"])

    blobs = rows.mapInArrow(collect, "part int, values binary, counts binary")
    found = cut(blobs.groupBy("part").applyInArrow(count, "value long, level int"))
    kept, lowest = 0, 0
    for r in found.groupBy("level").count().orderBy(F.desc("level")).collect():
        if kept + r["count"] > most_rows:
            lowest = r["level"]
            break
        kept += r["count"]
    table = found.filter(F.col("level") > lowest).toArrow()
    value, level = table.column("value").to_numpy().astype(np.uint32), table.column("level").to_numpy().astype(np.uint8)
    order = np.argsort(value)
    return value[order], level[order]


# --- the join ------------------------------------------------------------------------


def _prefixes(rows: DataFrame, k: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per row: id, set size, set hashes, group (hash of prefix and size) and the prefix with the levels of its shingles, once per group and task."""
    shared = rows.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value, level = shared.value
        posted: set[int] = set()
        for b in slices(batches, 1):
            texts = text_bytes(b.column(1))
            values, start = shingle_sets(texts, k)
            k1, k2 = _set_keys(values, start)
            n = np.diff(start)
            rank = np.zeros(len(values), np.int8)
            if len(value):
                low = (values & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                at = np.minimum(np.searchsorted(value, low), len(value) - 1)
                rank = np.where(value[at] == low, level[at], 0).astype(np.int8)
            owner = np.repeat(np.arange(len(texts)), n)
            order = np.lexsort((values, rank, owner))
            ordered, ranks = values[order], rank[order]
            groups, prefixes, levels, named = [], [], [], np.asarray(b.column(0).is_valid())
            for i in range(len(texts)):
                top = slice(start[i], start[i] + prefix_length(int(n[i])) if n[i] else start[i])
                p = ordered[top]
                g = int(np.bitwise_xor.reduce(mix64(p))) ^ int(n[i]) * 0x9E3779B97F4A7C15 % 2**64 if len(p) else None
                g = g - 2**64 if g is not None and g >= 2**63 else g
                new = g is not None and named[i] and g not in posted
                groups.append(g)
                prefixes.append(p.view(np.int64) if new else None)
                levels.append(ranks[top] if new else None)
                if new and len(posted) < 500_000:
                    posted.add(g)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(k1), pa.array(k2), pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(levels, pa.list_(pa.int8()))],
                ["id", "n", "k1", "k2", "g", "prefix", "levels"],
            )

    return rows.mapInArrow(run, "id long, n long, k1 long, k2 long, g long, prefix array<long>, levels array<tinyint>")


def _bands(n: np.ndarray) -> np.ndarray:
    """Size bands: sets of one band differ in size by an eighth at most."""
    return np.floor(np.log(n) / np.log(1.125)).astype(np.int64)


def _lists(sets: DataFrame) -> DataFrame:
    """Posting lists of several groups: (token, g, n, pos) with ``lead``, the leader of the group's size band, or for a leader that of the band before.

    A band is led by the group with the fewest rarer shingles ahead of the list's own: the original of a
    group of edited copies has none of their edits.  Lists are streamed in sorted order; a task holds one
    leader at a time.  Long lists are dealt over tasks, each with leaders of its own.
    """
    posted = sets.filter("prefix is not null and id is not null")
    posts = posted.select("g", "n", F.posexplode(F.arrays_zip("prefix", "levels")).alias("pos", "p")).select(F.col("p.prefix").alias("token"), "g", "n", "pos", F.col("p.levels").alias("level"))
    dealt = F.call_function("shiftleft", F.lit(1), F.greatest(F.col("level").cast("int") - SALT_FROM, F.lit(0)))
    salt = F.when(dealt > 1, F.pmod(F.xxhash64("token", "g"), dealt)).otherwise(-1)  # -1: the list is whole
    posts = posts.select("token", salt.cast("int").alias("salt"), "g", "n", "pos")
    parts = shuffle_parts(sets.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "salt", "g", "n", "pos"]
        held = {c: np.zeros(0, np.int64) for c in names}  # the last row seen, not returned yet if ``alone``
        alone, lead = True, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held["g"])
            x = {c: np.concatenate([held[c], np.asarray(batch.column(i)).astype(np.int64)]) for i, c in enumerate(names)}
            same = (x["token"][1:] == x["token"][:-1]) & (x["salt"][1:] == x["salt"][:-1])
            fresh = np.concatenate([[True], ~(same & (x["g"][1:] == x["g"][:-1]))])  # several tasks may post one group
            x = {c: v[fresh] for c, v in x.items()}
            size = len(x["g"])
            start = np.concatenate([[True], (x["token"][1:] != x["token"][:-1]) | (x["salt"][1:] != x["salt"][:-1])])
            band = _bands(x["n"])
            top = start | np.concatenate([[True], band[1:] != band[:-1]])
            top_at = np.flatnonzero(top)
            mine = top_at[np.cumsum(top) - 1]  # row of the leader of each row's band
            before = np.concatenate([[0], top_at[:-1]])
            leader = np.where(top, 0, x["g"][mine])
            leader[top_at] = x["g"][before]
            has = ~start
            if old and not alone:  # the first row belongs to a list that goes on, and its leader was seen earlier
                in_band = mine == 0
                leader[in_band] = lead
                has[in_band & (np.arange(size) > 0)] = True
                if len(top_at) > 1:
                    leader[top_at[1]] = lead
            run_id = np.cumsum(start) - 1
            several = (np.bincount(run_id)[run_id] > 1) | (x["salt"] >= 0)
            if old and not alone:
                several |= run_id == 0
            out = several.copy()
            if old and not alone:
                out[0] = False  # returned before
            last_several = bool(several[-1])
            if out.any():
                at = np.flatnonzero(out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[c][at]) for c in ("token", "g", "n", "pos")] + [pa.array(leader[at], mask=~has[at])], ["token", "g", "n", "pos", "lead"]
                )
            lead = lead if old and not alone and mine[-1] == 0 else int(x["g"][mine[-1]])
            alone = not last_several
            held = {c: v[-1:] for c, v in x.items()}

    sorted_posts = posts.repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.125)))), "pos", "g")
    return sorted_posts.mapInArrow(run, "token long, g long, n long, pos long, lead long")


def _need(n: Column, m: Column) -> Column:
    """Shingles that two linked sets of these sizes share at least."""
    t = THRESHOLD.numerator, THRESHOLD.numerator + THRESHOLD.denominator
    return F.floor(((n + m) * t[0] + (t[1] - 1)) / t[1])


def _least(n: Column, m: Column) -> Column:
    """How many of their first common shingles a pair is filtered by (``l`` above): about one in a hundred, as many as both prefixes allow."""
    spare = lambda x: _need(n, m) - F.ceil(x * THRESHOLD.numerator / THRESHOLD.denominator) + 1
    return F.least(F.floor((n + m) / 200) + 1, spare(n), spare(m))


def _sizes_fit(n: Column, m: Column) -> Column:
    return (n * THRESHOLD.denominator >= m * THRESHOLD.numerator) & (m * THRESHOLD.denominator >= n * THRESHOLD.numerator)


def _sets(wanted: DataFrame, classes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Shingle sets (c, tokens) of the wanted classes (c), made again from the texts of their first documents."""
    wanted = cut(wanted.distinct().join(classes.hint("merge"), "c").select("c", "k1", "k2"))
    bitmap = rows.sparkSession.sparkContext.broadcast(id_bitmap(wanted.select("c")))

    def sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices((b.filter(pa.array(maybe_members(b.column(0), bitmap.value))) for b in batches), 1):
            values, start = shingle_sets(text_bytes(b.column(1)), k)
            k1, k2 = _set_keys(values, start)
            blobs = [values[start[i] : start[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(k1), pa.array(k2), pa.array(blobs, pa.binary())], ["c", "k1", "k2", "tokens"])

    found = rows.mapInArrow(sets, "c long, k1 long, k2 long, tokens binary")
    return found.join(wanted.hint("shuffle_hash"), ["c", "k1", "k2"], "left_semi").dropDuplicates(["c", "k1", "k2"]).select("c", "tokens")


def _verify(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Those of the ``pairs`` (a, b) whose whole sets link."""
    found = cut(_sets(pairs.select(F.explode(F.array("a", "b")).alias("c")), classes, rows, k))
    # The set of b is sent to a, whose own set is joined where it is compared; many partners of one a can be split.
    one = pairs.join(found.select(F.col("c").alias("b"), F.col("tokens").alias("tb")).hint("merge"), "b").select("a", "b", "tb")
    both = one.join(found.select(F.col("c").alias("a"), F.col("tokens").alias("ta")).hint("merge"), "a").select("a", "b", "ta", "tb")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return cut(both.mapInArrow(compare, "a long, b long"))


def _across(rows: DataFrame, key: str, node: str, kept: list[str], fits: Column) -> DataFrame:
    """Pairs (x, y) of ``node`` in one list (``key``) whose ``part`` differs and that ``fits`` accepts (over ``kept`` and the same names with 2).

    Each list's largest part only answers; the others' rows look for partners among all.
    """
    held = rows.groupBy(key, "part").agg(F.count("*").alias("m")).groupBy(key).agg(F.max_by("part", F.struct("m", "part")).alias("main"), F.count("*").alias("kinds"))
    mixed = cut(rows.join(held.filter("kinds > 1").drop("kinds").hint("merge"), key))
    right = mixed.select(key, *[F.col(c).alias(f"{c}2") for c in (node, "part", *kept)], (F.col("part") == F.col("main")).alias("in_main"))
    met = mixed.filter("part <> main").join(right.hint("merge"), key)
    other = F.col("in_main") | (F.col(node) < F.col(f"{node}2"))
    return met.filter((F.col("part") != F.col("part2")) & other & fits)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node: rows (``c``, ``component``) from edges (a, b), for all nodes with an edge but the smallest ones themselves.

    Alternates two steps that hang every node under the smallest node known
    around it, until nothing changes.  Minima are pre-aggregated, so hubs do
    not gather in one task.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    ends = lambda df, *pairs: df.select(F.explode(F.array(*[F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in pairs])).alias("e")).select("e.u", "e.v")
    for _ in range(most_rounds):
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
        # As many partitions as the edges fill: a small graph needs no shuffles between the steps.
        e = e.coalesce(1) if now.n <= EDGES_PER_PARTITION else e
        both = ends(e, ("u", "v"), ("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = ends(large.join(least.hint("merge"), "u"), ("v", "m"), ("u", "m")).filter("u <> v").distinct()
        e = cut(small)
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "c")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id``.

    ``component_id`` is the smallest identifier reachable by links of Jaccard
    similarity 0.75 or more, the document itself included.  Fewer than ``k``
    words make one shingle; empty and null texts have none, link to nothing
    and keep their own identifier.  Rows without identifier have no component
    and link to nothing.  Rows with shingles that share an identifier are one
    node.  Other columns are ignored; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    frequent = frequent_shingles(rows.select("text"), k, FREQUENT, FREQUENT_ROWS)
    sets = cut(_prefixes(rows, k, frequent))
    known = sets.filter("id is not null and n > 0")
    classes = cut(known.groupBy("k1", "k2", "n", "g").agg(F.min("id").alias("c")))
    lists = cut(_lists(sets))
    placed = cut(sets.select("id", "n", "k1", "k2").join(classes.drop("g").hint("merge"), ["k1", "k2", "n"], "left").select("id", "n", F.when(F.col("id").isNotNull(), F.col("c")).alias("c")))
    # Documents of one identifier with several texts tie their classes together.
    twice = placed.filter("c is not null").groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).filter("a < z")
    same_id = cut(placed.join(twice.hint("merge"), "id").filter("a < c").select("a", F.col("c").alias("b")).distinct())

    # First step: groups against the leaders of their lists, classes against the first of their group.
    heads = classes.groupBy("g").agg(F.min("c").alias("c"), F.max("c").alias("z"), F.min("n").alias("m"))
    led = lists.filter("lead is not null").groupBy("lead", "g").agg(F.count("*").alias("shared"), F.min("n").alias("n"))
    led = led.join(heads.select(F.col("g").alias("lead"), F.col("c").alias("a"), "m").hint("merge"), "lead").filter(_sizes_fit(F.col("n"), F.col("m")) & (F.col("shared") >= _least(F.col("n"), F.col("m"))))
    led = led.join(heads.select("g", F.col("c").alias("b")).hint("merge"), "g").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    in_group = classes.select("g", F.col("c").alias("b")).join(heads.filter("c < z").select("g", F.col("c").alias("a")).hint("merge"), "g").select("a", "b")
    tried = cut(led.unionByName(in_group).filter("a < b").distinct())
    links = _verify(tried, classes, rows, k).unionByName(same_id)
    parts = cut(components(links))

    # Second step: all pairs across parts.
    crew = cut(classes.select("c", "g", "n").join(parts.hint("merge"), "c", "left").select("c", "g", "n", F.coalesce("component", "c").alias("part")))
    label = F.when(F.min("part") == F.max("part"), F.min("part")).otherwise(F.bitwise_not(F.col("g")))  # a group of several parts differs from all
    groups = crew.groupBy("g").agg(label.alias("part"), (F.min("part") < F.max("part")).alias("torn"))
    n, m = F.col("n"), F.col("n2")
    first = lambda pos, size: F.col(pos) < size - _need(n, m) + _least(n, m)
    met = _across(lists.drop("lead").join(groups.select("g", "part").hint("merge"), "g"), "token", "g", ["n", "pos"], _sizes_fit(n, m) & first("pos", n) & first("pos2", m))
    # Which of two groups looks for the other depends on the list, so both orders count together.
    pairs = met.groupBy(F.least("g", "g2").alias("g"), F.greatest("g", "g2").alias("g2"), _least(n, m).alias("least")).agg(F.count("*").alias("shared")).filter("shared >= least").select("g", "g2")
    expanded = pairs.join(crew.select("g", F.col("c").alias("a"), F.col("part").alias("pa")).hint("merge"), "g").join(crew.select(F.col("g").alias("g2"), F.col("c").alias("b"), F.col("part").alias("pb")).hint("merge"), "g2").filter("pa <> pb").select("a", "b")
    torn = _across(crew.join(groups.filter("torn").select("g").hint("merge"), "g", "left_semi"), "g", "c", ["n"], F.lit(True)).select(F.col("c").alias("a"), F.col("c2").alias("b"))
    rest = expanded.unionByName(torn).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    late = _verify(cut(rest.join(tried.hint("merge"), ["a", "b"], "left_anti")), classes, rows, k)

    roots = components(parts.select(F.col("c").alias("a"), F.col("component").alias("b")).unionByName(late))
    out = placed.join(roots.hint("merge"), "c", "left")
    per_id = F.when(F.col("id").isNotNull(), F.coalesce("component", "c", "id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), per_id.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that with the smallest identifier; rows without identifier stay."""
    found = near_duplicates(docs, doc_id, text)
    drop = cut(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(doc_id)).distinct())
    return without_ids(docs, drop, doc_id)

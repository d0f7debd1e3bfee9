"""An index for recall: product-quantised residuals in cells, searched by table look-ups and reranked exactly.

A posting's vector is its cell's centre plus a residual; the residual is cut
into parts, each coded by the number of the nearest word of a small codebook.
A code takes one byte a part, where the vector takes four a dimension, and is
kept in a table sorted by cell.  For a profile the products with all words are
computed once; the score of a code is the product with its centre plus one
look-up a part.  The best few hundred codes of each profile are then compared
by their true vectors.

Centres and codebooks are fitted once on a bounded sample; postings that come
later are coded with them.  Every posting is coded, none is dropped.  How many
cells a profile opens is measured on a bounded sample of profiles against their
exact neighbours, and is all cells where vectors have no structure to use.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from matchloom.operators.recall import BLOCK_ROWS, RECALL_LIMIT, FeedFilters, _matrix, eligible, in_blocks, recall, slices, top_k
from matchloom.operators.store import SnapshotStore

#: Postings and profiles that fitting and measuring look at, at most.
SAMPLE_POSTINGS, SAMPLE_PROFILES = 50_000, 100
#: Codes of a profile that are compared exactly, as a multiple of the rows wanted: at least this, more where :func:`tuned` finds that they are needed.
RERANK = 3
WORDS = 256


@dataclass(frozen=True)
class Codebook:
    """Centres (cells x dimensions), words (parts x words x dimensions of a part), how many cells a search opens and how many codes it compares exactly (times the rows wanted)."""

    centres: np.ndarray
    words: np.ndarray
    probes: int
    rerank: int = RERANK

    @property
    def cells(self) -> int:
        return len(self.centres)

    def order(self, vectors: np.ndarray) -> np.ndarray:
        """Cells of each vector, the nearest first, ties by number."""
        return np.argsort((self.centres**2).sum(1)[None] - 2 * vectors @ self.centres.T, axis=1, kind="stable")

    def split(self, vectors: np.ndarray) -> np.ndarray:
        parts, _, width = self.words.shape
        padded = np.zeros((len(vectors), parts * width))
        padded[:, : vectors.shape[1]] = vectors
        return padded.reshape(len(vectors), parts, width)

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and code (rows x parts, bytes) of each vector."""
        cell = self.order(vectors)[:, 0]
        rest = self.split(vectors - self.centres[cell])
        code = np.empty(rest.shape[:2], np.uint8)
        for k, words in enumerate(self.words):
            code[:, k] = ((words**2).sum(1)[None] - 2 * rest[:, k] @ words.T).argmin(1)
        return cell, code

    def tables(self, profiles: np.ndarray) -> np.ndarray:
        """Products of each profile's parts with all words (parts x profiles x words)."""
        return np.einsum("ipd,pwd->piw", self.split(profiles), self.words)

    def score(self, profiles: np.ndarray, cell: int, code: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Estimated similarity of all profiles and codes of one cell."""
        out = np.repeat((profiles @ self.centres[cell])[:, None], len(code), axis=1)
        for k, table in enumerate(tables):
            out += table[:, code[:, k]]
        return out

    def multiplications(self, codes: int, rerank: int) -> int:
        """Of one profile's search, in whole vectors: centres, words and exact comparisons.  The exact form takes ``codes``."""
        return min(codes, self.cells + self.words.shape[1] + rerank)


def _bounded_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those with the lowest hashes of the key."""
    h = F.pmod(F.xxhash64(key), F.lit(1 << 40))
    rate = min(1.0, 1.2 * (most + 100) / max(1, rows.count()))
    return rows.filter(h < int(rate * (1 << 40))).orderBy(h, key).limit(most)


def _lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """k-means of one part of a bounded sample."""
    rng = np.random.default_rng(seed)
    words = x[rng.choice(len(x), k, replace=len(x) < k)] if len(x) else np.zeros((k, x.shape[1]))
    for _ in range(rounds):
        near = np.concatenate([((words**2).sum(1)[None] - 2 * x[rows] @ words.T).argmin(1) for rows in slices(len(x), k)] or [np.zeros(0, int)])
        size = np.bincount(near, minlength=k)
        total = np.zeros_like(words)
        np.add.at(total, near, x)
        words = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], words)
    return words


def fit(postings: DataFrame, cells: int = 64, parts: int = 16, words: int = WORDS, seed: int = 7) -> Codebook:
    """Centres and codebooks from at most ``SAMPLE_POSTINGS`` embedded postings, those with the lowest hashes.

    The sample's parts are clustered in one task each; the driver receives
    centres and words only.  All cells are opened until :func:`tuned` has
    measured how many are needed.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = postings.sparkSession
    rows = postings.filter(F.col("embedding").isNotNull()).select("posting_id", "embedding")
    sample = _bounded_sample(rows, "posting_id", SAMPLE_POSTINGS).select("embedding").cache()
    try:
        first = sample.first()
        if first is None:
            raise ValueError("no embedded posting to fit on")
        fitted = KMeans(k=max(1, cells), seed=seed, maxIter=10).fit(sample.select(array_to_vector("embedding").alias("features"))) if cells > 1 else None
        dim = len(first["embedding"])
        centres = np.array(fitted.clusterCenters()) if fitted else np.zeros((1, dim))
        width = -(-dim // parts)
        blank = spark.sparkContext.broadcast(Codebook(centres, np.zeros((parts, words, width)), len(centres)))

        def rests(batches):
            for b in batches:
                if b.num_rows:
                    book = blank.value
                    x = _matrix(b.column(0))
                    rest = book.split(x - book.centres[book.order(x)[:, 0]])
                    flat = pa.FixedSizeListArray.from_arrays(pa.array(rest.transpose(1, 0, 2).ravel()), width).cast(pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(parts, dtype=np.int32), len(x))), flat], ["part", "rest"])

        def cluster(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            found = _lloyd(np.stack(rows["rest"].to_numpy()), words, seed)
            return pd.DataFrame({"part": key[0], "word": range(words), "at": list(found)})

        made = sample.mapInArrow(rests, "part int, rest array<double>").groupBy("part").applyInPandas(cluster, "part int, word int, at array<double>").toPandas()
    finally:
        sample.unpersist()
    book = np.zeros((parts, words, width))
    for r in made.itertuples():
        book[r.part, r.word] = r.at
    return Codebook(centres, book, len(centres))


def encode(postings: DataFrame, book: Codebook) -> DataFrame:
    """``posting_id``, ``cell`` and ``code`` of every embedded posting."""
    shared = postings.sparkSession.sparkContext.broadcast(book)

    def run(batches):
        for b in batches:
            if b.num_rows:
                cell, code = shared.value.encode(_matrix(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cell.astype(np.int32)), pa.array([x.tobytes() for x in code], pa.binary())], ["posting_id", "cell", "code"])

    rows = postings.filter(F.col("embedding").isNotNull()).select(F.col("posting_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "posting_id long, cell int, code binary")


def _best_of_cell(book: Callable[[], Codebook], keep: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        p, ids = _matrix(left.column("embedding")), left.column("profile_id").to_numpy()
        others = right.column("posting_id").to_numpy()
        if not len(ids) or not len(others):
            return pa.table({"profile_id": pa.array([], pa.int64()), "posting_id": pa.array([], pa.int64()), "estimate": pa.array([], pa.float64())})
        b = book()
        code = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(len(others), -1)
        k = min(keep, len(others))
        found, estimate = np.empty((len(p), k), np.int64), np.empty((len(p), k))
        for rows in slices(len(p), len(others)):
            score = b.score(p[rows], right.column("cell")[0].as_py(), code, b.tables(p[rows]))
            top = np.argpartition(-score, k - 1, axis=1)[:, :k]
            found[rows], estimate[rows] = others[top], np.take_along_axis(score, top, 1)
        return pa.table({"profile_id": pa.array(np.repeat(ids, k)), "posting_id": pa.array(found.ravel()), "estimate": pa.array(estimate.ravel())})

    return best


def search(profiles: DataFrame, postings: DataFrame, codes: DataFrame, book: Codebook, limit: int = RECALL_LIMIT, filters: FeedFilters | None = None, rerank: int | None = None, block_rows: int = 4 * BLOCK_ROWS) -> DataFrame:
    """Nearest postings by the index: rows (profile_id, posting_id, semantic_score, rank), scores exact.

    ``codes`` may hold more postings than are eligible now; closed ones and
    those that a filter excludes are left out before the search, so they take
    no places.  Eligible postings that have no code are not found: append them
    first.  Large cells are dealt over several tasks; profiles and codes meet
    by cell and part, never in all pairs of tables.
    """
    spark = profiles.sparkSession
    shared = spark.sparkContext.broadcast(book)
    open_ = eligible(postings, filters).select("posting_id", "embedding")
    live = codes.join(open_.select("posting_id").hint("merge"), "posting_id", "left_semi")
    sizes = F.broadcast(live.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts")))  # one row per cell
    dealt = live.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("posting_id"), F.col("parts")).cast("int")).drop("parts")

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        b = shared.value
        return pd.Series(b.order(np.stack(vectors.to_numpy()).astype(float))[:, : b.probes].astype(np.int32).tolist())

    left = profiles.filter(F.col("embedding").isNotNull()).select("profile_id", "embedding")
    probing = left.withColumn("cell", F.explode(nearest("embedding"))).join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keep = rerank or book.rerank * limit
    probing, dealt = in_blocks(probing, dealt, max(1, -(-left.count() // BLOCK_ROWS)))
    found = probing.groupBy("cell", "part", "block").cogroup(dealt.groupBy("cell", "part", "block")).applyInArrow(_best_of_cell(lambda: shared.value, keep), "profile_id long, posting_id long, estimate double")
    # The best estimates of each profile; a profile has at most ``keep`` of each cell and part.
    w = Window.partitionBy("profile_id").orderBy(F.desc("estimate"), "posting_id")
    near = found.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= keep).select("profile_id", "posting_id")
    both = near.join(open_.withColumnRenamed("embedding", "q").hint("merge"), "posting_id").join(left.withColumnRenamed("embedding", "p").hint("merge"), "profile_id")
    return top_k(both.select("profile_id", "posting_id", _product("p", "q").alias("semantic_score")), limit)


@F.pandas_udf(DoubleType())
def _product(p: pd.Series, q: pd.Series) -> pd.Series:
    return pd.Series(np.einsum("ij,ij->i", np.stack(p.to_numpy()).astype(float), np.stack(q.to_numpy()).astype(float)) if len(p) else [], dtype=float)


def tuned(book: Codebook, profiles: DataFrame, postings: DataFrame, codes: DataFrame, limit: int = RECALL_LIMIT, target: float = 0.95) -> Codebook:
    """``book`` with the fewest cells and exact comparisons that hold ``target`` of the exact neighbours of at most ``SAMPLE_PROFILES`` profiles.

    The cells alone hold a share halfway from ``target`` to all.  How many codes are estimated
    higher than a neighbour is counted over the codes of these cells, all of them, where they lie.
    """
    left = profiles.filter(F.col("embedding").isNotNull()).select("profile_id", "embedding")
    asked = left.orderBy(F.xxhash64("profile_id"), "profile_id").limit(SAMPLE_PROFILES)
    vectors = {r["profile_id"]: np.array(r["embedding"], float) for r in asked.collect()}
    orders = {i: book.order(v[None])[0] for i, v in vectors.items()}
    known = recall(asked, postings, limit).select("profile_id", "posting_id")  # at most SAMPLE_PROFILES x limit rows
    near = codes.join(F.broadcast(known), "posting_id").select("profile_id", "cell", "code").collect()
    if not near:
        return replace(book, probes=1)
    depth = np.array([int(np.flatnonzero(orders[r["profile_id"]] == r["cell"])[0]) for r in near])
    share = np.cumsum(np.bincount(depth, minlength=book.cells)) / len(near)
    probes = int(np.searchsorted(share, (1 + target) / 2 - 1e-12)) + 1

    bars: dict[int, list[float]] = {}  # estimates of each profile's neighbours that the cells hold
    for r, d in zip(near, depth):
        if d < probes:
            v = vectors[r["profile_id"]][None]
            bars.setdefault(r["profile_id"], []).append(float(book.score(v, r["cell"], np.frombuffer(r["code"], np.uint8)[None], book.tables(v))[0, 0]))
    shared = postings.sparkSession.sparkContext.broadcast((book, [(i, vectors[i], orders[i][:probes], np.sort(b)) for i, b in sorted(bars.items())]))

    def higher(batches):
        b, asked_ = shared.value
        counts = [np.zeros(len(bar) + 1, np.int64) for _, _, _, bar in asked_]
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(0).to_numpy()
            code = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(cells), -1)
            for n, (_, v, opened, bar) in enumerate(asked_):
                rows = np.flatnonzero(np.isin(cells, opened))
                table = b.tables(v[None])[:, 0]
                score = (b.centres @ v)[cells[rows]] + sum(t[code[rows, k]] for k, t in enumerate(table))
                counts[n] += np.bincount(np.searchsorted(bar, score, side="left"), minlength=len(bar) + 1)
        for (i, _, _, _), c in zip(asked_, counts):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), i)), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(c)], ["profile_id", "bar", "n"])

    per = codes.join(eligible(postings).select("posting_id").hint("merge"), "posting_id", "left_semi").select("cell", "code").mapInArrow(higher, "profile_id long, bar int, n long")
    above: dict[int, np.ndarray] = {i: np.zeros(len(b) + 1, np.int64) for i, b in bars.items()}
    for r in per.groupBy("profile_id", "bar").agg(F.sum("n").alias("n")).collect():
        above[r["profile_id"]][r["bar"]] = r["n"]
    places = np.sort(np.concatenate([np.cumsum(c[::-1])[::-1][1:] for c in above.values()]) + 1)  # of each neighbour among the estimates
    needed = places[min(len(places), int(np.ceil(target * len(near)))) - 1]
    return replace(book, probes=probes, rerank=max(RERANK, int(-(-needed // limit))))


class RecallIndex:
    """The index as tables of a :class:`SnapshotStore`: ``<name>_book`` (one row) and ``<name>_codes`` (sorted by cell).

    Appending writes the new codes only.  A crash leaves the version before.
    """

    def __init__(self, store: SnapshotStore, name: str = "recall") -> None:
        self.store, self.book_table, self.code_table = store, f"{name}_book", f"{name}_codes"

    def _sorted(self, codes: DataFrame) -> DataFrame:
        return codes.repartitionByRange("cell", "posting_id").sortWithinPartitions("cell", "posting_id")

    def create(self, postings: DataFrame, profiles: DataFrame | None = None, limit: int = RECALL_LIMIT, target: float = 0.95, **fitting: int) -> Codebook:
        """Fit on ``postings``, code them all and, given profiles, measure how many cells to open."""
        book = fit(postings, **fitting)
        self.store.write(self.code_table, self._sorted(encode(postings, book)))
        if profiles is not None:
            book = tuned(book, profiles, postings, self.codes(), limit, target)
        self._save(book)
        return book

    def _save(self, book: Codebook) -> None:
        spark: SparkSession = self.store.spark
        row = (book.centres.tolist(), book.words.tolist(), book.probes, book.rerank)
        self.store.write(self.book_table, spark.createDataFrame([row], "centres array<array<double>>, words array<array<array<double>>>, probes int, rerank int").coalesce(1))

    def book(self) -> Codebook:
        r = self.store.read(self.book_table).first()
        return Codebook(np.array(r["centres"], float), np.array(r["words"], float), r["probes"], r["rerank"])

    def codes(self) -> DataFrame:
        return self.store.read(self.code_table)

    def append(self, postings: DataFrame) -> None:
        """Code postings that the index does not have yet, without fitting anew."""
        new = postings.join(self.codes().select("posting_id").hint("merge"), "posting_id", "left_anti")
        self.store.append(self.code_table, self._sorted(encode(new, self.book())))

    def replace(self, postings: DataFrame) -> None:
        """Code postings whose vectors have changed."""
        new = encode(postings, self.book())
        kept = self.codes().join(new.select("posting_id").hint("merge"), "posting_id", "left_anti")
        self.store.write(self.code_table, self._sorted(kept.unionByName(new)))

    def search(self, profiles: DataFrame, postings: DataFrame, limit: int = RECALL_LIMIT, filters: FeedFilters | None = None, **options: int) -> DataFrame:
        return search(profiles, postings, self.codes(), self.book(), limit, filters, **options)


__all__ = ["Codebook", "RecallIndex", "encode", "fit", "search", "tuned"]

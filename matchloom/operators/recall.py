"""Nearest postings of every profile under hard filters.

``recall`` is exact: profiles are broadcast up to a block's size, or both sides
are dealt into blocks; a pair of blocks is one matrix product in one task, and
only each block's best rows reach the final ranking.  ``recall_cells`` compares a profile with the postings of its
nearest k-means cells only.  Filters run before either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

RECALL_LIMIT = 200
BLOCK_ROWS = 4096
#: Similarities that a task holds at once (8 MB of doubles, and a few copies while they are sorted).
CELLS = 1 << 20


@dataclass(frozen=True)
class FeedFilters:
    """What a profile's owner asks for; nothing set means no restriction."""

    remote_only: bool = False
    seniority: tuple[str, ...] = field(default_factory=tuple)
    max_min_years: float | None = None

    @property
    def is_empty(self) -> bool:
        return not (self.remote_only or self.seniority or self.max_min_years is not None)

    def conditions(self) -> list[Column]:
        """Unstated experience passes a threshold; an unstated level is in no band."""
        out = []
        if self.remote_only:
            out.append(F.col("remote_type") == "remote")
        if self.seniority:
            out.append(F.col("seniority").isin(*self.seniority))
        if self.max_min_years is not None:
            out.append(F.col("min_years").isNull() | (F.col("min_years") <= self.max_min_years))
        return out

    def apply(self, postings: DataFrame) -> DataFrame:
        for c in self.conditions():
            postings = postings.filter(c)
        return postings


def eligible(postings: DataFrame, filters: FeedFilters | None = None) -> DataFrame:
    """Open, embedded and extracted postings: one not yet extracted asks for nothing and would fit everybody."""
    rows = postings.filter("closed_at IS NULL AND embedding IS NOT NULL AND extraction_version IS NOT NULL")
    return (filters or FeedFilters()).apply(rows)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))


def slices(profiles: int, postings: int) -> Iterator[slice]:
    """Profiles in parts that hold at most about :data:`CELLS` similarities with the postings."""
    step = max(1, CELLS // max(1, postings))
    return (slice(k, k + step) for k in range(0, profiles, step))


def _best_of_block(limit: int):
    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        p, q = _matrix(left.column("embedding")), _matrix(right.column("embedding"))
        ids, others = left.column("profile_id").to_numpy(), right.column("posting_id").to_numpy()
        if not len(p) or not len(q):
            return pa.table({"profile_id": pa.array([], pa.int64()), "posting_id": pa.array([], pa.int64()), "semantic_score": pa.array([], pa.float64())})
        k = min(limit, len(others))
        # Ties at the border of a block's best are kept by identifier: sort on (-similarity, posting).
        order = np.argsort(others, kind="stable")
        q, others = q[order], others[order]
        found, score = np.empty((len(p), k), np.int64), np.empty((len(p), k))
        for rows in slices(len(p), len(others)):
            sim = p[rows] @ q.T
            top = np.argsort(-sim, axis=1, kind="stable")[:, :k]
            found[rows], score[rows] = others[top], np.take_along_axis(sim, top, 1)
        return pa.table({"profile_id": pa.array(np.repeat(ids, k), pa.int64()), "posting_id": pa.array(found.ravel(), pa.int64()), "semantic_score": pa.array(score.ravel())})

    return best


_FOUND = "profile_id long, posting_id long, semantic_score double"


def top_k(found: DataFrame, limit: int, digits: int = 6) -> DataFrame:
    """The best ``limit`` rows of each profile, ranked; similarities are compared rounded, ties by posting."""
    rounded = found.withColumn("semantic_score", F.bround("semantic_score", digits))
    w = Window.partitionBy("profile_id").orderBy(F.desc("semantic_score"), "posting_id")
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def _best_of_stream(limit: int, shared):
    """Best rows of one partition of postings for all profiles of a bounded block; the block's best so far are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, p = shared.value
        if not len(ids):
            return
        parts = list(slices(len(ids), BLOCK_ROWS))
        best = [(np.zeros((len(ids[rows]), 0)), np.zeros((len(ids[rows]), 0), np.int64)) for rows in parts]
        for b in batches:
            for k in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(k, BLOCK_ROWS)
                q, others = _matrix(part.column(1)), part.column(0).to_numpy()
                for n, rows in enumerate(parts):
                    score = np.concatenate([best[n][0], p[rows] @ q.T], axis=1)
                    found = np.concatenate([best[n][1], np.broadcast_to(others, (len(score), len(others)))], axis=1)
                    top = np.lexsort((found, -score), axis=1)[:, :limit]
                    best[n] = np.take_along_axis(score, top, 1), np.take_along_axis(found, top, 1)
        for rows, (score, found) in zip(parts, best):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], score.shape[1])), pa.array(found.ravel()), pa.array(score.ravel())], ["profile_id", "posting_id", "semantic_score"])

    return run


def recall(profiles: DataFrame, postings: DataFrame, limit: int = RECALL_LIMIT, filters: FeedFilters | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Exact nearest postings: rows (profile_id, posting_id, semantic_score, rank).  Embeddings are unit vectors.

    At most ``block_rows`` profiles, counted first, are broadcast, and postings
    stay where they are; more meet the postings in a grid of blocks.
    """
    left = profiles.filter(F.col("embedding").isNotNull()).select(F.col("profile_id").cast("long"), "embedding")
    right = eligible(postings, filters).select(F.col("posting_id").cast("long"), "embedding")
    # A block's border may cut ties apart after rounding, so blocks hand over a few rows more than asked for.
    few = left.limit(block_rows + 1).toArrow()
    if len(few) <= block_rows:
        shared = left.sparkSession.sparkContext.broadcast((few.column(0).to_numpy(), _matrix(few.column(1))))
        return top_k(right.mapInArrow(_best_of_stream(limit + 32, shared), _FOUND), limit)
    n_left, n_right = (max(1, -(-df.count() // block_rows)) for df in (left, right))
    grid_left = left.withColumn("p", F.pmod(F.xxhash64("profile_id"), F.lit(n_left)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_right - 1))))
    grid_right = right.withColumn("q", F.pmod(F.xxhash64("posting_id"), F.lit(n_right)).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(n_left - 1))))
    found = grid_left.groupBy("p", "q").cogroup(grid_right.groupBy("p", "q")).applyInArrow(_best_of_block(limit + 32), _FOUND)
    return top_k(found, limit)


def recall_sql_form(profiles: DataFrame, postings: DataFrame, limit: int = RECALL_LIMIT, filters: FeedFilters | None = None) -> DataFrame:
    """The same by built-in functions only: every pair in one plan.  For small sides and for checking :func:`recall`."""
    from matchloom.functions.vectors import cosine_of_units

    p = profiles.filter(F.col("embedding").isNotNull()).select("profile_id", F.col("embedding").alias("pe"))
    q = eligible(postings, filters).select("posting_id", F.col("embedding").alias("qe"))
    return top_k(p.crossJoin(q).select("profile_id", "posting_id", cosine_of_units(F.col("pe"), F.col("qe")).alias("semantic_score")), limit)


def recall_cells(profiles: DataFrame, postings: DataFrame, limit: int = RECALL_LIMIT, filters: FeedFilters | None = None, cells: int = 32, target: float = 0.95, sample_rows: int = 100_000, sample_profiles: int = 200, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Approximate nearest postings: each profile is compared with the postings of its nearest cells.

    Cells are fitted on at most about ``sample_rows`` postings; every posting
    is assigned to one.  How many cells a profile looks into is measured: the
    exact neighbours of ``sample_profiles`` profiles (lowest hash of the
    identifier) are looked up, and the smallest number of cells that holds
    ``target`` of them is used for all.  Vectors without structure need most
    cells, clustered ones few.  Large cells are dealt over several tasks.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    right = eligible(postings, filters).select("posting_id", "embedding")
    total = max(1, right.count())
    fitted = KMeans(k=max(2, min(cells, total)), seed=seed, maxIter=15).fit(right.sample(min(1.0, sample_rows / total), seed).select(array_to_vector("embedding").alias("features")))
    centres = np.array(fitted.clusterCenters())

    @F.pandas_udf(ArrayType(IntegerType()))
    def nearest(vectors):
        import pandas as pd

        x = np.stack(vectors.to_numpy()).astype(np.float64)
        d = (centres**2).sum(1)[None] - 2 * x @ centres.T  # the vector's own length does not change the order
        return pd.Series(np.argsort(d, axis=1, kind="stable").astype(np.int32).tolist())

    assigned = right.withColumn("cell", nearest("embedding")[0]).persist(StorageLevel.DISK_ONLY)
    left = profiles.filter(F.col("embedding").isNotNull()).select("profile_id", "embedding")
    asked = left.orderBy(F.xxhash64("profile_id"), "profile_id").limit(sample_profiles)
    known = F.broadcast(recall(asked, postings, limit, filters).select("profile_id", "posting_id"))  # at most sample_profiles x limit rows
    order = F.broadcast(asked.select("profile_id", nearest("embedding").alias("order")))
    depth = assigned.select("posting_id", "cell").join(known, "posting_id").join(order, "profile_id").groupBy(F.array_position("order", F.col("cell")).alias("depth")).count()
    held = sorted((r["depth"], r["count"]) for r in depth.collect())
    share = np.cumsum([n for _, n in held]) / max(1, sum(n for _, n in held))
    probes = int(held[int(np.searchsorted(share, target - 1e-12))][0]) if held else 1

    sizes = assigned.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int"))
    sizes = F.broadcast(sizes.select("cell", "parts"))  # one row per cell
    dealt = assigned.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("posting_id"), F.col("parts")).cast("int")).drop("parts")
    probing = left.withColumn("cell", F.explode(F.slice(nearest("embedding"), 1, probes))).join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    probing, dealt = in_blocks(probing, dealt, max(1, -(-left.count() // block_rows)))
    found = probing.groupBy("cell", "part", "block").cogroup(dealt.groupBy("cell", "part", "block")).applyInArrow(_best_of_block(limit + 32), _FOUND)
    return top_k(found, limit)


def in_blocks(profiles: DataFrame, postings: DataFrame, blocks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``block``: profiles are dealt over blocks, postings stand in each, so no task holds all profiles of a cell."""
    return profiles.withColumn("block", F.pmod(F.xxhash64("profile_id"), F.lit(blocks)).cast("int")), postings.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def recall_at_k(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of the exact rows that the approximate form found: one row (exact_rows, found_rows, recall)."""
    both = exact.select("profile_id", "posting_id").join(approximate.select("profile_id", "posting_id", F.lit(1).alias("hit")), ["profile_id", "posting_id"], "left")
    return both.agg(F.count("*").alias("exact_rows"), F.count("hit").alias("found_rows")).withColumn("recall", F.col("found_rows") / F.col("exact_rows"))


__all__ = ["FeedFilters", "eligible", "recall", "recall_at_k", "recall_cells", "recall_sql_form", "top_k"]

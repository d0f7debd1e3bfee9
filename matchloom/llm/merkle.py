"""Merkle manifest of a table: every row gets a proof up to one root, by butterfly exchange.

Rows are sorted by (group, identifier) and numbered within their group, and
cut into aligned blocks of ``fanout ** depth`` leaves.  A block hashes its own
subtree.  Then the blocks climb together: in each round the blocks of
``fanout`` neighbouring subtrees swap roots, and every one of them hashes the
common ancestor itself.  After the last round each block holds the siblings of
its whole way up, so nothing has to be sent down again.  A block has one
partner in each neighbouring subtree; where the last subtree has fewer blocks
than its neighbours, its blocks serve several of them, in turn.

The groups' roots are the leaves of one more tree, which the same function
builds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import cut, shuffle_parts

#: Leaves of a block are at most this many.
BLOCK_LEAVES = 4096
#: Tables of at most this many rows are broadcast; they are counted first.
BROADCAST_ROWS = 100_000
#: Rounds of the exchange between two checkpoints.
ROUNDS_TOGETHER = 6

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def parent(digests: list[str]) -> str:
    """Hash of the digests in order, as hex text."""
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(columns: Iterable[Column]) -> Column:
    """Hash over the columns: ``-`` for null, else byte count, ``:`` and the value as text."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def height(n: int, fanout: int) -> int:
    """Levels above the leaves until one node remains."""
    h = 0
    while n > 1:
        n, h = -(-n // fanout), h + 1
    return h


def climb(digests: list[str], levels: int, fanout: int) -> list[list[str]]:
    """The nodes of each level from the leaves up, ``levels`` levels above them."""
    out = [digests]
    for _ in range(levels):
        last = out[-1]
        out.append([parent(last[k : k + fanout]) for k in range(0, len(last), fanout)])
    return out


def way(nodes: list[list[str]], k: int, fanout: int) -> list[tuple[int, list[str]]]:
    """Of leaf ``k``: its place among its siblings and their digests, level by level."""
    out = []
    for level in nodes[:-1]:
        a = k - k % fanout
        out.append((k - a, level[a:k] + level[k + 1 : a + fanout]))
        k //= fanout
    return out


def fold(digest: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings lead to."""
    for place, others in steps:
        digest = parent([*others[:place], digest, *others[place:]])
    return digest


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` with the hint to broadcast it if it is small, counted, and to sort and merge it if not."""
    return df.hint("broadcast" if df.count() <= BROADCAST_ROWS else "merge")


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Leaves with their place ``k`` in the order of their group ``grp`` and the group's size ``n``.

    Places come from two passes: within sorted partitions, then offsets from
    counts per group and partition.  A group's rows may thus lie in any number
    of partitions.  ``leaves`` is read twice, so pass a written frame.
    """
    key = [F.col("grp"), *[F.col(c).asc_nulls_first() for c in order]]
    parts = leaves.repartitionByRange(shuffle_parts(leaves.sparkSession), *key).sortWithinPartitions(*key)
    placed = cut(parts.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}))
    # A row per group and partition: as rows are sorted by group, no more than there are partitions and groups.
    counts = placed.groupBy("grp", "part").agg(F.count("*").alias("c"), F.min("at").alias("start"))
    by = Window.partitionBy("grp")
    offsets = cut(counts.select("grp", "part", (F.sum("c").over(by.orderBy("part")) - F.col("c") - F.col("start")).alias("shift"), F.sum("c").over(by).alias("n")))
    return placed.join(_bounded(offsets), ["grp", "part"]).withColumn("k", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _exchange(state: DataFrame, fanout: int, span: int, size: int) -> DataFrame:
    """One round: blocks of ``fanout`` neighbouring subtrees of ``span`` blocks swap roots and hash the common ancestor."""
    block = F.col("block")
    blocks = F.ceil(F.col("n") / size).cast("long")
    mine = F.expr(f"block div {span}")
    begin = mine * span
    held = F.least(blocks - begin, F.lit(span).cast("long"))
    low = block - begin

    def receivers(j: Column) -> Column:
        """Blocks of neighbour ``j`` that this block serves: every ``held``-th; of its own subtree itself alone."""
        first = (F.expr(f"block div {span * fanout}") * fanout + j) * span
        end = F.least(first + span, blocks)
        return F.when(first == begin, F.array(block)).when(first + low < end, F.sequence(first + low, end - 1, held)).otherwise(F.array().cast("array<bigint>"))

    done = F.col("n") <= size * span  # the group has its root
    targets = F.when(done, F.array(block)).otherwise(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(fanout - 1)), receivers)))
    sent = state.select("*", mine.alias("from"), F.explode(targets).alias("to"))
    own = F.when(F.col("block") == F.col("to"), F.struct("n", "levels", "upper", "from", "root"))
    met = sent.groupBy("grp", F.col("to").alias("block")).agg(F.max(own).alias("own"), F.sort_array(F.collect_list(F.struct("from", "root"))).alias("all"))
    others = F.transform(F.filter("all", lambda x: x["from"] != F.col("own.from")), lambda x: x["root"])
    step = F.struct((F.col("own.from") % fanout).cast("int").alias("place"), others.alias("others"))
    done = F.col("own.n") <= size * span
    ancestor = F.sha2(F.array_join(F.transform("all", lambda x: x["root"]), "").cast("binary"), 256)
    return met.select(
        "grp", "block", F.col("own.n").alias("n"), F.col("own.levels").alias("levels"), F.when(done, F.col("own.root")).otherwise(ancestor).alias("root"),
        F.when(done, F.col("own.upper")).otherwise(F.concat("own.upper", F.array(step))).alias("upper"),
    )


def tree(leaves: DataFrame, order: list[str], fanout: int = 2, block_leaves: int = BLOCK_LEAVES) -> tuple[DataFrame, DataFrame]:
    """The trees over the groups of ``leaves``: ``grp`` (text, not null), ``digest`` and the columns of ``order``.

    Returns the leaves with their place ``k`` and ``block``, and one row per
    block: ``grp``, ``block``, ``n`` (leaves of the group), ``levels`` (within
    the block), ``root`` (of the group) and ``upper``, place and siblings of
    each level above the block.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    depth, size = 0, 1
    while size * fanout <= block_leaves:
        depth, size = depth + 1, size * fanout
    placed = cut(numbered(leaves, [*order, "digest"]).withColumn("block", F.expr(f"k div {size}")))

    def subtree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        levels = min(depth, height(n, fanout))
        top = climb(rows.sort_values("k")["digest"].tolist(), levels, fanout)[-1][0]
        return pd.DataFrame({"grp": [key[0]], "block": [key[1]], "n": [n], "levels": [levels], "root": [top]})

    state = placed.select("grp", "block", "n", "k", "digest").groupBy("grp", "block").applyInPandas(subtree, "grp string, block long, n long, levels int, root string")
    state = cut(state.withColumn("upper", F.array().cast("array<struct<place:int,others:array<string>>>")))
    rounds, span = max(0, height(state.agg(F.max("n")).first()[0] or 0, fanout) - depth), 1
    for r in range(rounds):
        state = _exchange(state, fanout, span, size)
        span *= fanout
        if (r + 1) % ROUNDS_TOGETHER == 0 or r + 1 == rounds:
            state = cut(state)
    return placed, state


def _prove(placed: DataFrame, state: DataFrame, fanout: int, visit: Callable[[pd.Series, dict, list], tuple], fields: str) -> DataFrame:
    """Visit every leaf with its way to the root.  ``state`` has a row per block with the ``upper`` part of the way; the lower part is hashed here."""
    names = [f.split()[0] for f in fields.split(", ")]

    def run(_: tuple, rows: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        b = blocks.iloc[0]
        nodes = climb(rows["digest"].tolist(), int(b["levels"]), fanout)
        upper = [(int(s["place"]), list(s["others"])) for s in b["upper"]]
        out = [visit(b, row, way(nodes, k, fanout) + upper) for k, row in enumerate(rows.to_dict("records"))]
        return pd.DataFrame(out, columns=names)

    return placed.groupBy("grp", "block").cogroup(state.groupBy("grp", "block")).applyInPandas(run, fields)


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", doc_id: str = "doc_id", claim: Callable[[DataFrame], Column] | None = None,
    fanout: int = 2, block_leaves: int = BLOCK_LEAVES, with_proof: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root``, ``verified``.

    The leaf is a hash of the ``fields``.  A group's leaves ascend by
    identifier (null first, equal ones by leaf); each ``fanout`` consecutive
    nodes become one until one remains, the group's root; the groups' roots,
    ordered by group (null first, then by UTF-8 bytes), become ``root`` alike.
    ``proof_sha256`` hashes the siblings on the way up, left to right and level
    by level, ``proof`` (if wanted) lists them.  ``folded_root`` is computed
    from them and from the digest that ``claim`` gives for a row, or the leaf
    where it gives none: what a reader of the row holds to be its leaf.
    ``verified`` tells whether it is the root.

    Null fields count as ``-``, empty texts as ``0:``; texts of any length are
    hashed in the JVM and not shuffled.  Repeated rows are leaves each.  Other
    columns are ignored; an empty table gives an empty result.
    """
    made = leaf_digest([F.col(f"`{f}`") for f in fields])
    told = claim(docs) if claim else F.lit(None).cast("string")
    # Group names that sort as wanted: null first, then by bytes.
    name = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    leaves = cut(docs.select(name.alias("grp"), F.col(f"`{doc_id}`").alias("doc_id"), made.alias("digest"), told.alias("told")))
    placed, state = tree(leaves, ["doc_id"], fanout, block_leaves)
    roots = cut(state.select("grp", "root").distinct())
    top_leaves, top = tree(roots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("root").alias("digest")), ["name"], fanout, block_leaves)
    steps = "upper array<struct<place:int,others:array<string>>>"
    ways = cut(_prove(top_leaves, top, fanout, lambda b, row, w: (row["name"], b["root"], [{"place": p, "others": o} for p, o in w]), f"grp string, top string, {steps.replace('upper', 'over', 1)}"))
    state = state.join(_bounded(ways), "grp").select("grp", "block", "levels", "root", "top", F.concat("upper", "over").alias("upper"))

    def visit(b: pd.Series, row: dict, steps: list) -> tuple:
        siblings = [x for _, others in steps for x in others]
        folded = fold(row["told"] or row["digest"], steps)
        base = (row["doc_id"], row["digest"], b["root"], b["top"], parent(siblings), folded, folded == b["top"])
        return (*base, siblings) if with_proof else base

    out = f"doc_id {dict(leaves.dtypes)['doc_id']}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return _prove(placed, state, fanout, visit, out + (", proof array<string>" if with_proof else ""))


def tampered(docs: DataFrame, fields: Sequence[str] = FIELDS, changed: str = "n_chars", doc_id: str = "doc_id", every: int = 7) -> Column:
    """Leaf of the row with one added to ``changed``, where ``every`` divides the crc32 of the identifier as text; null elsewhere."""
    hit = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % every == 0
    return F.when(hit, leaf_digest([F.col(f"`{f}`") + 1 if f == changed else F.col(f"`{f}`") for f in fields]))

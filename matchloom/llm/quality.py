"""Quality classifier: a linear-chain conditional random field labels every line of a document.

Each line has features of its own and of its neighbours; training lines take
the label of their document.  Forward-backward marginals of "good", averaged
with the lines' lengths as weights, make the document's score.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import LOWER, UPPER, extended, held_out, id_sample, mix64, slices, text_bytes
from matchloom.llm.crf import ChainCRF

_DIGITS = b"0123456789"
_SPACE = b" \t\n\v\f\r"
_COMMON = b".,'-"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _COMMON)
OWN = 12
NEAR = 5
N_FEATURES = OWN + 2 * (NEAR + 1)


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature matrix of the lines of one text, and the lines' weights (bytes + 1).  An empty text is one empty line."""
    lines = text.split(b"\n")
    own, seen = [], set()
    for line in lines:
        n = len(line) or 1
        count = lambda which: n_all - len(line.translate(None, which))
        n_all = len(line)
        words = line.split()
        w = len(words) or 1
        upper, lower = count(UPPER), count(LOWER)
        distinct = len(set(words))
        rich = math.log(distinct + 1) / math.log(w + 1) if w > 1 else 1.0
        repeats = sum(map(eq, words, words[1:])) / w
        odd = count(_SYMBOLS) / n
        again = line in seen and n_all > 0
        seen.add(line)
        own.append((
            1.0, math.log1p(n_all) / 5, upper / (upper + lower + 1), odd * 4, count(_DIGITS) / n, min((n_all - count(_SPACE)) / w, 60.0) / 10,
            rich, min(repeats * 4, 2.0), float(again), float(line[-1:] in (b".", b"!", b"?")), float(odd > 0.08), float(rich < 0.75),
        ))
    x = np.zeros((len(lines), N_FEATURES))
    x[:, :OWN] = own
    near = x[:, [2, 3, 6, 7, 8]]
    x[1:, OWN : OWN + NEAR], x[1:, OWN + NEAR] = near[:-1], 1.0
    x[:-1, OWN + NEAR + 1 : N_FEATURES - 1], x[:-1, N_FEATURES - 1] = near[1:], 1.0
    return x, np.array([len(line) + 1.0 for line in lines])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = 4000, max_pieces: int = 4, piece: int = 50, l2: float = 1.0) -> ChainCRF | None:
    """Train on at most ``max_docs`` labelled documents that are not held out (lowest hash of the id).

    Features are made from whole texts, then cut into pieces of ``piece``
    lines; at most ``max_pieces`` of a document, drawn by a hash from its whole
    length, are gathered on the driver.  None if no labels are given.
    """
    sample = labels.filter(~held_out(doc_id) & F.col(label).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    sample = id_sample(sample, "__id", max_docs)
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(sample), "__id")

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            drawn, sizes = [], []
            for t in text_bytes(b.column(1)):
                x = line_features(t)[0].astype(np.float32)
                start = np.arange(0, len(x), piece)
                start = np.sort(start[np.argsort(mix64(start.astype(np.uint64) + np.uint64(len(t))), kind="stable")[:max_pieces]])
                drawn.append(b"".join(x[a : a + piece].tobytes() for a in start))
                sizes.append([min(piece, len(x) - a) for a in start])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(sizes, pa.list_(pa.int32())), pa.array(drawn, pa.binary())], ["id", "y", "n", "x"])

    fields = [T.StructField("id", docs.schema[doc_id].dataType), T.StructField("y", T.IntegerType()), T.StructField("n", T.ArrayType(T.IntegerType())), T.StructField("x", T.BinaryType())]
    got = rows.select("__id", "__t", "__y").mapInArrow(features, T.StructType(fields)).toArrow().sort_by("id")
    if not got.num_rows:
        return None
    sizes = got.column("n").to_pylist()
    lengths = np.array([n for own in sizes for n in own], np.int64)
    lines = np.array([sum(own) for own in sizes], np.int64)
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(-1, N_FEATURES).astype(float)
    y = np.repeat(got.column("y").to_numpy(), lines).astype(float)
    return ChainCRF.fit(x, lengths, y, l2=l2, row_weight=np.repeat(1.0 / np.sqrt(lines), [len(own) for own in sizes]))


def document_score(model: ChainCRF | None, text: bytes) -> tuple[float, int, int]:
    """Length-weighted mean of the lines' marginals, number of lines, number of bad lines."""
    if model is None:
        return 0.5, text.count(b"\n") + 1, 0
    x, weight = line_features(text)
    p = np.array(model.marginals((x @ model.weights).tolist()))
    return float(min(1.0, max(0.0, p @ weight / weight.sum()))), len(p), int((p < 0.5).sum())


def score(docs: DataFrame, model: ChainCRF | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``n_lines`` and ``bad_lines`` added; columns of these names are replaced.

    Null text counts as empty, which is one empty line; without a model every
    score is 0.5.  Each row is scored by its whole text alone, so repeated rows
    score alike; an empty table gives an empty result.  No shuffle.
    """
    added = (("score", T.DoubleType()), ("n_lines", T.IntegerType()), ("bad_lines", T.IntegerType()))
    base = docs.drop(*[n for n, _ in added])
    names = base.columns
    at = names.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, at):
            got = [document_score(model, t) for t in text_bytes(b.column(at))]
            s, n, bad = zip(*got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array(n, pa.int32()), pa.array(bad, pa.int32())], [*names, "score", "n_lines", "bad_lines"])

    return base.mapInArrow(run, extended(base.schema, *added))


def predicted(threshold: float = 0.5) -> Column:
    return (F.col("score") >= threshold).cast("int")

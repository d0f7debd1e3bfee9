"""Toxicity: a linear-chain conditional random field tags the tokens of toxic spans.

Only documents carry labels, so two things are learned from them.  Words, and
beginnings of words (stems), have as evidence how much more often than in clean
training documents they stand behind different words in toxic ones; copies of
one passage bring no new neighbours, and so no weight.  Stems find open
compounds, whose full forms are too rare to be learned.  Token labels are then
fitted to the document labels in rounds: clean documents have no toxic token;
in toxic ones the tags start at the tokens with evidence and are replaced by
what the field fitted on them finds (its best token at least).  The field sees
each token's own evidence, that of its neighbours, and the number and share of
tokens with evidence nearby.  Forward-backward marginals give the offending
offsets and, through a logistic layer fitted on the same training documents,
the document's score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import cut, extended, held_out, id_sample, mix64, slices
from matchloom.llm.crf import ChainCRF, minimise

TOKEN = re.compile(r"[^\W_]+")
#: Digits that stand for letters.
PLAIN = str.maketrans("013457", "oieast")
#: Lengths of the beginnings of words that are stems.
STEM_LENGTHS = range(4, 9)
#: Tokens on either side that are nearby.
NEARBY = 8
N_FEATURES = 9
N_DOC = 4


def lowered(text: str) -> str:
    """Lower case of the same length: the few characters that would become several stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(c.lower()) > 1 else c.lower() for c in text)


def tokens(text: str) -> list[str]:
    return TOKEN.findall(lowered(text))


def by_head(stems: dict[str, float]) -> dict[str, dict[str, float]]:
    """Stems by their first letters, as many as the shortest has."""
    out: dict[str, dict[str, float]] = {}
    for stem, weight in stems.items():
        out.setdefault(stem[: STEM_LENGTHS[0]], {})[stem] = weight
    return out


def evidence(words: list[str], lexicon: dict[str, float], stems: dict[str, dict[str, float]]) -> list[float]:
    """Largest weight of each token and of its stems, 0 for unknown ones; digits within words are read as letters too."""
    get, heads = lexicon.get, STEM_LENGTHS[0]

    def stem(w: str) -> float:
        near = stems.get(w[:heads])
        return max(near.get(w[:n], 0.0) for n in STEM_LENGTHS) if near else 0.0

    found = [get(w, 0.0) for w in words]
    for k, w in enumerate(words):
        if w[:heads] in stems:
            found[k] = max(found[k], stem(w))
        if not found[k] and not w.isalpha() and not w.isdigit():
            plain = w.translate(PLAIN)
            found[k] = max(get(plain, 0.0), stem(plain))
    return found


def token_features(found: np.ndarray) -> np.ndarray:
    x = np.zeros((len(found), N_FEATURES))
    hit = found > 0
    x[:, 0], x[:, 1], x[:, 2] = 1.0, hit, found
    x[1:, 3], x[:-1, 4] = hit[:-1], hit[1:]
    x[2:, 5], x[:-2, 6] = hit[:-2], hit[2:]
    at, until = np.arange(len(found)), np.concatenate([[0], np.cumsum(hit)])
    low, high = np.maximum(at - NEARBY, 0), np.minimum(at + NEARBY + 1, len(found))
    near = until[high] - until[low] - hit
    x[:, 7], x[:, 8] = np.log1p(near), near / np.maximum(high - low - 1, 1)
    return x


def document_features(p: list[float]) -> list[float]:
    top, total = max(p, default=0.0), sum(p)
    return [1.0, math.log((top + 1e-4) / (1.0001 - top)), math.log1p(total), math.sqrt(total / (len(p) + 1))]


@dataclass
class ToxicityModel:
    lexicon: dict[str, float]
    chain: ChainCRF
    layer: np.ndarray
    stems: dict[str, dict[str, float]] = field(default_factory=dict)

    def clean_run(self, n: int) -> list[float]:
        """Marginals of ``n`` tokens without any evidence."""
        if not hasattr(self, "_runs"):
            self._runs: dict[int, list[float]] = {}
        if n not in self._runs:
            if len(self._runs) > 20_000:
                self._runs.clear()
            self._runs[n] = self.document_and_max([float(self.chain.weights[0])] * n)
        return self._runs[n]

    def document_and_max(self, scores: list[float]) -> list[float]:
        return document_features(self.chain.marginals(scores))

    def features(self, text: str) -> list[float]:
        """What the document layer sees."""
        found = evidence(tokens(text), self.lexicon, self.stems)
        return document_features(self.chain.marginals((token_features(np.array(found)) @ self.chain.weights).tolist())) if any(found) else self.clean_run(len(found))

    def judge(self, text: str, at_least: float = 0.5) -> tuple[float, int, list[dict]]:
        """Score of a document, number of tokens, and spans of toxic tokens with their character offsets and largest marginal."""
        words = tokens(text)
        found = evidence(words, self.lexicon, self.stems)
        spans: list[dict] = []
        if any(found):
            p = self.chain.marginals((token_features(np.array(found)) @ self.chain.weights).tolist())
            feats = document_features(p)
            for k, m in enumerate(TOKEN.finditer(lowered(text))):
                if p[k] >= at_least:
                    if spans and spans[-1]["last"] == k - 1:
                        spans[-1] |= {"end": m.end(), "last": k, "p": max(spans[-1]["p"], p[k])}
                    else:
                        spans.append({"start": m.start(), "end": m.end(), "p": p[k], "last": k})
        else:
            feats = self.clean_run(len(words))
        z = float(np.dot(feats, self.layer))
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))), len(words), [{"start": s["start"], "end": s["end"], "p": float(s["p"])} for s in spans]


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x @ w, -30, 30)
        p = 1 / (1 + np.exp(-z))
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * l2 * w @ w), x.T @ (p - y) + l2 * w

    return minimise(loss, np.zeros(x.shape[1]), 200)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", max_docs: int = 4000, max_pieces: int = 16, window: int = 64, rounds: int = 3, min_support: int = 8, min_z: float = 3.5) -> ToxicityModel | None:
    """Train on at most ``max_docs`` toxic and as many clean documents that are not held out (lowest hash of the id).

    Evidence counts cover the whole texts of these documents.  For the chain,
    tokens are cut into pieces of ``window``; pieces without evidence are alike
    and only counted, of the others at most ``max_pieces`` of a document, drawn
    by a hash, reach the driver.  None without labels or evidence.
    """
    known = labels.filter(~held_out(doc_id) & F.col(label).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("__y"))
    pick = lambda y: id_sample(known.filter(F.col("__y") == y), "__id", max_docs)
    sample = pick(1).unionByName(pick(0))
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__t")).join(F.broadcast(sample), "__id").select("__id", "__t", "__y")

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            out: set[tuple[str, str, int]] = set()
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = tokens(t or "")
                out.update(zip(words, ["", *words], [y] * len(words)))
            w, left, y = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(left, pa.string()), pa.array(y, pa.int32())], ["w", "left", "y"])

    pairs = rows.mapInArrow(neighbours, "w string, left string, y int").distinct()
    counts = cut(pairs.groupBy("w").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg")))
    begun = F.explode(F.array(*[F.when(F.length("w") >= n, F.substring("w", 1, n)) for n in STEM_LENGTHS]))
    beginnings = counts.select(begun.alias("w"), "pos", "neg").filter("w is not null").groupBy("w").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = counts.agg(F.sum("pos").alias("tp"), F.sum("neg").alias("tn")).first()
    ratio = F.log((F.col("pos") + 0.5) / F.lit(float((totals.tp or 0) + 1))) - F.log((F.col("neg") + 0.5) / F.lit(float((totals.tn or 0) + 1)))
    z = ratio / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("neg") + 0.5))

    def learned(seen: DataFrame) -> dict[str, float]:
        chosen = seen.withColumn("ratio", ratio).withColumn("z", z).filter((F.col("pos") >= min_support) & (F.col("z") >= min_z) & (F.col("ratio") >= 1.2))
        return {r["w"]: round(float(r["ratio"]), 6) for r in chosen.select("w", "ratio").collect()}

    lexicon, stems = learned(counts), by_head(learned(beginnings))

    if not (lexicon or stems):
        return None

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document: evidence of its drawn pieces with their surroundings, where the pieces begin and end in it, and the lengths of those without evidence."""
        for b in slices(batches, 1):
            rows_out: list[tuple] = []
            for t in b.column(1).to_pylist():
                f = np.array(evidence(tokens(t or ""), lexicon, stems), np.float32)
                edges = np.arange(0, len(f), window)
                hit = np.logical_or.reduceat(f > 0, edges) if len(f) else np.zeros(0, bool)
                full, part = int((~hit[: len(f) // window]).sum()), 0 if not len(f) % window or hit[-1] else len(f) % window
                some = edges[hit]
                some = np.sort(some[np.argsort(mix64(some.astype(np.uint64) + np.uint64(len(f))), kind="stable")[:max_pieces]])
                around = [(max(0, x - NEARBY), min(len(f), x + window + NEARBY)) for x in some]
                at = [(x - lo, min(x + window, len(f)) - lo) for x, (lo, _) in zip(some, around)]
                rows_out.append((full, part, np.concatenate([f[lo:hi] for lo, hi in around] or [f[:0]]).tobytes(), np.array([(hi - lo, *where) for (lo, hi), where in zip(around, at)], np.int32).tobytes()))
            full, part, f, where = zip(*rows_out)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(full, pa.int32()), pa.array(part, pa.int32()), pa.array(f, pa.binary()), pa.array(where, pa.binary())], ["id", "y", "full", "part", "f", "at"])

    key = T.StructField("id", docs.schema[doc_id].dataType)
    fields = [key, T.StructField("y", T.IntegerType()), T.StructField("full", T.IntegerType()), T.StructField("part", T.IntegerType()), T.StructField("f", T.BinaryType()), T.StructField("at", T.BinaryType())]
    got = rows.mapInArrow(pieces, T.StructType(fields)).toArrow().sort_by("id")
    plain = Counter({window: sum(got.column("full").to_pylist())})
    plain.update(n for n in got.column("part").to_pylist() if n)
    x, lengths, owner = [], [], []
    for k, (f, at) in enumerate(zip(got.column("f").to_pylist(), got.column("at").to_pylist())):
        f, start = np.frombuffer(f, np.float32).astype(float), 0
        for size, lo, hi in np.frombuffer(at, np.int32).reshape(-1, 3).tolist():
            x.append(token_features(f[start : start + size])[lo:hi])
            lengths.append(hi - lo)
            owner.append(k)
            start += size
    if not x:
        return None
    y = got.column("y").to_numpy()
    document = np.repeat(owner, lengths)
    toxic = y[document] == 1
    blank = sorted(n for n, m in plain.items() if m)
    features = np.concatenate([*x, *[token_features(np.zeros(n)) for n in blank]])
    sizes = np.array([*lengths, *blank])
    weight = np.array([1.0] * len(lengths) + [float(plain[n]) for n in blank])
    mine = len(document)
    tags = np.zeros(len(features))
    tags[:mine] = (features[:mine, 1] > 0) & toxic
    for _ in range(rounds):
        chain = ChainCRF.fit(features, sizes, tags, l2=1.0, row_weight=weight)
        p, at = np.zeros(mine), 0
        scores = features[:mine] @ chain.weights
        for n in lengths:
            p[at : at + n] = chain.marginals(scores[at : at + n].tolist())
            at += n
        best = np.zeros(len(y))
        np.maximum.at(best, document, p)
        again = ((p >= 0.5) | (p == best[document])) & toxic
        if (again == tags[:mine]).all():
            break
        tags[:mine] = again
    model = ToxicityModel(lexicon, chain, np.zeros(N_DOC), stems)

    def summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1):
            d = [model.features(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(d, pa.list_(pa.float64()))], ["id", "y", "d"])

    got = rows.mapInArrow(summaries, T.StructType([key, fields[1], T.StructField("d", T.ArrayType(T.DoubleType()))])).toArrow().sort_by("id")
    model.layer = _logistic(np.array(got.column("d").to_pylist()), got.column("y").to_numpy().astype(float))
    return model


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("p", T.DoubleType())]))


def score(docs: DataFrame, model: ToxicityModel | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, ``n_tokens`` and ``spans`` (character offsets) added; columns of these names are replaced.

    Null text counts as empty: no tokens, no spans, and the lowest score.
    Without a model every score is 0.  Each row is scored by its text alone, so
    repeated rows score alike; an empty table gives an empty result.  Texts are
    read whole.  No shuffle.
    """
    added = (("score", T.DoubleType()), ("n_tokens", T.IntegerType()), ("spans", SPANS))
    base = docs.drop(*[n for n, _ in added])
    names = base.columns
    at = names.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
        for b in slices(batches, at):
            texts = b.column(at).to_pylist()
            got = [model.judge(t or "") if model else (0.0, len(tokens(t or "")), []) for t in texts]
            s, n, sp = zip(*got)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array(n, pa.int32()), pa.array(sp, span)], [*names, "score", "n_tokens", "spans"])

    return base.mapInArrow(run, extended(base.schema, *added))

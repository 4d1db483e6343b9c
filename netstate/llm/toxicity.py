"""Toxicity of a text: a factorization machine over hashed terms.

Terms are the words of the lower-cased text and the beginnings of longer words (4 and 5 letters), hashed; a term counts once
a text, and only terms whose frequency differs significantly between the labels take part. Besides a weight, every term has a short vector, and the products of the vectors of all pairs of terms add to the
score: a pair such as an insult and the name of a group can weigh more than its two words do.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm.languages import hash_order
from netstate.llm.samples import held_out, stratified
from netstate.llm.texts import documents
from netstate.session import materialize

FACTORS = 8
#: Terms with a smaller log-likelihood ratio statistic between the labels are left out.
SIGNIFICANT = 12.0
#: At most about so many rows of either label are learned from.
SAMPLE = 4000
#: The ids drawn are sent to all tasks up to so many (16 bytes each), else joined by a shuffle.
BROADCAST = 100_000
THRESHOLD = 0.3
WORDS = re.compile(r"[^\W\d_]+")
CACHED = 300_000


class Terms(dict):
    """Hashed features of a word; with ``rows``, the rows of a model's table that they have."""

    def __init__(self, rows: dict[int, int] | None = None):
        super().__init__()
        self.rows = rows

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        forms = [word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k)]
        out = [zlib.crc32(f.encode("utf-8", "surrogatepass")) for f in forms]
        if self.rows is not None:
            out = [self.rows[h] for h in out if h in self.rows]
        self[word] = tuple(out)
        return self[word]

    def of(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for word in set(WORDS.findall((text or "").lower())):
            found.update(self[word])
        return np.array(sorted(found), dtype=np.uint32)


def significance(with_1: np.ndarray, with_0: np.ndarray, n_1: int, n_0: int) -> np.ndarray:
    """Log-likelihood ratio of a term's document counts in both labels against one common rate."""
    def part(seen, expected):
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)
    share = (with_1 + with_0) / (n_1 + n_0)
    return 2 * sum(part(k, n * share) + part(n - k, n * (1 - share)) for k, n in ((with_1, n_1), (with_0, n_0)))


class ToxicityModel:
    """bias + weights of terms + products of the vectors of pairs of terms, through a logistic function."""

    def __init__(self, bias: float, terms: np.ndarray, weights: np.ndarray, vectors: np.ndarray):
        self.bias, self.weights, self.vectors = bias, weights, vectors
        self.rows = {int(h): i for i, h in enumerate(terms)}

    def score(self, at: np.ndarray) -> float:
        """Probability of label 1 for rows of the term table."""
        v = self.vectors[at]
        total = v.sum(axis=0)
        z = self.bias + self.weights[at].sum() + 0.5 * (total @ total - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))

    @classmethod
    def train(cls, rows: list[tuple[np.ndarray, int]], prior: float, epochs: int = 20, rate=0.2, l1=1e-3, l2=1e-3) -> "ToxicityModel":
        """Adaptive gradient steps on the logistic loss with elastic net. Weights start at the log ratio of the term's rates.

        ``prior`` is the share of label 1 among all labelled rows; the bias is moved there from the share in the sample.
        """
        draw = np.random.default_rng(7)
        y = np.array([k for _, k in rows], dtype=int)
        n_1, n_0 = int(y.sum()), int(len(y) - y.sum())
        flat = np.concatenate([at for at, _ in rows]) if rows else np.zeros(0, np.uint32)
        terms, number = np.unique(flat, return_inverse=True)
        label = np.repeat(y, [len(at) for at, _ in rows])
        with_1, with_0 = (np.bincount(number[label == k], minlength=len(terms)).astype(float) for k in (1, 0))
        ratio = np.log((with_1 + 0.5) / (n_1 + 1)) - np.log((with_0 + 0.5) / (n_0 + 1))
        keep = significance(with_1, with_0, n_1, n_0) >= SIGNIFICANT if n_1 and n_0 else np.zeros(len(terms), dtype=bool)
        terms, w = terms[keep], 0.5 * ratio[keep]
        known = {int(h): i for i, h in enumerate(terms)}
        rows = [(np.array([known[h] for h in at.tolist() if h in known], dtype=np.int64), k) for at, k in rows]
        v = draw.normal(0, 0.05, (len(terms), FACTORS))
        gw, gv = np.ones(len(terms)), np.ones((len(terms), FACTORS))
        share = min(max(n_1 / max(1, len(rows)), 1e-6), 1 - 1e-6)
        bias, gb = np.log(share / (1 - share)) - 1.0, 1.0
        for _ in range(epochs):
            for k in draw.permutation(len(rows)):
                at, truth = rows[k]
                va = v[at]
                total = va.sum(axis=0)
                z = bias + w[at].sum() + 0.5 * (total @ total - (va * va).sum())
                e = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - truth
                gb += e * e
                bias -= rate * e / np.sqrt(gb)
                if len(at):
                    g = e + l2 * w[at]
                    gw[at] += g * g
                    step = rate / np.sqrt(gw[at])
                    new = w[at] - step * g
                    w[at] = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
                    g = np.clip(e * (total - va), -1, 1) + l2 * va
                    gv[at] += g * g
                    v[at] = va - rate * g / np.sqrt(gv[at])
        p = min(max(prior, 1e-6), 1 - 1e-6)
        shift = np.log(p / (1 - p)) - np.log(share / (1 - share))
        return cls(float(bias + shift), terms, w, v)

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> "ToxicityModel":
        """From texts and ``labels.toxic`` of rows outside the held-out fold; several labels of an id count as their largest."""
        marks = labels.where(F.col("toxic").isNotNull() & ~held_out() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
            F.max(F.col("toxic").cast("int")).alias("toxic"))
        counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
        chosen = materialize(stratified(marks, "toxic", most), "toxic-sample")
        chosen = F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen      # about ``most`` rows a label

        def features(batches):
            terms = Terms()
            for batch in batches:
                yield pa.record_batch([batch.column("doc_id"), batch.column("toxic"),
                                       pa.array([terms.of(t.as_py()).tobytes() for t in batch.column("text")], pa.binary())],
                                      names=["doc_id", "toxic", "terms"])

        rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "text", "toxic").mapInArrow(
            features, "doc_id bigint, toxic int, terms binary").collect()      # bounded by ``most``
        rows.sort(key=lambda r: (hash_order(r["doc_id"]), r["terms"]))
        data = [(np.frombuffer(r["terms"], dtype=np.uint32), r["toxic"]) for r in rows]
        return cls.train(data, counts.get(1, 0) / max(1, sum(counts.values())))


def scored(docs: DataFrame, model: ToxicityModel, *more: str) -> DataFrame:
    """doc_id, part, the columns ``more``, and score of every row from its text alone; null texts count as empty."""
    docs = documents(docs, *more)
    held = docs.sparkSession.sparkContext.broadcast(model)         # significant terms x (1 + FACTORS) numbers
    kept = docs.drop("text").schema

    def run(batches):
        model = held.value
        terms = Terms(model.rows)
        for batch in batches:
            score = [model.score(terms.of(t.as_py())) for t in batch.column("text")]
            yield pa.record_batch([*(batch.column(f.name) for f in kept), pa.array(score, pa.float64())],
                                  names=[*(f.name for f in kept), "score"])
    return docs.mapInArrow(run, type(kept)([*kept.fields]).add("score", "double"))


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, ToxicityModel.fit(docs, labels)).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all their columns, whose text scores below the threshold."""
    model = ToxicityModel.fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches):
        model = held.value
        terms = Terms(model.rows)
        for batch in batches:
            yield batch.filter(pa.array([model.score(terms.of(t.as_py())) < threshold for t in batch.column(at)], pa.bool_()))
    return docs.mapInArrow(run, docs.schema).select(*names)

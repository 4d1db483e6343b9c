"""Language of a text: multinomial logistic regression on TF-IDF of character n-grams.

n-grams of one to three characters of the lower-cased text are hashed. A term's weight is its share among the n-grams of
the text times its inverse document frequency, counted over all rows of the learning folds. The sparse regression is trained by
follow-the-regularised-leader with elastic net on a bounded sample, then one temperature is fitted on a fifth of that sample.
As the features are linear in counts, a prediction is a mean of table rows and no vector per text is built.
"""
from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.llm.samples import held_out, stratified
from netstate.llm.texts import documents

BITS, ORDERS, SCALE = 15, 3, 32.0
DIMS = ORDERS << BITS
#: At most about so many rows of every language are learned from.
SAMPLE = 1500
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def ngrams(text: str) -> np.ndarray:
    """Hashed n-grams of a text, with repeats; unpaired surrogates and short texts are fine."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out = []
    for n in range(1, min(ORDERS, len(c)) + 1):
        h = np.zeros(len(c) - n + 1, dtype=np.uint32)
        for i in range(n):
            h = (h ^ c[i:len(c) - n + 1 + i]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out.append((h >> np.uint32(32 - BITS)) + np.uint32((n - 1) << BITS))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


class FTRL:
    """Follow-the-regularised-leader for a softmax over sparse rows; weights are sparse by the L1 part of the penalty."""

    def __init__(self, dims: int, classes: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.02):
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p[None, :]
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of logits that makes held-back labels likeliest."""
    if not len(labels):
        return 1.0
    tried = np.geomspace(0.02, 20, 121)
    loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-300).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray, heat: float):
        self.languages, self.table, self.heat = languages, table, heat

    @classmethod
    def fit(cls, docs: DataFrame, most: int = SAMPLE, epochs: int = 3) -> "LanguageModel":
        """From doc_id, text and lang of rows with an id outside the held-out fold; without such rows every text is unknown."""
        rows = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")

        def frequencies(batches):
            df, seen, n = np.zeros(DIMS + 1, dtype=np.int64), np.zeros(DIMS, dtype=bool), 0
            for batch in batches:
                for text in batch.column("text"):
                    seen[ngrams(text.as_py())] = True
                    at = np.flatnonzero(seen)
                    df[at] += 1
                    seen[at] = False
                    n += 1
            df[DIMS] = n                                           # the number of texts
            at = np.flatnonzero(df)
            yield pa.record_batch({"term": pa.array(at, pa.int32()), "df": pa.array(df[at], pa.int64())})

        def features(batches):
            for batch in batches:
                at, count = [], []
                for text in batch.column("text"):
                    u, c = np.unique(ngrams(text.as_py()), return_counts=True)
                    at.append(u.astype(np.int32).tobytes())
                    count.append(c.astype(np.int32).tobytes())
                yield pa.record_batch([batch.column("doc_id"), batch.column("lang"), pa.array(at, pa.binary()),
                                       pa.array(count, pa.binary())], names=["doc_id", "lang", "term", "tf"])

        table = rows.select("text").mapInArrow(frequencies, "term int, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        df = np.zeros(DIMS + 1)
        for r in table.collect():                                  # as many rows as hashed terms
            df[r["term"]] = r["df"]
        idf = np.log((1 + df[DIMS]) / (1 + df[:DIMS])) + 1
        sample = stratified(rows, "lang", most).mapInArrow(features, "doc_id bigint, lang string, term binary, tf binary").collect()
        sample.sort(key=lambda r: (hash_order(r["doc_id"]), r["lang"], r["term"]))
        languages = sorted({r["lang"] for r in sample})
        number = {v: i for i, v in enumerate(languages)}
        data = []
        for r in sample:
            at, tf = np.frombuffer(r["term"], dtype=np.int32), np.frombuffer(r["tf"], dtype=np.int32)
            data.append((at, SCALE * tf / max(1, tf.sum()) * idf[at], number[r["lang"]]))
        learner = FTRL(DIMS, max(1, len(languages)))
        train, tune = [d for i, d in enumerate(data) if i % 5], data[::5]
        for _ in range(epochs):
            for d in train:
                learner.learn(*d)
        w = learner.weights()
        logits = np.array([x @ w[at] for at, x, _ in tune]).reshape(len(tune), w.shape[1])
        heat = temperature(logits, np.array([k for *_, k in tune], dtype=int))
        return cls(languages, (w * idf[:, None] * SCALE / heat).astype(np.float32), heat)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated probability); unknown with 0 for a null text or one without a letter."""
        if not text or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        p = softmax(self.table[ngrams(text)].mean(axis=0, dtype=np.float64))
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def hash_order(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15) % (1 << 64)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, part, lang_pred and score of every row from its text alone."""
    held = docs.sparkSession.sparkContext.broadcast(model)         # DIMS x languages numbers

    def run(batches):
        model = held.value
        for batch in batches:
            found = [model.predict(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), batch.column("part"), pa.array([f[0] for f in found], pa.string()),
                                   pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "part", "lang_pred", "score"])
    return documents(docs).select("doc_id", "part", "text").mapInArrow(run, "doc_id bigint, part int, lang_pred string, score double")


def language_digest(docs: DataFrame) -> DataFrame:
    return identified(docs, LanguageModel.fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")

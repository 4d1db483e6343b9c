"""Trained forecasters: one logistic regression per future step on the flattened history."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators.chunks import neighbours
from netstate.operators.scaling import Scaler
from netstate.operators.sequences import KEYS, has_history, history_of, with_future, with_samples
from netstate.session import materialize

# Inverse regularisation strength, iteration limit and sample cap of the baseline.
STRENGTH, ITERATIONS, SAMPLE_CAP = 0.05, 300, 40_000
COEFFICIENTS = "step int, class int, window int, feature string, weight double"
ABOUT = "scaler string, stages array<string>, history int, horizon int, window_seconds int"


def training_rows(states: DataFrame, scaler: Scaler, vocab: list[str], options: Options, label: str = "train",
                  cap: int = SAMPLE_CAP) -> DataFrame:
    """Samples of one split: ``flat`` history vector, future attack flags, future stage ids.

    Of more than ``cap`` samples about so many are drawn by a seeded hash of their key, each task by itself; only those gather
    their history.
    """
    samples = with_samples(with_future(states, options, vocab), options).where("is_sample").where(
        F.col("split") == label).select(*KEYS, "pos", "future_attack", "future_stage")
    samples = materialize(samples, "samples")
    share = cap / max(samples.count(), 1)
    draw = F.pmod(F.xxhash64(F.lit(options.seed), *KEYS, "pos"), F.lit(1 << 32)) / float(1 << 32)
    picked = samples if share >= 1 else materialize(samples.where(draw < share), "picked-samples")
    found = history_of(states, picked, scaler.vector(), options, few=True)
    return found.select(*KEYS, "pos", F.flatten("history").alias("flat")).join(picked, [*KEYS, "pos"])


def _regression(rows: DataFrame, n: float, iterations: int) -> LogisticRegression:
    """Same objective as a penalised sum of losses with strength C: Spark averages the losses over the weights."""
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=iterations, tol=1e-5,
                              regParam=1.0 / (STRENGTH * n), elasticNetParam=0.0, standardization=False)


def softmax(logits: list[Column]) -> Column:
    peak = F.greatest(*logits) if len(logits) > 1 else logits[0]
    weights = [F.exp(x - peak) for x in logits]
    return F.array(*[w / sum(weights[1:], weights[0]) for w in weights])


@dataclass
class LogisticScorer:
    """Coefficients per (step, class, window, feature); for the attack flag there is one class."""

    scaler: Scaler
    options: Options
    stages: list[str]
    attack: np.ndarray                     # (H, L, F)
    attack_bias: list[float | None]        # None: too few examples, probability 0
    stage: np.ndarray                      # (H, S, L, F)
    stage_bias: np.ndarray                 # (H, S)

    @staticmethod
    def fit(states: DataFrame, scaler: Scaler, vocab: list[str], options: Options, iterations: int = ITERATIONS,
            cap: int = SAMPLE_CAP, with_stages: bool = True, rows: DataFrame | None = None) -> "LogisticScorer":
        """``rows``: training rows that are there already, for example with replayed old samples."""
        rows = training_rows(states, scaler, vocab, options, cap=cap) if rows is None else rows
        rows = materialize(rows, "training-rows").withColumn("x", array_to_vector("flat")).cache()
        H, L, size, S = options.horizon, options.history, len(scaler.names), len(vocab)
        counts = rows.agg(F.count("*").alias("n"), *[F.sum(F.element_at("future_attack", k)).alias(f"p{k}")
                                                     for k in range(1, H + 1)]).first()
        attack, bias = np.zeros((H, L, size)), [None] * H
        stage, stage_bias = np.zeros((H, S, L, size)), np.zeros((H, S))
        for k in range(1, H + 1):
            n, p = counts["n"], counts[f"p{k}"] or 0
            if p >= 2 and n - p >= 2:
                y = F.element_at("future_attack", k)
                weight = F.when(y > 0, n / (2.0 * p)).otherwise(n / (2.0 * (n - p)))
                m = _regression(rows, n, iterations).fit(rows.select("x", y.alias("y"), weight.alias("w")))
                attack[k - 1] = m.coefficients.toArray().reshape(L, size)
                bias[k - 1] = float(m.intercept)
            if with_stages and S > 1:
                sid = F.element_at("future_stage", k)
                known = rows.where(sid >= 0).select("x", sid.cast("double").alias("y"), F.lit(1.0).alias("w"))
                support = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
                seen = sorted(support)
                if len(seen) < 2:
                    continue
                m = _regression(rows, sum(support.values()), iterations).setFamily("multinomial").fit(known)
                c = m.coefficientMatrix.toArray()
                stage[k - 1, :len(c)] = c.reshape(-1, L, size)
                stage_bias[k - 1, :len(c)] = m.interceptVector.toArray()
                absent = [i for i in range(S) if float(i) not in seen]
                stage_bias[k - 1, absent] = -1e3
        rows.unpersist()
        return LogisticScorer(scaler, options, list(vocab), attack, bias, stage, stage_bias)

    def table(self, spark: SparkSession) -> DataFrame:
        """(step, class, window, feature, weight): coefficients that aren't 0, and biases as window -1. Class 0 is the attack flag."""
        rows = [(h, 0, -1, None, b) for h, b in enumerate(self.attack_bias) if b is not None]
        rows += [(h, c + 1, -1, None, float(b)) for (h, c), b in np.ndenumerate(self.stage_bias) if b]
        rows += [(h, 0, w, self.scaler.names[f], float(x)) for (h, w, f), x in np.ndenumerate(self.attack) if x]
        rows += [(h, c + 1, w, self.scaler.names[f], float(x)) for (h, c, w, f), x in np.ndenumerate(self.stage) if x]
        return spark.createDataFrame(rows, COEFFICIENTS)

    @staticmethod
    def from_table(table: DataFrame, scaler: Scaler, vocab: list[str], options: Options) -> "LogisticScorer":
        """The scorer of a coefficient table: at most steps x (1 + stages) x windows x features rows."""
        H, L, size, S = options.horizon, options.history, len(scaler.names), len(vocab)
        at = {n: i for i, n in enumerate(scaler.names)}
        out = LogisticScorer(scaler, options, list(vocab), np.zeros((H, L, size)), [None] * H, np.zeros((H, S, L, size)), np.zeros((H, S)))
        for r in table.collect():
            step, kind, window, weight = r["step"], r["class"], r["window"], r["weight"]
            if window < 0 and kind == 0:
                out.attack_bias[step] = weight
            elif window < 0:
                out.stage_bias[step, kind - 1] = weight
            elif kind == 0:
                out.attack[step, window, at[r["feature"]]] = weight
            else:
                out.stage[step, kind - 1, window, at[r["feature"]]] = weight
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        """Coefficients as Parquet, and one row with the scaler, the stages and the shape they belong to."""
        self.table(spark).coalesce(1).write.mode("error").parquet(f"{path}/coefficients")
        about = [(self.scaler.to_json(), self.stages, self.options.history, self.options.horizon, self.options.window_seconds)]
        spark.createDataFrame(about, ABOUT).coalesce(1).write.mode("error").parquet(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str, options: Options) -> "LogisticScorer":
        """A saved scorer; options of another history, horizon or window are an error."""
        about = spark.read.parquet(f"{path}/about").first()
        stored = {n: about[n] for n in ("history", "horizon", "window_seconds")}
        wanted = {n: getattr(options, n) for n in stored}
        if stored != wanted:
            raise ValueError(f"{path} was trained for {stored}, not {wanted}")
        table = spark.read.schema(COEFFICIENTS).parquet(f"{path}/coefficients")
        return LogisticScorer.from_table(table, Scaler.from_json(about["scaler"]), list(about["stages"]), options)

    def score(self, states: DataFrame) -> DataFrame:
        """Each row is multiplied with all coefficients once; a forecast sums what its L rows contribute.

        Histories are never gathered, so the features are not copied L times.
        """
        H, L, S = self.options.horizon, self.options.history, len(self.stages)
        both = np.concatenate([self.attack.reshape(H, 1, L, -1), self.stage], axis=1)      # (H, 1 + S, L, F)
        matrix = np.ascontiguousarray(both.transpose(2, 0, 1, 3).reshape(L * H * (1 + S), -1).T)

        @F.pandas_udf("array<array<double>>")
        def contributions(z: pd.Series) -> pd.Series:
            if not len(z):
                return pd.Series([], dtype=object)
            out = np.stack(z.to_numpy()) @ matrix
            return pd.Series(list(out.reshape(len(z), L, H * (1 + S)).tolist()))

        rows = states.withColumn("_c", contributions(self.scaler.vector()))

        def summed(w):
            total = F.element_at("_c", L)
            for back in range(1, L):
                total = F.zip_with(total, F.element_at(F.lag("_c", back).over(w), L - back), lambda a, b: a + b)
            return {"_logits": total}

        logits = neighbours(rows, KEYS, "pos", self.options.chunk_windows, L - 1, 0, summed,
                            where=has_history(self.options))

        def logit(h, c):
            bias = self.attack_bias[h] if c == 0 else float(self.stage_bias[h, c - 1])
            return F.element_at("_logits", h * (1 + S) + c + 1) + F.lit(bias or 0.0)

        attack = F.array(*[F.lit(0.0) if self.attack_bias[h] is None else 1 / (1 + F.exp(-logit(h, 0)))
                           for h in range(H)])
        dists = [softmax([logit(h, c) for c in range(1, S + 1)]) for h in range(H)]
        return (logits.withColumn("attack_prob", attack).withColumn("stage_prob", F.array(*dists))
                .drop("_c", "_logits"))



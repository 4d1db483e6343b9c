"""Explanations of linear forecasts, and the traffic evidence next to them."""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.functions.knowledge import driver_sentence, with_feature_labels
from netstate.operators.chunks import neighbours
from netstate.operators.forecast import CLOSED_FORM_WEIGHTS, ClosedFormScorer
from netstate.operators.scaling import Scaler
from netstate.operators.sequences import KEYS, history_of, with_samples


def closed_form_weights(scorer: ClosedFormScorer) -> np.ndarray:
    """Weights per (step, window, feature) of the closed-form scorer: only the current window counts."""
    o, names = scorer.options, list(scorer.scaler.names)
    w = np.zeros((o.horizon, o.history, len(names)))
    for name, value in CLOSED_FORM_WEIGHTS.items():
        w[:, -1, names.index(name)] = value
    return w


def _top(rows: DataFrame, scaler: Scaler, weights: np.ndarray, gain: Column, step: Column, top_k: int, value: str,
         centre: np.ndarray | None = None) -> DataFrame:
    """Rank the features of every row by what they add. Rows stay where they are: no shuffle, one Arrow pass.

    ``weights`` is (step, window, feature), so its size is that of the model.
    """
    names = np.array(scaler.names)
    background = np.zeros(weights.shape[1:]) if centre is None else centre

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            z = np.stack(batch["_flat"].to_numpy()).reshape(len(batch), *weights.shape[1:])
            parts = (z - background) * weights[batch["_step"].to_numpy() - 1] * batch["_gain"].to_numpy()[:, None, None]
            total, size = parts.sum(axis=1), np.abs(parts).sum(axis=1)
            order = np.argsort(-np.abs(total), axis=1, kind="stable")[:, :top_k]
            row = np.repeat(np.arange(len(batch)), order.shape[1])
            col = order.ravel()
            share = size / (size.sum(axis=1, keepdims=True) + 1e-12)
            yield pd.DataFrame({
                **{k: batch[k].to_numpy()[row] for k in (*KEYS, "pos")},
                "rank": np.tile(np.arange(1, order.shape[1] + 1), len(batch)).astype("int32"), "feature": names[col],
                value: total[row, col], "share": share[row, col], "current_z": z[row, -1, col]})

    schema = f"source string, segment int, pos long, rank int, feature string, {value} double, share double, current_z double"
    narrow = rows.select(*KEYS, "pos", F.flatten("history").alias("_flat"), gain.alias("_gain"),
                         step.cast("int").alias("_step"))
    return narrow.mapInPandas(rank, schema)


def history_at(states: DataFrame, origins: DataFrame, scaler: Scaler, options: Options) -> DataFrame:
    """Scaled history of the given origins (source, segment, pos and whatever else they carry, in narrow columns)."""
    return history_of(states, origins, scaler.vector(), options).join(origins, [*KEYS, "pos"])


def histories(states: DataFrame, origins: DataFrame, scaler: Scaler, options: Options) -> DataFrame:
    """As :func:`history_at` where most windows are origins: what they carry meets the states before histories are collected.

    So the arrays of L vectors stay in the stage that makes them and are never shuffled.
    """
    carried = [c for c in origins.columns if c not in (*KEYS, "pos")]
    rows = scaler.with_vector(states).select(*KEYS, "pos", "z").join(
        origins.withColumn("_mark", F.lit(True)), [*KEYS, "pos"], "left")
    L = options.history
    return neighbours(rows, KEYS, "pos", options.chunk_windows, L - 1, 0,
                      lambda w: {"history": F.collect_list("z").over(w.rowsBetween(1 - L, 0))},
                      where=F.col("_mark") & (F.col("pos") >= L - 1)).select(*KEYS, "pos", "history", *carried)


def attributions(origins: DataFrame, scaler: Scaler, weights: np.ndarray, top_k: int = 10,
                 step: int | None = None) -> DataFrame:
    """Gradient x input of each origin (``history``, ``attack_prob``): top features, signed contribution, share.

    ``step`` picks one future step; without it the step with the highest probability (the risk) is explained.
    """
    p = F.col("attack_prob")
    at = F.lit(step) if step else F.array_position(p, F.array_max(p)).cast("int")
    prob = F.element_at(p, at)
    top = _top(origins, scaler, weights, prob * (1 - prob), at, top_k, "attribution")
    return top.withColumn("direction", F.when(F.col("attribution") > 0, "raises risk").otherwise("lowers risk"))


def window_shares(origins: DataFrame, weights: np.ndarray, step: int = 1) -> DataFrame:
    """Share of every past window in the contributions to one step (offset 0 = the current window)."""
    L = weights.shape[1]
    w = F.lit(weights[step - 1].tolist())
    size = F.transform(F.arrays_zip(F.col("history").alias("z"), w.alias("w")), lambda r: F.aggregate(
        F.zip_with(r["z"], r["w"], lambda a, b: F.abs(a * b)), F.lit(0.0), lambda s, e: s + e))
    total = F.aggregate("_size", F.lit(0.0), lambda s, e: s + e) + 1e-12
    return (origins.withColumn("_size", size).withColumn("_total", total)
            .select(*KEYS, "pos", "_total", F.posexplode("_size").alias("_i", "_m"))
            .select(*KEYS, "pos", (F.col("_i") - (L - 1)).alias("offset"), (F.col("_m") / F.col("_total")).alias("share")))


def train_mean(states: DataFrame, scaler: Scaler, options: Options) -> np.ndarray:
    """Mean (window, feature) over the histories of all training samples, without gathering one.

    A row knows from flags ahead of it in which samples it is, and at which window; means by window are combined map-side.
    """
    L = options.history
    marked = with_samples(states, options).withColumn("_in", F.col("is_sample") & (F.col("split") == "train"))
    rows = neighbours(scaler.with_vector(marked).select(*KEYS, "pos", "_in", "z"), KEYS, "pos", options.chunk_windows, 0, L - 1,
                      lambda w: {"_at": F.array(*[F.when(F.lead("_in", k).over(w) if k else F.col("_in"), L - 1 - k) for k in range(L)])})
    held = rows.select(F.explode(F.filter("_at", lambda x: x.isNotNull())).alias("l"), "z")
    mean = np.zeros((L, len(scaler.names)))
    for r in held.groupBy("l").agg(F.array(*[F.avg(F.get("z", F.lit(f))) for f in range(len(scaler.names))]).alias("m")).collect():
        mean[r["l"]] = r["m"]
    return mean


def linear_shap(origins: DataFrame, scaler: Scaler, weights: np.ndarray, centre: np.ndarray, step: int = 1,
                top_k: int = 10) -> DataFrame:
    """Exact SHAP values of a linear logit: weight x (value - background mean)."""
    return _top(origins, scaler, weights, F.lit(1.0), F.lit(step), top_k, "shap_value", centre)


def incident_drivers(found: DataFrame, scored: DataFrame, states: DataFrame, scaler: Scaler, weights: np.ndarray,
                     options: Options, top_k: int = 8, sentences: int = 4) -> DataFrame:
    """Top features of every incident at its opening window, the first ones with a sentence."""
    origins = found.select("id", *KEYS, F.col("opened_pos").alias("pos")).join(
        scored.select(*KEYS, "pos", "attack_prob"), [*KEYS, "pos"])
    top = attributions(history_at(states, origins, scaler, options), scaler, weights, top_k)
    named = with_feature_labels(top, options)
    return named.join(origins.select("id", *KEYS, "pos"), [*KEYS, "pos"]).select(
        "id", "rank", "feature", "attribution", "share",
        F.when(F.col("rank") <= sentences, driver_sentence(F.col("attribution"), F.col("feature_label"))
               ).alias("sentence"))


def traffic_evidence(states: DataFrame, features: list[str], options: Options) -> DataFrame:
    """Current value of features against the mean of the earlier windows of the history (rows with full history)."""
    L = options.history
    rows = neighbours(states.select(*KEYS, "pos", "timestamp", *features), KEYS, "pos", options.chunk_windows, L - 1, 0,
                      lambda w: {f"_m_{f}": F.avg(f).over(w.rowsBetween(1 - L, -1)) for f in features},
                      where=F.col("pos") >= L - 1)
    long = rows.select(*KEYS, "pos", "timestamp", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("current"), F.col(f"_m_{f}").alias("earlier_mean"))
        for f in features])))
    mean = F.col("earlier_mean")
    return long.withColumn("change", F.when(mean != 0, (F.col("current") - mean) / F.abs(mean)))

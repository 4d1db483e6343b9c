"""Whole evaluations: a forecaster on a hold-out split or on a labelled file, comparison and retraining."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators.drift import background_sample, drift_report
from netstate.operators.forecast import PersistenceScorer, Scorer, decoded, state_persistence_error
from netstate.operators.logistic import LogisticScorer, training_rows
from netstate.operators.metrics import (binary_metrics, choose_threshold, lead_time, onset_scores, stage_confusion,
                                        stage_metrics, stage_pairs, stage_report, stage_support, step_scores, window_outcomes,
                                        with_ranking)
from netstate.operators.scaling import Scaler
from netstate.operators.sequences import (KEYS, full_span, new_stages, with_future,
                                          with_future_values, with_samples, with_split)
from netstate.session import materialize


def scored_samples(states: DataFrame, scorer: Scorer, threshold: float, options: Options, label: str | None = "test",
                   ) -> DataFrame:
    """Samples of a split (None: every full span) with forecast, decoded stages and what really followed."""
    rows = decoded(scorer.score(with_future(states, options, scorer.stages)), scorer.stages, threshold)
    if label is None:
        return rows.where(full_span(options))
    return with_samples(rows, options).where(F.col("is_sample") & (F.col("split") == label))


def calibrate(states: DataFrame, scorer: Scorer, options: Options, label: str = "val",
              fallback: float | None = None) -> DataFrame:
    """Threshold chosen on a split."""
    samples = materialize(scored_samples(states, scorer, 0.5, options, label).select(
        *KEYS, "pos", "is_attack", "attack_prob", "future_attack"), "samples")
    return choose_threshold(onset_scores(samples), options.target_fpr,
                            options.fallback_threshold if fallback is None else fallback)


def _binary(scores: DataFrame, threshold: float, keys=(), undefined=0.0) -> DataFrame:
    return with_ranking(binary_metrics(scores, threshold, keys, undefined), scores, keys)


def evaluate(states: DataFrame, scorer: Scorer, scaler: Scaler, threshold: float, options: Options,
             label: str | None = "test") -> dict[str, DataFrame]:
    """forecast, per_horizon, onset, stage, per_class, support, confusion, state_persistence, lead_time, episodes."""
    keep = [*KEYS, "pos", "row", "timestamp", "is_attack", "attack_prob", "future_attack", "future_stage", "risk",
            "stage_idx", "headline_stage"]
    samples = materialize(scored_samples(states, scorer, threshold, options, label).select(*keep), "samples")
    steps, pairs = step_scores(samples), stage_pairs(samples)
    judged = states if label is None else with_split(states, options).withColumn(
        "is_attack", F.col("is_attack") & (F.col("split") == label))
    lead = lead_time(samples, judged, threshold, options, dense=False)
    return {"forecast": _binary(steps, threshold), "per_horizon": _binary(steps, threshold, ["step"]),
            "onset": _binary(onset_scores(samples), threshold), "stage": stage_metrics(pairs, scorer.stages),
            "per_class": stage_report(pairs, scorer.stages), "support": stage_support(pairs, scorer.stages), "confusion": stage_confusion(pairs, scorer.stages),
            "state_persistence": state_persistence_error(states, scaler, options, label),
            "lead_time": lead["summary"], "episodes": lead["episodes"]}


def evaluate_with_baselines(states: DataFrame, scorer: Scorer, scaler: Scaler, threshold: float, options: Options,
                            ) -> dict[str, DataFrame]:
    """:func:`evaluate` plus the persistence oracle and a logistic baseline with its own calibrated threshold."""
    logistic = LogisticScorer.fit(states, scaler, scorer.stages, options, with_stages=False)
    own = calibrate(states, logistic, options).first()["threshold"]
    out = evaluate(states, scorer, scaler, threshold, options)
    for name, model, thr in (("persistence", PersistenceScorer(options), 0.5), ("logistic", logistic, own)):
        samples = materialize(scored_samples(states, model, thr, options).select(
            *KEYS, "pos", "is_attack", "attack_prob", "future_attack"), "samples")
        out[f"{name}_forecast"] = _binary(step_scores(samples), thr)
        out[f"{name}_onset"] = _binary(onset_scores(samples), thr)
    return out


def validate_file(states: DataFrame, scorer: Scorer, threshold: float, options: Options) -> dict[str, DataFrame]:
    """Forecast against the labels of the analysed file itself; undefined ratios are null."""
    scored = materialize(decoded(scorer.score(with_future(states, options, scorer.stages)), scorer.stages, threshold)
                         .select(*KEYS, "pos", "seg_len", "row", "timestamp", "is_attack", "attack_prob",
                                 "future_attack", "risk", "headline_stage"), "scored")
    samples = scored.where(full_span(options))
    lead = lead_time(scored, states, threshold, options)
    future = with_future_values(states.select(*KEYS, "pos", F.struct("is_attack", "stage").alias("_s")), "_s", options)
    return {"forecast": _binary(step_scores(samples), threshold, undefined=None),
            "onset": _binary(onset_scores(samples), threshold, undefined=None),
            "lead_time": lead["summary"], "episodes": lead["episodes"],
            "outcomes": window_outcomes(samples.join(future.select(*KEYS, "pos", "future"), [*KEYS, "pos"]), threshold)}


def compare_scorers(states: DataFrame, scorers: dict[str, tuple[Scorer, float]], options: Options,
                    label: str | None = "test") -> DataFrame:
    """Forecast and onset metrics of several forecasters on the same samples, one row per (scorer, view)."""
    rows = []
    for name, (scorer, threshold) in scorers.items():
        samples = materialize(scored_samples(states, scorer, threshold, options, label).select(
            *KEYS, "pos", "is_attack", "attack_prob", "future_attack"), "samples")
        for view, scores in (("forecast", step_scores(samples)), ("onset", onset_scores(samples))):
            rows.append(_binary(scores, threshold).withColumns({"scorer": F.lit(name), "view": F.lit(view)}))
    return reduce(DataFrame.unionByName, rows)


def score_other_data(other: DataFrame, train: DataFrame, scorer: Scorer, scaler: Scaler, threshold: float,
                     options: Options) -> dict[str, DataFrame]:
    """Another data set used as a test set as a whole, and its drift against the training data."""
    out = evaluate(other, scorer, scaler, threshold, options, label=None)
    out["drift"] = drift_report(materialize(background_sample(train, scaler, options), "background"), other, scaler)
    return out


#: Old samples that are replayed: as many as there are new ones, within these bounds.
REPLAY_LEAST, REPLAY_MOST = 2_000, 20_000


def retrain(new: DataFrame, old: DataFrame, current: Scorer, scaler: Scaler, threshold: float, options: Options,
            iterations: int = 300, min_windows: int = 600) -> dict:
    """Candidate forecaster from new labelled data with replayed old samples, next to the current one.

    The scaler stays; the vocabulary grows by new stages; the threshold is the mean of the old and a newly calibrated
    one. Old samples are drawn, ``REPLAY_LEAST`` to ``REPLAY_MOST`` of them. Returns the candidate, its threshold and a comparison on the hold-outs of the new and the old data.
    """
    size = new.agg(F.count("*").alias("n"), F.count_if("is_attack").alias("a")).first()
    if size["a"] == 0:
        raise ValueError("the new data has no labelled attack windows")
    if size["n"] < min_windows:
        raise ValueError(f"at least {min_windows} labelled windows are needed, got {size['n']}")
    added = [r["stage"] for r in new_stages(new, current.stages, options).orderBy("id").collect()]
    vocab = [*current.stages, *added]
    rows = materialize(training_rows(new, scaler, vocab, options), "new-rows")
    replay = training_rows(old, scaler, vocab, options, cap=min(max(rows.count(), REPLAY_LEAST), REPLAY_MOST))
    candidate = LogisticScorer.fit(new, scaler, vocab, options, iterations, rows=rows.unionByName(replay))
    chosen = calibrate(new, candidate, options, fallback=threshold).first()
    mixed = (chosen["threshold"] + threshold) / 2
    own = threshold if chosen["method"] == "fallback" else min(max(mixed, 0.05), 0.95)
    both = {"current": (current, threshold), "candidate": (candidate, own)}
    report = reduce(DataFrame.unionByName, [
        compare_scorers(data, both, options).withColumn("data", F.lit(name))
        for name, data in (("new", new), ("old", old))])
    return {"candidate": candidate, "threshold": own, "new_stages": added, "report": report}



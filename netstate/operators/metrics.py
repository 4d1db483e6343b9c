"""Forecast metrics, threshold calibration, episodes and warning lead time."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators.alerts import alerts
from netstate.operators.chunks import beside, by_value_chunks, last_match, next_match, quantiles, running, runs
from netstate.operators.sequences import KEYS
from netstate.session import materialize


def _over(a: Column, b: Column, undefined) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(undefined))


# ---------------------------------------------------------------------------------------------- binary
def binary_metrics(scores: DataFrame, threshold: float | Column, keys: Sequence[str] = (), undefined: float | None = 0.0,
                   ) -> DataFrame:
    """Confusion counts and ratios of (p, y) rows per key; one aggregation.

    ``undefined`` stands in for a ratio without a denominator: 0 in an evaluation, None when a user's file is checked.
    """
    positive, predicted = F.col("y") > 0, F.col("p") >= threshold
    counts = scores.groupBy(*keys).agg(
        F.count_if(positive & predicted).alias("tp"), F.count_if(~positive & predicted).alias("fp"),
        F.count_if(~positive & ~predicted).alias("tn"), F.count_if(positive & ~predicted).alias("fn"),
        F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("_brier"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    mixed = (tp + fn > 0) & (fp + tn > 0)
    f1 = _over(2.0 * tp, 2 * tp + fp + fn, undefined)
    if undefined is None:
        f1 = F.when(tp + fn > 0, _over(2.0 * tp, 2 * tp + fp + fn, 0.0))
    return counts.select(
        *keys, _over(tp + tn, tp + fp + tn + fn, undefined).alias("accuracy"),
        _over(tp, tp + fp, undefined).alias("precision"), _over(tp, tp + fn, undefined).alias("recall"),
        f1.alias("f1"), _over(fp, fp + tn, undefined).alias("false_positive_rate"), "tp", "fp", "tn", "fn",
        (tp + fn).alias("support_positive"), (tp + fp + tn + fn).alias("support_total"),
        F.when(mixed, F.col("_brier")).alias("brier"))


def ranking_metrics(scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC and average precision of (p, y) rows per key; null when only one class occurs.

    Equal scores are counted together first; cumulative counts then run over the distinct scores, in chunks.
    """
    keys = list(keys)
    counted = materialize(scores.groupBy(*keys, "p").agg(F.count_if(F.col("y") > 0).alias("pos"),
                                                         F.count_if(F.col("y") <= 0).alias("neg")), "score-counts")
    ranked = running(by_value_chunks(counted, keys, "p"), keys, ["p"], F.col("_vchunk"),
                     sums={"pos_upto": F.col("pos"), "neg_upto": F.col("neg")},
                     totals={"all_pos": F.col("pos"), "all_neg": F.col("neg")})
    won = F.col("pos") * (F.col("neg_upto") - F.col("neg") + F.col("neg") / 2.0)
    at_least_pos = F.col("all_pos") - F.col("pos_upto") + F.col("pos")
    at_least = at_least_pos + F.col("all_neg") - F.col("neg_upto") + F.col("neg")
    mixed = (F.max("all_pos") > 0) & (F.max("all_neg") > 0)
    return ranked.groupBy(*keys).agg(
        F.when(mixed, F.sum(won) / (F.max("all_pos") * F.max("all_neg"))).alias("roc_auc"),
        F.when(mixed, F.sum(F.col("pos") * at_least_pos / at_least) / F.max("all_pos")).alias("pr_auc"))


def step_scores(samples: DataFrame) -> DataFrame:
    """(step, p, y) rows of samples with ``attack_prob`` and ``future_attack``."""
    return samples.select(*KEYS, "pos", F.posexplode(F.arrays_zip("attack_prob", "future_attack")).alias("_i", "_s")
                          ).select(*KEYS, "pos", (F.col("_i") + 1).alias("step"), F.col("_s.attack_prob").alias("p"),
                                   F.col("_s.future_attack").alias("y"))


def onset_scores(samples: DataFrame) -> DataFrame:
    """(p, y) of the samples whose current window is benign; y = an attack begins within the horizon."""
    return samples.where(~F.col("is_attack")).select(
        *KEYS, "pos", F.array_max("attack_prob").alias("p"), F.array_max("future_attack").alias("y"))


def with_ranking(metrics: DataFrame, scores: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    ranked = ranking_metrics(scores, keys)
    if keys:
        return metrics.join(ranked, list(keys), "left")
    return beside(metrics, ranked)


# ----------------------------------------------------------------------------------------------- stage
def stage_pairs(samples: DataFrame) -> DataFrame:
    """(actual_id, predicted_id, n) stage ids over all samples and steps."""
    long = samples.select(F.explode(F.arrays_zip("future_stage", "stage_idx")).alias("_s"))
    return long.groupBy(F.col("_s.future_stage").alias("actual_id"), F.col("_s.stage_idx").alias("predicted_id")).agg(
        F.count("*").alias("n"))


def stage_confusion(pairs: DataFrame, vocab: list[str]) -> DataFrame:
    """Confusion matrix as (actual_id, predicted_id, n) with stage names; unseen stages are not scored."""
    names = F.array(*[F.lit(s) for s in vocab])
    return pairs.where("actual_id >= 0").select(F.element_at(names, F.col("actual_id") + 1).alias("true_stage"),
                                           F.element_at(names, F.col("predicted_id") + 1).alias("predicted_stage"), "n")


def stage_report(pairs: DataFrame, vocab: list[str]) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs (at most one row per stage)."""
    scored = pairs.where("actual_id >= 0")
    sides = scored.select(F.inline(F.array(
        F.struct(F.col("actual_id").alias("id"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"),
                 F.when(F.col("actual_id") == F.col("predicted_id"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("predicted_id").alias("id"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hit")))))
    per = sides.groupBy("id").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"),
                                  F.sum("hit").alias("hit")).where("support > 0")
    names = F.array(*[F.lit(s) for s in vocab])
    return per.select(F.element_at(names, F.col("id") + 1).alias("stage"),
                      _over(F.col("hit"), F.col("claimed"), 0.0).alias("precision"),
                      (F.col("hit") / F.col("support")).alias("recall"),
                      _over(2.0 * F.col("hit"), F.col("claimed") + F.col("support"), 0.0).alias("f1"), "support")


def stage_support(pairs: DataFrame, vocab: list[str]) -> DataFrame:
    """Every stage of the vocabulary: how often it was true and how often forecast; ``scored`` is false where it never was true.

    Stages without support take no part in averages; this tells which ones these are.
    """
    sides = pairs.where("actual_id >= 0").select(F.inline(F.array(
        F.struct(F.col("actual_id").cast("int").alias("id"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed")),
        F.struct(F.col("predicted_id").cast("int").alias("id"), F.lit(0).cast("long").alias("support"), F.col("n").alias("claimed")))))
    counts = sides.groupBy("id").agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"))
    stages = pairs.sparkSession.createDataFrame(list(enumerate(vocab)), "id int, stage string")
    both = stages.join(counts, "id", "left").fillna(0, ["support", "claimed"])
    return both.select("stage", "support", "claimed", (F.col("support") > 0).alias("scored"))


def stage_metrics(pairs: DataFrame, vocab: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy and macro averages over the classes that occur; accuracy given an attack."""
    actual, same = F.col("actual_id"), F.col("actual_id") == F.col("predicted_id")
    overall = pairs.agg(
        (F.sum(F.when((actual >= 0) & same, F.col("n")).otherwise(0)) / F.sum(F.when(actual >= 0, F.col("n")))
         ).alias("accuracy"),
        F.coalesce(F.sum(F.when(actual < 0, F.col("n"))), F.lit(0)).alias("unseen_stage_samples"),
        (F.sum(F.when((actual > 0) & same, F.col("n")).otherwise(0)) / F.sum(F.when(actual > 0, F.col("n")))
         ).alias("accuracy_given_attack"))
    macro = stage_report(pairs, vocab).agg(
        F.when(F.count("*") > 1, F.avg("recall")).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"), F.count("*").alias("classes_with_support"))
    return beside(overall, macro)


# ----------------------------------------------------------------------------------------- calibration
# The candidate grid of the calibration and the quantile ranks added to it.
GRID = [round(0.05 + 0.01 * i, 2) for i in range(91)]
RANKS = [0.5 + (0.999 - 0.5) * i / 59 for i in range(60)]


def threshold_candidates(onsets: DataFrame) -> DataFrame:
    """One sorted, distinct array of candidate thresholds (at most 151 values)."""
    ranks = quantiles(onsets.select("p"), [], "p", RANKS)
    found = ranks.agg(F.collect_list(F.round("q", 4)).alias("_q"))
    return found.select(F.array_sort(F.array_distinct(F.concat(
        F.array(*[F.lit(g) for g in GRID]), "_q"))).alias("candidates"))


def threshold_table(onsets: DataFrame) -> DataFrame:
    """Confusion counts of every candidate threshold.

    A score is put into the bucket of the largest candidate it reaches; 152 bucket counts are then summed from above.
    The samples are read once and never crossed with the candidates.
    """
    candidates = F.lit(threshold_candidates(onsets).first()["candidates"])
    bucketed = onsets.select(F.size(F.filter(candidates, lambda c: c <= F.col("p"))).alias("bucket"), "y")
    counts = bucketed.groupBy("bucket").agg(F.count_if(F.col("y") > 0).alias("pos"),
                                            F.count_if(F.col("y") <= 0).alias("neg"))
    # at most 152 rows reach this point
    packed = counts.agg(F.collect_list(F.struct("bucket", "pos", "neg")).alias("_b"))
    listed = packed.select("_b", F.posexplode(candidates).alias("_i", "threshold"))

    def total(field, reached=None):
        rows = F.col("_b") if reached is None else F.filter("_b", reached)
        return F.aggregate(rows, F.lit(0).cast("long"), lambda s, b: s + b[field])

    at_or_above = lambda b: b["bucket"] > F.col("_i")
    return listed.select("threshold", total("pos", at_or_above).alias("tp"), total("neg", at_or_above).alias("fp"),
                         total("pos").alias("onset_positives"), total("neg").alias("onset_negatives"))


def choose_threshold(onsets: DataFrame, target_fpr: float, fallback: float) -> DataFrame:
    """One row: the threshold with the best onset recall whose false-positive rate meets the target.

    If no candidate meets it the best F1 counts; equal results go to the lower rate, then to the lower threshold. With
    fewer than three positives or negatives the fallback is returned.
    """
    table = threshold_table(onsets)
    pos, neg, tp, fp = (F.col(c) for c in ("onset_positives", "onset_negatives", "tp", "fp"))
    fpr, recall = fp / F.greatest(neg, F.lit(1)), tp / F.greatest(pos, F.lit(1))
    precision = tp / F.greatest(tp + fp, F.lit(1))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-9))
    meets = fpr <= target_fpr
    scored = table.select("threshold", fpr.alias("fpr"), recall.alias("recall"), precision.alias("precision"),
                          f1.alias("f1"), meets.alias("meets"), pos, neg)
    key = F.struct("meets", F.when(F.col("meets"), F.col("recall")).otherwise(F.col("f1")), -F.col("fpr"),
                   -F.col("threshold"))
    best = scored.agg(F.max_by(F.struct(*scored.columns), key).alias("b"), F.max("onset_positives").alias("pos"),
                      F.max("onset_negatives").alias("neg"))
    enough = (F.col("pos") >= 3) & (F.col("neg") >= 3)
    method = (F.when(~enough, "fallback").when(F.col("b.meets"), "max recall at target rate")
              .otherwise("best f1"))
    return best.select(
        F.when(enough, F.col("b.threshold")).otherwise(float(fallback)).alias("threshold"),
        method.alias("method"), *[F.when(enough, F.col(f"b.{c}")).alias(f"onset_{c}")
                                  for c in ("fpr", "recall", "precision", "f1")],
        F.coalesce("pos", F.lit(0)).alias("onset_positives"), F.coalesce("neg", F.lit(0)).alias("onset_negatives"))


def threshold_presets(onsets: DataFrame, balanced: float, min_samples: int = 50) -> DataFrame:
    """Alert thresholds for three sensitivities, calibrated at a 2 % and a 15 % rate around the model's own one."""
    def at(target):
        return choose_threshold(onsets, target, balanced).select("threshold").scalar()

    low, early = F.col("_low"), F.col("_early")
    enough = F.col("_n") >= min_samples
    one = onsets.agg(F.count("*").alias("_n")).withColumn("_low", at(0.02)).withColumn("_early", at(0.15))
    return one.select(
        F.when(enough, F.greatest(low, F.lit(balanced))).otherwise(min(balanced + 0.04, 0.98)).alias("low_noise"),
        F.lit(float(balanced)).alias("balanced"),
        F.when(~enough, max(balanced * 0.7, 0.2)).when(early < balanced, early)
        .otherwise(balanced * 0.75).alias("early_warning"),
        F.when(enough, "validation-calibrated").otherwise("offset").alias("method"))


# -------------------------------------------------------------------------------------------- episodes
def episodes(states: DataFrame, options: Options, max_gap: int = 2) -> DataFrame:
    """Attack episodes per segment; short breaks inside one are bridged."""
    rows = states.where("is_attack").select(*KEYS, "pos", "timestamp")
    return runs(rows, KEYS, "pos", options.chunk_windows, max_gap, "start_pos").groupBy(*KEYS, "start_pos").agg(
        F.max("pos").alias("end_pos"), F.count("*").alias("attack_windows"), F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"))


def episode_outcomes(found: DataFrame, raised: DataFrame, first_scored: DataFrame, options: Options) -> DataFrame:
    """Per episode: warned early, detected late, missed or not forecastable, with lead or delay.

    The earliest alert at or after a position is an as-of lookup, so episodes and alerts of a segment are never paired.
    """
    size, back = options.chunk_windows, options.lookback
    marks = raised.select(*KEYS, "opened_pos")
    near = next_match(found, marks, KEYS, F.col("start_pos") - back, F.col("opened_pos"), size, "_early")
    both = next_match(near, marks, KEYS, F.col("start_pos"), F.col("opened_pos"), size, "_late")
    known = both.join(first_scored, KEYS, "left")
    early = F.col("_early.at") < F.col("start_pos")
    late = F.col("_late.at") <= F.col("end_pos")
    status = (F.when(F.col("first_pos").isNull() | (F.col("start_pos") <= F.col("first_pos")), "not_forecastable")
              .when(early, "warned_early").when(late, "detected_late").otherwise("missed"))
    seconds = float(options.window_seconds)
    return known.withColumn("status", status).select(
        *KEYS, "start_pos", "end_pos", "start_time", "end_time", "status",
        F.when(F.col("status") == "warned_early", (F.col("start_pos") - F.col("_early.at")) * seconds
               ).alias("lead_seconds"),
        F.when(F.col("status") == "detected_late", (F.col("_late.at") - F.col("start_pos")) * seconds
               ).alias("delay_seconds"))


def false_alerts(found: DataFrame, raised: DataFrame, options: Options) -> DataFrame:
    """Alerts that open outside every episode widened by the look-back on both sides."""
    back = options.lookback
    hit = last_match(raised, found.select(*KEYS, "start_pos", "end_pos"), KEYS, F.col("opened_pos"),
                     F.col("start_pos") - back, options.chunk_windows, "_e", ["end_pos"])
    return hit.where(F.col("_e").isNull() | (F.col("opened_pos") > F.col("_e.end_pos") + back)).drop("_e")


def lead_time(scored: DataFrame, states: DataFrame, threshold: float, options: Options,
              dense: bool = True, found: DataFrame | None = None) -> dict[str, DataFrame]:
    """``episodes``: outcome per episode; ``summary``: one row of counts, coverage, lead times, false alerts.

    ``scored`` is the time line the alerts run on, ``states`` carries the labels to judge by, ``found`` the alerts where they are
    there already.
    """
    # both are small and read several times
    found = alerts(scored, threshold, options, dense=dense) if found is None else found
    raised = materialize(found.select(*KEYS, "opened_pos"), "alert-openings")
    found = materialize(episodes(states, options), "episodes")
    first = scored.groupBy(*KEYS).agg(F.min("pos").alias("first_pos"))
    outcome = episode_outcomes(found, raised, first, options)

    def n(s):
        return F.count_if(F.col("status") == s).alias(s)

    counts = outcome.agg(
        F.count("*").alias("attack_episodes"), n("not_forecastable"), n("warned_early"), n("detected_late"),
        n("missed"), F.avg("lead_seconds").alias("mean_lead_seconds"),
        # lead times are whole windows within the look-back, so this median sees few distinct values
        F.median("lead_seconds").alias("median_lead_seconds"), F.min("lead_seconds").alias("min_lead_seconds"),
        F.max("lead_seconds").alias("max_lead_seconds"))
    total = raised.agg(F.count("*")).scalar()
    false = false_alerts(found, raised, options).agg(F.count("*")).scalar()
    hours = scored.agg(F.greatest(F.count("*") * options.window_seconds / 3600.0, F.lit(1e-9))).scalar()
    able = F.col("attack_episodes") - F.col("not_forecastable")
    one = counts.withColumns({"total_alerts": total, "false_alerts": false, "_hours": hours})
    summary = one.select(
        "attack_episodes", able.alias("forecastable_episodes"), F.col("not_forecastable").alias(
            "not_forecastable_episodes"), "warned_early", "detected_late", "missed",
        _over(F.col("warned_early"), able, None).alias("warning_coverage"),
        _over(F.col("warned_early") + F.col("detected_late"), able, None).alias("detection_coverage_any"),
        "mean_lead_seconds", "median_lead_seconds", "min_lead_seconds", "max_lead_seconds", "total_alerts",
        "false_alerts", (F.col("false_alerts") / F.col("_hours")).alias("false_alerts_per_hour"),
        F.lit(options.lookback).alias("lookback_windows"))
    return {"episodes": outcome, "summary": summary}


# -------------------------------------------------------------------------------------------- outcomes
def window_outcomes(samples: DataFrame, threshold: float) -> DataFrame:
    """Per origin: predicted and actual attack and stage over the horizon, and whether the flag was right.

    ``samples`` carries risk, headline_stage and ``future`` (is_attack, stage per step). Equal counts of future stages
    go to the stage that comes first.
    """
    hits = F.transform(F.filter("future", lambda s: s["is_attack"]), lambda s: s["stage"])
    ranked = F.transform(F.array_distinct("_hits"), lambda s: F.struct(
        F.size(F.filter("_hits", lambda x: x == s)).alias("n"), (-F.array_position("_hits", s)).alias("at"),
        s.alias("stage")))
    predicted, actual = F.col("risk") >= threshold, F.size("_hits") > 0
    return samples.withColumn("_hits", hits).select(
        *KEYS, "pos", "timestamp", F.col("risk").alias("forecast_risk"), predicted.alias("predicted_attack"),
        F.when(predicted, F.col("headline_stage")).otherwise("None").alias("predicted_stage"),
        actual.alias("actual_attack"), F.when(actual, F.array_max(ranked)["stage"]).otherwise("None").alias(
            "actual_stage"), (predicted == actual).alias("correct"))


def only_incorrect(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(~F.col("correct"))



"""Forecasts: scorers (table in, table out) and the views of their output.

A scorer has ``stages`` and a method ``score(states)`` that keeps the rows with a full history and adds
``attack_prob`` (one probability per future step) and ``stage_prob`` (one distribution per future step).
"""
from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.config import BENIGN, Options
from netstate.functions.levels import display_level, level_of
from netstate.operators.chunks import neighbours
from netstate.operators.scaling import Scaler
from netstate.operators.sequences import KEYS, has_history

# Vocabulary, weights and threshold of the closed-form scorer.
CLOSED_FORM_STAGES = ["Benign", "Initial Access", "Credential Access", "Lateral Movement"]
CLOSED_FORM_THRESHOLD = 0.6
CLOSED_FORM_WEIGHTS = {"flow_count": 1.5, "failed_flow_ratio": 1.0}
CLOSED_FORM_STEP, CLOSED_FORM_BIAS = 0.15, -1.0
CLOSED_FORM_STAGE_FACTORS = [0.0, 1.0, 0.5, -1.0]


class Scorer(Protocol):
    stages: list[str]

    def score(self, states: DataFrame) -> DataFrame: ...


class ClosedFormScorer:
    """A fixed logistic on two scaled features of the current window; a plain projection."""

    stages = CLOSED_FORM_STAGES

    def __init__(self, scaler: Scaler, options: Options):
        self.scaler, self.options = scaler, options

    def base(self) -> Column:
        return sum((F.lit(w) * self.scaler.scaled(f) for f, w in CLOSED_FORM_WEIGHTS.items()), F.lit(0.0))

    def attack_prob(self) -> Column:
        logits = [F.col("_base") + CLOSED_FORM_STEP * s + CLOSED_FORM_BIAS for s in range(self.options.horizon)]
        return F.array(*[1 / (1 + F.exp(-x)) for x in logits])

    def stage_prob(self) -> Column:
        logits = [F.col("_base") * f for f in CLOSED_FORM_STAGE_FACTORS]
        peak = F.greatest(*logits)
        weights = [F.exp(x - peak) for x in logits]
        total = sum(weights[1:], weights[0])
        return F.array(*[w / total for w in weights])

    def score(self, states: DataFrame) -> DataFrame:
        scored = states.where(has_history(self.options)).withColumn("_base", self.base())
        return (scored.withColumn("attack_prob", self.attack_prob())
                .withColumn("stage_prob", F.array_repeat(self.stage_prob(), self.options.horizon)).drop("_base"))


class PersistenceScorer:
    """Repeats the current label over the whole horizon: an oracle of the present, blind to onsets."""

    stages = [BENIGN, "Attack"]

    def __init__(self, options: Options):
        self.options = options

    def score(self, states: DataFrame) -> DataFrame:
        now = F.col("is_attack").cast("double")
        H = self.options.horizon
        return (states.where(has_history(self.options)).withColumn("attack_prob", F.array_repeat(now, H))
                .withColumn("stage_prob", F.array_repeat(F.array(1 - now, now), H)))


# ------------------------------------------------------------------------------------------------ decode
def top_stage(probabilities: Column) -> Column:
    """Id of the likeliest attack stage in one distribution (the first of equal ones)."""
    attack = F.slice(probabilities, 2, F.greatest(F.size(probabilities) - 1, F.lit(0)))
    return F.when(F.size(probabilities) > 1, F.array_position(attack, F.array_max(attack))).otherwise(0).cast("int")


def decoded(scored: DataFrame, stages: list[str], threshold: float) -> DataFrame:
    """Add risk, stage id per step (0 below the threshold), top stage with its probability and the headline stage."""
    names = F.array(*[F.lit(s) for s in (stages if len(stages) > 1 else [BENIGN])])
    tops = F.transform("stage_prob", top_stage)
    first = F.array_position(F.transform("attack_prob", lambda p: p >= threshold), True).cast("int")
    rows = scored.withColumns({"top_stage": tops, "risk": F.array_max("attack_prob"), "first_step": first})
    one_stage = F.lit("Attack")
    headline = one_stage if len(stages) < 2 else F.element_at(
        names, F.element_at("top_stage", F.col("first_step")) + 1)
    return rows.withColumns({
        "stage_idx": F.zip_with("attack_prob", "top_stage", lambda p, t: F.when(p >= threshold, t).otherwise(0)),
        "top_stage_prob": F.zip_with("stage_prob", "top_stage", lambda d, t: F.element_at(d, t + 1)),
        "headline_stage": F.when(F.col("first_step") > 0, headline).otherwise(BENIGN)})


def timeline(states: DataFrame, scorer: Scorer, threshold: float, options: Options) -> DataFrame:
    """Forecast of every window with a full history: keys, risk, headline stage, p_t1..p_tH."""
    rows = decoded(scorer.score(states), scorer.stages, threshold)
    return rows.select(*KEYS, "pos", "timestamp", "risk", "headline_stage",
                       *[F.element_at("attack_prob", k).alias(f"p_t{k}") for k in range(1, options.horizon + 1)])


def forecast_rows(states: DataFrame, scorer: Scorer, threshold: float, options: Options,
                  labelled: bool = True) -> DataFrame:
    """One row per (window, future step): probability, display state, stage, and what really happened then."""
    H, names = options.horizon, F.array(*[F.lit(s) for s in scorer.stages])
    future = neighbours(
        states.withColumn("_now", F.struct("is_attack", "stage", "timestamp")), KEYS, "pos", options.chunk_windows,
        0, H, lambda w: {"_future": F.array(*[F.lead("_now", k).over(w) for k in range(1, H + 1)])})
    rows = decoded(scorer.score(future), scorer.stages, threshold).select(
        *KEYS, "pos", "timestamp", F.posexplode(F.arrays_zip("attack_prob", "stage_prob", "top_stage", "_future"))
        .alias("_i", "_s"))
    p, top, then = F.col("_s.attack_prob"), F.col("_s.top_stage"), F.col("_s._future")
    likely, above = F.element_at(names, top + 1), F.col("_s.attack_prob") >= threshold
    truth = F.lit(labelled) & then.isNotNull()
    seconds = (F.col("_i") + 1) * options.window_seconds
    return rows.select(
        *KEYS, "pos", "timestamp", (F.col("_i") + 1).alias("step"), seconds.alias("seconds"),
        F.concat(F.lit("+"), seconds.cast("string"), F.lit("s")).alias("label"), p.alias("risk"),
        display_level(level_of(p, threshold, options)).alias("state"), above.alias("above"),
        F.when(above, likely).otherwise("None").alias("stage"), likely.alias("likely_stage"),
        F.element_at(F.col("_s.stage_prob"), top + 1).alias("stage_conf"),
        F.when(truth, then["is_attack"]).alias("actual_attack"),
        F.when(truth, F.when(then["is_attack"], then["stage"]).otherwise("None")).alias("actual_stage"),
        F.when(truth, then["timestamp"]).alias("target_time"))


def forecast_table(states: DataFrame, scorer: Scorer, threshold: float, options: Options) -> DataFrame:
    """Short form of :func:`forecast_rows` for a replay view."""
    rows = forecast_rows(states, scorer, threshold, options, labelled=False)
    return rows.select(*KEYS, "pos", "step", F.col("seconds").alias("seconds_ahead"),
                       F.col("risk").alias("attack_probability"),
                       F.when(F.col("above"), F.col("likely_stage")).otherwise(BENIGN).alias("predicted_stage"),
                       F.col("likely_stage").alias("most_likely_attack_stage"),
                       F.col("stage_conf").alias("stage_confidence"))


def forecast_span(rows: DataFrame) -> DataFrame:
    """First and last step at or above the threshold per origin; origins without one are absent."""
    return rows.where("above").groupBy(*KEYS, "pos").agg(
        F.min_by("label", "step").alias("first_label"), F.max_by("label", "step").alias("last_label"))


def expected_now(scored: DataFrame, scorer: Scorer, threshold: float, options: Options) -> DataFrame:
    """What the forecast issued one window earlier said about the current window."""
    prior = neighbours(
        scored, KEYS, "pos", options.chunk_windows, 1, 0,
        lambda w: {"_p": F.lag(F.element_at("attack_prob", 1)).over(w),
                   "_d": F.lag(F.element_at("stage_prob", 1)).over(w)})
    names = F.array(*[F.lit(s) for s in scorer.stages])
    return prior.select(
        *KEYS, "pos", "timestamp", F.col("_p").alias("risk"),
        display_level(level_of(F.col("_p"), threshold, options)).alias("state"),
        F.when(F.col("_p") >= threshold, F.element_at(names, top_stage(F.col("_d")) + 1))
        .when(F.col("_p").isNotNull(), "None").alias("stage"))


def state_persistence_error(states: DataFrame, scaler: Scaler, options: Options, label: str | None = "test",
                            ) -> DataFrame:
    """Error of "the next windows look like this one" in model space, per step (step 0 = all steps pooled).

    Per window and step the active features are reduced to two numbers right away, so nothing is multiplied by the
    feature count.
    """
    from netstate.operators.sequences import with_samples

    active = [n for n, a in zip(scaler.names, scaler.active) if a]
    z = with_samples(states, options).select(*KEYS, "pos", "split", "is_sample",
                                             F.array(*[scaler.scaled(n) for n in active]).alias("z"))
    H = options.horizon
    ahead = neighbours(
        z, KEYS, "pos", options.chunk_windows, 0, H,
        lambda w: {"_err": F.array(*[F.struct(
            F.aggregate(F.zip_with("z", F.lead("z", k).over(w), lambda a, b: F.abs(a - b)), F.lit(0.0),
                        lambda s, e: s + e).alias("abs"),
            F.aggregate(F.zip_with("z", F.lead("z", k).over(w), lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                        lambda s, e: s + e).alias("sq")) for k in range(1, H + 1)])})
    used = ahead.where("is_sample") if label is None else ahead.where(F.col("is_sample") & (F.col("split") == label))
    long = used.select(F.posexplode("_err").alias("_i", "_e"))
    n = len(active)
    return long.rollup((F.col("_i") + 1).alias("step")).agg(
        (F.sum("_e.abs") / (F.count("*") * n)).alias("mae"),
        F.sqrt(F.sum("_e.sq") / (F.count("*") * n)).alias("rmse")).select(
        F.coalesce("step", F.lit(0)).alias("step"), "mae", "rmse")

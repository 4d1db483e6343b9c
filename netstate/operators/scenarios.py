"""What-if comparison: rescore with traffic features scaled as a defensive measure would scale them."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netstate.config import SCENARIO_RATIOS, SCENARIOS
from netstate.operators.forecast import Scorer
from netstate.operators.sequences import KEYS


def under_scenario(states: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Raw features times their factor; ratios stay within [0, 1], other features at or above 0."""
    changed = {}
    for name, factor in factors.items():
        value = F.greatest(F.col(name) * F.lit(factor), F.lit(0.0))
        changed[name] = F.least(value, F.lit(1.0)) if name in SCENARIO_RATIOS else value
    return states.withColumns(changed)


def scenario_scores(states: DataFrame, scorer: Scorer, scenarios: dict | None = None) -> DataFrame:
    """(origin, scenario, attack_prob) for "no action" and every scenario; each is one narrow projection."""
    scenarios = SCENARIOS if scenarios is None else scenarios
    every = {"no_action": ("No action", {}), **scenarios}
    parts = [scorer.score(under_scenario(states, factors) if factors else states).select(
        *KEYS, "pos", F.lit(key).alias("key"), F.lit(label).alias("scenario"), "attack_prob")
        for key, (label, factors) in every.items()]
    return reduce(DataFrame.unionByName, parts)


def scenario_summary(scores: DataFrame, threshold: float) -> DataFrame:
    """Per scenario over all origins: mean and peak risk, steps above, first step above, reduction against no action."""
    p = F.col("attack_prob")
    above = F.filter(p, lambda x: x >= threshold)
    first = F.array_position(F.transform(p, lambda x: x >= threshold), True)
    per = scores.groupBy("key", "scenario").agg(
        F.avg(F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)).alias("mean_risk"),
        F.max(F.array_max(p)).alias("peak_risk"), F.sum(F.size(above)).alias("steps_above_threshold"),
        F.min(F.when(first > 0, first)).alias("first_alert_step"))
    base = per.where("key = 'no_action'").select("mean_risk").scalar()
    return per.withColumn("risk_reduction_vs_no_action", base - F.col("mean_risk"))


def scenario_by_origin(scores: DataFrame, threshold: float) -> DataFrame:
    """The same figures for every single origin."""
    p = F.col("attack_prob")
    mean = F.aggregate(p, F.lit(0.0), lambda s, x: s + x) / F.size(p)
    first = F.array_position(F.transform(p, lambda x: x >= threshold), True)
    rows = scores.select(*KEYS, "pos", "key", mean.alias("mean_risk"), F.array_max(p).alias("peak_risk"),
                         F.size(F.filter(p, lambda x: x >= threshold)).alias("steps_above_threshold"),
                         F.when(first > 0, first).alias("first_alert_step"))
    base = rows.where("key = 'no_action'").select(*KEYS, "pos", F.col("mean_risk").alias("_base"))
    return (rows.join(base, [*KEYS, "pos"]).withColumn("risk_reduction_vs_no_action", F.col("_base") - F.col("mean_risk"))
            .drop("_base"))

"""Whole analyses in one call: what came in, and what a forecaster makes of it."""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators import alerts as al
from netstate.operators.forecast import Scorer, decoded
from netstate.operators.grid import regular_states
from netstate.operators.incidents import incidents
from netstate.operators.states import window_states
from netstate.session import materialize

PROBLEMS = {"too many fields": "too_many_fields", "header": "header_again", "time": "no_time", "port": "no_port"}


def observed_states(rows: DataFrame, options: Options) -> tuple[DataFrame, dict[str, int]]:
    """Regular states of raw rows (flows with ``problem``), and the counts that were observed while they were made.

    Counts: rows, flows, rows left out by problem, windows and segments seen and dropped as too short, rows kept and filled. They are
    collected by the jobs that write the tables anyway; nothing is read a second time.
    """
    seen, kept = Observation(), Observation()
    watched = rows.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("problem").isNull()).alias("flows"),
                           *[F.count_if(F.col("problem") == k).alias(n) for k, n in PROBLEMS.items()])
    flows = materialize(watched.where("problem is null").drop("problem"), "flows")
    told: dict = {}
    table = regular_states(materialize(window_states(flows, options), "window-states"), options, options.min_segment, told)
    states = materialize(table.observe(kept, F.count("*").alias("states"), F.count_if("filled").alias("filled")), "states")
    return states, {**seen.get, **told, **kept.get}


def ingest_report(rows: DataFrame, options: Options) -> DataFrame:
    """(measure, value) of :func:`observed_states`."""
    _, counts = observed_states(rows, options)
    return rows.sparkSession.createDataFrame([(k, int(v)) for k, v in counts.items()], "measure string, value long")


@dataclass(frozen=True)
class Analysis:
    """Tables of one analysis; ``scored`` and ``alerts`` are written, the others light plans on them."""

    states: DataFrame
    scored: DataFrame
    alerts: DataFrame
    incidents: DataFrame
    summary: DataFrame


def run_analysis(states: DataFrame, scorer: Scorer, threshold: float, options: Options) -> Analysis:
    """States -> forecasts -> alerts -> incidents -> one summary row a source, also for sources without alerts."""
    scored = materialize(decoded(scorer.score(states), scorer.stages, threshold), "analysis-scores")
    found = materialize(al.alerts(scored, threshold, options), "analysis-alerts")
    cases = incidents(found, states, options)
    own = states.groupBy("source").agg(F.count("*").alias("windows"), F.count_if("is_attack").alias("attack_windows"))
    risk = scored.groupBy("source").agg(F.count("*").alias("scored"), F.count_if(F.col("risk") >= threshold).alias("flagged"),
                                        F.max("risk").alias("peak_risk"))
    raised = found.groupBy("source").agg(F.count("*").alias("alerts"), F.count_if(F.col("status") == "OPEN").alias("open"))
    judged = cases.groupBy("source").agg(F.count_if(F.col("severity") == "Critical").alias("critical"),
                                         F.count_if(F.col("confirmed") == 1).alias("confirmed"))
    joined = own.join(risk, "source", "left").join(raised, "source", "left").join(judged, "source", "left")
    counts = ["scored", "flagged", "alerts", "open", "critical", "confirmed"]
    return Analysis(states, scored, found, cases, joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts}))

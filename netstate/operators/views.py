"""Traffic statistics and dashboard tables over states, forecasts and alerts."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netstate.config import BENIGN, Options
from netstate.functions.knowledge import port_service
from netstate.functions.levels import display_level, level_of, level_rank
from netstate.operators.chunks import neighbours, quantiles
from netstate.operators.sequences import KEYS, has_history
from netstate.schema import port_features

PROTOCOLS = ["protocol_tcp", "protocol_udp", "protocol_icmp", "protocol_other"]


def traffic_stats(states: DataFrame, options: Options) -> DataFrame:
    """One row: records, time range, windows, segments, filled and forecastable windows, longest segment."""
    per_segment = states.groupBy(*KEYS).agg(
        F.sum("flow_count").alias("records"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.count("*").alias("n"), F.count_if("filled").alias("filled"),
        F.count_if(has_history(options)).alias("able"))
    last = F.max("end") + F.make_dt_interval(secs=F.lit(options.window_seconds).cast("decimal(18,6)"))
    return per_segment.agg(
        F.sum("records").cast("long").alias("records"), F.min("start").alias("start"), last.alias("end"),
        F.sum("n").alias("windows"), F.count("*").alias("segments"), F.sum("filled").alias("gap_filled_windows"),
        F.sum("able").alias("forecastable_windows"), F.max("n").alias("longest_segment_windows")).withColumn(
        "duration_s", F.timestamp_diff("SECOND", "start", "end").cast("double"))


def _shares(states: DataFrame, columns: list[str], value) -> DataFrame:
    """One aggregated row, turned into (name, share) rows."""
    one = states.agg(*[value(c).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("share")) for c in columns])))


def _weighted(column: str) -> Column:
    return F.when(F.sum("flow_count") > 0, F.sum(F.col(column) * F.col("flow_count")) / F.sum("flow_count"))


def protocol_mix(states: DataFrame) -> DataFrame:
    """Share of flows per protocol."""
    rows = _shares(states, PROTOCOLS, _weighted).where("share > 0")
    return rows.select(F.upper(F.replace("name", F.lit("protocol_"), F.lit(""))).alias("protocol"), "share")


def port_mix(states: DataFrame, options: Options, top: int = 8) -> DataFrame:
    """The ``top`` destination ports by share of flows."""
    rows = _shares(states, port_features(options), _weighted).where("share > 0")
    return (rows.select(F.replace("name", F.lit("dst_port_"), F.lit("port ")).alias("port"), "share")
            .orderBy(F.col("share").desc(), "port").limit(top))


def label_mix(states: DataFrame) -> DataFrame:
    """Windows per attack stage, and benign windows."""
    stage = F.when(F.col("is_attack"), F.col("stage")).otherwise("Benign windows")
    return states.groupBy(stage.alias("label")).agg(F.count("*").alias("windows"))


def traffic_totals(states: DataFrame) -> DataFrame:
    """One row: flows, packets, bytes, active windows, mean duration weighted by flows."""
    flows = F.sum("flow_count")
    return states.agg(
        flows.alias("flows"), F.sum("packets_total").alias("packets"), F.sum("bytes_total").alias("bytes"),
        F.count_if((F.col("flow_count") > 0) & ~F.col("filled")).alias("active_windows"),
        F.count("*").alias("windows"),
        F.when(flows > 0, F.sum(F.col("duration_mean") * F.col("flow_count")) / flows).alias("mean_duration"))


def top_ports_over_time(states: DataFrame, options: Options, top: int = 5) -> DataFrame:
    """Ports with the largest mean share over all windows."""
    ports = [c for c in port_features(options) if c != "dst_port_other"]
    rows = _shares(states, ports, lambda c: F.avg(c)).where("share > 0")
    return (rows.select(F.replace("name", F.lit("dst_port_"), F.lit("")).alias("port"), "share")
            .orderBy(F.col("share").desc(), "port").limit(top))


def _port_entries(options: Options, other: bool = True) -> Column:
    ports = [c for c in port_features(options) if other or c != "dst_port_other"]
    return F.array(*[F.struct((-F.col(c)).alias("order"), F.lit(i).alias("i"),
                              F.lit(c.removeprefix("dst_port_")).alias("port"), F.col(c).alias("share"))
                     for i, c in enumerate(ports)])


def top_ports_of_windows(states: DataFrame, options: Options, top: int = 5) -> DataFrame:
    """The main destination ports of every window; sorted inside the row, no shuffle."""
    ranked = F.slice(F.array_sort(F.filter(_port_entries(options), lambda e: e["share"] > 0)), 1, top)
    return states.select(*KEYS, "pos", "timestamp", F.posexplode(ranked).alias("_i", "_e")).select(
        *KEYS, "pos", "timestamp", (F.col("_i") + 1).alias("rank"), "_e.port", "_e.share")


def source_coverage(states: DataFrame, options: Options) -> DataFrame:
    """Per source: windows, segments, longest segment, span, median flows, attack windows."""
    per_segment = states.groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min("timestamp").alias("start"), F.max("timestamp").alias("end"),
        F.count_if("is_attack").alias("attack"))
    per_source = per_segment.groupBy("source").agg(
        F.sum("n").alias("windows"), F.count("*").alias("segments"), F.max("n").alias("longest_segment"),
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("attack").alias("attack_windows"))
    median = quantiles(states, ["source"], "flow_count", [0.5]).select("source", F.col("q").alias("median_flows"))
    hours = F.timestamp_diff("SECOND", "start", "end") / 3600.0
    return per_source.withColumn("span_hours", hours).join(median, "source")


def stage_counts_by_source(states: DataFrame) -> DataFrame:
    """Attack windows per source and stage."""
    return states.where("is_attack").groupBy("source", "stage").agg(F.count("*").alias("windows"))


def class_weights(samples: DataFrame, vocab: list[str]) -> DataFrame:
    """Square-root inverse class frequency over all sample targets, with mean 1 over the classes that occur."""
    counts = samples.select(F.explode("future_stage").alias("id")).where("id >= 0").groupBy("id").agg(
        F.count("*").alias("n"))
    # at most one row per class from here on
    whole = Window.partitionBy()
    raw = counts.withColumn("raw", F.sqrt(F.sum("n").over(whole) / (len(vocab) * F.col("n"))))
    names = F.array(*[F.lit(s) for s in vocab])
    return raw.select(F.element_at(names, F.col("id") + 1).alias("stage"), "n",
                      (F.col("raw") / F.avg("raw").over(whole)).alias("weight"))


def positive_weight(samples: DataFrame) -> DataFrame:
    """Negatives per positive over all sample targets, within 1 and 10."""
    y = samples.select(F.explode("future_attack").alias("y"))
    pos = F.sum("y")
    return y.agg(pos.alias("positives"), (F.count("*") - pos).alias("negatives"),
                 F.least(F.greatest((F.count("*") - pos) / F.greatest(pos, F.lit(1.0)), F.lit(1.0)), F.lit(10.0)
                         ).alias("positive_weight"))


def alert_counts(found: DataFrame, events: DataFrame, options: Options) -> DataFrame:
    """One row: alerts, open and critical ones, mean length, peak risk, escalations."""
    escalations = events.agg(F.count_if(F.col("type") == "escalated")).scalar()
    one = found.agg(
        F.count("*").alias("alerts"), F.count_if(F.col("status") == "OPEN").alias("open"),
        F.count_if(F.col("peak_severity") == "CRITICAL").alias("critical"),
        (F.avg("duration_windows") * options.window_seconds).alias("mean_length_s"),
        F.max("peak_risk").alias("peak_risk"),
        display_level(F.max_by("peak_severity", level_rank(F.col("peak_severity")))).alias("highest_severity"))
    return one.withColumn("escalations", escalations)


def escalations_per_alert(found: DataFrame, events: DataFrame) -> DataFrame:
    n = events.where("type = 'escalated'").groupBy("source", "alert_id").agg(F.count("*").alias("n"))
    return (found.select("source", F.col("id").alias("alert_id")).join(n, ["source", "alert_id"], "left")
            .select("source", "alert_id", F.coalesce("n", F.lit(0)).alias("escalations")))


def system_overview(analyses: DataFrame) -> DataFrame:
    """One row over the table of stored analyses."""
    return analyses.agg(F.count("*").alias("analyses"), F.count_if("labelled").alias("labelled"),
                        F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"))


# ------------------------------------------------------------------------------------ forecast next to traffic
def current_windows(scored: DataFrame, threshold: float, options: Options) -> DataFrame:
    """Every scored window as "now": risk, state, forecast stage, observed totals and the true label."""
    stage = F.when(F.col("headline_stage") == BENIGN, "None").otherwise(F.col("headline_stage"))
    return scored.select(
        *KEYS, "pos", "timestamp", "risk", display_level(level_of(F.col("risk"), threshold, options)).alias("state"),
        stage.alias("forecast_stage"), F.col("flow_count").alias("flows"), F.col("packets_total").alias("packets"),
        F.col("bytes_total").alias("bytes"), "filled", F.col("is_attack").alias("actual_attack"),
        F.when(F.col("is_attack"), F.col("stage")).otherwise("None").alias("actual_stage"))


def observed_history(scored_states: DataFrame, options: Options) -> DataFrame:
    """For every origin the L windows it looks back on, each with the forecast issued one window before it.

    ``scored_states``: all state rows; ``p1`` is their first-step probability, null where none was issued.
    """
    L = options.history
    prior = neighbours(scored_states, KEYS, "pos", options.chunk_windows, 1, 0,
                       lambda w: {"prior_forecast": F.lag("p1").over(w)})
    entry = F.struct("timestamp", F.col("flow_count").alias("flows"), F.col("packets_total").alias("packets"),
                     F.col("bytes_total").alias("bytes"), "prior_forecast", F.col("is_attack").alias("actual_attack"))
    rows = neighbours(prior.select(*KEYS, "pos", entry.alias("_e")), KEYS, "pos", options.chunk_windows, L - 1, 0,
                      lambda w: {"_h": F.collect_list("_e").over(w.rowsBetween(1 - L, 0))}, where=F.col("pos") >= L - 1)
    return rows.select(*KEYS, "pos", F.posexplode("_h").alias("_i", "_e")).select(
        *KEYS, "pos", (F.col("_i") - (L - 1)).alias("offset"), "_e.*")


def flagged_traffic(scored: DataFrame, threshold: float, options: Options, newest: int = 12) -> DataFrame:
    """The newest windows at or above the watch level or labelled as attack, with their dominant port."""
    flagged = (scored.where((F.col("risk") >= threshold * options.watch_ratio) | F.col("is_attack"))
               .orderBy(F.col("timestamp").desc(), "source").limit(newest))
    main = F.array_min(_port_entries(options, other=False))
    port = F.when(main["share"] > 0, main["port"]).otherwise("other")
    service = port_service(F.expr("try_cast(port as int)"))
    return flagged.select(
        "source", "timestamp", "risk", "headline_stage", F.col("flow_count").alias("flows"),
        F.col("unique_dst_ports").alias("distinct_ports"), "syn_ratio", "failed_flow_ratio", "scan_score",
        port.alias("port"), F.col("stage").alias("dataset_label")).withColumn("service", F.coalesce(service, "port"))

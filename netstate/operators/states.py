"""Flows -> network states: one row of features per (source, time window)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netstate.config import BENIGN, Options
from netstate.functions.labels import attack_stages
from netstate.schema import feature_names

FLAGS = ["syn", "ack", "rst", "fin", "psh", "urg"]


def window_start(ts: Column, options: Options) -> Column:
    """Start of the tumbling, epoch-aligned window of ``ts``."""
    return F.window(ts, f"{options.window_seconds} seconds").start


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since the epoch of a zone-less timestamp, whatever the session time zone."""
    days = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def window_number(ts: Column, options: Options) -> Column:
    """Windows since the epoch."""
    return F.floor(epoch_seconds(ts) / F.lit(options.window_seconds)).cast("long")


def with_measures(flows: DataFrame, options: Options, *more: Column) -> DataFrame:
    """Per-flow quantities that the window aggregation adds up, and the columns ``more``."""
    def known(c):
        return F.coalesce(F.col(c), F.lit(0.0))

    def flag(condition):
        return F.coalesce(condition, F.lit(False)).cast("double")

    port, proto = F.col("dst_port"), F.col("protocol")
    seconds = F.greatest(known("flow_duration"), F.lit(1e-3))
    packets, payload = known("fwd_packets") + known("bwd_packets"), known("fwd_bytes") + known("bwd_bytes")
    return flows.select(
        "source", "timestamp", "stage",
        *[known(c).alias(c) for c in ["fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "flow_duration", "iat_mean", "iat_std",
                                      "iat_max", "retransmissions", "pktlen_mean", "pktlen_std", *FLAGS]],
        "win_fwd", "ttl", packets.alias("packets"), payload.alias("payload"),
        F.least(packets / seconds, F.lit(options.rate_clip)).alias("packet_rate"),
        F.least(payload / seconds, F.lit(options.rate_clip)).alias("byte_rate"),
        flag(known("bwd_packets") == 0).alias("failed"), flag(packets <= options.small_flow_packets).alias("small"),
        flag(port.isin(list(options.well_known_ports))).alias("well_known"),
        flag(proto == 6).alias("tcp"), flag(proto == 17).alias("udp"), flag(proto == 1).alias("icmp"),
        flag(~proto.isin(1, 6, 17)).alias("other_protocol"),
        *[flag(port == p).alias(f"port_{p}") for p in options.port_buckets],
        flag(~port.isin(list(options.port_buckets))).alias("port_other"), *more)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _variance(total: Column, squares: Column, n: Column) -> Column:
    mean = _ratio(total, n)
    return F.greatest(_ratio(squares, n) - mean * mean, F.lit(0.0))


def sum_columns(options: Options) -> list[Column]:
    """Additive part of a state: sums, one maximum and attack flows per stage."""
    squares = ["flow_duration", "win_fwd", "ttl", "payload"]
    plain = ["fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "flow_duration", "iat_mean", "iat_std", "win_fwd", "ttl",
             "retransmissions", "pktlen_mean", "pktlen_std", "payload", *FLAGS,
             "failed", "small", "well_known", "tcp", "udp", "icmp", "other_protocol", "packet_rate", "byte_rate",
             *[f"port_{p}" for p in options.port_buckets], "port_other"]
    return [F.count("stage").cast("double").alias("n"),
            *[F.coalesce(F.sum(c), F.lit(0.0)).alias(f"s_{c}") for c in plain],
            *[F.coalesce(F.sum(F.col(c) * F.col(c)), F.lit(0.0)).alias(f"q_{c}") for c in squares],
            F.count("win_fwd").cast("double").alias("n_win_fwd"), F.count("ttl").cast("double").alias("n_ttl"),
            F.max("iat_max").alias("x_iat_max"),
            F.count_if(F.col("stage") != BENIGN).cast("double").alias("attack_flows"),
            *[F.count_if(F.col("stage") == s).alias(f"stage_{i}") for i, s in enumerate(attack_stages(options))]]


def window_sums(flows: DataFrame, options: Options) -> DataFrame:
    """The additive part per (source, window), combined map-side before the shuffle."""
    start = window_start(F.col("timestamp"), options).alias("timestamp")
    return with_measures(flows, options).groupBy("source", start).agg(*sum_columns(options))


# kinds of distinct values counted per window
DISTINCT = ["unique_dst_ports", "unique_src_ports", "unique_src_ips", "unique_dst_ips", "pairs"]


def distinct_values(flows: DataFrame, window: Column) -> DataFrame:
    """One narrow row per flow and kind of value; addresses count only where both are known."""
    both = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    none_n, none_s = F.lit(None).cast("long"), F.lit(None).cast("string")

    def value(kind, number=none_n, a=none_s, b=none_s):
        return F.struct(F.lit(kind).alias("kind"), number.alias("number"), a.alias("a"), b.alias("b"))

    src, dst = F.col("src_ip"), F.col("dst_ip")
    port, src_port = F.col("dst_port").cast("long"), F.col("src_port").cast("long")
    values = F.filter(F.array(
        F.when(port.isNotNull(), value(0, port)), F.when(src_port.isNotNull(), value(1, src_port)),
        F.when(both, value(2, a=src)), F.when(both, value(3, a=dst)), F.when(both, value(4, a=src, b=dst))),
        lambda v: v.isNotNull())
    return flows.select("source", window, F.inline(values))


def distinct_columns() -> list[Column]:
    return [F.count_if(F.col("kind") == i).alias(n) for i, n in enumerate(DISTINCT)]


def window_distincts(flows: DataFrame, options: Options) -> DataFrame:
    """Distinct counts per window.

    Exact: repeated values are dropped map-side, the shuffle is keyed by the value itself, so one busy window is
    spread over all tasks. Approximate: mergeable sketches, no extra shuffle of values.
    """
    if options.approximate_distinct:
        both = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
        return (flows.select("source", window_start(F.col("timestamp"), options).alias("timestamp"), "dst_port",
                             "src_port", F.when(both, F.col("src_ip")).alias("a"),
                             F.when(both, F.col("dst_ip")).alias("b"))
                .groupBy("source", "timestamp").agg(
                    F.approx_count_distinct("dst_port").alias(DISTINCT[0]),
                    F.approx_count_distinct("src_port").alias(DISTINCT[1]),
                    F.approx_count_distinct("a").alias(DISTINCT[2]), F.approx_count_distinct("b").alias(DISTINCT[3]),
                    F.approx_count_distinct(F.when(F.col("a").isNotNull(), F.xxhash64("a", "b"))).alias(DISTINCT[4])))
    start = window_start(F.col("timestamp"), options).alias("timestamp")
    return distinct_values(flows, start).distinct().groupBy("source", "timestamp").agg(*distinct_columns())


def window_states(flows: DataFrame, options: Options) -> DataFrame:
    """Canonical flows -> one state row per non-empty window of each source."""
    sums, distincts = window_sums(flows, options), window_distincts(flows, options)
    return finish_states(sums.join(distincts, ["source", "timestamp"], "left"), options)


#: Base 2 logarithm of the registers of a distinct-count sketch: a standard error of 1.04 / 2^(12 / 2), or 1.6 %.
SKETCH_BITS = 12


def partial_states(flows: DataFrame, options: Options, bits: int = SKETCH_BITS) -> DataFrame:
    """State rows that can be put together: sums, maxima, and a sketch for each distinct count, per (source, window).

    Stored once for short windows, they give the states of any longer window by :func:`roll_up` without the flows; rows of the
    same window from different loads add up too. One scan, and one row a window in the shuffle.
    """
    both = F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull()
    values = [F.col("dst_port").cast("long"), F.col("src_port").cast("long"), F.when(both, F.col("src_ip")), F.when(both, F.col("dst_ip")),
              F.when(both, F.concat_ws(" ", "src_ip", "dst_ip"))]
    rows = with_measures(flows, options, *[v.alias(f"d_{n}") for n, v in zip(DISTINCT, values)])
    start = window_start(F.col("timestamp"), options).alias("timestamp")
    return rows.groupBy("source", start).agg(*sum_columns(options), *[F.hll_sketch_agg(f"d_{n}", bits).alias(n) for n in DISTINCT])


def roll_up(partials: DataFrame, options: Options) -> DataFrame:
    """Partial states of the windows of ``options``, from those of windows that divide them."""
    how = {**{n: F.hll_union_agg(n) for n in DISTINCT}, "x_iat_max": F.max("x_iat_max")}
    start = window_start(F.col("timestamp"), options).alias("timestamp")
    names = [c for c in partials.columns if c not in ("source", "timestamp")]
    return partials.groupBy("source", start).agg(*[how.get(c, F.sum(c)).alias(c) for c in names])


def rolled_states(partials: DataFrame, options: Options) -> DataFrame:
    """Window states of partial ones: all features exact but the distinct counts and what is made of them, which are estimates."""
    rolled = roll_up(partials, options)
    return finish_states(rolled.withColumns({n: F.hll_sketch_estimate(n) for n in DISTINCT}), options)


def finish_states(sums: DataFrame, options: Options) -> DataFrame:
    """Turn sums and distinct counts into the feature row."""
    n = F.col("n")

    def mean(c):
        return _ratio(F.col(f"s_{c}"), n)

    def uniq(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("double")

    failed, small = mean("failed"), mean("small")
    scan = uniq("unique_dst_ports") / (n + 10) * (0.5 + 0.5 * failed) * small * 2
    columns = {
        "flow_count": n,
        **{c: uniq(c) for c in DISTINCT[:4]},
        "packets_total": F.col("s_fwd_packets") + F.col("s_bwd_packets"), "bytes_total": F.col("s_fwd_bytes") + F.col("s_bwd_bytes"),
        "pkt_rate_mean": mean("packet_rate"), "byte_rate_mean": mean("byte_rate"),
        "duration_mean": mean("flow_duration"), "duration_std": F.sqrt(_variance(F.col("s_flow_duration"), F.col("q_flow_duration"), n)),
        "iat_mean": mean("iat_mean"), "iat_std": mean("iat_std"), "iat_max": F.greatest(F.col("x_iat_max"), F.lit(0.0)),
        "ttl_mean": _ratio(F.col("s_ttl"), F.col("n_ttl")),
        "ttl_var": _variance(F.col("s_ttl"), F.col("q_ttl"), F.col("n_ttl")),
        "tcp_window_mean": _ratio(F.col("s_win_fwd"), F.col("n_win_fwd")),
        "tcp_window_var": _variance(F.col("s_win_fwd"), F.col("q_win_fwd"), F.col("n_win_fwd")),
        "pkt_len_mean": mean("pktlen_mean"), "pkt_len_std": mean("pktlen_std"),
        "payload_mean": mean("payload"), "payload_std": F.sqrt(_variance(F.col("s_payload"), F.col("q_payload"), n)),
        "retransmissions": F.col("s_retransmissions"),
        **{f"{f}_count": F.col(f"s_{f}") for f in FLAGS},
        "syn_ratio": mean("syn"), "rst_ratio": mean("rst"),
        "inbound_outbound_byte_ratio": _ratio(F.col("s_bwd_bytes"), F.col("s_fwd_bytes")),
        "inbound_outbound_packet_ratio": _ratio(F.col("s_bwd_packets"), F.col("s_fwd_packets")),
        "distinct_dst_per_src_mean": uniq("pairs") / F.greatest(uniq("unique_src_ips"), F.lit(1.0)),
        "failed_flow_ratio": failed, "small_flow_ratio": small,
        "scan_score": F.least(F.greatest(scan, F.lit(0.0)), F.lit(1.0)),
        "well_known_dst_port_ratio": mean("well_known"),
        "protocol_tcp": mean("tcp"), "protocol_udp": mean("udp"), "protocol_icmp": mean("icmp"),
        "protocol_other": mean("other_protocol"),
        **{f"dst_port_{p}": mean(f"port_{p}") for p in options.port_buckets}, "dst_port_other": mean("port_other"),
    }
    fraction = _ratio(F.col("attack_flows"), n)
    attack = (F.col("attack_flows") >= options.min_attack_flows) & (fraction >= options.min_attack_fraction)
    # most frequent attack stage; equal counts go to the stage that comes first in the stage order
    stages = attack_stages(options)
    dominant = F.array_max(F.array(*[F.struct(F.col(f"stage_{i}").alias("n"), F.lit(-i).alias("rank"),
                                              F.lit(s).alias("stage")) for i, s in enumerate(stages)]))["stage"]
    return sums.select(
        "timestamp", *[columns[f].alias(f) for f in feature_names(options)],
        "attack_flows", fraction.alias("attack_fraction"),
        F.when(attack, dominant).otherwise(BENIGN).alias("stage"), attack.alias("is_attack"),
        "source", F.lit(False).alias("filled"))


def source_info(flows: DataFrame, options: Options) -> DataFrame:
    """Ingest report per source: flows, windows, time range, which optional fields carry data.

    Counted over per-window partial rows, so no distinct set of windows is held for a source.
    """
    def some(c):
        return F.bool_or(F.col(c).isNotNull()).alias(c)

    per_window = flows.groupBy("source", window_start(F.col("timestamp"), options).alias("w")).agg(
        F.count("*").alias("n"), some("src_ip"), some("dst_ip"), some("src_port"), some("ttl"), some("retransmissions"))
    return per_window.groupBy("source").agg(
        F.sum("n").alias("flow_rows"), F.count("*").alias("windows"), F.min("w").alias("start"),
        F.max("w").alias("end"), (F.bool_or("src_ip") & F.bool_or("dst_ip")).alias("has_ip"),
        F.bool_or("src_port").alias("has_src_port"), F.bool_or("ttl").alias("has_ttl"),
        F.bool_or("retransmissions").alias("has_retransmissions"))

"""The driver's ``events`` table read as canonical flows (two sensors, a labelled campaign every 37 hours)."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.config import WELL_KNOWN_PORTS, Options
from netstate.functions.labels import stage_of_label
from netstate.operators.states import epoch_seconds

CAMPAIGNS = ["SSH-Bruteforce", "DoS attacks-Hulk", "Infilteration", "Bot", "SQL Injection", "Totally New Attack"]


def event_flows(spark: SparkSession, sf_dir: str, options: Options | None = None) -> DataFrame:
    return flows_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"), options)


def flows_of_events(events: DataFrame, options: Options | None = None) -> DataFrame:
    """Works on a batch and on a streaming table alike."""
    k, kind, value = F.col("k"), F.col("event_type"), F.col("value")
    base = events.select(
        "*", F.get_json_object("props", "$.k").cast("int").alias("k"), (F.col("user_id") % 2).alias("sensor"),
        F.floor(epoch_seconds(F.col("ts")) / 3600).alias("h"))
    shifted = F.col("h") + 11 * F.col("sensor")
    base = base.select("*", (shifted % 37).alias("phase"), (F.floor(shifted / 37) % 6).cast("int").alias("camp"))
    ports = F.array(*[F.lit(p) for p in WELL_KNOWN_PORTS])
    icmp = (kind == "error") & (k % 10 == 0)
    first = F.col("sensor") == 0

    def double(c):
        return c.cast("double")

    flows = base.select(
        F.concat(F.lit("sensor-"), F.col("sensor").cast("string")).alias("source"), F.col("ts").alias("timestamp"),
        double(F.when(k < 68, F.element_at(ports, k % 17 + 1)).otherwise(1000 + k * 7)).alias("dst_port"),
        double(F.when(k == 99, 47).when(kind == "signup", 17).when(icmp, 1).otherwise(6)).alias("protocol"),
        (value / 10).alias("flow_duration"), double(1 + k % 6).alias("fwd_packets"),
        double(F.when(kind == "error", 0).otherwise(k % 5)).alias("bwd_packets"),
        F.round(value * 10).alias("fwd_bytes"), F.round(value * (k % 5) * 4).alias("bwd_bytes"),
        (value / 100).alias("iat_mean"), (value / 200).alias("iat_std"), (value / 20).alias("iat_max"),
        F.when((k != 99) & (kind != "signup") & ~icmp, double(8192 + 512 * (k % 8))).alias("win_fwd"),
        F.when(first, double(32 + 32 * (k % 3))).alias("ttl"),
        F.when(first, double(F.when(k % 20 == 0, 1).otherwise(0))).alias("retransmissions"),
        (value * 2).alias("pktlen_mean"), (value / 2).alias("pktlen_std"),
        double(F.when(kind.isin("click", "view", "error"), 1).otherwise(0)).alias("syn"), double(k % 4).alias("ack"),
        double(F.when(k % 9 == 0, 1).otherwise(0)).alias("rst"), double(k % 2).alias("fin"),
        double(k % 3).alias("psh"), F.lit(0.0).alias("urg"),
        F.concat_ws(".", F.lit("10.0"), F.floor(F.col("user_id") / 250).cast("string"),
                    (F.col("user_id") % 250).cast("string")).alias("src_ip"),
        F.concat(F.lit("192.168.1."), (k % 20).cast("string")).alias("dst_ip"),
        double(1024 + F.col("event_id") % 50000).alias("src_port"),
        F.when((F.col("phase") < 5) & (kind != "click"),
               F.element_at(F.array(*[F.lit(c) for c in CAMPAIGNS]), F.col("camp") + 1))
        .otherwise("Benign").alias("raw_label"))
    return flows.withColumn("stage", stage_of_label(F.col("raw_label"), options or Options()))

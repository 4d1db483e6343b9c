"""Named queries over the driver's tables. Each takes (spark, sf_dir) and returns a DataFrame."""
from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.functions import knowledge as know
from netstate.functions.labels import unmapped_labels
from netstate.functions.levels import display_level, incident_level, level_of
from netstate.operators import alerts as al
from netstate.operators import analysis, chunks, drift, evaluation, explain, forecast, grid, incidents, logistic, metrics, packets
from netstate.operators import quality, scaling, scenarios, sequences, states, views
from netstate.operators.sequences import KEYS
from netstate.plans.events import event_flows, flows_of_events
from netstate.schema import FLOW_NUMBERS, feature_names
from netstate.session import materialize, shared_folder

T3600, G600, G300 = (Options(window_seconds=s) for s in (3600, 600, 300))
THRESHOLD = forecast.CLOSED_FORM_THRESHOLD
NUDGE = 1e-9
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__.removesuffix("_")] = f
    return f


def tidy(df: DataFrame, nudge: float = 0.0) -> DataFrame:
    """Doubles to six places: sums come in any order. ``nudge`` moves means of short decimals off exact rounding ties."""
    return df.select(*[F.round(F.col(c) + nudge, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- tables several queries start from, written once
@lru_cache(maxsize=16)
def _regular(spark: SparkSession, sf: str, seconds: int) -> DataFrame:
    options = Options(window_seconds=seconds)
    return materialize(grid.build_states(event_flows(spark, sf, options), options), "states")


def regular(spark, sf, options: Options = T3600) -> DataFrame:
    return _regular(spark, sf, options.window_seconds)


@lru_cache(maxsize=16)
def scaler(spark, sf) -> scaling.Scaler:
    train = sequences.with_split(regular(spark, sf), T3600).where("split = 'train'")
    return scaling.Scaler.fit(train, T3600)


def scorer(spark, sf) -> forecast.ClosedFormScorer:
    return forecast.ClosedFormScorer(scaler(spark, sf), T3600)


@lru_cache(maxsize=16)
def scored(spark, sf) -> DataFrame:
    """Forecast of every window with a full history, with the windows' own columns and what followed."""
    model = scorer(spark, sf)
    rows = model.score(sequences.with_future(regular(spark, sf), T3600, model.stages))
    rows = sequences.with_samples(forecast.decoded(rows, model.stages, THRESHOLD), T3600)
    return materialize(rows, "scored")


def samples(spark, sf, split="test") -> DataFrame:
    return scored(spark, sf).where(F.col("is_sample") & (F.col("split") == split))


@lru_cache(maxsize=16)
def raised(spark, sf) -> DataFrame:
    return al.alerts(scored(spark, sf), THRESHOLD, T3600)


def found_incidents(spark, sf) -> DataFrame:
    return incidents.incidents(raised(spark, sf), regular(spark, sf), T3600)


@lru_cache(maxsize=16)
def background(spark, sf) -> DataFrame:
    return materialize(drift.background_sample(regular(spark, sf), scaler(spark, sf), T3600), "background")


# -------------------------------------------------------------------------------------------- flows and states
@query
def window_states(spark, sf):
    return tidy(states.window_states(event_flows(spark, sf), T3600), NUDGE)


@query
def window_distincts(spark, sf):
    return states.window_distincts(event_flows(spark, sf), G600)


@query
def flow_measures(spark, sf):
    """Every per-flow quantity, added up by source."""
    m = states.with_measures(event_flows(spark, sf), T3600)
    return tidy(m.groupBy("source").agg(*[F.sum(c).alias(c) for c, t in m.dtypes if t == "double"]), NUDGE)


@query
def label_stages(spark, sf):
    return event_flows(spark, sf).groupBy("raw_label", "stage").agg(F.count("*").alias("flows"))


@query
def unmapped_label_report(spark, sf):
    return unmapped_labels(event_flows(spark, sf))


@query
def source_info(spark, sf):
    return states.source_info(event_flows(spark, sf), T3600)


@query
def regular_states(spark, sf):
    table = materialize(states.window_states(event_flows(spark, sf), G600), "window-states")
    return tidy(grid.regular_states(table, G600).drop("seg_len", "row", "source_rows"), NUDGE)


@query
def segment_prune(spark, sf):
    table = regular(spark, sf, G300)
    return table.groupBy(*KEYS).agg(F.count("*").alias("windows"), F.min("timestamp").alias("start"),
                                    F.max("timestamp").alias("end"), F.count_if("filled").alias("filled"),
                                    F.max("row").alias("last_row"))


@query
def segment_extremes(spark, sf):
    return grid.short_and_long_segments(regular(spark, sf, G300))


def _flow_text(flows: DataFrame, time, protocol) -> DataFrame:
    """Every field of a flow under the column names of a flow CSV; times in microseconds, missing windows as -1."""
    named = {"fwd_packets": "Tot Fwd Pkts", "bwd_packets": "Tot Bwd Pkts", "fwd_bytes": "TotLen Fwd Pkts", "bwd_bytes": "TotLen Bwd Pkts",
             "pktlen_mean": "Pkt Len Mean", "pktlen_std": "Pkt Len Std", "ttl": "TTL", "retransmissions": "Retransmission Count",
             "src_ip": "Src IP", "dst_ip": "Dst IP", "src_port": "Src Port", "raw_label": "Label",
             **{f: f"{f.upper()} Flag Cnt" for f in states.FLAGS}}
    micros = {"flow_duration": "Flow Duration", "iat_mean": "Flow IAT Mean", "iat_std": "Flow IAT Std", "iat_max": "Flow IAT Max"}
    return flows.select(
        "source", F.col("dst_port").cast("int").alias("Dst Port"), protocol.alias("Protocol"), time.alias("Timestamp"),
        *[(F.col(c) * 1e6).alias(n) for c, n in micros.items()], *[F.col(c).alias(n) for c, n in named.items()],
        F.coalesce("win_fwd", F.lit(-1.0)).alias("Init Fwd Win Byts"))


def _ingested(spark: SparkSession, text: DataFrame) -> DataFrame:
    """Sums of every number that comes back, with the addresses and times next to them."""
    import uuid

    from netstate.sources.flow_csv import read_flows
    path = f"{shared_folder(spark)}/flow-csv-{uuid.uuid4().hex}"
    text.write.partitionBy("source").option("header", "true").csv(path)
    sums = [c for c in FLOW_NUMBERS if c != "protocol"]
    return tidy(read_flows(spark, path, Options()).groupBy("protocol", "stage", "raw_label").agg(
        F.count("*").alias("flows"), *[F.sum(c).alias(c) for c in [*sums, "src_port"]],
        F.countDistinct("src_ip").alias("sources"), F.countDistinct("dst_ip").alias("targets"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last")), NUDGE)


@query
def csv_ingest(spark, sf):
    """Flows written as flow CSVs of one sensor each, read back through the dialect-tolerant scan."""
    return _ingested(spark, _flow_text(event_flows(spark, sf), F.date_format("timestamp", "dd/MM/yyyy HH:mm:ss"),
                                       F.col("protocol").cast("int").cast("string")))


@query
def csv_ingest_mixed(spark, sf):
    """As csv_ingest, but later days of a file write times in another format and protocols by name."""
    late = F.dayofmonth("timestamp") > 10
    name = F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "UDP").when(F.col("protocol") == 1, "icmp")
    number = F.col("protocol").cast("int").cast("string")
    return _ingested(spark, _flow_text(
        event_flows(spark, sf), F.when(late, F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).otherwise(
            F.date_format("timestamp", "dd/MM/yyyy HH:mm:ss")), F.when(late, F.coalesce(name, number)).otherwise(number)))


def _spoilt(spark, sf) -> DataFrame:
    """Flow lines of which some lack a time or a port, and some are header lines once more."""
    flows = event_flows(spark, sf)
    n = F.col("src_port").cast("long")
    text = _flow_text(flows.withColumn("_n", n), F.when(n % 97 == 0, "no time").otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")),
                      F.col("protocol").cast("int").cast("string"))
    k = F.round(F.col("Flow Duration"))                              # lines are spoilt by what they hold
    return text.withColumns({"Dst Port": F.when(k % 11 == 0, "none").otherwise(F.col("Dst Port").cast("string")),
                             "Label": F.when(k % 13 == 0, "Label").otherwise(F.col("Label"))})


def _flow_folder(spark, text: DataFrame) -> str:
    import uuid
    path = f"{shared_folder(spark)}/flow-csv-{uuid.uuid4().hex}"
    text.write.partitionBy("source").option("header", "true").csv(path)
    return path


@query
def ingest_report(spark, sf):
    """What is read, left out, dropped and filled on the way from spoilt flow files to regular states."""
    from netstate.sources.flow_csv import read_rows
    path = _flow_folder(spark, _spoilt(spark, sf).repartition(1, "source"))
    rows = read_rows(spark, path, T3600)
    return analysis.ingest_report(rows.withColumn("source", F.lit("all")), T3600)


@query
def rejected_rows(spark, sf):
    """Rows, flows and rows that are none by their problem, over all files."""
    from netstate.sources.flow_csv import row_report
    report = row_report(spark, _flow_folder(spark, _spoilt(spark, sf)), T3600)
    return report.agg(*[F.sum(c).alias(c) for c in report.columns if c != "source"])


@query
def file_checks(spark, sf):
    """A file that can be read, one without times, one without ports and one of another kind."""
    import uuid

    from netstate.sources import flow_csv
    path = f"{shared_folder(spark)}/flow-csv-{uuid.uuid4().hex}"
    text = _flow_text(event_flows(spark, sf), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.col("protocol").cast("int").cast("string")).drop("source")
    for folder, rows in {"good": text, "untimed": text.withColumn("Timestamp", F.lit("never")), "portless": text.drop("Dst Port")}.items():
        rows.coalesce(1).write.option("header", "true").csv(f"{path}/{folder}")
    text.select("Label").coalesce(1).write.json(f"{path}/other")
    checks = flow_csv.file_checks(spark, path, T3600)
    return checks.withColumn("folder", F.element_at(F.split("path", "/"), -2)).drop("path")


@query
def rolled_up_states(spark, sf):
    """Hours out of stored ten-minute partial states: sums as they are, estimated distinct counts against exact ones."""
    flows = event_flows(spark, sf)
    rolled = states.rolled_states(materialize(states.partial_states(flows, G600), "partial-states"), T3600)
    kinds = states.DISTINCT[:4]
    exact = states.window_distincts(flows, T3600).select("source", "timestamp", *[F.col(k).cast("long").alias(f"exact_{k}") for k in kinds])
    near = [(F.abs(F.col(k) - F.col(f"exact_{k}")) <= 1 + 0.05 * F.col(f"exact_{k}")).alias(f"near_{k}") for k in kinds]
    sums = ["flow_count", "packets_total", "bytes_total", "duration_std", "iat_max", "payload_std", "syn_count", "failed_flow_ratio", "dst_port_443"]
    return tidy(rolled.join(exact, ["source", "timestamp"]).select("source", "timestamp", *sums, "stage", "is_attack",
                                                                 *[f"exact_{k}" for k in kinds], *near), NUDGE)


def _packets(spark, sf) -> DataFrame:
    """TCP and UDP frames built from the events, five conversations per sensor."""
    # k has its own projection, so the JSON is parsed once a row
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    up = k % 3 != 0

    def hexed(value, digits):
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    udp = F.col("user_id") % 5 == 4
    client, server = F.concat(F.lit("0A0000"), hexed(F.col("user_id") % 5 + 1, 2)), F.lit("C0A80101")
    cport, sport = hexed(F.lit(40000) + F.col("user_id") % 5, 4), hexed(F.lit(443), 4)
    body = F.when(udp, 8).otherwise(20)
    total = body + 20 + k
    l4_rest = F.when(udp, F.concat(hexed(8 + k, 4), F.lit("0000"))).otherwise(F.concat(
        hexed(k % 10, 8), F.lit("00000000"), F.lit("50"), hexed(k % 64, 2), hexed(8192 + k, 4), F.lit("00000000")))
    frame = F.concat(
        F.lit("1" * 24), F.lit("0800"), F.lit("4500"), hexed(total, 4), F.lit("00000000"), hexed(32 + k % 32, 2),
        F.when(udp, "11").otherwise("06"), F.lit("0000"), F.when(up, client).otherwise(server),
        F.when(up, server).otherwise(client), F.when(up, cport).otherwise(sport), F.when(up, sport).otherwise(cport),
        l4_rest)
    return e.select(F.concat(F.lit("sensor-"), (F.col("user_id") % 2).cast("string")).alias("capture"),
                    F.col("event_id").alias("packet_no"),
                    states.epoch_seconds(F.col("ts")).cast("double").alias("ts"), F.lit(1).alias("linktype"),
                    F.unhex(frame).alias("frame"))


@query
def packet_decode(spark, sf):
    return packets.decode(_packets(spark, sf)).groupBy("proto", "src", "dport").agg(
        F.count("*").alias("packets"), F.sum("payload").alias("payload"), F.sum("flags").alias("flags"),
        F.sum("win").alias("win"), F.sum("ttl").alias("ttl"), F.sum("seq").alias("seq"))


def _frames(spark, sf) -> DataFrame:
    """Ethernet, VLAN, Linux cooked and raw IP frames with TCP, UDP and ICMP, one capture for each sensor and link."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    k, u, link = F.get_json_object("props", "$.k").cast("int"), F.col("user_id") % 5, F.col("event_id") % 4

    def hexed(value, digits):
        return F.lpad(F.hex(value.cast("long")), digits, "0")

    proto = F.when(u == 4, 17).when(u == 3, 1).otherwise(6)
    l4 = (F.when(proto == 17, F.concat(hexed(40000 + u, 4), hexed(53 + k, 4), hexed(8 + k, 4), F.lit("0000")))
          .when(proto == 1, F.lit("0800000000000000")).otherwise(F.concat(
              hexed(40000 + u, 4), hexed(F.lit(443), 4), hexed(k % 10, 8), F.lit("0000000050"), hexed(k % 64, 2),
              hexed(8192 + k, 4), F.lit("00000000"))))
    ip = F.concat(F.lit("4500"), hexed(F.when(proto == 6, 40).otherwise(28) + k, 4), F.lit("00000000"), hexed(32 + k % 32, 2),
                  hexed(proto, 2), F.lit("0000"), F.lit("0A0000"), hexed(u + 1, 2), F.lit("C0A80101"), l4,
                  F.repeat(F.lit("5A"), k))
    header = (F.when(link == 0, "1" * 24 + "0800").when(link == 1, "1" * 24 + "810000050800")
              .when(link == 2, "00000001000602020202020200000800").otherwise(""))
    name = F.element_at(F.array(*[F.lit(x) for x in ("eth", "vlan", "sll", "raw")]), link.cast("int") + 1)
    return e.select(F.format_string("sensor-%d-%s.pcap", F.col("user_id") % 2, name).alias("capture"),
                    F.col("event_id").alias("packet_no"), states.epoch_seconds(F.col("ts")).cast("double").alias("ts"),
                    F.when(link < 2, 1).when(link == 2, 113).otherwise(101).alias("linktype"),
                    F.unhex(F.concat(header, ip)).alias("frame"))


@query
def capture_scan(spark, sf):
    """Frames written as captures and read back in ranges of 16 KiB."""
    import uuid

    from netstate.sources.captures import read_captures, write_captures
    folder = f"{shared_folder(spark)}/captures-{uuid.uuid4().hex}"
    written = write_captures(_frames(spark, sf), folder).agg(F.sum("packets").alias("written"))
    total = written.first()[0] or 0
    rows = packets.decode(read_captures(spark, folder, range_bytes=16 << 10))
    return rows.groupBy("capture", "proto", "src", "dport").agg(
        F.count("*").alias("packets"), F.sum("packet_no").alias("numbers"), F.max("ts").alias("last"),
        F.sum("payload").alias("payload"), F.sum("flags").alias("flags"), F.sum("win").alias("win"),
        F.sum("ttl").alias("ttl"), F.sum("seq").alias("seq")).withColumn("written", F.lit(total))


@query
def packet_idle_flows(spark, sf):
    return tidy(packets.packet_flows(_packets(spark, sf), idle=1800.0, active=1e9))


@query
def packet_flows(spark, sf):
    """Conversations cut by silence and by length: some thirty flows in a session."""
    return tidy(packets.packet_flows(_packets(spark, sf), idle=21600.0, active=86400.0))


# ------------------------------------------------------------------------------------------------ splits
@query
def split_labels(spark, sf):
    return sequences.with_split(regular(spark, sf), T3600).select(*KEYS, "pos", "split")


@query
def split_by_day(spark, sf):
    o = T3600.having(split_strategy="day_chronological")
    return sequences.with_split(regular(spark, sf), o).select(*KEYS, "pos", "split")


@query
def split_by_time(spark, sf):
    o = T3600.having(split_strategy="chronological")
    return sequences.with_split(regular(spark, sf), o).select(*KEYS, "pos", "split")


@query
def split_summary(spark, sf):
    return sequences.split_summary(regular(spark, sf), T3600)


@query
def split_totals(spark, sf):
    return sequences.split_totals(regular(spark, sf), T3600)


@query
def sample_ends(spark, sf):
    rows = sequences.with_samples(regular(spark, sf), T3600).where("is_sample")
    return rows.select(*KEYS, "pos", "split")


@query
def inference_ends(spark, sf):
    return regular(spark, sf, G300).where(sequences.has_history(G300)).groupBy(*KEYS).agg(F.count("*").alias("ends"))


@query
def future_targets(spark, sf):
    rows = sequences.with_future(regular(spark, sf), T3600, forecast.CLOSED_FORM_STAGES).where(
        sequences.full_span(T3600))
    return rows.select(*KEYS, "pos", *[F.element_at("future_attack", k).alias(f"a{k}") for k in range(1, 7)],
                       *[F.element_at("future_stage", k).alias(f"s{k}") for k in range(1, 7)])


@query
def history_windows(spark, sf):
    rows = sequences.with_history(regular(spark, sf).select(*KEYS, "pos", "flow_count"), "flow_count", T3600)
    rows = rows.where("pos >= 11")
    return rows.select(*KEYS, "pos", F.element_at("history", 1).alias("oldest"),
                       F.element_at("history", -1).alias("newest"), F.size("history").alias("length"),
                       F.aggregate("history", F.lit(0.0), lambda a, b: a + b).alias("total"))


@query
def flat_sequences(spark, sf):
    """Flattened scaled histories, summed up per origin."""
    z = scaler(spark, sf).with_vector(sequences.with_samples(regular(spark, sf), T3600)).select(*KEYS, "pos", "z")
    flat = sequences.flat_history(z, "z", T3600).where("pos >= 11")
    return tidy(flat.select(*KEYS, "pos", F.size("flat").alias("length"),
                            F.aggregate("flat", F.lit(0.0), lambda a, b: a + b).alias("total")))


@query
def stage_vocabulary(spark, sf):
    return sequences.stage_vocabulary(regular(spark, sf), T3600)


@query
def stage_ids(spark, sf):
    sid = sequences.stage_id(forecast.CLOSED_FORM_STAGES)
    return regular(spark, sf).groupBy(sid.alias("id"), "stage").agg(F.count("*").alias("windows"))


@query
def new_stages(spark, sf):
    return sequences.new_stages(regular(spark, sf), forecast.CLOSED_FORM_STAGES, T3600)


@query
def samples_by_next_stage(spark, sf):
    return sequences.samples_by_next_stage(regular(spark, sf), T3600)


@query
def holdout_blocks(spark, sf):
    blocks = sequences.holdout_blocks(regular(spark, sf), T3600)
    return blocks.withColumn("stages", F.array_join("stages", ", "))


@query
def holdout_selection(spark, sf):
    return sequences.holdout_selection(regular(spark, sf), T3600, 3).groupBy("source", "segment").agg(
        F.count("*").alias("windows"), F.min("timestamp").alias("start"),
        F.count_if("is_attack").alias("attack_windows"))


@query
def attack_bands(spark, sf):
    return sequences.attack_bands(regular(spark, sf), T3600)


# ----------------------------------------------------------------------------------------------- scaling
@query
def scaler_params(spark, sf):
    train = sequences.with_split(regular(spark, sf), T3600).where("split = 'train'")
    return tidy(scaling.scaler_params(train, T3600))


@query
def scaled_states(spark, sf):
    return tidy(scaler(spark, sf).transform(regular(spark, sf)).select(*KEYS, "pos", *feature_names(T3600)))


@query
def unscaled_states(spark, sf):
    s = scaler(spark, sf)
    return tidy(s.inverse(s.transform(regular(spark, sf))).select(*KEYS, "pos", *feature_names(T3600)), NUDGE)


@query
def feature_report(spark, sf):
    return scaling.feature_report(regular(spark, sf), scaler(spark, sf), T3600, ["source"])


# ---------------------------------------------------------------------------------------------- forecast
@query
def forecast_scores(spark, sf):
    rows = scorer(spark, sf).score(regular(spark, sf))
    return tidy(rows.select(*KEYS, "pos", *[F.element_at("attack_prob", k).alias(f"p{k}") for k in range(1, 7)],
                            *[F.element_at(F.element_at("stage_prob", 1), k).alias(f"d{k}") for k in range(1, 5)]))


@query
def timeline(spark, sf):
    return tidy(forecast.timeline(regular(spark, sf), scorer(spark, sf), THRESHOLD, T3600))


@query
def timeline_rethreshold(spark, sf):
    again = forecast.decoded(scored(spark, sf), forecast.CLOSED_FORM_STAGES, 0.8)
    return again.groupBy("headline_stage").agg(F.count("*").alias("windows"))


@query
def forecast_long(spark, sf):
    return tidy(forecast.forecast_rows(regular(spark, sf), scorer(spark, sf), THRESHOLD, T3600))


@query
def forecast_table(spark, sf):
    return tidy(forecast.forecast_table(regular(spark, sf), scorer(spark, sf), THRESHOLD, T3600))


@query
def forecast_span(spark, sf):
    rows = forecast.forecast_rows(regular(spark, sf), scorer(spark, sf), THRESHOLD, T3600)
    return forecast.forecast_span(rows)


@query
def expected_now(spark, sf):
    return tidy(forecast.expected_now(scored(spark, sf), scorer(spark, sf), THRESHOLD, T3600))


@query
def risk_levels(spark, sf):
    level = level_of(F.col("risk"), THRESHOLD, T3600)
    return scored(spark, sf).groupBy(level.alias("level"), display_level(level).alias("state"),
                                     incident_level(level).alias("severity")).agg(F.count("*").alias("windows"))


@query
def state_persistence(spark, sf):
    return tidy(forecast.state_persistence_error(regular(spark, sf), scaler(spark, sf), T3600))


# ------------------------------------------------------------------------------------------------ alerts
@query
def alert_log(spark, sf):
    rows = al.alerts(scored(spark, sf), THRESHOLD, T3600)
    return tidy(rows.select(*KEYS, "id", "stage", "severity", "peak_severity", "opened_pos", "opened_time", "last_pos",
                            "peak_risk", "eta_seconds", "status", "n_windows",
                            F.array_join("stages", " > ").alias("stages"), "closed_pos", "closed_time",
                            "duration_windows"))


@query
def alert_events(spark, sf):
    return al.alert_events(raised(spark, sf))


@query
def alert_table(spark, sf):
    return tidy(al.alert_table(raised(spark, sf), scored(spark, sf), THRESHOLD, T3600))


@query
def alert_open_at(spark, sf):
    return tidy(al.open_at(raised(spark, sf), scored(spark, sf), T3600))


@query
def alert_reason(spark, sf):
    table = al.alert_table(raised(spark, sf), scored(spark, sf), THRESHOLD, T3600)
    return al.alert_reason(table, THRESHOLD, T3600).select("source", "n", "reason")


@query
def risk_text(spark, sf):
    rows = forecast.forecast_rows(regular(spark, sf), scorer(spark, sf), THRESHOLD, T3600)
    return al.risk_text(rows, THRESHOLD, T3600)


@query
def replay_history(spark, sf):
    return tidy(al.replay_history(scored(spark, sf)))


# ---------------------------------------------------------------------------------------------- incidents
@query
def incident_table(spark, sf):
    return tidy(found_incidents(spark, sf))


@query
def incident_summary(spark, sf):
    return tidy(incidents.incident_summary(found_incidents(spark, sf), scored(spark, sf), regular(spark, sf),
                                           THRESHOLD, T3600))


def _stored(spark, sf) -> DataFrame:
    """The incidents of one sensor stored earlier, some of them triaged."""
    rows = incidents.new_incident_table(found_incidents(spark, sf)).where("source = 'sensor-0'")
    done = F.hour("opened_time") % 2 == 0
    return rows.withColumns({"status": F.when(done, "Resolved").otherwise("New"),
                             "note": F.when(done, "done").otherwise(""), "peak_risk": F.lit(0.0)})


@query
def incident_upsert(spark, sf):
    return tidy(incidents.upsert_incidents(_stored(spark, sf), found_incidents(spark, sf)))


@query
def incident_list(spark, sf):
    rows = incidents.upsert_incidents(_stored(spark, sf), found_incidents(spark, sf))
    return tidy(incidents.list_incidents(rows, statuses=["New", "Investigating"], severities=["Critical"]))


@query
def incident_queue(spark, sf):
    return incidents.queue_counts(incidents.upsert_incidents(_stored(spark, sf), found_incidents(spark, sf)))


def _triage(spark, sf) -> DataFrame:
    inc = found_incidents(spark, sf)
    first = inc.select("id", F.lit("Investigating").alias("status"), F.lit("look").alias("note"),
                       F.col("opened_time").alias("ts"), F.lit(1).cast("long").alias("seq"))
    second = inc.where("confirmed = 0").select("id", F.lit("False positive").alias("status"),
                                               F.lit("no attack").alias("note"), F.col("opened_time").alias("ts"),
                                               F.lit(2).cast("long").alias("seq"))
    return first.unionByName(second)


@query
def incident_triage(spark, sf):
    table = incidents.with_triage(incidents.new_incident_table(found_incidents(spark, sf)), _triage(spark, sf))
    return table.select("id", "status", "note")


@query
def audit_tail(spark, sf):
    return incidents.audit_tail(incidents.audit_rows(_triage(spark, sf)), 25)


# ------------------------------------------------------------------------------------------------- metrics
@query
def binary_metrics(spark, sf):
    s = metrics.step_scores(samples(spark, sf))
    return tidy(metrics.with_ranking(metrics.binary_metrics(s, THRESHOLD), s))


@query
def metrics_per_horizon(spark, sf):
    s = metrics.step_scores(samples(spark, sf))
    return tidy(metrics.with_ranking(metrics.binary_metrics(s, THRESHOLD, ["step"]), s, ["step"]))


@query
def onset_metrics(spark, sf):
    s = metrics.onset_scores(samples(spark, sf))
    return tidy(metrics.with_ranking(metrics.binary_metrics(s, THRESHOLD), s))


@query
def persistence_oracle(spark, sf):
    rows = evaluation.scored_samples(regular(spark, sf), forecast.PersistenceScorer(T3600), 0.5, T3600)
    s = metrics.step_scores(rows)
    return tidy(metrics.with_ranking(metrics.binary_metrics(s, 0.5), s))


@query
def stage_confusion(spark, sf):
    return metrics.stage_confusion(metrics.stage_pairs(samples(spark, sf)), forecast.CLOSED_FORM_STAGES)


@query
def stage_report(spark, sf):
    return tidy(metrics.stage_report(metrics.stage_pairs(samples(spark, sf)), forecast.CLOSED_FORM_STAGES))


@query
def stage_support(spark, sf):
    """With a stage that never occurs and is never forecast."""
    return metrics.stage_support(metrics.stage_pairs(samples(spark, sf)), [*forecast.CLOSED_FORM_STAGES, "Exfiltration"])


@query
def stage_metrics(spark, sf):
    return tidy(metrics.stage_metrics(metrics.stage_pairs(samples(spark, sf)), forecast.CLOSED_FORM_STAGES))


def _onsets(spark, sf, split="val") -> DataFrame:
    return metrics.onset_scores(samples(spark, sf, split))


@query
def threshold_table(spark, sf):
    return tidy(metrics.threshold_table(_onsets(spark, sf, "train")))


@query
def threshold_choice(spark, sf):
    return tidy(metrics.choose_threshold(_onsets(spark, sf), T3600.target_fpr, T3600.fallback_threshold))


@query
def threshold_presets(spark, sf):
    return tidy(metrics.threshold_presets(_onsets(spark, sf), THRESHOLD))


@query
def risk_quantiles(spark, sf):
    return tidy(chunks.quantiles(scored(spark, sf), ["source"], "risk", [0.0, 0.1, 0.5, 0.9, 0.99, 1.0]))


@query
def episodes(spark, sf):
    return metrics.episodes(regular(spark, sf), T3600)


def _lead(spark, sf) -> dict[str, DataFrame]:
    return metrics.lead_time(scored(spark, sf), regular(spark, sf), THRESHOLD, T3600, found=raised(spark, sf))


@query
def lead_time_episodes(spark, sf):
    return _lead(spark, sf)["episodes"]


@query
def lead_time_summary(spark, sf):
    return tidy(_lead(spark, sf)["summary"])


@query
def false_alerts(spark, sf):
    found = metrics.episodes(regular(spark, sf), T3600)
    return metrics.false_alerts(found, raised(spark, sf), T3600).select(*KEYS, "id", "opened_pos")


def _outcomes(spark, sf) -> DataFrame:
    future = sequences.with_future_values(
        regular(spark, sf).select(*KEYS, "pos", F.struct("is_attack", "stage").alias("_s")), "_s", T3600)
    rows = scored(spark, sf).where(sequences.full_span(T3600))
    return metrics.window_outcomes(rows.join(future.select(*KEYS, "pos", "future"), [*KEYS, "pos"]), THRESHOLD)


@query
def window_outcomes(spark, sf):
    return tidy(_outcomes(spark, sf))


@query
def wrong_outcomes(spark, sf):
    return metrics.only_incorrect(_outcomes(spark, sf)).groupBy("predicted_stage", "actual_stage").agg(
        F.count("*").alias("windows"))


def _parts(rows: dict[str, DataFrame]) -> DataFrame:
    return tidy(reduce(DataFrame.unionByName, [r.select(F.lit(k).alias("part"), "*") for k, r in rows.items()]))


@query
def file_validation(spark, sf):
    """All windows of a file against its own labels: steps and onsets at a threshold so high that ratios can be undefined."""
    out = evaluation.validate_file(regular(spark, sf), scorer(spark, sf), 0.99, T3600)
    return _parts({k: out[k] for k in ("forecast", "onset")})


@query
def holdout_report(spark, sf):
    """Steps together, each step, and onsets of the hold-out split."""
    out = evaluation.evaluate(regular(spark, sf), scorer(spark, sf), scaler(spark, sf), THRESHOLD, T3600)
    steps = out["per_horizon"].withColumn("part", F.format_string("step %d", "step")).drop("step")
    return _parts({k: out[k] for k in ("forecast", "onset")}).unionByName(tidy(steps))


@query
def holdout_evaluation(spark, sf):
    """Lead time on the hold-out split only, where alerts run over samples with holes in between."""
    out = evaluation.evaluate(regular(spark, sf), scorer(spark, sf), scaler(spark, sf), THRESHOLD, T3600)
    return tidy(out["lead_time"])


# --------------------------------------------------------------------------------------------------- drift
def _drift(spark, sf) -> DataFrame:
    s = scaler(spark, sf)
    active = [n for n, a in zip(s.names, s.active) if a]
    split = sequences.with_split(regular(spark, sf), T3600)
    part = {k: drift.long_values(split.where(F.col("split") == k), active, lambda n: F.round(s.scaled(n), 9))
            for k in ("train", "test")}
    return drift.drift_table(part["train"], part["test"])


@query
def drift_psi(spark, sf):
    return tidy(_drift(spark, sf))


@query
def drift_overall(spark, sf):
    return tidy(drift.drift_overall(_drift(spark, sf)))


@query
def drift_against_background(spark, sf):
    s = scaler(spark, sf)
    active = [n for n, a in zip(s.names, s.active) if a]
    train = sequences.with_split(regular(spark, sf), T3600).where("split = 'train'")
    old, new = (drift.long_values(t, active, lambda n: F.round(s.scaled(n), 9)) for t in (train, regular(spark, sf)))
    return tidy(drift.drift_table(old, new))


# ------------------------------------------------------------------------------------------------- explain
def _origins(spark, sf) -> DataFrame:
    """Every scored window as an origin."""
    rows = scored(spark, sf).select(*KEYS, "pos", "attack_prob")
    return explain.histories(regular(spark, sf), rows, scaler(spark, sf), T3600)


@query
def attributions(spark, sf):
    top = explain.attributions(_origins(spark, sf), scaler(spark, sf), explain.closed_form_weights(scorer(spark, sf)), 2)
    return tidy(top)


@query
def attribution_by_window(spark, sf):
    w = explain.closed_form_weights(scorer(spark, sf))
    return tidy(explain.window_shares(_origins(spark, sf), w).groupBy("offset").agg(F.avg("share").alias("share")))


@query
def linear_shap(spark, sf):
    s = scaler(spark, sf)
    centre = explain.train_mean(regular(spark, sf), s, T3600)
    top = explain.linear_shap(_origins(spark, sf), s, explain.closed_form_weights(scorer(spark, sf)), centre, 1, 2)
    return tidy(top)


@query
def incident_drivers(spark, sf):
    w = explain.closed_form_weights(scorer(spark, sf))
    drivers = explain.incident_drivers(found_incidents(spark, sf), scored(spark, sf), regular(spark, sf),
                                       scaler(spark, sf), w, T3600, 2)
    return tidy(drivers)


@query
def traffic_evidence(spark, sf):
    return tidy(explain.traffic_evidence(regular(spark, sf), ["flow_count", "syn_ratio", "scan_score"], T3600))


@query
def feature_labels(spark, sf):
    used = scaling.scaler_params(regular(spark, sf), T3600).where("active").select("feature")
    return know.with_feature_labels(used, T3600)


@query
def stage_playbooks(spark, sf):
    rows = views.label_mix(regular(spark, sf)).withColumnRenamed("label", "stage")
    return know.with_playbook(rows).select("stage", "windows", "tactic_id", F.size("actions").alias("actions"))


@query
def stage_tactics(spark, sf):
    rows = regular(spark, sf).where("is_attack").groupBy("stage").agg(F.count("*").alias("windows"))
    return know.with_tactic(rows).select("stage", "windows", "tactic_id", "url",
                                         F.array_join("dataset_labels", ", ").alias("dataset_labels"))


# ------------------------------------------------------------------------------------------------ scenarios
@query
def scenario_summary(spark, sf):
    scores = scenarios.scenario_scores(regular(spark, sf), scorer(spark, sf))
    return tidy(scenarios.scenario_summary(scores, THRESHOLD))


@query
def scenario_by_origin(spark, sf):
    scores = scenarios.scenario_scores(regular(spark, sf), scorer(spark, sf))
    return tidy(scenarios.scenario_by_origin(scores, THRESHOLD))


# --------------------------------------------------------------------------------------------------- views
@query
def traffic_stats(spark, sf):
    return tidy(views.traffic_stats(regular(spark, sf, G300), G300))


@query
def protocol_mix(spark, sf):
    return tidy(views.protocol_mix(regular(spark, sf)))


@query
def port_mix(spark, sf):
    return tidy(views.port_mix(regular(spark, sf), T3600))


@query
def label_mix(spark, sf):
    return views.label_mix(regular(spark, sf))


@query
def traffic_totals(spark, sf):
    return tidy(views.traffic_totals(regular(spark, sf, G600)))


@query
def top_ports_over_time(spark, sf):
    return tidy(views.top_ports_over_time(regular(spark, sf), T3600))


@query
def top_ports_of_windows(spark, sf):
    return tidy(views.top_ports_of_windows(regular(spark, sf), T3600))


@query
def source_coverage(spark, sf):
    return tidy(views.source_coverage(regular(spark, sf, G300), G300))


@query
def stage_counts_by_source(spark, sf):
    return views.stage_counts_by_source(regular(spark, sf))


@query
def class_weights(spark, sf):
    return tidy(views.class_weights(samples(spark, sf, "train"), forecast.CLOSED_FORM_STAGES))


@query
def positive_weight(spark, sf):
    return tidy(views.positive_weight(samples(spark, sf, "train")))


@query
def alert_counts(spark, sf):
    return tidy(views.alert_counts(raised(spark, sf), al.alert_events(raised(spark, sf)), T3600))


@query
def escalations_per_alert(spark, sf):
    return views.escalations_per_alert(raised(spark, sf), al.alert_events(raised(spark, sf)))


@query
def current_windows(spark, sf):
    return tidy(views.current_windows(scored(spark, sf), THRESHOLD, T3600))


@query
def observed_history(spark, sf):
    first = scored(spark, sf).select(*KEYS, "pos", F.element_at("attack_prob", 1).alias("p1"))
    return tidy(views.observed_history(regular(spark, sf).join(first, [*KEYS, "pos"], "left"), T3600))


@query
def flagged_traffic(spark, sf):
    return tidy(views.flagged_traffic(scored(spark, sf), THRESHOLD, T3600))


@query
def system_overview(spark, sf):
    """One stored analysis per sensor."""
    analyses = scored(spark, sf).groupBy("source").agg(F.bool_or("is_attack").alias("labelled"))
    counted = raised(spark, sf).groupBy("source").agg(F.count("*").alias("alerts"))
    return views.system_overview(analyses.join(counted, "source", "left"))


# ------------------------------------------------------------------------------------------------- quality
@query
def traffic_checks(spark, sf):
    return quality.traffic_checks(regular(spark, sf), scaler(spark, sf), T3600)


@query
def order_violations(spark, sf):
    return quality.order_violations(regular(spark, sf, G300), G300)


@query
def sanity_checks(spark, sf):
    return tidy(quality.sanity_checks(regular(spark, sf), scored(spark, sf)))


@query
def stored_table_checks(spark, sf):
    """A stored state table with windows taken out, repeated and put in another place."""
    import uuid

    from netstate.sources import tables
    folder = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    table = regular(spark, sf, G300).drop("row", "source_rows", "seg_len")
    kept = table.where("pos % 50 <> 7")
    repeated = kept.union(table.where("pos % 40 = 5"))
    place = F.when(F.col("pos") % 30 == 11, F.col("timestamp") + F.expr("interval 1 hour")).otherwise(F.col("timestamp"))
    repeated.orderBy(place, "source", "segment", "pos").drop("pos").coalesce(1).write.parquet(folder)
    return quality.stored_table_checks(tables.read_states(spark, folder, G300), G300)


@query
def stored_table_positions(spark, sf):
    """Positions count the rows of a stored table, so holes and repeats leave every row its place."""
    table = regular(spark, sf, G300)
    spoilt = table.where("pos % 50 <> 7").union(table.where("pos % 40 = 5"))
    placed = grid.index_states(spoilt, G300)
    return placed.groupBy(*KEYS).agg(F.min("pos").alias("low"), F.max("pos").alias("high"), F.countDistinct("pos").alias("places"),
                                     F.max("seg_len").alias("seg_len"), F.min("row").alias("first_row"), F.max("row").alias("last_row"),
                                     F.max("source_rows").alias("source_rows"))


@query
def analysis_summary(spark, sf):
    """States -> forecasts -> alerts -> incidents -> summary in one call."""
    return tidy(analysis.run_analysis(regular(spark, sf), scorer(spark, sf), THRESHOLD, T3600).summary)


@query
def table_fingerprint(spark, sf):
    """Digests of the rows of four tables, whatever files hold them."""
    wanted = {"events": ("event_id", ["event_id", "user_id", "event_type", "props"]), "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
              "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]), "pages": ("page_id", ["page_id", "url", "html"])}
    parts = [quality.table_digest(spark.read.parquet(f"{sf}/{t}.parquet"), key, columns, 64, 16).select(F.lit(t).alias("table"), "rows", "digest")
             for t, (key, columns) in wanted.items()]
    return reduce(DataFrame.union, parts)


# ------------------------------------------------------------------- trained forecasters (iterative, no SQL form)
def linear_weight(step: int, kind: int, window: int, feature: int) -> float:
    """A coefficient that is a product of one number for each index."""
    return (step + 1) / 6 * (0.5 - 0.3 * kind) * 0.9 ** (11 - window) * ((feature * 7) % 11 - 5) / 40


@lru_cache(maxsize=16)
def _logistic(spark, sf) -> logistic.LogisticScorer:
    return logistic.LogisticScorer.fit(regular(spark, sf), scaler(spark, sf), forecast.CLOSED_FORM_STAGES, T3600)


@query
def logistic_timeline(spark, sf):
    return tidy(forecast.timeline(regular(spark, sf), _logistic(spark, sf), 0.5, T3600))


@query
def linear_scores(spark, sf):
    """Forecasts of a saved and loaded linear scorer whose coefficients follow a rule."""
    import uuid

    fitted, options = scaler(spark, sf), T3600
    rows = [(h, k, w, n, linear_weight(h, k, w, f)) for h in range(options.horizon) for k in range(3) for w in range(options.history)
            for f, n in enumerate(fitted.names)]
    rows += [(h, k, -1, None, 0.1 * h - 0.2 * k - 0.5) for h in range(options.horizon) for k in range(3)]
    table = spark.createDataFrame(rows, logistic.COEFFICIENTS)
    path = f"{shared_folder(spark)}/scorer-{uuid.uuid4().hex}"
    logistic.LogisticScorer.from_table(table, fitted, ["Benign", "Impact"], options).save(spark, path)
    found = logistic.LogisticScorer.load(spark, path, options).score(regular(spark, sf))
    return tidy(found.select(*KEYS, "pos", *[F.element_at("attack_prob", k).alias(f"p{k}") for k in range(1, 7)],
                             *[F.element_at(F.element_at("stage_prob", k), 2).alias(f"d{k}") for k in range(1, 7)]))


@query
def forecaster_comparison(spark, sf):
    return tidy(evaluation.compare_scorers(regular(spark, sf), {
        "closed form": (scorer(spark, sf), THRESHOLD), "logistic": (_logistic(spark, sf), 0.5),
        "persistence": (forecast.PersistenceScorer(T3600), 0.5)}, T3600))


@query
def background_sample(spark, sf):
    return background(spark, sf).select(*KEYS, "pos", F.size("history").alias("windows"))


@query
def retrained_comparison(spark, sf):
    """Learn from one sensor with replayed samples of the other one."""
    table = regular(spark, sf)
    out = evaluation.retrain(table.where("source = 'sensor-1'"), table.where("source = 'sensor-0'"), scorer(spark, sf),
                             scaler(spark, sf), THRESHOLD, T3600)
    return tidy(out["report"])


# ------------------------------------------------------------------------------------------------ streaming
def _stream_folder(spark) -> str:
    import uuid
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _as_files(table: DataFrame, time: str, folder: str, newest_first: bool = False, n: int = 3) -> None:
    """``table`` as ``n`` files of equal spans of time in ``folder``, written one after the other."""
    low, high = table.agg(F.min(time), F.max(time)).first()
    for i in reversed(range(n)) if newest_first else range(n):
        share = F.least(F.floor((F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp")))
                                * n / (F.unix_micros(F.lit(high).cast("timestamp"))
                                       - F.unix_micros(F.lit(low).cast("timestamp")) + 1)), F.lit(n - 1))
        table.where(share == i).coalesce(1).write.mode("append").parquet(folder)


def _backwards(spark, table: DataFrame, time: str, folder: str) -> DataFrame:
    """``table`` as a stream of one file a micro-batch, the newest first, and a closing mark at the end."""
    from datetime import timedelta

    from netstate.streaming import states as st
    _as_files(table, time, folder, newest_first=True)
    st.closing_file(spark, folder, table.schema, time, table.agg(F.max(time)).first()[0] + timedelta(days=3000))
    return st.replay_files(spark, folder, table.schema)


#: Longer than the events last: windows may come in any order.
ANY_ORDER = "400 days"


@query
def stream_window_states(spark, sf):
    """Window states of a stream over the events, whose files come newest first."""
    from netstate.streaming import states as st
    st.use_rocksdb(spark)
    folder = _stream_folder(spark)
    events = _backwards(spark, spark.read.parquet(f"{sf}/events.parquet"), "ts", f"{folder}/in")
    return tidy(st.run_to_table(st.stream_window_states(flows_of_events(events), T3600, ANY_ORDER), folder), NUDGE)


@query
def stream_packet_flows(spark, sf):
    """Flows of a stream of packets by both timeouts, the newest file first."""
    from netstate.streaming import states as st
    st.use_rocksdb(spark)
    folder = _stream_folder(spark)
    table = materialize(packets.decode(_packets(spark, sf)), "packets")
    _as_files(table, "ts", f"{folder}/in", newest_first=True)
    st.closing_file(spark, f"{folder}/in", table.schema, "ts", table.agg(F.max("ts")).first()[0] + 3000 * 86400.0)
    stream = st.replay_files(spark, f"{folder}/in", table.schema)
    rows = st.run_to_table(st.stream_packet_flows(stream, 21600.0, 86400.0, ANY_ORDER), folder)
    return rows.select("capture", "proto", F.when(F.col("low").startswith("192."), F.col("high")).otherwise(F.col("low")).alias("client"),
                       "first_packet", "first_ts", "last_ts", "packets", "bytes")


def _streamed_grid(spark, sf, folder: str) -> DataFrame:
    """Window states, newest file first -> pruned regular states of a streaming grid."""
    from netstate.streaming import states as st
    st.use_rocksdb(spark)
    table = materialize(states.window_states(event_flows(spark, sf), T3600), "window-states")
    stream = st.stream_grid(_backwards(spark, table, "timestamp", f"{folder}/in"), T3600, ["flow_count"], ANY_ORDER,
                            T3600.min_segment)
    return st.run_to_table(stream, f"{folder}/grid")


@query
def stream_regular_states(spark, sf):
    """The streaming grid of windows in any order; nothing is late."""
    rows = _streamed_grid(spark, sf, _stream_folder(spark))
    return tidy(rows.drop("history", "pruned"), NUDGE)


@query
def stream_alert_events(spark, sf):
    """Window states -> streaming grid -> forecast -> streaming alerts, a third of the windows in each micro-batch."""
    from netstate.streaming import states as st
    from netstate.streaming.alerts import stream_alerts
    folder = _stream_folder(spark)
    rows = _streamed_grid(spark, sf, folder)
    _as_files(rows, "timestamp", f"{folder}/ordered")
    scored_rows = st.stream_scores(st.replay_files(spark, f"{folder}/ordered", rows.schema), scorer(spark, sf), THRESHOLD)
    events = st.run_to_table(stream_alerts(scored_rows, THRESHOLD, T3600), f"{folder}/alerts")
    return events.select(*KEYS, "alert_id", "type", "pos", "time", "severity", "stage")

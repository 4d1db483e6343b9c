"""The same queries in plain SQL (DuckDB dialect), built from shared WITH chains."""
from __future__ import annotations

from netstate.config import EXACT_LABELS, SCENARIO_RATIOS, SCENARIOS, STAGE_ORDER, TACTIC_IDS, Options
from netstate.functions.knowledge import FEATURE_LABELS, PLAYBOOKS, PORT_SERVICES
from netstate.functions.levels import DISPLAY_LEVELS, INCIDENT_LEVELS
from netstate.operators.forecast import CLOSED_FORM_STAGES
from netstate.operators.metrics import GRID, RANKS
from netstate.schema import BASE_FEATURES, LOG_FEATURES, OPTIONAL_FEATURES, feature_names, port_features

O = Options()
FEATURES, PORTS = feature_names(O), port_features(O)
THR, CRIT, WATCH, CLEAR = 0.6, 0.6 + 0.5 * (1 - 0.6), 0.7 * 0.6, 0.8 * 0.6
ORACLES: dict[str, str] = {}


def text(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# ------------------------------------------------------------------------------------------------- flows
FLOWS = """
b AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 2 AS sensor,
             CAST(floor(epoch(ts) / 3600) AS BIGINT) AS h FROM events),
c AS (SELECT *, (h + 11 * sensor) % 37 AS ph, ((h + 11 * sensor) // 37) % 6 AS camp FROM b),
raw AS (
  SELECT 'sensor-' || sensor AS source, ts AS timestamp,
    CAST(CASE WHEN k < 68 THEN [20,21,22,23,25,53,80,110,123,135,139,143,443,445,3389,8080,8443][k % 17 + 1]
              ELSE 1000 + k * 7 END AS DOUBLE) AS dst_port,
    CAST(CASE WHEN k = 99 THEN 47 WHEN event_type = 'signup' THEN 17
              WHEN event_type = 'error' AND k % 10 = 0 THEN 1 ELSE 6 END AS DOUBLE) AS protocol,
    value / 10 AS dur, CAST(1 + k % 6 AS DOUBLE) AS fp,
    CAST(CASE WHEN event_type = 'error' THEN 0 ELSE k % 5 END AS DOUBLE) AS bp,
    round(value * 10) AS fb, round(value * (k % 5) * 4) AS bb,
    value / 100 AS iatm, value / 200 AS iats, value / 20 AS iatx,
    CASE WHEN k <> 99 AND event_type <> 'signup' AND NOT (event_type = 'error' AND k % 10 = 0)
         THEN CAST(8192 + 512 * (k % 8) AS DOUBLE) END AS win,
    CASE WHEN sensor = 0 THEN CAST(32 + 32 * (k % 3) AS DOUBLE) END AS ttl,
    CASE WHEN sensor = 0 THEN CAST(CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END AS DOUBLE) END AS retr,
    value * 2 AS plm, value / 2 AS pls,
    CAST(CASE WHEN event_type IN ('click', 'view', 'error') THEN 1 ELSE 0 END AS DOUBLE) AS syn,
    CAST(k % 4 AS DOUBLE) AS ack, CAST(CASE WHEN k % 9 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS rst,
    CAST(k % 2 AS DOUBLE) AS fin, CAST(k % 3 AS DOUBLE) AS psh, CAST(0 AS DOUBLE) AS urg,
    '10.0.' || (user_id // 250) || '.' || (user_id % 250) AS src_ip,
    '192.168.1.' || (k % 20) AS dst_ip, CAST(1024 + event_id % 50000 AS DOUBLE) AS src_port,
    CASE WHEN ph < 5 AND event_type <> 'click'
         THEN ['SSH-Bruteforce','DoS attacks-Hulk','Infilteration','Bot','SQL Injection','Totally New Attack'][camp + 1]
         ELSE 'Benign' END AS raw_label
  FROM c),
f AS (SELECT *, CASE raw_label WHEN 'SSH-Bruteforce' THEN 'Credential Access' WHEN 'DoS attacks-Hulk' THEN 'Impact'
             WHEN 'Infilteration' THEN 'Lateral Movement' WHEN 'Bot' THEN 'Command and Control'
             WHEN 'SQL Injection' THEN 'Initial Access' WHEN 'Totally New Attack' THEN 'Initial Access'
             ELSE 'Benign' END AS stage, greatest(dur, 1e-3) AS sec FROM raw)"""


def bucket(seconds: int, col: str = "timestamp") -> str:
    return f"make_timestamp(CAST(floor(epoch({col}) / {seconds}) AS BIGINT) * {seconds * 1_000_000})"


def window_states(seconds: int) -> str:
    ports = ", ".join(f"avg(CAST(dst_port = {p} AS INT)) AS dst_port_{p}" for p in O.port_buckets)
    known = ", ".join(str(p) for p in O.port_buckets)
    flags = ", ".join(f"sum({x}) AS {x}_count" for x in ("syn", "ack", "rst", "fin", "psh", "urg"))
    order = text(STAGE_ORDER)
    return FLOWS + f""",
w AS (SELECT *, {bucket(seconds)} AS t FROM f),
a AS (SELECT source, t, CAST(count(*) AS DOUBLE) AS flow_count,
    CAST(count(DISTINCT src_ip) AS DOUBLE) AS unique_src_ips, CAST(count(DISTINCT dst_ip) AS DOUBLE) AS unique_dst_ips,
    CAST(count(DISTINCT src_port) AS DOUBLE) AS unique_src_ports,
    CAST(count(DISTINCT dst_port) AS DOUBLE) AS unique_dst_ports, sum(fp + bp) AS packets_total,
    sum(fb + bb) AS bytes_total, avg(least((fp + bp) / sec, 1e6)) AS pkt_rate_mean,
    avg(least((fb + bb) / sec, 1e6)) AS byte_rate_mean, avg(dur) AS duration_mean,
    sqrt(greatest(avg(dur * dur) - avg(dur) * avg(dur), 0)) AS duration_std, avg(iatm) AS iat_mean,
    avg(iats) AS iat_std, max(iatx) AS iat_max, coalesce(avg(ttl), 0) AS ttl_mean,
    coalesce(greatest(avg(ttl * ttl) - avg(ttl) * avg(ttl), 0), 0) AS ttl_var, coalesce(avg(win), 0) AS tcp_window_mean,
    coalesce(greatest(avg(win * win) - avg(win) * avg(win), 0), 0) AS tcp_window_var, avg(plm) AS pkt_len_mean,
    avg(pls) AS pkt_len_std, avg(fb + bb) AS payload_mean,
    sqrt(greatest(avg((fb + bb) * (fb + bb)) - avg(fb + bb) * avg(fb + bb), 0)) AS payload_std,
    coalesce(sum(retr), 0) AS retransmissions, {flags}, avg(syn) AS syn_ratio, avg(rst) AS rst_ratio,
    CASE WHEN sum(fb) > 0 THEN sum(bb) / sum(fb) ELSE 0 END AS inbound_outbound_byte_ratio,
    CASE WHEN sum(fp) > 0 THEN sum(bp) / sum(fp) ELSE 0 END AS inbound_outbound_packet_ratio,
    count(DISTINCT (src_ip, dst_ip)) / CAST(count(DISTINCT src_ip) AS DOUBLE) AS distinct_dst_per_src_mean,
    avg(CAST(bp = 0 AS INT)) AS failed_flow_ratio, avg(CAST(fp + bp <= 3 AS INT)) AS small_flow_ratio,
    least(count(DISTINCT dst_port) / (count(*) + 10.0) * (0.5 + 0.5 * avg(CAST(bp = 0 AS INT)))
          * avg(CAST(fp + bp <= 3 AS INT)) * 2, 1) AS scan_score,
    avg(CAST(dst_port IN ({known}) AS INT)) AS well_known_dst_port_ratio,
    avg(CAST(protocol = 6 AS INT)) AS protocol_tcp, avg(CAST(protocol = 17 AS INT)) AS protocol_udp,
    avg(CAST(protocol = 1 AS INT)) AS protocol_icmp,
    avg(CAST(protocol NOT IN (1, 6, 17) AS INT)) AS protocol_other, {ports},
    avg(CAST(dst_port NOT IN ({known}) AS INT)) AS dst_port_other,
    CAST(count(*) FILTER (stage <> 'Benign') AS DOUBLE) AS attack_flows FROM w GROUP BY 1, 2),
m AS (SELECT source, t, stage AS top FROM (SELECT source, t, stage, count(*) AS n FROM w WHERE stage <> 'Benign' GROUP BY 1, 2, 3)
      QUALIFY row_number() OVER (PARTITION BY source, t ORDER BY n DESC, list_position({order}, stage)) = 1),
ws AS (SELECT a.*, attack_flows / flow_count AS attack_fraction,
              attack_flows >= 3 AND attack_flows / flow_count >= 0.01 AS is_attack,
              CASE WHEN attack_flows >= 3 AND attack_flows / flow_count >= 0.01 THEN top ELSE 'Benign' END AS stage
       FROM a LEFT JOIN m USING (source, t))"""


def regular(seconds: int, least: int = 1) -> str:
    zero = ", ".join(f"coalesce({x}, 0) AS {x}" for x in [*FEATURES, "attack_flows", "attack_fraction"])
    return window_states(seconds) + f""",
n AS (SELECT *, CAST(epoch(t) / {seconds} AS BIGINT) AS wn FROM ws),
sg AS (SELECT source, wn, sum(CASE WHEN d IS NULL OR d > 7 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY wn) AS g
       FROM (SELECT source, wn, wn - lag(wn) OVER (PARTITION BY source ORDER BY wn) AS d FROM n)),
sp AS (SELECT source, lo, hi, CAST(dense_rank() OVER (PARTITION BY source ORDER BY lo) - 1 AS INT) AS segment FROM
        (SELECT source, g, min(wn) AS lo, max(wn) AS hi FROM sg GROUP BY 1, 2) WHERE hi - lo + 1 >= {least}),
gr AS (SELECT source, segment, lo, hi - lo + 1 AS seg_len, unnest(range(lo, hi + 1)) AS wn FROM sp),
st AS (SELECT make_timestamp(wn * {seconds * 1_000_000}) AS timestamp, {zero}, coalesce(stage, 'Benign') AS stage,
              coalesce(is_attack, false) AS is_attack, source, t IS NULL AS filled, segment, wn - lo AS pos, seg_len,
              row_number() OVER (PARTITION BY source ORDER BY wn) - 1 AS rn, count(*) OVER (PARTITION BY source) AS rows
       FROM gr LEFT JOIN n USING (source, wn))"""


REG = regular(3600, 19)


def add(name: str, with_: str, body: str) -> None:
    ORACLES[name] = f"WITH RECURSIVE {with_}\n{body}"


VALUES = ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in [*FEATURES, "attack_flows", "attack_fraction"])
STATE_OUT = f"t AS timestamp, {VALUES}, stage, is_attack, source"
add("window_states", window_states(3600), f"SELECT {STATE_OUT}, false AS filled FROM ws")
add("window_distincts", FLOWS, f"""SELECT source, {bucket(600)} AS timestamp, count(DISTINCT dst_port) AS unique_dst_ports,
 count(DISTINCT src_port) AS unique_src_ports, count(DISTINCT src_ip) AS unique_src_ips,
 count(DISTINCT dst_ip) AS unique_dst_ips, count(DISTINCT (src_ip, dst_ip)) AS pairs FROM f GROUP BY 1, 2""")
MEASURES = {
    "fwd_packets": "fp", "bwd_packets": "bp", "fwd_bytes": "fb", "bwd_bytes": "bb", "flow_duration": "dur", "iat_mean": "iatm",
    "iat_std": "iats", "iat_max": "iatx", "retransmissions": "retr", "pktlen_mean": "plm", "pktlen_std": "pls",
    **{x: x for x in ("syn", "ack", "rst", "fin", "psh", "urg", "ttl")}, "win_fwd": "win", "packets": "fp + bp", "payload": "fb + bb",
    "packet_rate": "least((fp + bp) / sec, 1e6)", "byte_rate": "least((fb + bb) / sec, 1e6)",
    "failed": "CAST(bp = 0 AS INT)", "small": "CAST(fp + bp <= 3 AS INT)", "well_known": f"CAST(dst_port IN {tuple(O.well_known_ports)} AS INT)",
    "tcp": "CAST(protocol = 6 AS INT)", "udp": "CAST(protocol = 17 AS INT)", "icmp": "CAST(protocol = 1 AS INT)",
    "other_protocol": "CAST(protocol NOT IN (1, 6, 17) AS INT)", **{f"port_{p}": f"CAST(dst_port = {p} AS INT)" for p in O.port_buckets},
    "port_other": f"CAST(dst_port NOT IN {tuple(O.port_buckets)} AS INT)"}
NEVER_NULL = {"retransmissions"}
add("flow_measures", FLOWS, "SELECT source, " + ", ".join(
    f"round(CAST(sum({f'coalesce({x}, 0)' if n in NEVER_NULL else x}) AS DOUBLE) + 1e-9, 6) AS {n}" for n, x in MEASURES.items()) + " FROM f GROUP BY 1")
add("label_stages", FLOWS, "SELECT raw_label, stage, count(*) AS flows FROM f GROUP BY 1, 2")
add("unmapped_label_report", FLOWS,
    "SELECT raw_label, count(*) AS flows FROM f WHERE raw_label = 'Totally New Attack' GROUP BY 1")
add("source_info", FLOWS, f"""SELECT source, count(*) AS flow_rows, count(DISTINCT {bucket(3600)}) AS windows,
 min({bucket(3600)}) AS start, max({bucket(3600)}) AS "end", bool_or(src_ip IS NOT NULL) AS has_ip,
 bool_or(src_port IS NOT NULL) AS has_src_port, bool_or(ttl IS NOT NULL) AS has_ttl,
 bool_or(retr IS NOT NULL) AS has_retransmissions FROM f GROUP BY 1""")
add("regular_states", regular(600), f"""SELECT timestamp, {VALUES}, stage, is_attack, source,
 filled, segment, pos FROM st""")
R300 = regular(300, 19)
add("segment_prune", R300, """SELECT source, segment, count(*) AS windows, min(timestamp) AS start, max(timestamp) AS "end",
 count(*) FILTER (filled) AS filled, max(rn) AS last_row FROM st GROUP BY 1, 2""")
add("segment_extremes", R300 + """, z AS (SELECT source, segment, count(*) AS windows FROM st GROUP BY 1, 2)""",
    """(SELECT *, 'shortest' AS "end" FROM z ORDER BY windows, source, segment LIMIT 10) UNION ALL
(SELECT *, 'longest' AS "end" FROM z ORDER BY windows DESC, source, segment LIMIT 5)""")
FLOW_SUMS = {"dst_port": "dst_port", "flow_duration": "dur", "fwd_packets": "fp", "bwd_packets": "bp", "fwd_bytes": "fb", "bwd_bytes": "bb",
             "iat_mean": "iatm", "iat_std": "iats", "iat_max": "iatx", "win_fwd": "win", "ttl": "ttl", "retransmissions": "retr",
             "pktlen_mean": "plm", "pktlen_std": "pls", **{x: x for x in ("syn", "ack", "rst", "fin", "psh", "urg", "src_port")}}
for name in ("csv_ingest", "csv_ingest_mixed"):
    add(name, FLOWS, "SELECT protocol, stage, raw_label, count(*) AS flows, " + ", ".join(
        f"round(sum({x}) + 1e-9, 6) AS {n}" for n, x in FLOW_SUMS.items()) + """, count(DISTINCT src_ip) AS sources,
 count(DISTINCT dst_ip) AS targets, min(date_trunc('second', timestamp)) AS first, max(date_trunc('second', timestamp)) AS last
 FROM f GROUP BY 1, 2, 3""")


def spoilt() -> str:
    """The flows with what is wrong with their lines; a header line counts before a time, that before a port."""
    return FLOWS + """,
sp AS (SELECT *, CASE WHEN round(dur * 1e6) % 13 = 0 THEN 'header' WHEN CAST(src_port AS BIGINT) % 97 = 0 THEN 'time'
   WHEN round(dur * 1e6) % 11 = 0 THEN 'port' END AS problem FROM f)"""


REJECTED = """count(*) AS rows, count(*) FILTER (problem IS NULL) AS flows, 0 AS too_many_fields,
 count(*) FILTER (problem = 'header') AS header_again, count(*) FILTER (problem = 'time') AS no_time, count(*) FILTER (problem = 'port') AS no_port"""
add("rejected_rows", spoilt(), f"SELECT {REJECTED} FROM sp")
add("ingest_report", spoilt() + f""",
w AS (SELECT DISTINCT CAST(floor(epoch(timestamp) / 3600) AS BIGINT) AS wn FROM sp WHERE problem IS NULL),
g AS (SELECT wn, sum(CASE WHEN d IS NULL OR d > 7 THEN 1 ELSE 0 END) OVER (ORDER BY wn) AS g FROM (SELECT wn, wn - lag(wn) OVER (ORDER BY wn) AS d FROM w)),
sg AS (SELECT g, count(*) AS n, max(wn) - min(wn) + 1 AS len FROM g GROUP BY 1),
rp AS (SELECT {REJECTED}, (SELECT sum(n) FROM sg) AS windows, (SELECT count(*) FROM sg) AS segments,
  (SELECT coalesce(sum(n), 0) FROM sg WHERE len < 19) AS windows_dropped, (SELECT count(*) FROM sg WHERE len < 19) AS segments_dropped,
  (SELECT coalesce(sum(len), 0) FROM sg WHERE len >= 19) AS states, (SELECT coalesce(sum(len - n), 0) FROM sg WHERE len >= 19) AS filled FROM sp)""",
    "SELECT measure, CAST(value AS BIGINT) AS value FROM (UNPIVOT (SELECT COLUMNS(*)::BIGINT FROM rp) ON COLUMNS(*) INTO NAME measure VALUE value)")
add("file_checks", FLOWS + ", fc AS (SELECT count(*) AS n FROM f)", """SELECT * FROM (SELECT 'good' AS folder, 'ok' AS status, NULL AS problem, n AS rows, n AS flows FROM fc
 UNION ALL SELECT 'untimed', 'fail', 'no usable record', n, 0 FROM fc
 UNION ALL SELECT 'portless', 'fail', 'missing fields: dst_port', NULL, NULL FROM fc
 UNION ALL SELECT 'other', 'fail', 'unsupported kind', NULL, NULL FROM fc)""")
ROLLED = ["flow_count", "packets_total", "bytes_total", "duration_std", "iat_max", "payload_std", "syn_count", "failed_flow_ratio", "dst_port_443"]
KINDS = ["unique_dst_ports", "unique_src_ports", "unique_src_ips", "unique_dst_ips"]
add("rolled_up_states", window_states(3600), "SELECT source, t AS timestamp, " + ", ".join(f"round({n} + 1e-9, 6) AS {n}" for n in ROLLED)
    + ", stage, is_attack, " + ", ".join(f"CAST({k} AS BIGINT) AS exact_{k}, true AS near_{k}" for k in KINDS) + " FROM ws")

# ----------------------------------------------------------------------------------------------- packets
PACKETS = """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 5 AS u FROM events),
pk AS (SELECT 'sensor-' || (user_id % 2) AS capture, event_id AS packet_no, floor(epoch(ts)) AS ts,
   CASE WHEN u = 4 THEN 17 ELSE 6 END AS proto, k % 3 <> 0 AS up, '10.0.0.' || (u + 1) AS client, 40000 + u AS cport,
   32 + k % 32 AS ttl, CASE WHEN u = 4 THEN 0 ELSE 8192 + k END AS win, CASE WHEN u = 4 THEN 0 ELSE k % 64 END AS flags,
   k AS payload, CASE WHEN u = 4 THEN 0 ELSE k % 10 END AS seq, CASE WHEN u = 4 THEN 28 ELSE 40 END + k AS ip_len FROM e)"""
add("packet_decode", PACKETS, """SELECT CAST(proto AS BIGINT) AS proto, CASE WHEN up THEN client ELSE '192.168.1.1' END AS src,
 CAST(CASE WHEN up THEN 443 ELSE cport END AS BIGINT) AS dport, count(*) AS packets, CAST(sum(payload) AS BIGINT) AS payload,
 CAST(sum(flags) AS BIGINT) AS flags, CAST(sum(win) AS BIGINT) AS win, CAST(sum(ttl) AS BIGINT) AS ttl,
 CAST(sum(seq) AS BIGINT) AS seq FROM pk GROUP BY 1, 2, 3""")
add("capture_scan", """
e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id % 5 AS u FROM events),
fr AS (SELECT 'sensor-' || (user_id % 2) || '-' || ['eth', 'vlan', 'sll', 'raw'][CAST(event_id % 4 AS INT) + 1] || '.pcap' AS capture, event_id,
   floor(epoch(ts)) AS ts, CASE u WHEN 4 THEN 17 WHEN 3 THEN 1 ELSE 6 END AS proto, k, u FROM e),
nr AS (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY event_id) - 1 AS packet_no FROM fr)""",
    """SELECT capture, CAST(proto AS BIGINT) AS proto, '10.0.0.' || (u + 1) AS src,
 CAST(CASE proto WHEN 17 THEN 53 + k WHEN 6 THEN 443 ELSE 0 END AS BIGINT) AS dport, count(*) AS packets,
 CAST(sum(packet_no) AS BIGINT) AS numbers, max(ts) AS last, CAST(sum(k) AS BIGINT) AS payload,
 CAST(sum(CASE WHEN proto = 6 THEN k % 64 ELSE 0 END) AS BIGINT) AS flags, CAST(sum(CASE WHEN proto = 6 THEN 8192 + k ELSE 0 END) AS BIGINT) AS win,
 CAST(sum(32 + k % 32) AS BIGINT) AS ttl, CAST(sum(CASE WHEN proto = 6 THEN k % 10 ELSE 0 END) AS BIGINT) AS seq,
 (SELECT count(*) FROM fr) AS written FROM nr GROUP BY 1, 2, 3, 4""")


def packet_flows(idle: int, active: int) -> tuple[str, str]:
    """Flows begin after silence and, from the begin of the flow before, at the first packet more than ``active`` later."""
    marks = ", ".join(f"CAST(count(*) FILTER (proto = 6 AND flags & {bit} > 0) AS DOUBLE) AS {f}" for f, bit in (
        ("syn", 2), ("ack", 16), ("rst", 4), ("fin", 1), ("psh", 8), ("urg", 32)))
    with_ = PACKETS + f""",
l AS (SELECT *, ts - lag(ts) OVER (PARTITION BY capture, client ORDER BY packet_no) AS d FROM pk),
s AS (SELECT *, sum(CASE WHEN d IS NULL OR d > {idle} THEN 1 ELSE 0 END) OVER (PARTITION BY capture, client ORDER BY packet_no) AS ses FROM l),
bg AS (SELECT capture, client, ses, min(packet_no) AS p, arg_min(ts, packet_no) AS t FROM s GROUP BY 1, 2, 3
       UNION ALL
       SELECT b.capture, b.client, b.ses, min(s.packet_no), arg_min(s.ts, s.packet_no) FROM bg b JOIN s
         ON s.capture = b.capture AND s.client = b.client AND s.ses = b.ses AND s.packet_no > b.p AND s.ts - b.t > {active}
       GROUP BY b.capture, b.client, b.ses, b.p),
m AS (SELECT s.*, max(bg.p) OVER (PARTITION BY s.capture, s.client ORDER BY s.packet_no) AS fl FROM s
      LEFT JOIN bg ON bg.capture = s.capture AND bg.client = s.client AND bg.p = s.packet_no),
g AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE d END AS gap, up = first(up) OVER w AS fwd,
       first(up) OVER w AS fup, first(ts) OVER w AS t0 FROM m WINDOW w AS (PARTITION BY capture, client, fl ORDER BY packet_no)),
rt AS (SELECT capture, client, fl, sum(c - 1) AS retr FROM (SELECT capture, client, fl, count(*) AS c FROM g
       WHERE fwd AND proto = 6 AND payload > 0 GROUP BY capture, client, fl, seq, payload, flags & 7) GROUP BY 1, 2, 3)"""
    return with_, f"""SELECT capture AS source, make_timestamp(CAST(min(t0) AS BIGINT) * 1000000) AS timestamp,
 CAST(CASE WHEN bool_and(fup) THEN 443 ELSE any_value(cport) END AS DOUBLE) AS dst_port, CAST(any_value(proto) AS DOUBLE) AS protocol,
 arg_max(ts, packet_no) - min(t0) AS flow_duration,
 CAST(count(*) FILTER (fwd) AS DOUBLE) AS fwd_packets, CAST(count(*) FILTER (NOT fwd) AS DOUBLE) AS bwd_packets,
 CAST(coalesce(sum(payload) FILTER (fwd), 0) AS DOUBLE) AS fwd_bytes, CAST(coalesce(sum(payload) FILTER (NOT fwd), 0) AS DOUBLE) AS bwd_bytes,
 round(avg(gap), 6) AS iat_mean, round(stddev_pop(gap), 6) AS iat_std, CAST(max(gap) AS DOUBLE) AS iat_max,
 CAST(arg_min(win, packet_no) FILTER (fwd AND proto = 6) AS DOUBLE) AS win_fwd, round(avg(ttl) FILTER (fwd), 6) AS ttl,
 CAST(coalesce(any_value(retr), 0) AS DOUBLE) AS retransmissions, round(avg(ip_len), 6) AS pktlen_mean,
 round(stddev_pop(ip_len), 6) AS pktlen_std, {marks},
 CASE WHEN bool_and(fup) THEN client ELSE '192.168.1.1' END AS src_ip, CASE WHEN bool_and(fup) THEN '192.168.1.1' ELSE client END AS dst_ip,
 CAST(CASE WHEN bool_and(fup) THEN any_value(cport) ELSE 443 END AS DOUBLE) AS src_port, 'unlabeled' AS raw_label, 'Benign' AS stage
 FROM g LEFT JOIN rt USING (capture, client, fl) GROUP BY capture, client, fl"""


add("packet_idle_flows", *packet_flows(1800, 1_000_000_000))
add("packet_flows", *packet_flows(21600, 86400))

# ------------------------------------------------------------------------------------------------- splits
PATTERN = text(O.split_parts)


def blocked(shift: str = "0") -> str:
    return f"{PATTERN}[CAST(((rn + {shift}) // greatest(30, least(90, rows // 10))) % 10 AS INT) + 1]"


SPLIT = REG + f""",
sl AS (SELECT *, {blocked()} AS split,
   pos >= 11 AND pos + 6 < seg_len AND {blocked('-11')} = {blocked()} AND {blocked('6')} = {blocked()} AS is_sample FROM st)"""
FRACTIONS = """CASE WHEN {r} >= floor({n} * 0.7999999999999999::DOUBLE) + 18 THEN 'test'
 WHEN {r} >= floor({n} * 0.7::DOUBLE) + 18 AND {r} < floor({n} * 0.7999999999999999::DOUBLE) THEN 'val'
 WHEN {r} < floor({n} * 0.7::DOUBLE) THEN 'train' ELSE 'gap' END"""
KEY = "source, segment, pos"
add("split_labels", SPLIT, f"SELECT {KEY}, split FROM sl")
add("split_by_day", REG, f"SELECT {KEY}, {FRACTIONS.format(r='rn', n='rows')} AS split FROM st")
add("split_by_time", REG + """, gl AS (SELECT *, row_number() OVER (ORDER BY timestamp, source) - 1 AS gr,
 count(*) OVER () AS ga FROM st)""", f"SELECT {KEY}, {FRACTIONS.format(r='gr', n='ga')} AS split FROM gl")
add("split_summary", SPLIT, """SELECT split, CASE WHEN is_attack THEN stage ELSE 'Benign' END AS stage, count(*) AS windows
 FROM sl GROUP BY 1, 2""")
add("split_totals", SPLIT, "SELECT split, count(*) AS windows, count(*) FILTER (is_attack) AS attack_windows FROM sl GROUP BY 1")
add("sample_ends", SPLIT, f"SELECT {KEY}, split FROM sl WHERE is_sample")
add("inference_ends", R300, "SELECT source, segment, count(*) FILTER (pos >= 11) AS ends FROM st GROUP BY 1, 2")
VOCAB = text(CLOSED_FORM_STAGES)
SID = f"CAST(coalesce(list_position({VOCAB}, CASE WHEN is_attack THEN stage ELSE 'Benign' END), 0) - 1 AS INT)"
LEADS = ", ".join(f"lead(CAST(is_attack AS DOUBLE), {k}) OVER w AS a{k}, lead({SID}, {k}) OVER w AS s{k}" for k in range(1, 7))
FUTURE = SPLIT + f", fu AS (SELECT *, {LEADS} FROM sl WINDOW w AS (PARTITION BY source, segment ORDER BY pos))"
add("future_targets", FUTURE, f"SELECT {KEY}, {', '.join(f'a{k}' for k in range(1, 7))}, {', '.join(f's{k}' for k in range(1, 7))} FROM fu WHERE pos >= 11 AND pos + 6 < seg_len")
add("history_windows", REG + f""", hi AS (SELECT {KEY}, lag(flow_count, 11) OVER w AS oldest, flow_count AS newest,
 CAST(12 AS INT) AS length, sum(flow_count) OVER (PARTITION BY source, segment ORDER BY pos ROWS 11 PRECEDING) AS total
 FROM st WINDOW w AS (PARTITION BY source, segment ORDER BY pos))""", "SELECT * FROM hi WHERE pos >= 11")
add("stage_vocabulary", SPLIT, f"""SELECT stage, CAST(row_number() OVER (ORDER BY list_position({text(STAGE_ORDER)}, stage)) - 1 AS INT) AS id
 FROM (SELECT 'Benign' AS stage UNION SELECT DISTINCT stage FROM sl WHERE split = 'train' AND is_attack)""")
add("stage_ids", REG, f"SELECT {SID} AS id, stage, count(*) AS windows FROM st GROUP BY 1, 2")
add("new_stages", SPLIT, f"""SELECT stage, CAST(row_number() OVER (ORDER BY list_position({text(STAGE_ORDER)}, stage)) + 3 AS INT) AS id
 FROM (SELECT DISTINCT stage FROM sl WHERE split = 'train' AND is_attack) WHERE NOT list_contains({VOCAB}, stage)""")
add("samples_by_next_stage", SPLIT + """, nx AS (SELECT *, lead(CASE WHEN is_attack THEN stage ELSE 'Benign' END) OVER
 (PARTITION BY source, segment ORDER BY pos) AS next_stage FROM sl)""",
    "SELECT split, next_stage, count(*) AS samples FROM nx WHERE is_sample GROUP BY 1, 2")
BLOCKS = SPLIT + """, hb AS (SELECT source, segment, min(pos) AS first_pos, count(*) AS windows, max(pos) AS last_pos,
 min(timestamp) AS start, count(*) FILTER (is_attack) AS attack_windows,
 list_sort(list(DISTINCT stage) FILTER (is_attack)) AS stages
 FROM (SELECT *, pos - row_number() OVER (PARTITION BY source, segment ORDER BY pos) AS isl FROM sl WHERE split = 'test')
 GROUP BY source, segment, isl)"""
add("holdout_blocks", BLOCKS, "SELECT * REPLACE (coalesce(array_to_string(stages, ', '), '') AS stages) FROM hb")
add("holdout_selection", BLOCKS + """, ck AS (SELECT *, row_number() OVER (ORDER BY attack_windows = 0,
 coalesce(len(stages), 0) * 1000 + attack_windows DESC, start, source) AS pl FROM hb WHERE windows >= 23),
 ch AS (SELECT *, row_number() OVER (ORDER BY start, source, first_pos) AS no FROM ck WHERE pl <= 3 AND (attack_windows > 0 OR pl <= 1))""",
    """SELECT printf('holdout-%02d-%s', no, substring(sl.source, 1, 20)) AS source, CAST(no - 1 AS INT) AS segment,
 count(*) AS windows, min(sl.timestamp) AS start, count(*) FILTER (sl.is_attack) AS attack_windows
 FROM sl JOIN ch ON sl.source = ch.source AND sl.segment = ch.segment AND sl.pos BETWEEN ch.first_pos AND ch.last_pos GROUP BY no, sl.source""")


def islands(gap: int) -> str:
    return f"""(SELECT *, sum(CASE WHEN d IS NULL OR d > {gap + 1} THEN 1 ELSE 0 END) OVER (PARTITION BY source, segment ORDER BY pos) AS isl
 FROM (SELECT source, segment, pos, timestamp, pos - lag(pos) OVER (PARTITION BY source, segment ORDER BY pos) AS d FROM st WHERE is_attack))"""


add("attack_bands", REG, f"""SELECT source, segment, min(pos) AS first_pos, max(pos) AS last_pos, min(timestamp) AS start,
 max(timestamp) AS "end" FROM {islands(0)} GROUP BY source, segment, isl""")
EPISODES = f"""ep AS (SELECT source, segment, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS attack_windows,
 min(timestamp) AS start_time, max(timestamp) AS end_time FROM {islands(2)} GROUP BY source, segment, isl)"""
add("episodes", REG + ", " + EPISODES, "SELECT * FROM ep")


# ------------------------------------------------------------------------------------------------ scaling
def slog(x: str) -> str:
    return f"sign({x}) * ln(1 + abs({x}))"


def model_space(f: str, value: str | None = None) -> str:
    return slog(value or f) if f in LOG_FEATURES else (value or f)


SCALE = SPLIT + ", sc AS (SELECT " + ", ".join(
    f"avg({model_space(f)}) AS m_{f}, stddev_pop({model_space(f)}) AS s_{f}" for f in FEATURES) + " FROM sl WHERE split = 'train')"


def z(f: str, value: str | None = None) -> str:
    x = f"({model_space(f, value)} - m_{f}) / s_{f}"
    return f"CASE WHEN s_{f} > 1e-8 THEN least(greatest({x}, -10.0), 10.0) ELSE 0.0 END"


add("scaler_params", SCALE, " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({i} AS INT) AS position, round(m_{f}, 6) AS mean, "
    f"round(CASE WHEN s_{f} > 1e-8 THEN s_{f} ELSE 1 END, 6) AS std, s_{f} > 1e-8 AS active, {str(f in LOG_FEATURES).lower()} AS logged FROM sc"
    for i, f in enumerate(FEATURES)))
add("scaled_states", SCALE, f"SELECT {KEY}, " + ", ".join(f"round({z(f)}, 6) AS {f}" for f in FEATURES) + " FROM sl, sc")
add("flat_sequences", SCALE + f", zz AS (SELECT {KEY}, " + " + ".join(f"({z(f)})" for f in FEATURES) + " AS total FROM sl, sc)",
    f"""SELECT * FROM (SELECT {KEY}, CAST(720 AS INT) AS length, round(sum(total) OVER (PARTITION BY source, segment ORDER BY pos ROWS 11 PRECEDING), 6) AS total FROM zz)
 WHERE pos >= 11""")
UNSCALED = FEATURES
add("unscaled_states", SCALE, f"SELECT {KEY}, " + ", ".join(
    "round(" + (f"sign(v_{f}) * (exp(abs(v_{f})) - 1)" if f in LOG_FEATURES else f"v_{f}") + f" + 1e-9, 6) AS {f}" for f in UNSCALED)
    + f" FROM (SELECT {KEY}, " + ", ".join(f"({z(f)}) * (CASE WHEN s_{f} > 1e-8 THEN s_{f} ELSE 1 END) + m_{f} AS v_{f}" for f in UNSCALED) + " FROM sl, sc)")
add("feature_report", SCALE + ", us AS (SELECT source, " + ", ".join(f"sum(abs({f})) AS u_{f}" for f in FEATURES) + " FROM sl GROUP BY 1)",
    " UNION ALL ".join(
        [f"SELECT source, 'inactive' AS kind, '{f}' AS feature FROM sc, us WHERE NOT s_{f} > 1e-8" for f in FEATURES]
        + [f"SELECT source, 'unavailable', '{f}' FROM sc, us WHERE s_{f} > 1e-8 AND NOT u_{f} > 0" for f in FEATURES]
        + [f"SELECT source, 'novel', '{f}' FROM sc, us WHERE NOT s_{f} > 1e-8 AND u_{f} > 0" for f in OPTIONAL_FEATURES]))

# ----------------------------------------------------------------------------------------------- forecast
PS = [f"p{k}" for k in range(1, 7)]


def forecast_chain(base_from: str = "fu", name: str = "fc") -> str:
    probs = ", ".join(f"1 / (1 + exp(-(base + {0.15 * (k - 1)!r} - 1.0))) AS p{k}" for k in range(1, 7))
    lg = ["0", "base", "0.5 * base", "-base"]
    peak = f"greatest({', '.join(lg)})"
    dist = ", ".join(f"exp({x} - {peak}) / (" + " + ".join(f"exp({y} - {peak})" for y in lg) + f") AS d{i + 1}" for i, x in enumerate(lg))
    return f"""
bs AS (SELECT fu.*, 1.5 * ({z('flow_count')}) + 1.0 * ({z('failed_flow_ratio')}) AS base FROM {base_from} AS fu, sc WHERE pos >= 11),
pr AS (SELECT *, {probs}, {dist} FROM bs),
{name} AS (SELECT *, p6 AS risk, CASE WHEN d2 >= d3 AND d2 >= d4 THEN 1 WHEN d3 >= d4 THEN 2 ELSE 3 END AS top,
  CASE WHEN p6 >= {THR} THEN {VOCAB}[CASE WHEN d2 >= d3 AND d2 >= d4 THEN 1 WHEN d3 >= d4 THEN 2 ELSE 3 END + 1] ELSE 'Benign' END AS head,
  [{', '.join(PS)}] AS pp, [a1, a2, a3, a4, a5, a6] AS aa, [s1, s2, s3, s4, s5, s6] AS ss FROM pr)"""


FUT = FUTURE + SCALE[len(SPLIT):]
FC = FUT + "," + forecast_chain()
LEVEL = "CASE WHEN {x} >= " + repr(CRIT) + " THEN 'CRITICAL' WHEN {x} >= " + repr(THR) + " THEN 'WARNING' WHEN {x} >= " + repr(WATCH) + " THEN 'WATCH' ELSE 'OK' END"


def shown(level: str, names: dict) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def state(x: str) -> str:
    return shown(LEVEL.format(x=x), DISPLAY_LEVELS)


add("forecast_scores", FC, f"SELECT {KEY}, {r6(*PS, 'd1', 'd2', 'd3', 'd4')} FROM fc")
add("timeline", FC, f"SELECT {KEY}, timestamp, round(risk, 6) AS risk, head AS headline_stage, "
    + ", ".join(f"round({p}, 6) AS p_t{p[1]}" for p in PS) + " FROM fc")
add("timeline_rethreshold", FC, f"""SELECT CASE WHEN risk >= 0.8 THEN {VOCAB}[top + 1] ELSE 'Benign' END AS headline_stage,
 count(*) AS windows FROM fc GROUP BY 1""")
LONG = FC + f""",
nx AS (SELECT {KEY}, timestamp, is_attack, stage FROM st),
fl AS (SELECT source, segment, pos, timestamp, top, d2, d3, d4, unnest(range(1, 7)) AS step, unnest(pp) AS p FROM fc),
lo AS (SELECT fl.*, {VOCAB}[top + 1] AS likely, CASE top WHEN 1 THEN d2 WHEN 2 THEN d3 ELSE d4 END AS conf,
  nx.is_attack AS na, nx.stage AS ns, nx.timestamp AS nt
  FROM fl LEFT JOIN nx ON nx.source = fl.source AND nx.segment = fl.segment AND nx.pos = fl.pos + fl.step)"""
add("forecast_long", LONG, f"""SELECT {KEY}, timestamp, CAST(step AS INT) AS step, CAST(step * 3600 AS INT) AS seconds,
 '+' || (step * 3600) || 's' AS label, round(p, 6) AS risk, {state('p')} AS state, p >= {THR} AS above,
 CASE WHEN p >= {THR} THEN likely ELSE 'None' END AS stage, likely AS likely_stage, round(conf, 6) AS stage_conf,
 na AS actual_attack, CASE WHEN na THEN ns WHEN NOT na THEN 'None' END AS actual_stage, nt AS target_time FROM lo""")
add("forecast_table", LONG, f"""SELECT {KEY}, CAST(step AS INT) AS step, CAST(step * 3600 AS INT) AS seconds_ahead,
 round(p, 6) AS attack_probability, CASE WHEN p >= {THR} THEN likely ELSE 'Benign' END AS predicted_stage,
 likely AS most_likely_attack_stage, round(conf, 6) AS stage_confidence FROM lo""")
add("forecast_span", LONG, f"""SELECT {KEY}, '+' || (min(step) * 3600) || 's' AS first_label,
 '+' || (max(step) * 3600) || 's' AS last_label FROM lo WHERE p >= {THR} GROUP BY ALL""")
add("expected_now", FC + f", pv AS (SELECT {KEY}, timestamp, lag(p1) OVER w AS q, lag(top) OVER w AS qt FROM fc WINDOW w AS (PARTITION BY source, segment ORDER BY pos))",
    f"""SELECT {KEY}, timestamp, round(q, 6) AS risk, CASE WHEN q IS NOT NULL THEN {state('q')} END AS state,
 CASE WHEN q >= {THR} THEN {VOCAB}[qt + 1] WHEN q IS NOT NULL THEN 'None' END AS stage FROM pv""")
add("risk_levels", FC, f"""SELECT {LEVEL.format(x='risk')} AS level, {state('risk')} AS state,
 {shown(LEVEL.format(x='risk'), INCIDENT_LEVELS)} AS severity, count(*) AS windows FROM fc GROUP BY 1, 2, 3""")
ZS = SCALE + f", zv AS (SELECT {KEY}, split, is_sample, [" + ", ".join(z(f) for f in FEATURES) + "] AS zl, [" + ", ".join(
    f"s_{f} > 1e-8" for f in FEATURES) + "] AS act FROM sl, sc)"
add("state_persistence", ZS + """, er AS (SELECT unnest(range(1, 7)) AS step, zl, act, [lead(zl, 1) OVER w, lead(zl, 2) OVER w, lead(zl, 3) OVER w, lead(zl, 4) OVER w,
 lead(zl, 5) OVER w, lead(zl, 6) OVER w] AS nl, is_sample, split FROM zv WINDOW w AS (PARTITION BY source, segment ORDER BY pos)),
 ee AS (SELECT step, unnest(range(1, 61)) AS i, zl, nl[step] AS nz, act FROM er WHERE is_sample AND split = 'test'),
 dd AS (SELECT step, zl[i] - nz[i] AS d FROM ee WHERE act[i])""",
    """SELECT CAST(coalesce(step, 0) AS INT) AS step, round(avg(abs(d)), 6) AS mae, round(sqrt(avg(d * d)), 6) AS rmse
 FROM dd GROUP BY ROLLUP (step)""")

# ------------------------------------------------------------------------------------------------- alerts
# one row per scored window with the state of the alert rules after it
ALERTS = FC + f""",
tl AS (SELECT source, segment, pos, timestamp, risk, head, pp, {LEVEL.format(x='risk')} AS lv FROM fc),
rec AS (
  SELECT source, segment, CAST(10 AS BIGINT) AS pos, CAST(NULL AS TIMESTAMP) AS timestamp, 0.0::DOUBLE AS risk, ''::VARCHAR AS head,
    'OK'::VARCHAR AS lv, 0::BIGINT AS ab, 0::BIGINT AS be, false AS op, 0::BIGINT AS id, ''::VARCHAR AS stg,
    ''::VARCHAR AS pk, MAP {{'Benign': -1::BIGINT}} AS cd, ''::VARCHAR AS ev, 0::BIGINT AS nw
  FROM (SELECT DISTINCT source, segment FROM tl)
  UNION ALL
  SELECT source, segment, pos, timestamp, risk, head, lv, ab, be, CASE WHEN opening THEN true WHEN closing THEN false ELSE op END,
    id + CAST(opening AS BIGINT), CASE WHEN opening THEN head WHEN adding THEN stg || ' > ' || head ELSE stg END,
    CASE WHEN opening OR raising THEN lv ELSE pk END,
    CASE WHEN closing THEN map_concat(cd, map_from_entries(list_transform(string_split(stg, ' > '), lambda s: {{'k': s, 'v': pos + 6}}))) ELSE cd END,
    CASE WHEN opening THEN 'opened' WHEN closing THEN 'closed' WHEN raising THEN 'escalated' ELSE '' END,
    CASE WHEN opening THEN ab WHEN op AND hot THEN nw + 1 ELSE nw END
  FROM (SELECT *, NOT op AND hot AND ab >= 2 AND coalesce(cd[head], -1) < pos AS opening,
          op AND hot AND head <> 'Benign' AND NOT list_contains(string_split(stg, ' > '), head) AS adding,
          op AND hot AND lv = 'CRITICAL' AND pk <> 'CRITICAL' AS raising, op AND be >= 3 AS closing
        FROM (SELECT t.source, t.segment, t.pos, t.timestamp, t.risk, t.head, t.lv, t.risk >= {THR} AS hot,
                CASE WHEN t.risk >= {THR} THEN r.ab + 1 ELSE 0 END AS ab,
                CASE WHEN t.risk < {CLEAR!r} THEN r.be + 1 ELSE 0 END AS be, r.op, r.id, r.stg, r.pk, r.cd, r.nw
              FROM rec r JOIN tl t ON t.source = r.source AND t.segment = r.segment AND t.pos = r.pos + 1))),
ra AS (SELECT *, ev = 'closed' OR op AS live FROM rec WHERE pos > 10),
ag AS (SELECT source, segment, id, min(pos) AS opened_pos, min(timestamp) AS opened_time,
   arg_min(head, pos) AS stage, arg_max(lv, pos) FILTER (risk >= {THR}) AS severity, arg_max(pk, pos) AS peak_severity,
   max(pos) FILTER (risk >= {THR}) AS last_pos, max(timestamp) FILTER (risk >= {THR}) AS last_time,
   max(risk) FILTER (risk >= {THR}) AS peak_risk, arg_max(stg, pos) AS stages,
   max(pos) FILTER (ev = 'closed') AS closed_pos, max(timestamp) FILTER (ev = 'closed') AS closed_time,
   arg_max(nw, pos) AS n_windows FROM ra WHERE live GROUP BY 1, 2, 3),
al AS (SELECT ag.*, CASE WHEN closed_pos IS NULL THEN 'OPEN' ELSE 'CLOSED' END AS status, last_pos - opened_pos + 1 AS duration_windows,
   greatest(coalesce(list_position(list_transform(tl.pp, lambda p: p >= {THR}), true), 1), 1) AS step, tl.pp
   FROM ag JOIN tl ON tl.source = ag.source AND tl.segment = ag.segment AND tl.pos = ag.opened_pos)"""
add("alert_log", ALERTS, """SELECT source, segment, id, stage, severity, peak_severity, opened_pos, opened_time, last_pos,
 round(peak_risk, 6) AS peak_risk, step * 3600.0::DOUBLE AS eta_seconds, status, n_windows, stages, closed_pos, closed_time,
 duration_windows FROM al""")
add("alert_events", ALERTS, """SELECT source, segment, id AS alert_id, ev AS type, pos, timestamp AS time,
 CASE WHEN ev <> 'closed' THEN lv END AS severity, CASE WHEN ev = 'opened' THEN head END AS stage FROM ra WHERE ev <> ''""")
TABLE = f"""SELECT source, segment, id AS n, opened_pos, last_pos, closed_pos, opened_time, closed_time, stage, stages,
 {shown('peak_severity', DISPLAY_LEVELS)} AS severity, round(peak_risk, 6) AS peak_risk, CAST(step AS INT) AS step,
 CAST(step * 3600 AS INT) AS seconds_ahead, round(pp[step], 6) AS risk_at_step, n_windows AS windows, duration_windows,
 step * 3600.0::DOUBLE AS eta_seconds, status FROM al"""
add("alert_table", ALERTS, TABLE)
add("alert_reason", ALERTS, f"""SELECT source, id AS n, 'Opened after 2 windows in a row with a risk of 60% or more; '
 || printf('%.0f', pp[step] * 100) || '% is expected ' || (step * 3600) || ' seconds ahead.' AS reason FROM al""")
add("alert_open_at", ALERTS, f"""SELECT tl.source, tl.segment, tl.pos, tl.timestamp, round(risk, 6) AS risk, al.id AS alert_id,
 al.stage AS alert_stage FROM tl LEFT JOIN al ON al.source = tl.source AND al.segment = tl.segment AND tl.pos >= al.opened_pos
 AND (al.closed_pos IS NULL OR tl.pos < al.closed_pos)""")
add("risk_text", LONG, f"""SELECT {KEY}, CASE WHEN max(p) >= {THR} THEN arg_min(likely, step) FILTER (p >= {THR})
 || ' expected from +' || (min(step) FILTER (p >= {THR}) * 3600) || 's (' || printf('%.0f', 100 * arg_min(p, step) FILTER (p >= {THR}))
 || '%, limit 60%). ' ELSE 'Below the limit of 60% in every step. ' END
 || 'Peak over 21600 seconds: ' || printf('%.0f', 100 * max(p)) || '% at +21600s.' AS text FROM lo GROUP BY {KEY}""")
add("replay_history", FC, """SELECT source, rn AS "row", timestamp, round(risk, 6) AS risk, head AS stage, is_attack AS truth,
 stage AS truth_stage, flow_count FROM fc""")

# ---------------------------------------------------------------------------------------------- incidents
INC = ALERTS + f""",
ii AS (SELECT 'INC-' || upper(substring(sha1(source || '|' || strftime(opened_time, '%Y-%m-%d %H:%M:%S') || '|' || stage), 1, 6)) AS id,
   source, opened_time, closed_time, stage, stages AS progression, {shown('peak_severity', INCIDENT_LEVELS)} AS severity,
   peak_risk, step * 3600.0::DOUBLE AS eta_seconds, n_windows AS windows,
   CASE WHEN NOT (SELECT bool_or(is_attack) FROM st) THEN -1 ELSE CAST(EXISTS (SELECT 1 FROM st WHERE st.source = al.source
     AND st.segment = al.segment AND is_attack AND st.pos BETWEEN al.opened_pos - 6 AND al.last_pos + 6) AS INT) END AS confirmed,
   segment, opened_pos FROM al)"""
add("incident_table", INC, "SELECT * REPLACE (round(peak_risk, 6) AS peak_risk) FROM ii")
add("incident_summary", INC, f"""SELECT (SELECT count(*) FROM st) AS windows, (SELECT count(*) FROM st) * 1.0::DOUBLE AS hours,
 (SELECT bool_or(is_attack) FROM st) AS labelled, (SELECT min(timestamp) FROM st) AS start, (SELECT max(timestamp) FROM st) AS "end",
 (SELECT round(max(risk), 6) FROM tl) AS peak_risk, (SELECT round(avg(risk), 6) FROM tl) AS mean_risk,
 (SELECT round(avg(CAST(risk >= {WATCH!r} AS INT)), 6) FROM tl) AS share_elevated, count(*) AS incidents,
 count(*) FILTER (severity = 'Critical') AS critical, count(*) FILTER (severity = 'High') AS high,
 (SELECT stage FROM ii GROUP BY stage ORDER BY count(*) DESC, stage DESC LIMIT 1) AS top_tactic,
 round(avg(CAST(confirmed = 1 AS INT)), 6) AS confirmed_share FROM ii""")
UPSERT = INC + """,
up AS (SELECT id, source, opened_time, closed_time, stage, progression, severity, round(peak_risk, 6) AS peak_risk, eta_seconds,
  windows, confirmed, CASE WHEN source = 'sensor-0' AND hour(opened_time) % 2 = 0 THEN 'Resolved' ELSE 'New' END AS status,
  CASE WHEN source = 'sensor-0' AND hour(opened_time) % 2 = 0 THEN 'done' ELSE '' END AS note FROM ii)"""
add("incident_upsert", UPSERT, "SELECT * FROM up")
add("incident_list", UPSERT, "SELECT * FROM up WHERE status IN ('New', 'Investigating') AND severity = 'Critical'")
add("incident_queue", UPSERT, """SELECT count(*) AS queue, count(*) FILTER (severity = 'Critical') AS critical,
 count(*) FILTER (severity = 'High') AS high, count(*) FILTER (status = 'New') AS new,
 count(*) FILTER (status = 'False positive') AS false_positives FROM up""")
add("incident_triage", INC, """SELECT id, CASE WHEN confirmed = 0 THEN 'False positive' ELSE 'Investigating' END AS status,
 CASE WHEN confirmed = 0 THEN 'no attack' ELSE 'look' END AS note FROM ii""")
add("audit_tail", INC, """SELECT opened_time AS ts, 'incident_update' AS action, id || ' -> ' || status AS detail FROM (
 SELECT opened_time, id, 'Investigating' AS status FROM ii UNION ALL SELECT opened_time, id, 'False positive' FROM ii WHERE confirmed = 0)
 ORDER BY ts DESC, action, detail LIMIT 25""")


# ------------------------------------------------------------------------------------------------ metrics
def binary(keys: str = "", thr: float = THR, undefined: str = "0.0", brier: bool = True) -> str:
    def over(a, b, other):
        return f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE {other} END"
    f1 = over("2.0 * tp", "(2 * tp + fp + fn)", "0.0")
    if undefined == "NULL":
        f1 = f"CASE WHEN tp + fn > 0 THEN {f1} END"
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    cols = f"""{lead}round({over('(tp + tn)', '(tp + fp + tn + fn)', undefined)}, 6) AS accuracy,
 round({over('tp', '(tp + fp)', undefined)}, 6) AS precision, round({over('tp', '(tp + fn)', undefined)}, 6) AS recall,
 round({f1}, 6) AS f1, round({over('fp', '(fp + tn)', undefined)}, 6) AS false_positive_rate, tp, fp, tn, fn,
 tp + fn AS support_positive, tp + fp + tn + fn AS support_total"""
    if brier:
        cols += ", round(CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN br END, 6) AS brier"
    return f"""bm AS (SELECT {cols} FROM (SELECT {lead}count(*) FILTER (y > 0 AND p >= {thr}) AS tp, count(*) FILTER (y <= 0 AND p >= {thr}) AS fp,
 count(*) FILTER (y <= 0 AND p < {thr}) AS tn, count(*) FILTER (y > 0 AND p < {thr}) AS fn, avg((p - y) * (p - y)) AS br
 FROM sr {group}))"""


def ranking(keys: str = "") -> str:
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""gp AS (SELECT {lead}p, count(*) FILTER (y > 0) AS np, count(*) FILTER (y <= 0) AS nn FROM sr GROUP BY {lead}p),
cu AS (SELECT *, sum(np) OVER u AS up, sum(nn) OVER u AS un, sum(np) OVER ({part}) AS tp_, sum(nn) OVER ({part}) AS tn_ FROM gp
  WINDOW u AS ({part} ORDER BY p)),
rk AS (SELECT {lead}round(CASE WHEN max(tp_) > 0 AND max(tn_) > 0 THEN sum(np * (un - nn + nn / 2.0)) / (max(tp_) * max(tn_)) END, 6) AS roc_auc,
  round(CASE WHEN max(tp_) > 0 AND max(tn_) > 0 THEN sum(np * (tp_ - up + np) / CAST(tp_ - up + np + tn_ - un + nn AS DOUBLE)) / max(tp_) END, 6) AS pr_auc
  FROM cu {'GROUP BY ' + keys if keys else ''})"""


STEPS = "sr AS (SELECT source, segment, pos, unnest(range(1, 7)) AS st_, unnest(pp) AS p, unnest(aa) AS y FROM fc WHERE is_sample AND split = 'test')"


def onsets(where: str) -> str:
    return f"sr AS (SELECT risk AS p, list_max(aa) AS y FROM fc WHERE {where} AND NOT is_attack)"


ONSET_TEST, ONSET_VAL = (onsets(f"is_sample AND split = '{s}'") for s in ("test", "val"))
add("binary_metrics", f"{FC}, {STEPS}, {binary()}, {ranking()}", "SELECT bm.*, roc_auc, pr_auc FROM bm, rk")
STEP_KEY = STEPS.replace("AS st_", "AS step")
add("metrics_per_horizon", f"{FC}, {STEP_KEY}, {binary('step')}, {ranking('step')}",
    "SELECT bm.* REPLACE (CAST(bm.step AS INT) AS step), roc_auc, pr_auc FROM bm JOIN rk USING (step)")
add("onset_metrics", f"{FC}, {ONSET_TEST}, {binary()}, {ranking()}", "SELECT bm.*, roc_auc, pr_auc FROM bm, rk")
add("persistence_oracle", f"""{FC}, sr AS (SELECT CAST(is_attack AS DOUBLE) AS p, unnest(aa) AS y FROM fc WHERE is_sample AND split = 'test'),
 {binary(thr=0.5)}, {ranking()}""", "SELECT bm.*, roc_auc, pr_auc FROM bm, rk")
PAIRS = FC + f""", pa AS (SELECT t, q, count(*) AS n FROM (SELECT unnest(ss) AS t, unnest(list_transform(pp, lambda p: CASE WHEN p >= {THR} THEN top ELSE 0 END)) AS q
 FROM fc WHERE is_sample AND split = 'test') GROUP BY 1, 2),
 kl AS (SELECT i, coalesce((SELECT sum(n) FROM pa WHERE t = i), 0) AS sup, coalesce((SELECT sum(n) FROM pa WHERE q = i AND t >= 0), 0) AS cl,
   coalesce((SELECT sum(n) FROM pa WHERE t = i AND q = i), 0) AS hit FROM range(0, 4) r(i)),
 rp AS (SELECT {VOCAB}[i + 1] AS stage, CASE WHEN cl > 0 THEN hit / cl ELSE 0 END AS precision, hit / sup AS recall,
   2.0 * hit / (cl + sup) AS f1, CAST(sup AS BIGINT) AS support FROM kl WHERE sup > 0)"""
add("stage_confusion", PAIRS, f"SELECT {VOCAB}[t + 1] AS true_stage, {VOCAB}[q + 1] AS predicted_stage, n FROM pa WHERE t >= 0")
add("stage_support", PAIRS, f"""SELECT {VOCAB}[i + 1] AS stage, CAST(sup AS BIGINT) AS support, CAST(cl AS BIGINT) AS claimed, sup > 0 AS scored FROM kl
 UNION ALL SELECT 'Exfiltration', 0, 0, false""")
add("stage_report", PAIRS, "SELECT stage, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rp")
add("stage_metrics", PAIRS, """SELECT round(sum(n) FILTER (t = q) / sum(n) FILTER (t >= 0), 6) AS accuracy,
 CAST(coalesce(sum(n) FILTER (t < 0), 0) AS BIGINT) AS unseen_stage_samples,
 round(coalesce(sum(n) FILTER (t > 0 AND t = q), 0) / sum(n) FILTER (t > 0), 6) AS accuracy_given_attack,
 (SELECT round(CASE WHEN count(*) > 1 THEN avg(recall) END, 6) FROM rp) AS balanced_accuracy,
 (SELECT round(avg(precision), 6) FROM rp) AS macro_precision, (SELECT round(avg(recall), 6) FROM rp) AS macro_recall,
 (SELECT round(avg(f1), 6) FROM rp) AS macro_f1, (SELECT count(*) FROM rp) AS classes_with_support FROM pa""")
TRAIN_SAMPLES = "is_sample AND split = 'train'"
CAND = f"""cs AS (SELECT DISTINCT unnest(list_concat({GRID}, list_transform((SELECT quantile_cont(p, {RANKS}) FROM sr), lambda q: round(q, 4)))) AS threshold),
ct AS (SELECT threshold, count(*) FILTER (y > 0 AND p >= threshold) AS tp, count(*) FILTER (y <= 0 AND p >= threshold) AS fp,
  count(*) FILTER (y > 0) AS onset_positives, count(*) FILTER (y <= 0) AS onset_negatives FROM cs, sr GROUP BY 1)"""
add("threshold_table", f"{FC}, {onsets(TRAIN_SAMPLES)}, {CAND}",
    "SELECT round(threshold, 6) AS threshold, tp, fp, onset_positives, onset_negatives FROM ct")


def chosen(target: float, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (SELECT threshold, fp / greatest(onset_negatives, 1) AS fpr, tp / greatest(onset_positives, 1) AS recall,
  tp / greatest(tp + fp, 1) AS prec, onset_positives AS np, onset_negatives AS nn FROM ct)
  ORDER BY (fpr <= {target}) DESC, CASE WHEN fpr <= {target} THEN recall ELSE 2 * prec * recall / greatest(prec + recall, 1e-9) END DESC, fpr, threshold LIMIT 1)"""


add("threshold_choice", f"{FC}, {ONSET_VAL}, {CAND}, {chosen(0.05, 'be')}", """SELECT
 CASE WHEN np >= 3 AND nn >= 3 THEN threshold ELSE 0.5 END AS threshold,
 CASE WHEN np < 3 OR nn < 3 THEN 'fallback' WHEN fpr <= 0.05 THEN 'max recall at target rate' ELSE 'best f1' END AS method,
 CASE WHEN np >= 3 AND nn >= 3 THEN round(fpr, 6) END AS onset_fpr, CASE WHEN np >= 3 AND nn >= 3 THEN round(recall, 6) END AS onset_recall,
 CASE WHEN np >= 3 AND nn >= 3 THEN round(prec, 6) END AS onset_precision,
 CASE WHEN np >= 3 AND nn >= 3 THEN round(2 * prec * recall / greatest(prec + recall, 1e-9), 6) END AS onset_f1,
 np AS onset_positives, nn AS onset_negatives FROM be""")
add("threshold_presets", f"{FC}, {ONSET_VAL}, {CAND}, {chosen(0.02, 'lo')}, {chosen(0.15, 'ea')}", """SELECT
 round(greatest(lo.threshold, 0.6), 6) AS low_noise, 0.6::DOUBLE AS balanced,
 round(CASE WHEN ea.threshold < 0.6 THEN ea.threshold ELSE 0.6 * 0.75 END, 6) AS early_warning, 'validation-calibrated' AS method
 FROM lo, ea""")
add("risk_quantiles", FC, """SELECT source, CAST(i - 1 AS INT) AS i, round(quantile_cont(risk, [0.0, 0.1, 0.5, 0.9, 0.99, 1.0])[i], 6) AS q
 FROM fc, range(1, 7) r(i) GROUP BY source, i""")
LEAD = f"""{ALERTS}, {EPISODES},
fs AS (SELECT source, segment, min(pos) AS first_pos FROM tl GROUP BY 1, 2),
ec AS (SELECT ep.*, first_pos, (SELECT min(opened_pos) FROM al WHERE al.source = ep.source AND al.segment = ep.segment
    AND opened_pos >= start_pos - 6 AND opened_pos < start_pos) AS er,
  (SELECT min(opened_pos) FROM al WHERE al.source = ep.source AND al.segment = ep.segment
    AND opened_pos BETWEEN start_pos AND end_pos) AS la FROM ep LEFT JOIN fs USING (source, segment)),
eo AS (SELECT source, segment, start_pos, end_pos, start_time, end_time, CASE WHEN first_pos IS NULL OR start_pos <= first_pos THEN 'not_forecastable'
    WHEN er IS NOT NULL THEN 'warned_early' WHEN la IS NOT NULL THEN 'detected_late' ELSE 'missed' END AS status, er, la FROM ec),
ez AS (SELECT source, segment, start_pos, end_pos, start_time, end_time, status,
    CASE WHEN status = 'warned_early' THEN (start_pos - er) * 3600.0::DOUBLE END AS lead_seconds,
    CASE WHEN status = 'detected_late' THEN (la - start_pos) * 3600.0::DOUBLE END AS delay_seconds FROM eo),
fa AS (SELECT source, segment, id, opened_pos FROM al WHERE NOT EXISTS (SELECT 1 FROM ep WHERE ep.source = al.source
    AND ep.segment = al.segment AND opened_pos BETWEEN start_pos - 6 AND end_pos + 6))"""
add("lead_time_episodes", LEAD, "SELECT * FROM ez")
add("false_alerts", LEAD, "SELECT * FROM fa")
add("lead_time_summary", LEAD, """SELECT count(*) AS attack_episodes, count(*) FILTER (status <> 'not_forecastable') AS forecastable_episodes,
 count(*) FILTER (status = 'not_forecastable') AS not_forecastable_episodes, count(*) FILTER (status = 'warned_early') AS warned_early,
 count(*) FILTER (status = 'detected_late') AS detected_late, count(*) FILTER (status = 'missed') AS missed,
 round(count(*) FILTER (status = 'warned_early') / count(*) FILTER (status <> 'not_forecastable'), 6) AS warning_coverage,
 round(count(*) FILTER (status IN ('warned_early', 'detected_late')) / count(*) FILTER (status <> 'not_forecastable'), 6) AS detection_coverage_any,
 round(avg(lead_seconds), 6) AS mean_lead_seconds, median(lead_seconds) AS median_lead_seconds, min(lead_seconds) AS min_lead_seconds,
 max(lead_seconds) AS max_lead_seconds, (SELECT count(*) FROM al) AS total_alerts, (SELECT count(*) FROM fa) AS false_alerts,
 round((SELECT count(*) FROM fa) / (SELECT count(*) * 1.0 FROM tl), 6) AS false_alerts_per_hour, CAST(6 AS INT) AS lookback_windows FROM ez""")
OUT = FC + f""", fx AS (SELECT fc.source, fc.segment, fc.pos, list(st.stage ORDER BY st.pos) FILTER (st.is_attack) AS h FROM fc JOIN st
   ON st.source = fc.source AND st.segment = fc.segment AND st.pos BETWEEN fc.pos + 1 AND fc.pos + 6 GROUP BY 1, 2, 3),
 ot AS (SELECT {KEY}, timestamp, round(risk, 6) AS forecast_risk, risk >= {THR} AS predicted_attack,
  CASE WHEN risk >= {THR} THEN head ELSE 'None' END AS predicted_stage, list_max(aa) > 0 AS actual_attack,
  coalesce((SELECT s FROM (SELECT unnest(h) AS s, unnest(range(len(h))) AS o) GROUP BY s ORDER BY count(*) DESC, min(o) LIMIT 1), 'None') AS actual_stage,
  (risk >= {THR}) = (list_max(aa) > 0) AS correct FROM fc JOIN fx USING (source, segment, pos) WHERE pos + 6 < seg_len)"""
add("window_outcomes", OUT, "SELECT * FROM ot")
add("wrong_outcomes", OUT, "SELECT predicted_stage, actual_stage, count(*) AS windows FROM ot WHERE NOT correct GROUP BY 1, 2")


def judged(rows: str, **how) -> str:
    """Binary and ranking metrics of the score rows ``rows``, as a subquery with CTEs of its own."""
    return f"(WITH {rows}, {binary(**how)}, {ranking(how.get('keys', ''))} SELECT bm.*, roc_auc, pr_auc FROM bm{' JOIN rk USING (step)' if 'keys' in how else ', rk'})"


FULL = STEPS.replace("WHERE is_sample AND split = 'test'", "WHERE pos >= 11 AND pos + 6 < seg_len")
add("file_validation", FC, f"""SELECT 'forecast' AS part, * FROM {judged(FULL, thr=0.99, undefined='NULL')}
 UNION ALL SELECT 'onset', * FROM {judged(onsets('pos + 6 < seg_len'), thr=0.99, undefined='NULL')}""")
add("holdout_report", FC, f"""SELECT 'forecast' AS part, * FROM {judged(STEPS)} UNION ALL SELECT 'onset', * FROM {judged(ONSET_TEST)}
 UNION ALL SELECT 'step ' || step, * EXCLUDE (step) FROM {judged(STEP_KEY, keys='step')}""")

# -------------------------------------------------------------------------------------------------- drift
DRIFT = SCALE + ", lv AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, split, round({z(f)}, 9) AS v FROM sl, sc WHERE s_{f} > 1e-8 AND split IN ('train', 'test')" for f in FEATURES) + f"""),
ed AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {[i / 10 for i in range(11)]}))) AS e, avg(v) AS rm, count(*) AS rc
  FROM lv WHERE split = 'train' GROUP BY 1),
tn AS (SELECT feature, avg(v) AS xm, count(*) AS xc FROM lv WHERE split = 'test' GROUP BY 1),
bn AS (SELECT feature, split, len(list_filter(e[2:-2], lambda x: x <= v)) AS bin, count(*) AS n FROM lv JOIN ed USING (feature) GROUP BY 1, 2, 3),
bi AS (SELECT feature, unnest(range(0, greatest(len(e) - 1, 1))) AS bin FROM ed),
pp AS (SELECT bi.feature, bi.bin, greatest(coalesce(r.n, 0) / rc, 1e-4) AS pr, greatest(coalesce(x.n, 0) / xc, 1e-4) AS px
  FROM bi JOIN ed USING (feature) JOIN tn USING (feature)
  LEFT JOIN bn r ON r.feature = bi.feature AND r.bin = bi.bin AND r.split = 'train'
  LEFT JOIN bn x ON x.feature = bi.feature AND x.bin = bi.bin AND x.split = 'test'),
dr AS (SELECT feature, CASE WHEN any_value(len(e)) < 3 THEN CASE WHEN abs(any_value(xm - rm)) < 0.5 THEN 0.0 ELSE 1.0 END
   ELSE sum((px - pr) * ln(px / pr)) END AS psi, any_value(xm - rm) AS mean_shift FROM pp JOIN ed USING (feature) JOIN tn USING (feature) GROUP BY 1)"""
add("drift_psi", DRIFT, """SELECT feature, round(psi, 6) AS psi, round(mean_shift, 6) AS mean_shift, CASE WHEN psi >= 0.25 THEN 'significant'
 WHEN psi >= 0.10 THEN 'moderate' ELSE 'stable' END AS level FROM dr""")
add("drift_overall", DRIFT, """SELECT round(avg(CAST(psi >= 0.25 AS INT)), 6) AS significant_share,
 CASE WHEN avg(CAST(psi >= 0.25 AS INT)) > 0.25 THEN 'significant' WHEN avg(CAST(psi >= 0.25 AS INT)) > 0.08
 OR avg(CAST(psi >= 0.10 AS INT)) > 0.3 THEN 'moderate' ELSE 'stable' END AS overall FROM dr""")

# ------------------------------------------------------------------------------------------------ explain
AT = FC + f""", c2 AS (SELECT {KEY}, risk * (1 - risk) AS g, 1.5 * ({z('flow_count')}) AS cf, 1.0 * ({z('failed_flow_ratio')}) AS cr FROM fc, sc),
at_ AS (SELECT {KEY}, 'flow_count' AS feature, g * cf AS v, abs(cf) / (abs(cf) + abs(cr)) AS share, cf / 1.5 AS z FROM c2 UNION ALL
  SELECT {KEY}, 'failed_flow_ratio', g * cr, abs(cr) / (abs(cf) + abs(cr)), cr FROM c2),
ar AS (SELECT *, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY abs(v) DESC, feature DESC) AS INT) AS rank FROM at_)"""
add("attributions", AT, f"""SELECT {KEY}, rank, feature, round(v, 6) AS attribution, round(share, 6) AS share, round(z, 6) AS current_z,
 CASE WHEN v > 0 THEN 'raises risk' ELSE 'lowers risk' END AS direction FROM ar""")
add("attribution_by_window", FC, """SELECT CAST(i - 11 AS INT) AS "offset", CASE WHEN i = 11 THEN 1.0::DOUBLE ELSE 0.0 END AS share FROM range(0, 12) r(i)
 WHERE EXISTS (SELECT 1 FROM fc)""")
add("incident_drivers", INC + AT[len(FC):], f"""SELECT ii.id, rank, feature, round(v, 6) AS attribution, round(share, 6) AS share,
 CASE WHEN v > 0 THEN 'Raises' ELSE 'Lowers' END || ' the risk: ' || CASE feature WHEN 'flow_count' THEN '{FEATURE_LABELS['flow_count']}'
 ELSE '{FEATURE_LABELS['failed_flow_ratio']}' END AS sentence FROM ii JOIN ar ON ar.source = ii.source AND ar.segment = ii.segment AND ar.pos = ii.opened_pos""")
add("traffic_evidence", REG + ", ev AS (" + " UNION ALL ".join(
    f"SELECT {KEY}, timestamp, '{f}' AS feature, {f} AS cu, avg({f}) OVER (PARTITION BY source, segment ORDER BY pos ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING) AS me FROM st"
    for f in ("flow_count", "syn_ratio", "scan_score")) + ")", f"""SELECT {KEY}, timestamp, feature, round(cu, 6) AS current, round(me, 6) AS earlier_mean,
 CASE WHEN me <> 0 THEN round((cu - me) / abs(me), 6) END AS change FROM ev WHERE pos >= 11""")
add("feature_labels", REG, " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{FEATURE_LABELS.get(f, f.replace("_", " "))}' AS feature_label FROM st HAVING stddev_pop({model_space(f)}) > 1e-8" for f in FEATURES))
MIX = "SELECT CASE WHEN is_attack THEN stage ELSE 'Benign windows' END AS {n}, count(*) AS windows FROM st GROUP BY 1"
add("label_mix", REG, MIX.format(n="label"))
ids = " ".join(f"WHEN '{s}' THEN '{TACTIC_IDS[s]}'" for s in TACTIC_IDS)
acts = " ".join(f"WHEN '{s}' THEN {len(PLAYBOOKS[s][1])}" for s in PLAYBOOKS)
add("stage_playbooks", REG, f"""SELECT stage, windows, CASE stage {ids} ELSE '-' END AS tactic_id, CAST(CASE stage {acts} ELSE 2 END AS INT) AS actions
 FROM ({MIX.format(n='stage')})""")
labels = " ".join("WHEN '{}' THEN '{}'".format(s, ", ".join(k for k, v in EXACT_LABELS.items() if v == s)) for s in TACTIC_IDS)
add("stage_tactics", REG, f"""SELECT stage, count(*) AS windows, CASE stage {ids} END AS tactic_id,
 'https://attack.mitre.org/tactics/' || CASE stage {ids} END || '/' AS url, CASE stage {labels} END AS dataset_labels FROM st WHERE is_attack GROUP BY stage""")


# ---------------------------------------------------------------------------------------------- scenarios
def scenario(key: str, label: str, factors: dict[str, float]) -> str:
    def v(f):
        x = f"greatest({f} * {factors[f]!r}, 0.0)" if f in factors else f
        return f"least({x}, 1.0)" if f in factors and f in SCENARIO_RATIOS else x
    base = f"1.5 * ({z('flow_count', '(' + v('flow_count') + ')')}) + 1.0 * ({z('failed_flow_ratio', '(' + v('failed_flow_ratio') + ')')})"
    return f"SELECT {KEY}, '{key}' AS key, '{label}' AS scenario, {base} AS base FROM sl, sc WHERE pos >= 11"


SCEN = SCALE + ", sb AS (" + " UNION ALL ".join(
    scenario(k, a, b) for k, (a, b) in {"no_action": ("No action", {}), **SCENARIOS}.items()) + f"""),
so AS (SELECT {KEY}, key, scenario, list_transform(range(0, 6), lambda s: 1 / (1 + exp(-(base + 0.15 * s - 1.0)))) AS pp FROM sb),
sx AS (SELECT {KEY}, key, scenario, list_avg(pp) AS mr, list_max(pp) AS pk, len(list_filter(pp, lambda p: p >= {THR})) AS ab,
  nullif(list_position(list_transform(pp, lambda p: p >= {THR}), true), 0) AS fs FROM so)"""
add("scenario_summary", SCEN, """SELECT key, scenario, round(avg(mr), 6) AS mean_risk, round(max(pk), 6) AS peak_risk,
 CAST(sum(ab) AS BIGINT) AS steps_above_threshold, CAST(min(fs) AS BIGINT) AS first_alert_step,
 round((SELECT avg(mr) FROM sx WHERE key = 'no_action') - avg(mr), 6) AS risk_reduction_vs_no_action FROM sx GROUP BY 1, 2""")
add("scenario_by_origin", SCEN, f"""SELECT s.source, s.segment, s.pos, s.key, round(s.mr, 6) AS mean_risk, round(s.pk, 6) AS peak_risk,
 CAST(s.ab AS INT) AS steps_above_threshold, CAST(s.fs AS BIGINT) AS first_alert_step, round(n.mr - s.mr, 6) AS risk_reduction_vs_no_action
 FROM sx s JOIN sx n ON n.source = s.source AND n.segment = s.segment AND n.pos = s.pos AND n.key = 'no_action'""")

# -------------------------------------------------------------------------------------------------- views
add("traffic_stats", R300, """SELECT CAST(sum(flow_count) AS BIGINT) AS records, min(timestamp) AS start,
 max(timestamp) + INTERVAL 300 SECOND AS "end", count(*) AS windows, count(DISTINCT (source, segment)) AS segments,
 count(*) FILTER (filled) AS gap_filled_windows, count(*) FILTER (pos >= 11) AS forecastable_windows,
 max(seg_len) AS longest_segment_windows, CAST(epoch(max(timestamp) + INTERVAL 300 SECOND) - epoch(min(timestamp)) AS DOUBLE) AS duration_s FROM st""")


def shares(columns, agg) -> str:
    return "sh AS (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {agg.format(c=c)} AS share FROM st" for c in columns) + ")"


WEIGHTED = "sum({c} * flow_count) / sum(flow_count)"
add("protocol_mix", f"{REG}, {shares([c for c in BASE_FEATURES if c.startswith('protocol_')], WEIGHTED)}",
    "SELECT upper(replace(name, 'protocol_', '')) AS protocol, round(share, 6) AS share FROM sh WHERE share > 0")
add("port_mix", f"{REG}, {shares(PORTS, WEIGHTED)}",
    "SELECT replace(name, 'dst_port_', 'port ') AS port, round(share, 6) AS share FROM sh WHERE share > 0 ORDER BY sh.share DESC, port LIMIT 8")
add("top_ports_over_time", f"{REG}, {shares(PORTS[:-1], 'avg({c})')}",
    "SELECT replace(name, 'dst_port_', '') AS port, round(share, 6) AS share FROM sh WHERE share > 0 ORDER BY sh.share DESC, port LIMIT 5")
add("traffic_totals", regular(600, 19), """SELECT sum(flow_count) AS flows, sum(packets_total) AS packets, sum(bytes_total) AS bytes,
 count(*) FILTER (flow_count > 0 AND NOT filled) AS active_windows, count(*) AS windows,
 round(sum(duration_mean * flow_count) / sum(flow_count), 6) AS mean_duration FROM st""")
PORT_ROWS = "pw AS (" + " UNION ALL ".join(
    f"SELECT {KEY}, timestamp, {i} AS i, '{c.removeprefix('dst_port_')}' AS port, {c} AS share FROM st" for i, c in enumerate(PORTS)) + ")"
add("top_ports_of_windows", f"{REG}, {PORT_ROWS}", f"""SELECT {KEY}, timestamp, CAST(rank AS INT) AS rank, port, round(share, 6) AS share FROM
 (SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY share DESC, i) AS rank FROM pw WHERE share > 0) WHERE rank <= 5""")
add("source_coverage", R300, """SELECT source, count(*) AS windows, count(DISTINCT segment) AS segments, max(seg_len) AS longest_segment,
 min(timestamp) AS start, max(timestamp) AS "end", count(*) FILTER (is_attack) AS attack_windows,
 round((epoch(max(timestamp)) - epoch(min(timestamp))) / 3600, 6) AS span_hours, median(flow_count) AS median_flows FROM st GROUP BY 1""")
add("stage_counts_by_source", REG, "SELECT source, stage, count(*) AS windows FROM st WHERE is_attack GROUP BY 1, 2")
TRAIN = FC + ", tt AS (SELECT unnest(ss) AS s, unnest(aa) AS y FROM fc WHERE is_sample AND split = 'train')"
add("class_weights", TRAIN + ", cn AS (SELECT s, count(*) AS n FROM tt WHERE s >= 0 GROUP BY 1), cw AS (SELECT *, sqrt((SELECT sum(n) FROM cn) / (4.0 * n)) AS w FROM cn)",
    f"SELECT {VOCAB}[s + 1] AS stage, n, round(w / (SELECT avg(w) FROM cw), 6) AS weight FROM cw")
add("positive_weight", TRAIN, """SELECT sum(y) AS positives, count(*) - sum(y) AS negatives,
 round(least(greatest((count(*) - sum(y)) / greatest(sum(y), 1), 1), 10), 6) AS positive_weight FROM tt""")
add("alert_counts", ALERTS, f"""SELECT count(*) AS alerts, count(*) FILTER (status = 'OPEN') AS open,
 count(*) FILTER (peak_severity = 'CRITICAL') AS critical, round(avg(duration_windows) * 3600, 6) AS mean_length_s,
 round(max(peak_risk), 6) AS peak_risk, CASE WHEN bool_or(peak_severity = 'CRITICAL') THEN 'HIGH RISK' ELSE 'WARNING' END AS highest_severity,
 (SELECT count(*) FROM ra WHERE ev = 'escalated') AS escalations FROM al""")
add("escalations_per_alert", ALERTS, """SELECT source, id AS alert_id, (SELECT count(*) FROM ra WHERE ra.source = al.source AND ra.id = al.id
 AND ev = 'escalated') AS escalations FROM al""")
add("current_windows", FC, f"""SELECT {KEY}, timestamp, round(risk, 6) AS risk, {state('risk')} AS state,
 CASE WHEN head = 'Benign' THEN 'None' ELSE head END AS forecast_stage, flow_count AS flows, packets_total AS packets, bytes_total AS bytes,
 filled, is_attack AS actual_attack, CASE WHEN is_attack THEN stage ELSE 'None' END AS actual_stage FROM fc""")
add("observed_history", FC + """, pf AS (SELECT st.*, fc.p1 AS q FROM st LEFT JOIN fc ON fc.source = st.source AND fc.segment = st.segment AND fc.pos = st.pos - 1)""",
    """SELECT o.source, o.segment, o.pos, CAST(h.pos - o.pos AS INT) AS "offset", h.timestamp, h.flow_count AS flows, h.packets_total AS packets,
 h.bytes_total AS bytes, round(h.q, 6) AS prior_forecast, h.is_attack AS actual_attack
 FROM st o JOIN pf h ON h.source = o.source AND h.segment = o.segment AND h.pos BETWEEN o.pos - 11 AND o.pos WHERE o.pos >= 11""")
services = " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in PORT_SERVICES.items())
best = "greatest(" + ", ".join(PORTS[:-1]) + ")"
add("flagged_traffic", FC + f""", fg AS (SELECT *, CASE WHEN {best} > 0 THEN {text(p.removeprefix('dst_port_') for p in PORTS[:-1])}[list_position([{', '.join(PORTS[:-1])}], {best})]
   ELSE 'other' END AS port FROM fc WHERE risk >= {WATCH!r} OR is_attack ORDER BY timestamp DESC, source LIMIT 12)""",
    f"""SELECT source, timestamp, round(risk, 6) AS risk, head AS headline_stage, flow_count AS flows, unique_dst_ports AS distinct_ports,
 {r6('syn_ratio', 'failed_flow_ratio', 'scan_score')}, port, stage AS dataset_label, CASE port {services} ELSE port END AS service FROM fg""")
add("system_overview", ALERTS, """SELECT (SELECT count(DISTINCT source) FROM fc) AS analyses,
 (SELECT count(*) FROM (SELECT source FROM fc GROUP BY 1 HAVING bool_or(is_attack))) AS labelled, count(*) AS alerts FROM al""")

# ------------------------------------------------------------------------------------------------ quality
active = " + ".join(f"CAST(s_{f} > 1e-8 AND NOT u_{f} > 0 AS INT)" for f in FEATURES)
novel = " + ".join(f"CAST(NOT s_{f} > 1e-8 AND u_{f} > 0 AS INT)" for f in OPTIONAL_FEATURES)
add("traffic_checks", SCALE + ", us AS (SELECT " + ", ".join(f"sum(abs({f})) AS u_{f}" for f in FEATURES) + f""" FROM sl),
 k AS (SELECT {active} AS un, {novel} AS nv FROM sc, us), b0 AS (SELECT count(*) AS n, min(timestamp) AS t0, max(timestamp) AS t1, count(*) FILTER (pos >= 11) AS able FROM sl)""",
    """SELECT CAST(no AS INT) AS no, "check", status, detail FROM (
 SELECT 1 AS no, 'File format recognized' AS "check", CASE WHEN n > 0 THEN 'ok' ELSE 'fail' END AS status, 'Flow CSV' AS detail FROM b0
 UNION ALL SELECT 2, 'Timestamp detected', 'ok', strftime(t0, '%Y-%m-%d %H:%M:%S') || ' to ' || strftime(t1, '%Y-%m-%d %H:%M:%S') FROM b0
 UNION ALL SELECT 3, 'Required traffic fields detected', 'ok', 'optional fields present: none' FROM b0
 UNION ALL SELECT 4, 'Temporal ordering verified', 'ok', '0 windows out of order' FROM b0
 UNION ALL SELECT 5, 'Compatible feature representation', CASE WHEN un + nv > 0 THEN 'warn' ELSE 'ok' END, '0 missing, ' || un || ' empty, ' || nv || ' ignored features' FROM k
 UNION ALL SELECT 6, 'Sufficient temporal history', CASE WHEN able > 0 THEN 'ok' ELSE 'fail' END, able || ' windows have the history a forecast needs' FROM b0
 UNION ALL SELECT 7, 'No training performed', 'ok', 'the scaler and the model are only read' FROM b0)""")
add("order_violations", R300, """SELECT count(*) AS bad FROM (SELECT timestamp, lag(timestamp) OVER (PARTITION BY source, segment ORDER BY pos) AS b FROM st)
 WHERE timestamp <= b""")
add("sanity_checks", FC, """SELECT * REPLACE (round(value, 6) AS value) FROM (
 SELECT 'timestamps sane' AS "check", min(year(timestamp)) >= 2000 AND max(year(timestamp)) <= 2035 AS passed, CAST(min(year(timestamp)) AS DOUBLE) AS value FROM st
 UNION ALL SELECT 'no negative durations or counts', count(*) FILTER (least(duration_mean, flow_count, packets_total, bytes_total) < 0) = 0,
   CAST(count(*) FILTER (least(duration_mean, flow_count, packets_total, bytes_total) < 0) AS DOUBLE) FROM st
 UNION ALL SELECT 'attack windows present', count(*) FILTER (is_attack) > 0, CAST(count(*) FILTER (is_attack) AS DOUBLE) FROM st
 UNION ALL SELECT 'probabilities valid', min(p1) >= 0 AND max(p6) <= 1, max(p6) FROM fc
 UNION ALL SELECT 'forecast depends on the step', avg(list_stddev_pop(pp)) > 1e-4, avg(list_stddev_pop(pp)) FROM fc
 UNION ALL SELECT 'risk higher during attacks', coalesce(avg(risk) FILTER (is_attack) - avg(risk) FILTER (NOT is_attack) > 0.1, false),
   avg(risk) FILTER (is_attack) - avg(risk) FILTER (NOT is_attack) FROM fc)""")

# ------------------------------------------------------------------------------------------------- streams
#: A stream that has been closed gives what the batch gives.
ORACLES["stream_window_states"] = ORACLES["window_states"]
add("stream_regular_states", REG, f"""SELECT timestamp, {VALUES}, stage, is_attack, source, filled, segment, pos,
 CAST(0 AS BIGINT) AS late FROM st""")
ORACLES["stream_alert_events"] = ORACLES["alert_events"]


# ------------------------------------------------------------------------------------------------- fingerprints
def tree(table: str, key: str, columns: list[str]) -> str:
    """CTEs <table>_n: the nodes of a digest tree with 64 keys a leaf and 16 nodes below a node; the root is marked done."""
    text_of = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"""{table}_r AS (SELECT {key} AS k, sha256(concat_ws('|', {text_of})) AS d FROM {table}),
{table}_l AS (SELECT (k - (SELECT min(k) FROM {table}_r)) // 64 AS ix, sha256(string_agg(d, '' ORDER BY k, d)) AS d FROM {table}_r GROUP BY 1),
{table}_n(lv, ix, d, top, done) AS (SELECT 0, ix, d, (SELECT max(ix) FROM {table}_l), false FROM {table}_l
  UNION ALL SELECT lv + 1, ix // 16, sha256(string_agg(d, '' ORDER BY ix)), any_value(top // 16), any_value(top < 16) FROM {table}_n
  WHERE NOT done GROUP BY lv, ix // 16)"""


TREES = {"events": ("event_id", ["event_id", "user_id", "event_type", "props"]),
         "orders": ("o_orderkey", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]),
         "documents": ("doc_id", ["doc_id", "text", "lang", "source", "n_chars"]), "pages": ("page_id", ["page_id", "url", "html"])}
add("table_fingerprint", ",\n".join(tree(t, *x) for t, x in TREES.items()), " UNION ALL ".join(
    f"""SELECT '{t}' AS "table", (SELECT count(*) FROM {t}_r) AS rows, d AS digest FROM {t}_n WHERE done""" for t in TREES))


# ------------------------------------------------------------------------------------------------- stored tables, analyses
SPOILT = R300 + """,
sd AS (SELECT source, segment, pos, timestamp FROM st WHERE pos % 50 <> 7 UNION ALL SELECT source, segment, pos, timestamp FROM st WHERE pos % 40 = 5)"""
add("stored_table_checks", SPOILT + """,
od AS (SELECT *, lag(timestamp) OVER (PARTITION BY source, segment ORDER BY timestamp + CASE WHEN pos % 30 = 11 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, pos) AS b FROM sd)""",
    """SELECT source, segment, count(*) AS rows, CAST((epoch(max(timestamp)) - epoch(min(timestamp))) / 300 + 1 AS BIGINT) - count(DISTINCT timestamp) AS missing,
 count(*) - count(DISTINCT timestamp) AS repeated, count(*) FILTER (timestamp <= b) AS disordered FROM od GROUP BY 1, 2""")
add("stored_table_positions", SPOILT + """,
sn AS (SELECT source, segment, count(*) AS n FROM sd GROUP BY 1, 2),
cu AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY segment) AS upto, sum(n) OVER (PARTITION BY source) AS rows FROM sn)""",
    """SELECT source, segment, 0 AS low, n - 1 AS high, n AS places, n AS seg_len, CAST(upto - n AS BIGINT) AS first_row,
 CAST(upto - 1 AS BIGINT) AS last_row, CAST(rows AS BIGINT) AS source_rows FROM cu""")
add("analysis_summary", INC, f"""SELECT source, count(*) AS windows, count(*) FILTER (is_attack) AS attack_windows,
 (SELECT count(*) FROM tl WHERE tl.source = s.source) AS scored, (SELECT count(*) FROM tl WHERE tl.source = s.source AND risk >= {THR}) AS flagged,
 (SELECT round(max(risk), 6) FROM tl WHERE tl.source = s.source) AS peak_risk, (SELECT count(*) FROM al WHERE al.source = s.source) AS alerts,
 (SELECT count(*) FROM al WHERE al.source = s.source AND status = 'OPEN') AS open,
 (SELECT count(*) FROM ii WHERE ii.source = s.source AND severity = 'Critical') AS critical,
 (SELECT count(*) FROM ii WHERE ii.source = s.source AND confirmed = 1) AS confirmed FROM st s GROUP BY source""")
add("stream_packet_flows", packet_flows(21600, 86400)[0], """SELECT capture, CAST(any_value(proto) AS BIGINT) AS proto, client || ':' || any_value(cport) AS client,
 fl AS first_packet, min(t0) AS first_ts, arg_max(ts, packet_no) AS last_ts, count(*) AS packets, CAST(sum(payload) AS BIGINT) AS bytes
 FROM g GROUP BY capture, client, fl""")

LINEAR = " + ".join(f"({(f * 7) % 11 - 5} / 40.0::DOUBLE) * ({z(n)})" for f, n in enumerate(FEATURES) if (f * 7) % 11 != 5)
add("linear_scores", SCALE + f""",
dt AS (SELECT source, segment, pos, {LINEAR} AS dot FROM sl, sc),
hs AS (SELECT source, segment, pos, {" + ".join(f"power(0.9::DOUBLE, {b}) * lag(dot, {b}) OVER w" for b in range(12))} AS h FROM dt
       WINDOW w AS (PARTITION BY source, segment ORDER BY pos))""",
    "SELECT source, segment, pos, " + ", ".join(
        f"round(1 / (1 + exp(-({(h + 1) / 6!r}::DOUBLE * 0.5 * h + {0.1 * h - 0.5!r}::DOUBLE))), 6) AS p{h + 1}, "
        f"round(1 / (1 + exp({(h + 1) / 6!r}::DOUBLE * (0.2::DOUBLE - -0.1::DOUBLE) * h + 0.2::DOUBLE)), 6) AS d{h + 1}" for h in range(6))
    + " FROM hs WHERE pos >= 11")

AGAINST = SCALE + ", lv AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, '{k}' AS split, round({z(f)}, 9) AS v FROM sl, sc WHERE s_{f} > 1e-8" + (" AND split = 'train'" if k == "train" else "")
    for f in FEATURES for k in ("train", "test")) + ")" + DRIFT[DRIFT.index(",\ned AS"):]
add("drift_against_background", AGAINST, """SELECT feature, round(psi, 6) AS psi, round(mean_shift, 6) AS mean_shift,
 CASE WHEN psi >= 0.25 THEN 'significant' WHEN psi >= 0.10 THEN 'moderate' ELSE 'stable' END AS level FROM dr""")
add("linear_shap", FC + f""",
ce AS (SELECT avg({z('flow_count')}) AS mf, avg({z('failed_flow_ratio')}) AS mr FROM sl, sc WHERE is_sample AND split = 'train'),
c2 AS (SELECT {KEY}, {z('flow_count')} AS zf, {z('failed_flow_ratio')} AS zr, mf, mr FROM fc, sc, ce),
pz AS (SELECT *, 1.5 * (zf - mf) AS cf, 1.0 * (zr - mr) AS cr FROM c2),
sh AS (SELECT {KEY}, 'flow_count' AS feature, cf AS v, abs(cf) / (abs(cf) + abs(cr)) AS share, zf AS z FROM pz UNION ALL
  SELECT {KEY}, 'failed_flow_ratio', cr, abs(cr) / (abs(cf) + abs(cr)), zr FROM pz)""",
    f"""SELECT {KEY}, CAST(row_number() OVER (PARTITION BY {KEY} ORDER BY abs(v) DESC, feature DESC) AS INT) AS rank, feature,
 round(v, 6) AS shap_value, round(share, 6) AS share, round(z, 6) AS current_z FROM sh""")
add("background_sample", SPLIT, f"""SELECT source, segment, pos, 12 AS windows FROM sl WHERE is_sample AND split = 'train'
 ORDER BY md5('{O.seed}|' || source || '|' || segment || '|' || pos) LIMIT 100""")

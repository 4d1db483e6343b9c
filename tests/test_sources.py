"""Flow CSVs, state tables, captures, history."""
import datetime as dt
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.functions.labels import simple_name, stage_of_label, unmapped_labels
from netstate.operators.packets import packet_flows
from netstate.operators.states import window_states
from netstate.sources import history, tables
from netstate.sources import captures
from netstate.sources.captures import read_captures, write_captures
from netstate.sources.flow_csv import describe_files, read_flows, resolve_columns, row_report

O = Options()
HEADER = ("Dst Port,Protocol,Timestamp,Flow Duration,Tot Fwd Pkts,Tot Bwd Pkts,TotLen Fwd Pkts,TotLen Bwd Pkts,"
          "Flow IAT Mean,Flow IAT Std,Flow IAT Max,Init Fwd Win Byts,Label\n")


@pytest.mark.parametrize("raw, stage", [
    ("Benign", "Benign"), ("normal", "Benign"), ("0", "Benign"), ("  ", "Benign"), (None, "Benign"),
    ("DoS attacks-Hulk", "Impact"), ("DDOS attack-HOIC", "Impact"), ("Infilteration", "Lateral Movement"),
    ("Bot", "Command and Control"), ("SSH-Bruteforce", "Credential Access"), ("SQL Injection", "Initial Access"),
    ("Totally New Attack", "Initial Access")])
def test_labels(spark, raw, stage):
    df = spark.createDataFrame([(raw,)], "raw_label string")
    assert df.select(stage_of_label(F.col("raw_label"), O)).first()[0] == stage
    assert unmapped_labels(df).count() == (raw == "Totally New Attack")


def test_headers():
    assert simple_name("  Tot Fwd Pkts ") == "tot_fwd_pkts"
    fields = resolve_columns(["Dst Port", "dst_port", "Protocol", "ts"])
    assert fields == {"timestamp": 3, "dst_port": 0, "protocol": 2}


def test_messy_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER + "80,6,01/02/2018 08:00:01,1000000,2,1,100,50,Infinity,1,5,-1,Benign\n"
        "22,6,1/2/2018 8:00:11,-5,2,0,10,0,1,1,5,8192,SSH-Bruteforce\n" + HEADER
        + "x,6,01/02/2018 08:00:12,1,1,1,1,1,1,1,1,1,Benign\n"
        "80,17,13/02/2018 08:00:01,1,1,1,1,1,1,1,1,1,Weird,one,more\n")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.csv").write_text("ts,dport,proto\n1519000000000,53,udp\n1519000001000,53,unas\n")
    (tmp_path / "sub" / "my_states.csv").write_text("a,b\n1,2\n")
    rows = read_flows(spark, str(tmp_path), O).orderBy("source", "timestamp").collect()
    assert [r["source"] for r in rows] == ["a.csv", "a.csv", "b.csv", "b.csv"]
    first, second = rows[:2]
    assert first["timestamp"] == dt.datetime(2018, 2, 1, 8, 0, 1) and first["flow_duration"] == 1.0
    assert first["iat_mean"] is None and first["win_fwd"] is None and first["ttl"] is None
    assert second["flow_duration"] == 0 and second["stage"] == "Credential Access" and second["win_fwd"] == 8192
    assert [r["protocol"] for r in rows[2:]] == [17, 0] and rows[2]["timestamp"] == dt.datetime(2018, 2, 19, 0, 26, 40)
    assert describe_files(spark, str(tmp_path), O).count() == 2
    state = window_states(read_flows(spark, str(tmp_path), O), O).where("source = 'b.csv'").first()
    assert state["failed_flow_ratio"] == 1 and state["protocol_other"] > 0


def test_formats_that_change_late_in_a_file(spark, tmp_path):
    line = "80,{},{},1,1,1,1,1,1,1,1,1,Benign\n"
    (tmp_path / "a.csv").write_text(
        HEADER + "".join(line.format(6, f"{13 + i % 9}/02/2018 08:00:01") for i in range(2500))
        + "".join(line.format("tcp", f"2018-02-{13 + i % 9} 08:00:01") for i in range(900))
        + line.format("udp", "1519000000") + line.format("udp", "1519000000000") + line.format(6, "no time") + HEADER)
    flows = read_flows(spark, str(tmp_path), O)
    assert {r["protocol"]: r["count"] for r in flows.groupBy("protocol").count().collect()} == {6.0: 3400, 17.0: 2}
    assert flows.where("protocol = 17").select("timestamp").distinct().first()[0] == dt.datetime(2018, 2, 19, 0, 26, 40)
    assert [tuple(r) for r in row_report(spark, str(tmp_path), O).collect()] == [("a.csv", 3404, 3402, 0, 1, 1, 0)]


def test_mixed_folder(spark, tmp_path):
    (tmp_path / "b.csv").write_text(HEADER + "80,6,01/02/2018 08:00:01,1000000,2,1,100,50,1,1,5,-1,Benign\n" * 3)
    packet = frame("10.0.0.1", "10.0.0.2", 5, 80, 6, 60, 2, 8192, 0, 1, False)
    (tmp_path / "a.PCAP").write_bytes(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
                                      + struct.pack("<IIII", 1517472000, 0, len(packet), len(packet)) + packet)
    states, info = tables.load_traffic(spark, str(tmp_path), Options(min_segment_windows=1))
    assert {r["source"] for r in states.select("source").distinct().collect()} == {"a.PCAP", "b.csv"}
    assert info["kind"] == "mixed" and info["labelled"] and "ttl" in info["optional_fields"]
    tables.write_states(states, str(tmp_path / "own"))
    with pytest.raises(ValueError, match="state tables"):
        tables.load_traffic(spark, str(tmp_path), O)


def test_missing_field(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="timestamp"):
        read_flows(spark, str(tmp_path), O)


def test_unsw_headerless_equals_headed(spark, tmp_path):
    from netstate.sources.flow_csv import UNSW_COLUMNS
    line = ["1.1.1.1", "80", "2.2.2.2", "53", "tcp", "CON", "0.5", "10", "20", "64", "60", "1", "0", "-", "1", "1", "2", "3",
            "255", "255"] + ["0"] * 8 + ["1421927414", "1421927415", "12.5", "1"] + ["0"] * 15 + [" Fuzzers", "1"]
    for name, head in (("plain", ""), ("headed", ",".join(UNSW_COLUMNS) + "\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "u.csv").write_text(head + (",".join(line) + "\n") * 2)
    a, b = (read_flows(spark, str(tmp_path / n), O).collect() for n in ("plain", "headed"))
    assert a == b and len(a) == 2 and a[0]["flow_duration"] == 0.5 and a[0]["stage"] == "Command and Control"


def test_state_tables(spark, sf, tmp_path):
    from netstate.plans.registry import G600, regular
    table = regular(spark, sf, G600)
    tables.write_states(table, str(tmp_path / "p"))
    tables.write_states(table.drop("stage"), str(tmp_path / "c"), "csv")
    for path in ("p", "c"):
        back, info = tables.load_traffic(spark, str(tmp_path / path), G600)
        assert info["kind"] == "state-table" and info["labelled"] and back.count() == table.count()
        same = back.select("source", "segment", "pos", "row").exceptAll(table.select("source", "segment", "pos", "row"))
        assert same.isEmpty()
    tables.export(table.select("source", F.array("stage").alias("s")), str(tmp_path / "e"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "e")).columns == ["source", "s"]


def test_history(spark, sf, tmp_path):
    from netstate.plans import registry as q
    root, when = str(tmp_path / "h"), dt.datetime(2024, 5, 1, 12)
    args = (q.regular(spark, sf), q.scored(spark, sf), q.raised(spark, sf), 0.6, "flow-csv", True)
    first = history.save_analysis(root, "Day One.csv", when, "Ann", *args)
    second = history.save_analysis(root, "b.csv", when + dt.timedelta(hours=1), "bob", *args)
    assert first == "20240501-120000-day-one"
    assert [r["id"] for r in history.list_history(spark, root).collect()] == [second, first]
    assert [r["id"] for r in history.list_history(spark, root, "ANN").collect()] == [first]
    assert history.load_analysis(spark, root, first).count() == q.regular(spark, sf).count()
    history.delete_analysis(spark, root, first, when)
    assert [r["id"] for r in history.list_history(spark, root).collect()] == [second]
    with pytest.raises(KeyError):
        history.load_analysis(spark, root, first)


# ------------------------------------------------------------------------------------------------ packets
def frame(src, dst, sport, dport, proto, ttl, flags, win, payload, seq, vlan):
    a, b = (bytes(map(int, x.split("."))) for x in (src, dst))
    l4 = {6: struct.pack("!HHIIBBHHH", sport, dport, seq, 0, 80, flags, win, 0, 0),
          17: struct.pack("!HHHH", sport, dport, 8 + payload, 0)}.get(proto, b"\x08" + b"\0" * 7) + b"\0" * payload
    ip = struct.pack("!BBHHHBBH", 0x45, 0, 20 + len(l4), 0, 0, ttl, proto, 0) + a + b
    return b"\x11" * 12 + (b"\x81\0\0\1" if vlan else b"") + b"\x08\0" + ip + l4


def test_packet_flows_against_brute_force(spark, tmp_path):
    rng, t, packets = np.random.default_rng(1), 1.7e9, []
    for _ in range(1500):
        t += float(rng.exponential(3.0)) + 200 * (rng.random() < 0.003)
        server, client = ("10.0.0.1", 80), (f"10.0.0.{rng.integers(2, 5)}", 1000 + int(rng.integers(0, 2)))
        x, y = (server, client) if rng.random() < .4 else (client, server)
        packets.append((t, (x[0], y[0], x[1], y[1], int(rng.choice([6, 6, 17, 1])), int(rng.integers(30, 64)),
                            int(rng.integers(0, 64)), int(rng.integers(0, 65535)), int(rng.choice([0, 100, 200])),
                            int(rng.integers(0, 20)), bool(rng.random() < .2))))
    with open(tmp_path / "x.pcap", "wb") as f:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for ts, p in packets:
            b = frame(*p)
            f.write(struct.pack("<IIII", int(ts), int((ts % 1) * 1e6), len(b), len(b)) + b)
        f.write(struct.pack("<IIII", int(t) + 1, 0, 14, 14) + b"\x11" * 12 + b"\x86\xdd")
    expected, alive = [], {}
    for ts, (src, dst, sport, dport, proto, ttl, flags, win, payload, seq, _) in packets:
        ts = int(ts) + int((ts % 1) * 1e6) * 1e-6
        if proto == 1:
            sport = dport = 0
        key = (proto, *sorted([(src, sport), (dst, dport)]))
        flow = alive.get(key)
        if flow is None or ts - flow["times"][-1] > 120 or ts - flow["times"][0] > 600:
            flow = alive[key] = {"src": src, "sport": sport, "proto": proto, "times": [], "fwd": [], "bytes": [0, 0],
                                 "seen": [], "win": None}
            expected.append(flow)
        forward = (src, sport) == (flow["src"], flow["sport"])
        flow["times"].append(ts)
        flow["bytes"][not forward] += payload
        if forward:
            flow["fwd"].append(ttl)
            if proto == 6:
                flow["win"] = win if flow["win"] is None else flow["win"]
                flow["seen"] += [(seq, payload, flags & 7)] if payload else []
    flows = packet_flows(read_captures(spark, str(tmp_path), range_bytes=20_000))
    got = sorted((round(r["flow_duration"], 4), r["src_ip"], r["src_port"], r["protocol"], r["fwd_packets"], r["bwd_packets"], r["fwd_bytes"], r["bwd_bytes"],
                  r["retransmissions"], round(r["ttl"], 6), round(r["iat_mean"], 5), round(r["iat_std"], 4),
                  r["win_fwd"] if r["protocol"] == 6 else None) for r in flows.collect())
    want = []
    for f in expected:
        gaps = np.diff([f["times"][0], *f["times"]])
        want.append((round(f["times"][-1] - f["times"][0], 4), f["src"], float(f["sport"]), float(f["proto"]),
                     float(len(f["fwd"])), float(len(f["times"]) - len(f["fwd"])), float(f["bytes"][0]),
                     float(f["bytes"][1]), float(len(f["seen"]) - len(set(f["seen"]))), round(np.mean(f["fwd"]), 6),
                     round(gaps.mean(), 5), round(gaps.std(), 4), f["win"] if f["proto"] == 6 else None))
    assert got == sorted(want) and max(x[0] for x in want) > 590


@pytest.mark.parametrize("order, magic, ticks", [("<", 0xA1B2C3D4, 10 ** 6), (">", 0xA1B23C4D, 10 ** 9)])
def test_captures_in_byte_ranges(spark, tmp_path, order, magic, ticks):
    """Payloads that look like records, packets longer than a range, a record that the file cuts off."""
    rng, records = np.random.default_rng(7), []
    decoy = struct.pack(order + "IIII", 1_700_000_000, 5, 4, 4) + b"abcd"
    for i in range(400):
        size = int(rng.choice([0, 1, 14, 60, 500, 5000], p=[.05, .05, .2, .4, .28, .02]))
        body = b"e" * 60 if i == 399 else decoy * 40 if i % 17 == 0 else rng.integers(0, 256, size, dtype=np.uint8).tobytes()
        records.append((1_700_000_000 + i, i % 1000, body))
    data = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, 101) + b"".join(
        struct.pack(order + "IIII", s, f, len(b), max(1, len(b))) + b for s, f, b in records)
    for name, cut in (("a.pcap", 0), ("b.pcap", 7), ("c.cap", len(data) - 24)):
        (tmp_path / name).write_bytes(data[:len(data) - cut])
    last = records[-1][2]
    for range_bytes in (100, 1000, 1 << 20):
        got = {}
        for r in read_captures(spark, str(tmp_path), range_bytes=range_bytes).collect():
            got.setdefault(r["capture"], {})[r["packet_no"]] = (round(r["ts"], 5), r["linktype"], bytes(r["frame"]))
        assert set(got) == {"a.pcap", "b.pcap"}
        for name, end in (("a.pcap", last), ("b.pcap", last[:-7])):
            want = [(round(s + f / ticks, 5), 101, b) for s, f, b in records]
            want[-1] = (*want[-1][:2], end)
            assert [got[name][i] for i in range(len(records))] == want and len(got[name]) == len(records)


def test_a_border_needs_a_run():
    body = b"".join(struct.pack("<IIII", 1_700_000_000 + i, i, 20, 20) + b"x" * 20 for i in range(8))
    assert captures._border(b"zz" + body, "<", 10 ** 6, False) == 2
    assert captures._border(body[:100], "<", 10 ** 6, False) == -1
    assert captures._border(b"\0" * 300, "<", 10 ** 6, True) == -1


def test_captures_are_written_and_read_again(spark, tmp_path):
    rows = [(f"{c}.pcap", i, 1.7e9 + i / 8, 1, bytes([i % 256] * (i % 50))) for c in "ab" for i in range(300)]
    schema = "capture string, packet_no long, ts double, linktype int, frame binary"
    written = write_captures(spark.createDataFrame(rows, schema), str(tmp_path)).collect()
    assert sorted(map(tuple, written)) == [("a.pcap", 300), ("b.pcap", 300)]
    got = sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in read_captures(spark, str(tmp_path), range_bytes=777).collect())
    assert got == rows


def test_flows_are_cut_by_a_chain_of_timeouts(spark):
    """Clocks that step back, equal times, exact borders."""
    from netstate.operators.packets import with_flow
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for c in range(6):
        t, begin, before = 1000.0, None, None
        for i in range(400):
            t += float(rng.choice([0, 1, 5, 30, -40, 100], p=[.2, .3, .3, .1, .05, .05]))
            rows.append(("x", c * 1000 + i, t, 6, f"10.0.0.{c}", "10.1.1.1", 1, 2))
            if before is None or t - before > 90 or t - begin[0] > 60:
                begin = (t, c * 1000 + i)
            want[c * 1000 + i] = begin[1]
            before = t
    packets = spark.createDataFrame(rows, "capture string, packet_no long, ts double, proto int, src string, dst string, sport int, dport int")
    got = {r["packet_no"]: r["begin"]["packet_no"] for r in with_flow(packets, 90.0, 60.0).select("packet_no", "begin").collect()}
    assert got == want and len(set(want.values())) > 100


def test_flows_go_on_across_chunks(spark, monkeypatch):
    """Sessions and flows that begin in an earlier chunk, conversations that skip chunks; as with one chunk, and the rows come from written tables."""
    from netstate.operators import packets as p
    rng = np.random.default_rng(4)
    rows, t = [], 1000.0
    for i in range(900):
        t += float(rng.choice([0, 1, 5, 30, 100], p=[.2, .4, .3, .07, .03]))
        c = int(rng.choice([0, 1, 2], p=[.7, .28, .02]))
        rows.append(("x", i, t, 6, f"10.0.0.{c}", "10.1.1.1", 1, 2))
    packets = spark.createDataFrame(rows, "capture string, packet_no long, ts double, proto int, src string, dst string, sport int, dport int")

    def flows():
        found = p.with_flow(packets, 90.0, 60.0)
        assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
        return sorted((r["packet_no"], r["begin"]["packet_no"], r["begin"]["src"], r["gap"]) for r in found.collect())

    whole = flows()
    assert len({r[1] for r in whole}) > 30 and len(whole) == 900
    monkeypatch.setattr(p, "PACKET_CHUNK", 13)
    assert flows() == whole


def test_all_rows_elect_the_format(spark, tmp_path):
    """The first 2 500 rows could be day-first or month-first; those after them tell."""
    def lines(stamps):
        return "".join(f"80,6,{t},1000000,1,1,10,10,1,1,1,100,Benign\n" for t in stamps)
    month = [f"03/04/2018 08:{i // 60 % 60:02d}:{i % 60:02d}" for i in range(2500)] + [f"04/{13 + i % 15}/2018 10:00:00" for i in range(600)]
    (tmp_path / "a.csv").write_text(HEADER + lines(month))
    (tmp_path / "b.csv").write_text(HEADER + lines(["03/04/2018 08:00:00 AM", "13/04/2018 11:30:00 PM"] * 5))
    (tmp_path / "c.csv").write_text(HEADER + lines([1517472000000 + i for i in range(5)]))
    got = {r["source"]: r["t"] for r in read_flows(spark, str(tmp_path), O).groupBy("source").agg(F.min("timestamp").alias("t")).collect()}
    assert got == {"a.csv": dt.datetime(2018, 3, 4, 8, 0, 0), "b.csv": dt.datetime(2018, 4, 3, 8, 0, 0), "c.csv": dt.datetime(2018, 2, 1, 8, 0, 0)}
    assert read_flows(spark, str(tmp_path), O).count() == 3115

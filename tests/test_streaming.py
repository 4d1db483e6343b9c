"""Streams give what the batch operators give."""
import uuid
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators.alerts import alert_events
from netstate.operators.grid import regular_states
from netstate.operators.states import window_states
from netstate.plans import registry as q
from netstate.plans.events import event_flows, flows_of_events
from netstate.streaming import states as st

O = Options(window_seconds=3600)


def in_order(df, column, path, n=2):
    """Write ``df`` as ``n`` files, oldest first."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    for i in range(n):
        part = df.where(F.col(column) >= low + i * (high - low) / n)
        if i < n - 1:
            part = part.where(F.col(column) < low + (i + 1) * (high - low) / n)
        part.coalesce(1).write.mode("append").parquet(path)


def test_window_states_leave_as_the_watermark_passes(spark, sf, tmp_path):
    st.use_rocksdb(spark)
    events = spark.read.parquet(f"{sf}/events.parquet")
    in_order(events, "ts", str(tmp_path / "in"))
    flows = flows_of_events(st.replay_files(spark, str(tmp_path / "in"), events.schema), O)
    streamed = q.tidy(st.run_to_table(st.stream_window_states(flows, O, "1 hour"), str(tmp_path / "out")), 1e-9)
    batch = q.tidy(window_states(event_flows(spark, sf, O), O), 1e-9).select(*streamed.columns)
    assert streamed.exceptAll(batch).isEmpty()
    # the last windows wait for the watermark, until the stream is closed and started again
    assert 0 < batch.exceptAll(streamed).count() <= 6
    st.closing_file(spark, str(tmp_path / "in"), events.schema, "ts", events.agg(F.max("ts")).first()[0] + timedelta(days=9))
    whole = q.tidy(st.run_to_table(st.stream_window_states(flows, O, "1 hour"), str(tmp_path / "out")), 1e-9)
    assert whole.exceptAll(batch).isEmpty() and batch.exceptAll(whole).isEmpty()


def test_streams_in_any_order_equal_the_batch(spark, sf):
    """The newest file first, one file a micro-batch."""
    table = q.tidy(q.regular(spark, sf).drop("seg_len", "row", "source_rows"), q.NUDGE)
    grid = q.stream_regular_states(spark, sf)
    assert grid.agg(F.sum("late")).first()[0] == 0
    grid = grid.select(*table.columns)
    assert grid.exceptAll(table).isEmpty() and table.exceptAll(grid).isEmpty()
    got, want = q.stream_alert_events(spark, sf), alert_events(q.raised(spark, sf))
    assert got.count() == want.count() > 0 and got.exceptAll(want.select(*got.columns)).isEmpty()


def test_late_repeated_and_pruned_windows_are_counted(spark, sf, tmp_path):
    st.use_rocksdb(spark)
    batch = window_states(event_flows(spark, sf, O), O).cache()
    low, high = batch.agg(F.min("timestamp"), F.max("timestamp")).first()
    early = batch.where(F.col("timestamp") < low + timedelta(hours=100))
    there = batch.where(F.col("timestamp") >= high - timedelta(hours=100))
    middle = batch.where((F.col("timestamp") >= low + timedelta(hours=100)) & (F.col("timestamp") < high - timedelta(hours=100)))
    small = early.withColumn("flow_count", F.lit(0.5))               # repeats with fewer flows lose
    blip = there.where(F.col("timestamp") == there.agg(F.min("timestamp")).first()[0]).withColumn(
        "timestamp", F.col("timestamp") + F.expr("interval 10 days"))
    further = there.withColumn("timestamp", F.col("timestamp") + F.expr("interval 30 days"))
    for part in (early.union(small), there, blip, middle, further):  # what lies in the middle comes when its place has passed
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    st.closing_file(spark, str(tmp_path / "in"), batch.schema, "timestamp", high + timedelta(days=400))
    stream = st.stream_grid(st.replay_files(spark, str(tmp_path / "in"), batch.schema), O, ["flow_count"], "1 hour", 20)
    rows = st.run_to_table(stream, str(tmp_path / "grid"))
    kept = early.union(there).union(blip).union(further)
    want = regular_states(kept, O, 20).select("source", "segment", "pos", "timestamp", "flow_count", "filled")
    got = rows.select(*want.columns)
    assert got.count() > 300 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    told = rows.agg(F.sum("late"), F.sum("pruned")).first()
    assert tuple(told) == (middle.count(), regular_states(kept, O).count() - rows.count()) and min(told) > 0
    assert rows.where("history is not null").count() == rows.where("pos >= 11").count()


def test_repeated_flows_count_once(spark, sf, tmp_path):
    flows = event_flows(spark, sf).limit(50)
    flows.unionByName(flows).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = st.replay_files(spark, str(tmp_path / "in"), flows.schema)
    once = st.run_to_table(st.drop_repeated_flows(stream, ["source", "timestamp", "src_ip", "src_port"]),
                           str(tmp_path / uuid.uuid4().hex))
    assert once.count() == 50


def test_packet_sessions(spark, tmp_path):
    rows = [("c", i, "a", "b", 1, 2, 6, float(t), 10) for i, t in enumerate([0, 100, 200, 400, 450, 9000, 99999])]
    df = spark.createDataFrame(rows, "capture string, packet_no long, src string, dst string, sport long, dport long, "
                                     "proto long, ts double, payload long")
    in_order(df, "ts", str(tmp_path / "in"))
    out = st.run_to_table(st.packet_sessions(st.replay_files(spark, str(tmp_path / "in"), df.schema), "120 seconds"),
                          str(tmp_path / "out"))
    assert [(r["first_ts"], r["packets"]) for r in out.orderBy("first_ts").collect()] == [(0, 3), (400, 2), (9000, 1)]


def test_packet_flows_by_both_timeouts(spark, tmp_path):
    """Out of order within the delay, in five files: what the batch cuts."""
    from netstate.operators.packets import with_flow
    st.use_rocksdb(spark)
    rng, rows, t = np.random.default_rng(5), [], 1.7e9
    for i in range(600):
        t += float(rng.choice([0.5, 3, 20, 150], p=[.4, .4, .17, .03]))
        c = int(rng.integers(0, 3))
        rows.append(("x", i, "10.0.0.9" if i % 3 else f"10.0.0.{c}", f"10.0.0.{c}" if i % 3 else "10.0.0.9", 7, 7, 6, t, i % 9))
    schema = "capture string, packet_no long, src string, dst string, sport long, dport long, proto long, ts double, payload long"
    df = spark.createDataFrame(rows, schema)
    for i in range(5):                                               # neighbours in time are in different files
        part = df.where((F.col("packet_no") >= i * 120 - 9 * (i % 2)) & (F.col("packet_no") < (999 if i == 4 else (i + 1) * 120 - 9 * ((i + 1) % 2))))
        part.orderBy(F.desc("packet_no")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df.limit(1).withColumns({"ts": F.lit(t + 1e6), "capture": F.lit("end")}).write.mode("append").parquet(str(tmp_path / "in"))
    stream = st.replay_files(spark, str(tmp_path / "in"), df.schema)
    got = st.run_to_table(st.stream_packet_flows(stream, 100.0, 300.0, "1000 seconds"), str(tmp_path / "out"))
    want = with_flow(df, 100.0, 300.0).groupBy("capture", F.col("begin.packet_no").alias("first_packet")).agg(
        F.count("*").alias("packets"), F.sum("payload").alias("bytes"), F.max("ts").alias("last_ts"))
    names = ["capture", "first_packet", "packets", "bytes"]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, want.select(*names).collect()))
    assert want.count() > 20


class Handle:
    """State of one key in memory, with counts of calls."""

    def __init__(self):
        self.states, self.timers, self.calls = {}, set(), 0

    def _state(self, name, *_):
        handle, held = self, self.states.setdefault(name, {})

        class State:
            def __getattr__(self, call):
                handle.calls += 1
                return {"updateValue": held.__setitem__, "getValue": held.get, "removeKey": held.pop, "keys": lambda: iter(list(held)),
                        "iterator": lambda: iter(list(held.items())), "update": lambda v: held.update({0: v}), "get": lambda: held.get(0),
                        "clear": held.clear}[call]
        return State()

    getMapState = getValueState = _state

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_packets_of_a_conversation_wait_in_blocks():
    """As one fold over the packets does, with some that come twice, and with far fewer calls and timers than packets."""
    rng = np.random.default_rng(9)
    steps = rng.choice([0, 0.25, 2, 20, 150], p=[.1, .4, .4, .07, .03], size=6000)
    micros = (1.7e15 + np.cumsum(steps) * 1e6).astype(np.int64)
    rows = pd.DataFrame({"micros": micros, "packet_no": np.arange(6000), "payload": rng.integers(0, 90, 6000)})
    want, flow = [], None
    for at, n, size in rows.itertuples(index=False):
        if flow and (at - flow[2] > 100e6 or at - flow[1] > 300e6):
            want.append(flow)
            flow = None
        flow = (flow[0], flow[1], at, flow[3] + 1, flow[4] + size) if flow else (n, at, at, 1, size)
    want.append(flow)

    handle, got, key = Handle(), [], ("x", 6, "low", "high")
    processor = st.FlowProcessor(100.0, 300.0)
    processor.FLUSH = 500
    processor.init(handle)
    for k, stop in enumerate(range(1000, 7000, 1000)):
        mixed = rows.iloc[stop - 1000:stop].sample(frac=1, random_state=k)
        earlier = mixed.head(50).assign(payload=9999)                # the last one of a packet counts
        closing = pd.DataFrame({"micros": [0], "packet_no": [None], "payload": [None]})
        list(processor.handleInputRows(key, iter([earlier, mixed.iloc[:300], closing, mixed.iloc[300:]]), None))
        passed = int(micros[stop - 300] // 1000) if stop < 6000 else int(micros[-1] // 1000) + 10 ** 6
        for timer in sorted(t for t in handle.timers if t <= passed):
            handle.timers.discard(timer)
            for frame in processor.handleExpiredTimer(key, Clock(passed), timer):
                got += frame.itertuples(index=False)
    assert [(r.first_packet, round(r.first_ts * 1e6), round(r.last_ts * 1e6), r.packets, r.bytes) for r in got] == want
    assert len(want) > 100 and handle.calls < 3000 and not handle.states["waiting"] and not handle.states["flow"]

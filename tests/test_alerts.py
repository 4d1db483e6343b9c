"""Alert rules: hand-made cases, and the batch and the stream form against a plain reading of the rules."""
import numpy as np
import pandas as pd
import pytest

from netstate.config import Options
from netstate.operators import alerts as batch_alerts
from netstate.operators.alerts import alert_events, alerts, open_at
from netstate.functions.levels import level_bounds
from netstate.streaming.alerts import Watch, run_lengths
from tests.conftest import TIMELINE, moment, timeline_of

THR = 0.5
O5 = Options(cooldown_windows=5)


def level(risk, options=O5):
    return next((name for name, bound in level_bounds(THR, options) if risk >= bound), "OK")


def test_levels():
    assert [level(r) for r in (0.1, 0.4, 0.6, 0.9)] == ["OK", "WATCH", "WARNING", "CRITICAL"]


def test_run_lengths():
    flags = np.array([True, True, False, True, False, False, True])
    assert run_lengths(flags, 3).tolist() == [4, 5, 0, 1, 0, 0, 1]


@pytest.mark.parametrize("risks, n, status", [
    ([.1, .9, .1, .1], 0, None),
    ([.1, .9, .9, .9], 1, "OPEN"),
    ([.9] * 3 + [.45] * 2 + [.9] * 3, 1, "OPEN"),
    ([.9] * 3 + [.1] * 3 + [.9] * 3, 1, "CLOSED"),
])
def test_persistence_hysteresis_cooldown(spark, risks, n, status):
    found = alerts(timeline_of(spark, risks), THR, O5).collect()
    assert len(found) == n
    assert not n or found[0]["status"] == status


def test_progression_and_escalation(spark):
    stages = ["Reconnaissance"] * 2 + ["Initial Access"] * 2
    a = alerts(timeline_of(spark, [.6, .6, .6, .95], stages), THR, O5)
    row = a.first()
    assert row["stages"] == ["Reconnaissance", "Initial Access"] and row["peak_severity"] == "CRITICAL"
    assert [r["type"] for r in alert_events(a).orderBy("pos").collect()] == ["opened", "escalated"]


def test_next_segment_closes(spark):
    first = timeline_of(spark, [.9] * 3)
    later = spark.createDataFrame([("a", 1, 0, 50, moment(900), .1, "Benign", [.1] * 6)], TIMELINE)
    row = alerts(first.unionByName(later), THR, O5).first()
    assert row["status"] == "CLOSED" and row["closed_time"] == moment(900)


def random_rows(seed):
    rng = np.random.default_rng(seed)
    names, rows = ["Impact", "Discovery", "Initial Access"], []
    for source in ("a", "b"):
        row = 0
        for segment in range(3):
            n, left, mode = int(rng.integers(5, 300)), 0, 0
            for i in range(n):
                if left <= 0:
                    mode, left = int(rng.integers(0, 4)), int(rng.integers(1, 8))
                left -= 1
                low, high = [(0, .39), (.5, .74), (.75, 1), (.3, .55)][mode]
                risk = float(rng.uniform(low, high))
                stage = "Benign" if risk < THR else names[rng.integers(0, 3)] if rng.random() < .3 else names[segment]
                rows.append((source, segment, i + 11, row + i + 11, moment(10 * (row + i)), risk, stage,
                             [risk * 0.6, risk]))
            row += n + 11
    return rows


def read_rules(rows, options):
    """Events and final alerts of the windows of one source, each window looked at with all windows before it in view."""
    events, found, by_segment = [], {}, {}
    for r in rows:
        by_segment.setdefault(r[1], []).append(r)
    for segment, windows in by_segment.items():
        names, risks = [level(r[5], options) for r in windows], [r[5] for r in windows]
        hot = [n in ("WARNING", "CRITICAL") for n in names]
        calm = [x < options.clear_ratio * THR for x in risks]

        def run(flags, i):
            return next((k for k in range(i + 1) if not flags[i - k]), i + 1)

        blocked, here = {}, None                                    # here: indexes of the windows of the open alert
        for i, (_, _, pos, _, _, risk, stage, attack) in enumerate(windows):
            if here is None and run(hot, i) >= options.persistence and blocked.get(stage, -1) < pos:
                here = [i]
                events.append((segment, pos, "opened", len(found) + 1, names[i], stage))
                found[len(found) + 1] = here, windows, names, run(hot, i)
            elif here is not None and hot[i]:
                if names[i] == "CRITICAL" and all(names[j] == "WARNING" for j in here):
                    events.append((segment, pos, "escalated", len(found), "CRITICAL", None))
                here.append(i)
            if here is not None and run(calm, i) >= options.clear_windows:
                events.append((segment, pos, "closed", len(found), None, None))
                held = {windows[here[0]][6]} | {windows[j][6] for j in here if windows[j][6] != "Benign"}
                blocked |= {s: pos + options.cooldown_windows for s in held}
                here = None
    told = {}
    for n, (here, windows, names, before) in found.items():
        first = windows[here[0]]
        stages = list(dict.fromkeys([first[6], *(windows[j][6] for j in here if windows[j][6] != "Benign")]))
        step = next((k for k, p in enumerate(first[7], 1) if p >= THR), 1)
        told[n] = (stages, max((names[j] for j in here), key=["WARNING", "CRITICAL"].index), names[here[-1]], first[2],
                   windows[here[-1]][2], len(here) - 1 + before, step * options.window_seconds,
                   round(max(windows[j][5] for j in here), 9))
    return events, told


@pytest.mark.parametrize("seed, chunk", [(0, 16), (1, 4096)])
def test_batch_follows_the_rules(spark, seed, chunk):
    options, rows = Options(chunk_windows=chunk), random_rows(seed)
    found = alerts(spark.createDataFrame(rows, TIMELINE), THR, options)
    events = {(r["source"], r["segment"], r["pos"], r["type"], r["alert_id"], r["severity"], r["stage"])
              for r in alert_events(found).collect()}
    expected, seen = set(), {}
    for source in ("a", "b"):
        out, told = read_rules([r for r in rows if r[0] == source], options)
        expected |= {(source, *e) for e in out}
        seen |= {(source, n): t for n, t in told.items()}
    assert events == expected and len(expected) > 50
    got = {(r["source"], r["id"]): (r["stages"], r["peak_severity"], r["severity"], r["opened_pos"], r["last_pos"],
                                    r["n_windows"], r["eta_seconds"], round(r["peak_risk"], 9)) for r in found.collect()}
    assert got == seen


@pytest.mark.parametrize("seed, size", [(2, 1), (3, 7), (4, 10_000)])
def test_stream_follows_the_rules(seed, size):
    """In batches of any size."""
    options = Options()
    rows = [r for r in random_rows(seed) if r[0] == "a"]
    frame = pd.DataFrame([(r[1], r[2], r[4], 1 + ["OK", "WATCH", "WARNING", "CRITICAL"].index(level(r[5], options)),
                           r[5] < options.clear_ratio * THR, r[6]) for r in rows],
                         columns=["segment", "pos", "timestamp", "rank", "quiet", "stage"])
    watch, got = Watch(), []
    for start in range(0, len(frame), size):
        for _, part in frame.iloc[start:start + size].groupby("segment"):
            got += [(e[0], e[1], *e[3:]) for e in watch.feed(part, options)]
    assert got == read_rules(rows, options)[0] and len(got) > 20


@pytest.mark.parametrize("chunk, cooldown, most", [(8, 20, 512), (32, 60, 4096), (16, 6, 512), (8, 40, 2)])
def test_long_chains_in_pieces(spark, monkeypatch, chunk, cooldown, most):
    """A source that flaps all the time: every stretch depends on the ones before it, across pieces."""
    monkeypatch.setattr(batch_alerts, "MOST_STATES", most)
    monkeypatch.setattr(batch_alerts._settled_chains, "__defaults__", (most,))
    options = Options(chunk_windows=chunk, cooldown_windows=cooldown)
    rng, names, rows = np.random.default_rng(chunk), ["Impact", "Discovery", "Initial Access", "Collection"], []
    for i in range(900):
        hot = i % 9 < 4 if i < 600 else rng.random() < 0.6
        risk = float(rng.uniform(.55, 1) if hot else rng.uniform(0, .35))
        rows.append(("a", 0, i, i, moment(10 * i), risk, names[rng.integers(0, 4)] if hot else "Benign", [risk, risk]))
    found = alerts(spark.createDataFrame(rows, TIMELINE), THR, options)
    got = {(r["segment"], r["pos"], r["type"], r["alert_id"], r["severity"], r["stage"]) for r in alert_events(found).collect()}
    events = read_rules(rows, options)[0]
    assert got == set(events) and len(events) > 30


def test_open_at(spark):
    line = timeline_of(spark, [.1, .9, .9, .1, .1, .1, .1])
    rows = open_at(alerts(line, THR, O5), line, O5).orderBy("pos").collect()
    assert [r["alert_id"] for r in rows] == [None, None, 1, 1, 1, None, None]

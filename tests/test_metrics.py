"""Metrics, calibration, episodes, lead time, drift, incidents."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from netstate.config import Options
from netstate.operators import drift, incidents, metrics
from netstate.operators.alerts import alerts
from netstate.operators.chunks import last_match, next_match, quantiles
from tests.conftest import moment, timeline_of

O = Options()


def labelled(spark, n, attacks):
    rows = [("a", 0, i, moment(10 * i), any(lo <= i <= hi for lo, hi in attacks), "Impact") for i in range(n)]
    return spark.createDataFrame(rows, "source string, segment int, pos long, timestamp timestamp_ntz, is_attack boolean, "
                                       "stage string")


def test_episodes_bridge_short_breaks(spark):
    for o in (O, O.having(chunk_windows=4)):
        found = metrics.episodes(labelled(spark, 30, [(5, 7), (9, 11), (20, 21)]), o).orderBy("start_pos").collect()
        assert [(r["start_pos"], r["end_pos"]) for r in found] == [(5, 11), (20, 21)]


def lead(spark, attacks, hot):
    risks = [0.9 if any(lo <= i <= hi for lo, hi in hot) else 0.05 for i in range(150)]
    out = metrics.lead_time(timeline_of(spark, risks), labelled(spark, 150, attacks), 0.5, O)
    return out["summary"].first()


def test_lead_time(spark):
    s = lead(spark, [(30, 35), (60, 65), (100, 105)], [(26, 36), (62, 66)])
    assert (s["warned_early"], s["detected_late"], s["missed"]) == (1, 1, 1)
    assert s["min_lead_seconds"] == 30 and s["false_alerts"] == 0


def test_false_alert(spark):
    s = lead(spark, [(100, 105)], [(20, 25)])
    assert s["false_alerts"] == 1 and s["missed"] == 1


def test_stage_report_scores_only_what_occurs(spark):
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 1, 2), (-1, 0, 3)],
                                  "actual_id int, predicted_id int, n long")
    report = {r["stage"]: r for r in metrics.stage_report(pairs, ["A", "B", "C"]).collect()}
    assert set(report) == {"A", "B"} and report["B"]["recall"] == 1
    whole = metrics.stage_metrics(pairs, ["A", "B", "C"]).first()
    assert whole["accuracy"] == 0.75 and whole["unseen_stage_samples"] == 3


def brute_auc(p, y):
    pos, neg = p[y > 0], p[y <= 0]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])


def test_ranking_with_ties(spark):
    rng = np.random.default_rng(0)
    p, y = np.round(rng.random(400), 2), (rng.random(400) < 0.3).astype(float)
    got = metrics.ranking_metrics(spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "p double, y double"))
    assert abs(got.first()["roc_auc"] - brute_auc(p, y)) < 1e-12


def test_threshold_meets_target(spark):
    rng = np.random.default_rng(3)
    y = (rng.random(600) < 0.3).astype(float)
    p = np.where(y > 0, rng.beta(5, 2, 600), rng.beta(2, 5, 600))
    rows = spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y)], "p double, y double")
    got = metrics.choose_threshold(rows, 0.05, 0.5).first()
    cands = np.unique(np.round(np.concatenate([np.linspace(.05, .95, 91), np.quantile(p, np.linspace(.5, .999, 60))]), 4))
    rates = [((p >= t)[y == 0].mean(), (p >= t)[y == 1].mean(), t) for t in cands]
    best = max((r for r in rates if r[0] <= 0.05), key=lambda r: (r[1], -r[0], -r[2]))
    assert got["threshold"] == pytest.approx(best[2]) and got["onset_fpr"] <= 0.05
    few = metrics.choose_threshold(rows.limit(2), 0.05, 0.5).first()
    assert few["method"] == "fallback" and few["threshold"] == 0.5


def test_quantiles_are_exact(spark):
    x = np.random.default_rng(1).normal(size=501).round(2)
    rows = spark.createDataFrame([("k", float(v)) for v in x], "k string, v double")
    got = {r["i"]: r["q"] for r in quantiles(rows, ["k"], "v", [0, .1, .5, .77, 1]).collect()}
    assert np.allclose([got[i] for i in range(5)], np.quantile(x, [0, .1, .5, .77, 1]))


def test_matches(spark):
    left = spark.createDataFrame([("a", x) for x in (0, 5, 9, 40)], "k string, x long")
    right = spark.createDataFrame([("a", x) for x in (5, 20)] + [("b", 1)], "k string, y long")
    nxt = next_match(left, right, ["k"], F.col("x"), F.col("y"), 3, "m").orderBy("x").collect()
    assert [r["m"] and r["m"]["at"] for r in nxt] == [5, 5, 20, None]
    prev = last_match(left, right, ["k"], F.col("x"), F.col("y"), 3, "m").orderBy("x").collect()
    assert [r["m"] and r["m"]["at"] for r in prev] == [None, 5, 5, 20]


def test_drift_direction(spark):
    rng = np.random.default_rng(0)
    ref = spark.createDataFrame([("f", float(v)) for v in rng.normal(size=800)], "feature string, value double")
    moved = ref.withColumn("value", F.col("value") * 2 + 3)
    assert drift.drift_table(ref, ref).first()["psi"] < 1e-9
    assert drift.drift_table(ref, moved).first()["level"] == "significant"
    flat = ref.withColumn("value", F.lit(1.0))
    assert drift.drift_table(flat, flat.withColumn("value", F.lit(3.0))).first()["psi"] == 1.0


def test_incidents_keep_triage(spark):
    line, truth = timeline_of(spark, [.1, .9, .9, .9, .1, .1, .1]), labelled(spark, 7, [(2, 3)])
    new = incidents.incidents(alerts(line, 0.5, O), truth, O)
    row = new.first()
    assert row["confirmed"] == 1 and row["severity"] == "Critical" and row["id"].startswith("INC-")
    stored = incidents.new_incident_table(new).withColumns({"status": F.lit("Resolved"), "note": F.lit("done")})
    for _ in range(2):
        stored = incidents.upsert_incidents(stored, new)
    assert stored.count() == 1 and stored.first()["status"] == "Resolved" and stored.first()["note"] == "done"
    unlabelled = truth.withColumn("is_attack", F.lit(False))
    assert incidents.incidents(alerts(line, 0.5, O), unlabelled, O).first()["confirmed"] == -1
    with pytest.raises(ValueError):
        incidents.triage_event(spark, "INC-1", "Closed", "", moment(0), 1)


def test_stages_without_support_are_named(spark):
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 1, 2), (-1, 1, 4)], "actual_id int, predicted_id int, n long")
    got = {r["stage"]: tuple(r)[1:] for r in metrics.stage_support(pairs, ["Benign", "Initial Access", "Impact"]).collect()}
    assert got == {"Benign": (2, 1, True), "Initial Access": (2, 3, True), "Impact": (0, 0, False)}


def test_a_saved_forecaster_scores_alike(spark, sf, tmp_path):
    from netstate.operators.logistic import LogisticScorer
    from netstate.plans import registry as q
    table, o = q.regular(spark, sf), q.T3600
    fitted = LogisticScorer.fit(table, q.scaler(spark, sf), ["Benign", "Impact"], o, iterations=3, cap=200)
    fitted.save(spark, str(tmp_path / "m"))
    loaded = LogisticScorer.load(spark, str(tmp_path / "m"), o)
    names = ["source", "segment", "pos", "attack_prob", "stage_prob"]
    a, b = (x.score(table).select(*names) for x in (fitted, loaded))
    assert a.exceptAll(b).isEmpty() and a.count() > 0
    with pytest.raises(ValueError):
        LogisticScorer.load(spark, str(tmp_path / "m"), q.G300)

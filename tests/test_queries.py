"""Registered queries against their SQL forms, and forecasters."""
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from netstate.operators import evaluation, explain, forecast, logistic
from netstate.plans import registry as q
from tools.compare import compare

CHECKED = ["window_states", "regular_states", "segment_prune", "split_labels", "future_targets", "scaler_params",
           "forecast_long", "alert_log", "alert_events", "incident_table", "metrics_per_horizon", "threshold_choice",
           "lead_time_summary", "drift_psi", "attributions", "scenario_summary", "source_coverage", "packet_idle_flows"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.01/events.parquet'")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, "/root/testdata/sf0.01", name).startswith("ok")


def test_every_sql_form_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_logistic_scores_equal_the_dot_product(spark):
    """The per-row contributions add up to the plain product of history and coefficients."""
    sf = "/root/testdata/sf0.01"
    table, scaler = q.regular(spark, sf), q.scaler(spark, sf)
    rng, o = np.random.default_rng(0), q.T3600.having(chunk_windows=32)
    n, stages = len(scaler.names), ["Benign", "Impact"]
    w, s = rng.normal(size=(6, 12, n)) / 50, rng.normal(size=(6, 2, 12, n)) / 50
    model = logistic.LogisticScorer(scaler, o, stages, w, [0.1] * 5 + [None], s, np.zeros((6, 2)))
    got = {(r["source"], r["pos"]): r for r in model.score(table).select("source", "pos", "attack_prob",
                                                                         "stage_prob").collect()}
    origins = explain.history_at(table, table.where("pos in (11, 40, 333)").select("source", "segment", "pos"), scaler, o)
    for r in origins.collect():
        h, g = np.array(r["history"]), got[r["source"], r["pos"]]
        for k in range(5):
            assert g["attack_prob"][k] == pytest.approx(1 / (1 + np.exp(-((h * w[k]).sum() + 0.1))))
            e = np.exp([(h * s[k, c]).sum() for c in range(2)])
            assert np.allclose(g["stage_prob"][k], e / e.sum())
        assert g["attack_prob"][5] == 0


def test_trained_forecaster_beats_chance(spark):
    sf = "/root/testdata/sf0.01"
    table, scaler = q.regular(spark, sf), q.scaler(spark, sf)
    model = logistic.LogisticScorer.fit(table, scaler, forecast.CLOSED_FORM_STAGES, q.T3600, 5, with_stages=False)
    report = evaluation.compare_scorers(table, {"m": (model, .5)}, q.T3600, "train").where("view = 'forecast'").first()
    assert report["roc_auc"] > 0.6
    oracle = evaluation.compare_scorers(table, {"p": (forecast.PersistenceScorer(q.T3600), .5)}, q.T3600)
    assert oracle.where("view = 'onset'").first()["recall"] == 0


def test_shap_sums_to_the_logit_difference(spark):
    sf = "/root/testdata/sf0.01"
    s, o = q.scaler(spark, sf), q.T3600
    w, centre = explain.closed_form_weights(q.scorer(spark, sf)), np.full((12, len(s.names)), 0.25)
    origin = explain.history_at(q.regular(spark, sf), q.scored(spark, sf).where("pos = 99").select(
        "source", "segment", "pos", "attack_prob"), s, o)
    total = explain.linear_shap(origin, s, w, centre, 1, 60).groupBy("source").agg(F.sum("shap_value").alias("v"))
    z = {r["source"]: np.array(r["history"]) for r in origin.collect()}
    for r in total.collect():
        assert r["v"] == pytest.approx(((z[r["source"]] - centre) * w[0]).sum())

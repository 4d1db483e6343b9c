"""Registered drift, SHAP and trained queries use all training data and the operators' own settings."""
import numpy as np
import pytest

from netstate.operators import explain, logistic, sequences
from netstate.plans import registry as q


def test_references_are_the_whole_train_split(spark, sf, monkeypatch):
    def no_sample(*a):
        raise AssertionError("a bounded sample was taken")
    monkeypatch.setattr(q, "background", no_sample)
    assert q.drift_against_background(spark, sf).count() > 0 and q.linear_shap(spark, sf).count() > 0
    table, fitted, L = q.regular(spark, sf), q.scaler(spark, sf), q.T3600.history
    z = {tuple(r)[:3]: r["z"] for r in fitted.with_vector(table).select(*q.KEYS, "pos", "z").collect()}
    ends = [tuple(r) for r in sequences.with_samples(table, q.T3600).where("is_sample and split = 'train'").select(*q.KEYS, "pos").collect()]
    want = np.mean([[z[a, b, p - L + 1 + k] for k in range(L)] for a, b, p in ends], axis=0)
    assert len(ends) > 100 and np.allclose(explain.train_mean(table, fitted, q.T3600), want)


def test_trained_queries_keep_the_defaults(spark, sf, monkeypatch):
    given = []

    def fit(*a, **settings):
        given.append(settings)
        raise InterruptedError
    monkeypatch.setattr(logistic.LogisticScorer, "fit", fit)
    q._logistic.cache_clear()
    with pytest.raises(InterruptedError):
        q.logistic_timeline(spark, sf)
    assert given == [{}]

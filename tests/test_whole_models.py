"""Folds and restarts of registered queries are those of the settings."""

import pytest

from spanledger import Settings
from spanledger.catalog import model_queries as Q
from spanledger.sources.adapters import Tables

from oracle import ROOT


class Asked(Exception):
    pass


def test_folds_and_restarts(spark, monkeypatch):
    def spy(*args, **kw):
        raise Asked(args, kw)

    t = Tables(spark, f"{ROOT}/sf0.001")
    monkeypatch.setattr(Q.models, "kfold_cv", spy)
    monkeypatch.setattr(Q.K, "kprototypes", spy)
    with pytest.raises(Asked) as got:
        Q.kfold_cv(t)
    assert got.value.args[0][2] == Settings().series.folds == 10
    for query in (Q.kprototypes, Q.centroid_report):
        with pytest.raises(Asked) as got:
            query(t)
        assert got.value.args[1]["n_runs"] == Settings().cluster.n_runs == 15

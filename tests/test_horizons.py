"""All horizons in one pass against one horizon at a time."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from spanledger.operators import grid as G
from spanledger.plans import dataset as D, jobs
from spanledger.sources.adapters import EVENT_CFG as CFG, Tables
from spanledger.config import HorizonSettings

WEEKS = [0, 1, 2]


@pytest.fixture(scope="module")
def episodes(spark):
    return Tables(spark, "/root/testdata/sf0.001").raw_episodes().persist()


def test_one_pass_equals_one_horizon_at_a_time(spark, episodes):
    labels = D.label_table(episodes, CFG, series=True, n_anchors=4).persist()
    both = D.horizon_dataset(episodes, CFG, WEEKS, n_anchors=4, labels=labels)
    every, meta = both.encoded.persist(), None
    for n in WEEKS:
        own = D.series_dataset(episodes, replace(CFG, horizon_weeks=n), meta, n_anchors=4, labels=labels)
        meta = meta or own.meta
        got = every.where(F.col("n") == n).drop("n")
        assert got.columns == own.encoded.columns
        a, b = (sorted(map(str, df.collect())) for df in (got, own.encoded))
        assert a == b and len(a) > 50
    assert meta == replace(both.meta, horizon_weeks=meta.horizon_weeks)
    assert every.where(F.pmod(F.col("ClientID"), F.lit(1)) != 0).count() == 0


def test_plan_does_not_grow_with_the_horizons(episodes, spark):
    meta = D.series_dataset(episodes, CFG, n_anchors=4).meta

    def size(weeks):
        text = D.horizon_dataset(episodes, CFG, weeks, meta, n_anchors=4).encoded._jdf.queryExecution().optimizedPlan().toString()
        return text.count("InMemoryRelation"), text.count("Join"), text.count("Aggregate")

    assert size([0, 1]) == size(list(range(0, 5)))


def test_clients_are_told_apart(spark):
    grid = G.HorizonGrid.of(G.Grid(1_000_000, 86_400, 3), (0, 7, 14))
    rows = grid.spread(spark.createDataFrame([(-5,), (0,), (7,)], "client long"))
    got = {(r["c"], r["h"], r["o"]) for r in rows.select(grid.client_of().alias("c"), grid.horizon_of().alias("h"), grid.origin().alias("o")).collect()}
    assert got == {(c, h, 1_000_000 - h * 7 * 86_400) for c in (-5, 0, 7) for h in (0, 1, 2)}


def test_search_over_series(episodes):
    cfg = replace(CFG, horizon=HorizonSettings(0, 1, 1), series=replace(CFG.series, folds=2))
    out = jobs.horizon_search(episodes, cfg, "logreg", series=True, n_anchors=7, maxIter=3, regParam=0.01)
    assert {(r["n"], r["fold"]) for r in out.collect()} == {(n, f) for n in (0, 1) for f in (1, 2)}

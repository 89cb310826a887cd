"""Draws, local fits and label-driven bins against plain definitions."""

import random
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.operators import encode as N
from spanledger.operators import explain as L
from spanledger.operators import localfit as G


def test_alias_tables_hold_the_given_shares():
    rng = random.Random(1)
    for weights in ([1], [3, 1], [0, 5, 0], [1 / 5000] * 5000, [rng.randrange(1000) for _ in range(300)], [0.2, 0.3, 0.5], [0, 0]):
        cut, other = L.alias_table(weights)
        share = np.zeros(len(weights))
        for i, (c, j) in enumerate(zip(cut, other)):
            share[i] += c / L.DRAWS / len(weights)
            share[j] += (1 - c / L.DRAWS) / len(weights)
        want = np.array(weights) / sum(weights) if sum(weights) else np.full(len(weights), 1 / len(weights))
        assert np.allclose(share, want, atol=1e-8)


def test_drawn_shares_follow_the_table(spark):
    df = spark.createDataFrame([(i, float(i % 40), (i * i) % 7) for i in range(700)], "id long, v double, k int")
    ex = L.fit(df, ["v"], ["k"])
    got = L.perturb(df.where("id = 4"), ex, "id", 20_000).where("sample > 0")
    n = {r["k"]: r["count"] / 19_999 for r in got.groupBy("k").count().collect()}
    want = {r["k"]: r["count"] / 700 for r in df.groupBy("k").count().collect()}
    assert set(n) == {float(k) for k in want} and all(abs(n[float(k)] - want[k]) < 0.02 for k in want)
    assert got.where("v < 0 OR v > 39").count() == 0


def test_a_plan_draws_once(spark):
    df = spark.createDataFrame([(i, float(i), i % 5) for i in range(50)], "id long, v double, k int")
    near = L.neighbour_weights(L.perturb(df, L.fit(df, ["v"], ["k"]), "id", 30), 2.0)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan.split("Generate")[0]  # only the bins of the examples, before they are multiplied
    assert plan.count("48271") == 2 * 4  # two features, of which the numeric one has two more numbers; twice in one draw


def _wide(seed, n=400, d=6):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, d)) < 0.5).astype(float)
    y = x @ rng.normal(0, 1, d) + 0.5 * x[:, 0] * x[:, 1] + rng.normal(0, 0.1, n)
    return x, y, rng.random(n) + 0.1


def _least_squares(x, y, w, use):
    own = np.column_stack([np.ones(len(x)), x[:, use]])
    coef = np.linalg.lstsq(own * np.sqrt(w)[:, None], y * np.sqrt(w), rcond=None)[0]
    mean = np.average(y, weights=w)
    return 1 - (w * (y - own @ coef) ** 2).sum() / (w * (y - mean) ** 2).sum()


@pytest.mark.parametrize("seed", range(6))
def test_forward_selection_is_a_search_over_fits(seed):
    x, y, w = _wide(seed)
    used = []
    for _ in range(4):
        used.append(max((j for j in range(6) if j not in used), key=lambda j: _least_squares(x, y, w, [*used, j])))
    assert G.select(G.Gram.of(x, y, w), 4, "forward_selection").tolist() == used


@pytest.mark.parametrize("seed", range(8))
def test_lasso_path_meets_its_conditions(seed):
    x, y, w = _wide(seed, n=60, d=9)
    if seed % 2:
        x[:, 3] = x[:, 2]  # a copy, and a column that never changes
        x[:, 5] = 1.0
    xx, xy, _ = G.Gram.of(x, y, w).centred
    path = G.lasso_path(xx, xy)
    levels = []
    for b in path:
        c = xy - xx @ b
        level = np.abs(c).max()
        levels.append(level)
        for j in np.flatnonzero(b):  # equal products with the residual, of the sign of the coefficient
            assert abs(c[j] - np.sign(b[j]) * level) < 1e-7 * max(1, np.abs(xy).max())
    assert levels == sorted(levels, reverse=True) and levels[-1] < 1e-7 * np.abs(xy).max()
    # Every point between two knots, found by coordinate descent.
    for a, b, la, lb in zip(path, path[1:], levels, levels[1:]):
        at = (la + lb) / 2
        own = np.zeros(len(xy))
        for _ in range(4000):
            for j in range(len(xy)):
                if xx[j, j] > 1e-9:
                    r = xy[j] - xx[j] @ own + xx[j, j] * own[j]
                    own[j] = np.sign(r) * max(abs(r) - at, 0) / xx[j, j]
        value = lambda z: z @ xx @ z / 2 - z @ xy + at * np.abs(z).sum()
        assert abs(value((a + b) / 2) - value(own)) < 1e-6 * max(1, abs(value(own)))
    for k in range(1, 9):
        assert len(G.select(G.Gram.of(x, y, w), k, "lasso_path")) <= k


@pytest.mark.parametrize("method", G.METHODS)
def test_rows_of_an_example_may_come_in_any_order(spark, monkeypatch, method):
    monkeypatch.setattr(G, "HELD_NUMBERS", 200)  # matrices leave their task early
    rows, want = [], {}
    for e in range(12):
        x, y, w = _wide(e, n=90, d=5)
        g = G.Gram.of(x, y, w)
        use = G.select(g, 3, method)
        want[e] = dict(zip(use.tolist(), g.ridge(1.0, use)))
        rows += [(e, float(b), float(c), [int(v) for v in a]) for a, b, c in zip(x, y, w)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "id long, score double, weight double, same array<int>").repartition(7)
    got = {}
    for r in G.local_models(df, "id", 3, method).collect():
        got.setdefault(r["id"], {})[r["pos"]] = r["weight"]
        assert r["rows"] == 90
    assert {e: set(v) for e, v in got.items()} == {e: set(v) for e, v in want.items()}
    assert all(abs(got[e][p] - want[e][p]) < 1e-9 for e in want for p in want[e])


def test_model_at_the_example(spark):
    x, y, w = _wide(3)
    df = spark.createDataFrame([(1, float(b), float(c), [int(v) for v in a]) for a, b, c in zip(x, y, w)], "id long, score double, weight double, same array<int>")
    r = G.local_models(df, "id", 6, "none").first()
    own = np.column_stack([np.ones(len(x)), x])
    penal = np.diag([0.0] + [1.0] * 6)
    coef = np.linalg.solve(own.T @ (own * w[:, None]) + penal, own.T @ (w * y))
    assert abs(r["intercept"] - coef[0]) < 1e-9 and abs(r["local_score"] - coef.sum()) < 1e-9
    left = y - own @ coef
    assert abs(r["r2"] - (1 - (w * left ** 2).sum() / (w * (y - np.average(y, weights=w)) ** 2).sum())) < 1e-9


def _entropy(ys):
    return -sum(p * log2(p) for c in set(ys) if (p := ys.count(c) / len(ys)) > 0)


def _cut(rows, depth, mdl):
    rows = sorted(rows)
    ys = [y for _, y in rows]
    best = None
    for i in range(1, len(rows)):
        if rows[i][0] > rows[i - 1][0]:
            a, b = ys[:i], ys[i:]
            gain = round(_entropy(ys) - len(a) / len(ys) * _entropy(a) - len(b) / len(ys) * _entropy(b), 12)
            k, ka, kb = len(set(ys)), len(set(a)), len(set(b))
            need = (log2(len(ys) - 1) + log2(3 ** k - 2) - (k * _entropy(ys) - ka * _entropy(a) - kb * _entropy(b))) / len(ys) if mdl else 0
            if gain > need and (best is None or gain > best[0]):
                best = gain, i
    if not depth or best is None:
        return []
    i = best[1]
    return [*_cut(rows[:i], depth - 1, mdl), (rows[i][0] + rows[i - 1][0]) / 2, *_cut(rows[i:], depth - 1, mdl)]


@pytest.mark.parametrize("mdl", [False, True])
def test_entropy_bins_are_the_best_cuts(spark, mdl):
    rng = random.Random(9)
    rows = [(float(a := rng.randrange(60)), float(rng.randrange(4)), 5.0, None if rng.random() < 0.05 else "hi" if a > 40 and rng.random() < 0.9 else rng.choice(["lo", "mid"])) for _ in range(500)]
    rows += [(None, 1.0, 5.0, "lo")] * 5
    df = spark.createDataFrame(rows, "a double, b double, c double, y string")
    got = {r["feature"]: list(r["edges"]) for r in N.entropy_bins(df, ["a", "b", "c"], "y", depth=4, mdl=mdl).collect()}
    want = {f: _cut([(r[i], r[3]) for r in rows if r[i] is not None and r[3] is not None], 4, mdl) for i, f in enumerate("abc")}
    assert got == want
    ex = L.fit(df.withColumn("id", F.lit(1)), ["a"], label="y")
    assert len(ex.table["a"]) == len(ex.edges["a"]) + 1


def test_explainer_from_statistics(spark):
    ex = L.from_statistics({"v": [1.0, 2.0]}, {"v": [(0.5, 0.5, 0.1, 0.0, 1.0), (0.25, 1.5, 0.1, 1.0, 2.0), (0.25, 3.0, 0.5, 2.0, 4.0)]}, {"k": {0: 0.25, 3: 0.75}})
    df = spark.createDataFrame([(1, 1.5, 3)], "id long, v double, k int")
    got = L.perturb(df, ex, "id", 4000).where("sample > 0").agg(F.avg((F.col("v") <= 1).cast("int")), F.avg((F.col("k") == 3).cast("int")), F.max("v")).first()
    assert abs(got[0] - 0.5) < 0.04 and abs(got[1] - 0.75) < 0.04 and got[2] <= 4
    with pytest.raises(ValueError):
        L.from_statistics({"v": [1.0]}, {"v": [(1.0, 0.0, 0.0, 0.0, 0.0)]})

"""Ranks by selection, draws by hash, and lazy picks against plain definitions."""

import random

import pytest
from pyspark.sql import functions as F

from spanledger.functions import ordered as O
from spanledger.functions.exprs import mix
from spanledger.operators import explain as L, split as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [10_000, 3])
def test_cuts_are_the_rows_of_their_ranks(spark, monkeypatch, few):
    monkeypatch.setattr(O, "FEW_ROWS", few)
    df = spark.range(5000).select((F.col("id") * 7 + 3).alias("id"))
    order = [tuple(r) for r in df.select(mix(F.col("id"), 5), "id").collect()]
    order.sort()
    ranks = [0, 1, 2, 77, 2500, 4999, 5000, 9999]
    n, cuts = O.rank_cuts(df, "id", 5, ranks, slices=8)
    assert n == 5000 and cuts == [None] + [order[min(r, 5000) - 1] for r in ranks[1:]]
    assert O.rank_cuts(df.limit(0), "id", 5, [1, lambda n: n]) == (0, [None, None])
    for r, c in zip(ranks, cuts):
        assert df.where(O.up_to("id", 5, c)).count() == min(r, 5000)


def test_splits_move_no_row(spark):
    df = spark.range(1003).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"), F.rand(1).alias("wide"))
    for out in (S.hash_split(df, "id", 0.8, 0.1, 0.1, 3), S.kfold_assign(df, "id", 7, 3), S.oversample_parity(df, "id", "y", 3)):
        assert "Exchange" not in _plan(out)
    sizes = sorted(r["count"] for r in S.kfold_assign(df, "id", 7, 3).groupBy("fold").count().collect())
    assert sizes == [143] * 5 + [144] * 2
    assert S.kfold_assign(df, "id", 1, 3).select("fold").distinct().collect()[0][0] == 0
    even = {r["y"]: r["count"] for r in S.oversample_parity(df, "id", "y", 3).groupBy("y").count().collect()}
    assert even[0] == even[1] == 902
    assert S.oversample_parity(df.where("y = 0"), "id", "y", 3).count() == 902


def test_random_oversampling_draws_the_same_rows_again(spark):
    df = spark.range(6000).select("id", (F.col("id") % 30 == 0).cast("int").alias("y"))
    a, b = (sorted(tuple(r) for r in S.oversample_random(x, "y", 9).collect()) for x in (df, df.repartition(11)))
    assert a == b
    few = [r for r in a if r[1] == 1]
    assert abs(len(few) - 5800) < 500 and len({r for r in few}) == 200
    assert len([r for r in a if r[1] == 0]) == 5800
    assert sorted(tuple(r) for r in S.oversample_random(df, "y", 10).collect()) != a
    wide = S.oversample_random(df.where("id % 30 <> 0 OR id < 30"), "y", 9).groupBy("y").count().collect()
    assert all(abs(r["count"] - 5800) < 400 for r in wide)  # one row, thousands of times


@pytest.mark.parametrize("held", [2, 5, 2_048])
@pytest.mark.parametrize("seed", [1, 2])
def test_lazy_picks_equal_a_scan(spark, held, seed):
    rng = random.Random(seed)
    data = [(e, f"r{r}", rng.choice([-1, 1]) * rng.randrange(0, 4) / 8) for e in range(60) for r in rng.sample(range(18), 3)]
    imp, has = {}, {e: set() for e in range(60)}
    for e, r, w in data:
        imp[r] = imp.get(r, 0) + abs(w)
        if w:
            has[e].add(r)
    covered, left, want, total = set(), set(has), [], 0.0
    for step in range(1, 13):
        gains = {e: round(sum(sorted(imp[r] ** 0.5 for r in has[e] - covered)), 9) for e in left}
        best = max(left, key=lambda e: (gains[e], e))
        total += gains[best]
        covered |= has[best]
        left.discard(best)
        want.append((step, best, round(total, 6)))
    got = L.greedy_pick(spark.createDataFrame(data, "exp_id long, rule string, weight double"), 12, held=held)
    assert sorted((r["step"], r["exp_id"], round(r["coverage"], 6)) for r in got.collect()) == want
    assert L.greedy_pick(spark.createDataFrame(data[:3], "exp_id long, rule string, weight double"), 12).count() == 1
    assert L.greedy_pick(spark.createDataFrame([], "exp_id long, rule string, weight double"), 3).count() == 0


def test_ranks_within_hot_groups(spark):
    df = spark.range(3000).select((F.col("id") % 7 % 3).alias("g"), (F.col("id") * 31 % 101).alias("v"), "id").repartition(5)
    got = {r["id"]: r["r"] for r in O.range_rank(df, "g", ["v", "id"], "r").collect()}
    by = {}
    for r in df.collect():
        by.setdefault(r["g"], []).append((r["v"], r["id"]))
    assert got == {i: n for own in by.values() for n, (_, i) in enumerate(sorted(own), 1)}


def test_rings_leave_out_what_is_too_near_or_too_far(spark):
    import numpy as np

    from spanledger.operators import neighbours as B

    rng = np.random.default_rng(1)
    # Shells around one centre: only the distance to the pivot can tell them apart.
    x = rng.standard_normal((1200, 2))
    x *= (np.arange(1200) % 40 + 1)[:, None] / np.linalg.norm(x, axis=1, keepdims=True)
    x[0] = 0
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    rows, base = B._cells(df, x[:1], 60), B._cells(df, x[:1], 60)
    first, more = B.block_pairs(rows, base, x[:1], 3)
    assert rows.select("chunk").distinct().count() == 20
    assert more.count() < 0.5 * 20 * 20
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    want = {i: sorted(zip(d[i], range(1200)))[:3] for i in range(1200)}
    got = {}
    for r in B._best(first.unionByName(B._compare(rows, base, more, 3)), 3).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["nb"]))
    assert {i: [n for _, n in sorted(v)] for i, v in got.items()} == {i: [n for _, n in v] for i, v in want.items()}

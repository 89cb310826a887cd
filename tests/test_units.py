"""Helpers and operators against plain restatements on small data, with hot keys."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.functions.ordered import exact_quantiles, hash_rank, prior_max, prior_row, running_sums
from spanledger.operators import (answers as Q, cleanse, cluster as K, encode as N, explain as L, export as X, metrics as M,
                                  models, neighbours as B, series, split)
from spanledger.sources import checks, readers, sinks


def test_prior_max_and_prior_row_on_a_hot_key(spark):
    rng = random.Random(3)
    data = [(1 if rng.random() < 0.5 else k, t, rng.randrange(1000)) for k in range(2, 6) for t in range(0, 40 * 86_400, 3_600)]
    data = list({(k, t): (k, t, v) for k, t, v in data}.values())
    df = spark.createDataFrame(data, "k long, t long, v long").repartition(5)
    got = {(r["k"], r["t"]): (r["m"], r["p"]) for r in prior_row(
        prior_max(df, ["k"], "t", "v", "m", 5 * 86_400), ["k"], ["t", "v"], "t", "p", 86_400).collect()}
    by = {}
    for k, t, v in sorted(data):
        seen = by.setdefault(k, [])
        m, p = got[k, t]
        assert m == (max(x for _, x in seen) if seen else None)
        assert (tuple(p) if p else None) == (seen[-1] if seen else None)
        seen.append((t, v))


@pytest.mark.parametrize("slices", [None, 3, 200])
def test_running_sums_and_hash_rank(spark, slices):
    vals = [round(random.Random(i).gauss(0, 1), 6) for i in range(500)]
    df = spark.createDataFrame([(v, i % 3) for i, v in enumerate(sorted(set(vals)))], "v double, n long")
    rows = running_sums(df, "v", ["n"], slices=slices, descending=True).orderBy(F.desc("v")).collect()
    total = 0
    for r in rows:
        total += r["n"]
        assert r["cum_n"] == total
    ranks = hash_rank(df.withColumn("id", F.row_number().over(__import__("pyspark").sql.Window.orderBy("v"))), "id", 5, "r").select("r").collect()
    assert sorted(r["r"] for r in ranks) == list(range(1, len(rows) + 1))


def test_exact_quantiles(spark):
    rng = random.Random(1)
    data = [("a", float(rng.randrange(50))) for _ in range(700)] + [("b", rng.random()) for _ in range(301)] + [("c", 4.0)] * 9
    counts = spark.createDataFrame(data, "f string, v double").groupBy("f", "v").agg(F.count("*").alias("n"))
    got = {(r["f"], r["p"]): r["q"] for r in exact_quantiles(counts, "f", "v", "n", [0.1, 0.25, 0.5, 0.99]).collect()}
    for f in "abc":
        vals = [v for g, v in data if g == f]
        for p in (0.1, 0.25, 0.5, 0.99):
            assert math.isclose(got[f, p], float(np.quantile(vals, p)), rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("block_rows,queries", [(10_000, 400), (40, 400), (40, 120)])
def test_knn_is_exact_across_blocks_and_hot_cells(spark, block_rows, queries):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    x[100:240] = x[0]                       # a third of the rows in one place
    x[240:300] += 20
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in B.knn(df.where(F.col("id") < queries), df, 5, block_rows=block_rows).collect():
        got.setdefault(r["id"], {})[r["rank"]] = (r["nb"], r["d2"])
    assert len(got) == queries
    for i in range(queries):
        d = ((x - x[i]) ** 2).sum(1)
        want = sorted((dist, j) for j, dist in enumerate(d) if j != i)[:5]
        assert [got[i][r][0] for r in range(1, 6)] == [j for _, j in want]


def test_smote_reaches_parity_and_stays_between(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(a) for a in rng.normal(size=2)], int(i % 5 == 0)) for i in range(103)],
                               "id long, x array<double>, y int")
    new = B.smote(df, "y", 3).collect()
    assert len(new) == 82 - 21
    points = {r["id"]: r["x"] for r in df.collect()}
    for r in new:
        for a, v, b in zip(points[r["id"]], r["x"], points[r["nb"]]):
            assert min(a, b) - 1e-9 <= v <= max(a, b) + 1e-9


def mixed(spark, n=240):
    rng = np.random.default_rng(6)
    rows = [(i, [float(v) for v in rng.normal(size=2) + 6 * (i % 3)], [int(i % 3), int(rng.integers(3))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, x array<double>, c array<int>").repartition(4)


def test_silhouette_matches_pairs(spark):
    rows, df = mixed(spark, 60)
    gamma = 0.7
    lab = {i: 1 + (i % 4 if i < 58 else 4) for i, _, _ in rows}          # a cluster of two, and mixed ones
    got = {r["id"]: r["silhouette"] for r in K.silhouette_rows(
        df.withColumn("cluster", F.when(F.col("id") < 58, 1 + F.col("id") % 4).otherwise(5)), gamma).collect()}
    dist = lambda a, b: sum((p - q) ** 2 for p, q in zip(a[1], b[1])) + gamma * sum(p != q for p, q in zip(a[2], b[2]))
    for a in rows:
        means = {}
        for b in rows:
            if a[0] != b[0]:
                means.setdefault(lab[b[0]], []).append(dist(a, b))
        own = means.pop(lab[a[0]])
        near = min(sum(v) / len(v) for v in means.values())
        mine = sum(own) / len(own)
        assert math.isclose(got[a[0]], (near - mine) / max(near, mine), abs_tol=1e-9)


def test_kprototypes_finds_separate_groups(spark):
    _, df = mixed(spark)
    model = K.kprototypes(df, 3, n_runs=6, max_iter=25, seed=2)
    by = {}
    for r in K.assign(df, model.centroids, model.gamma).collect():
        by.setdefault(r["id"] % 3, set()).add(r["cluster"])
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == 3
    again = K.update(K.assign(df, model.centroids, model.gamma), 2, 2).collect()
    for r in again:
        c = model.centroids[r["cluster"] - 1]
        assert np.allclose(r["x"], c.x) and tuple(r["c"]) == c.c


def test_local_fit_recovers_a_linear_score(spark):
    df = spark.createDataFrame([(i, float(i % 17), float(i % 5), i % 3) for i in range(300)], "id long, a double, b double, k int")
    ex = L.fit(df, ["a", "b"], ["k"])
    near = L.neighbour_weights(L.perturb(df.where("id = 7"), ex, "id", 800), 2.0)
    again = L.perturb(df.where("id = 7"), ex, "id", 800)
    assert near.select("a", "b", "k").collect() == again.select("a", "b", "k").collect()
    scored = near.withColumn("score", 3.0 * F.get("same", F.lit(0)) - 1.0 * F.get("same", F.lit(2)))
    got = {r["pos"]: r["weight"] for r in L.local_fit(scored, "id", 2).collect()}
    assert set(got) == {0, 2} and abs(got[0] - 3) < 0.1 and abs(got[2] + 1) < 0.1


def test_perturbation_keeps_zero_categories_and_the_example_first(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 1, 6.0), (3, 2, 9.0)], "id long, k int, v double")
    ex = L.fit(df, ["v"], ["k"])
    rows = L.perturb(df, ex, "id", 50).collect()
    assert all(r["k"] == 0 and r["same"][1] == 1 for r in rows if r["id"] == 1)
    firsts = {r["id"]: (r["v"], list(r["same"])) for r in rows if r["sample"] == 0}
    assert firsts == {1: (5.0, [1, 1]), 2: (6.0, [1, 1]), 3: (9.0, [1, 1])}
    assert len(rows) == 150


def test_greedy_pick_matches_a_scan(spark):
    rng = random.Random(8)
    data = [(e, f"r{r}", rng.choice([-1, 1]) * rng.randrange(1, 9) / 8) for e in range(30) for r in rng.sample(range(25), 4)]
    imp = {}
    for _, r, w in data:
        imp[r] = imp.get(r, 0) + abs(w)
    has = {e: {r for x, r, _ in data if x == e} for e in range(30)}
    covered, left, want = set(), set(range(30)), []
    for _ in range(5):
        best = max(left, key=lambda e: (round(sum(imp[r] ** 0.5 for r in has[e] - covered), 9), e))
        covered |= has[best]
        left.discard(best)
        want.append(best)
    df = spark.createDataFrame(data, "exp_id long, rule string, weight double")
    assert [r["exp_id"] for r in L.greedy_pick(df, 5).orderBy("step").collect()] == want


def test_split_sequence_keeps_the_order_of_steps(spark):
    values = [0.0] * 400 + [float(v) for v in range(1, 11)] * 6
    df = spark.createDataFrame([(values,)], "f array<double>")
    static, steps = series.split_sequence(F.col("f"), 6, 10)
    row = df.select(static.alias("s"), steps.alias("t")).first()
    assert row["s"] == [0.0] * 400
    assert row["t"] == [[float(v) for v in range(1, 11)]] * 6


def test_date_roles_are_disjoint_and_ordered(spark):
    df = spark.sql("select date_add(date'2020-01-01', cast(id as int)) as d from range(49)")
    rows = split.forward_chain_folds(df, "d", 4, 0.05, 0.05).collect()
    for fold in range(4):
        by = {}
        for r in rows:
            if r["fold"] == fold:
                by.setdefault(r["role"], []).append(r["d"])
        assert max(by["train"]) < min(by["val"]) <= max(by["val"]) < min(by["test"])
        assert len(by["test"]) == 2 and len(by["train"]) == 49 - 4 - 2 * fold


def test_kfold_sizes(spark):
    sizes = sorted(r["count"] for r in split.kfold_assign(spark.range(103), "id", 10, 1).groupBy("fold").count().collect())
    assert sizes == [10] * 7 + [11] * 3


def test_oversampling_reaches_parity(spark):
    df = spark.range(1000).withColumn("y", (F.col("id") % 9 == 0).cast("int"))
    n = {r["y"]: r["count"] for r in split.oversample_parity(df, "id", "y", 3).groupBy("y").count().collect()}
    assert n[0] == n[1] == 888


def test_undefined_scores_are_zero(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, p double")
    assert [tuple(r) for r in M.prf_thresholds(df, [0.5]).collect()] == [(0.5, 0.0, 0.0, 0.0)]


# --- sources -------------------------------------------------------------------------------------

def test_episode_csv_round_trip_in_latin_1(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes("ClientID,City,DateStart,DateEnd,TotalScore\n1,Montréal,2020-01-01 10:00:00,,x\n".encode("latin-1"))
    row = readers.read_episodes(spark, str(path), ["ClientID", "City", "DateStart", "DateEnd", "TotalScore"]).first()
    assert row["City"] == "Montréal" and row["DateEnd"] is None and row["TotalScore"] is None


def test_answers_json_utf16_with_line_breaks(spark, tmp_path):
    text = '{"VISPDATS":[{"IntakeID":5,"ClientID":1,"QuestionE":"Wh\r\nat?","Component":"1","ScoreValue":"3"},\r\n{"IntakeID":5,"ClientID":1}]}'
    (tmp_path / "a.json").write_bytes(text.encode("utf-16"))
    rows = readers.read_answers(spark, str(tmp_path / "a.json")).orderBy("pos").collect()
    assert [(r["pos"], r["QuestionE"], r["ScoreValue"]) for r in rows] == [(0, "What?", "3"), (1, "0", "0")]


def test_runs_append_with_new_columns(spark, tmp_path):
    p = str(tmp_path / "runs")
    sinks.append_run(spark.createDataFrame([(1,)], "a int"), p, "2024-01-01")
    sinks.append_run(spark.createDataFrame([(2, "x")], "a int, b string"), p, "2024-01-08")
    assert [(r["a"], r["b"]) for r in sinks.read_runs(spark, p).orderBy("a").collect()] == [(1, None), (2, "x")]


def test_snapshot_messages(spark):
    df = spark.sql("select timestamp'2020-01-01' as DateStart, 1 as x")
    old = spark.createDataFrame([(5, 3)], "n_rows long, n_cols long")
    msgs = [r["message"] for r in checks.messages(checks.snapshot_checks(df, "DateStart", "2024-01-01", old)).collect()]
    assert len(msgs) == 3


def test_json_sink_drops_commas(spark):
    assert sinks.json_rows(spark.createDataFrame([("a,b", 1)], "t string, n int")).first()["value"] == '{"t":"ab","n":1}'


def test_timestamps_by_name(spark):
    df = spark.createDataFrame([("2020-01-02", "bad", "2020-01-02", 7)], "DateStart string, EndX string, Other string, StartN int")
    got = cleanse.coerce_timestamps(df, keep=["StartN"]).first()
    assert got["DateStart"].day == 2 and got["EndX"] is None and got["Other"] == "2020-01-02" and got["StartN"] == 7


def test_names_with_dots_survive_encoding(spark):
    df = spark.createDataFrame([(1, "St. John", 2.0), (2, "b", 3.0)], "id long, city string, n double")
    vocab = {"city": ["St. John", "b"]}
    hot = N.onehot_single(N.ordinal_encode(df, vocab), vocab)
    assert hot.columns == ["city_St. John", "city_b", "id", "n"]
    assert models.assemble(hot, ["city_St. John", "n"]).first()["features"].toArray().tolist() == [1.0, 2.0]


def test_question_roots_across_chunks(spark):
    rows = [(1, 1, 0, "1", "Root"), (1, 1, 1, "a", "x"), (1, 1, 2, "b", "y"), (1, 1, 3, "2", "Alone"), (1, 1, 4, "3", "Next"), (1, 1, 5, "a", "z")]
    df = spark.createDataFrame([(c, i, p, k, q, "1") for c, i, p, k, q in rows],
                               "ClientID long, IntakeID long, pos long, Component string, QuestionE string, ScoreValue string")
    for chunk in (2, 3, 100):
        full, roots = Q.question_roots(df, chunk)
        assert [r["QuestionE"] for r in full.orderBy("pos").collect()] == ["Root", "Rootx", "Rooty", "Alone", "Next", "Nextz"]
        assert sorted(r["QuestionE"] for r in roots.collect()) == ["Next", "Root"]


def test_text_list_counts_repeats_and_cuts(spark):
    df = spark.createDataFrame([(1, "bb")] * 50 + [(1, "a"), (2, None), (3, "z")], "k int, m string")
    got = {r["k"]: r["t"] for r in X.text_list(df, "k", "m", "t").collect()}
    assert got == {1: ("a" + "|bb" * 50)[:30], 3: "z"}


def test_perturb_with_thousands_of_codes(spark):
    table = {"f": [(i, 1 / 5000, 0.0, 0.0, 0.0, 0.0) for i in range(5000)]}
    ex = L.Explainer((), ("f",), {}, table, {})
    one = spark.createDataFrame([(1, 7.0), (2, 0.0)], "id long, f double")
    got = L.perturb(one, ex, "id", 400).collect()
    assert all(r.f == 0 for r in got if r.id == 2)
    drawn = {r.f for r in got if r.id == 1 and r["sample"]}
    assert len(drawn) > 300 and drawn <= set(range(5000))


def test_adasyn_of_separated_classes(spark):
    rows = [(i, [float(i), 0.0], 1) for i in range(6)] + [(100 + i, [float(i), 1e6], 0) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int")
    assert {r.n_new for r in B.adasyn_weights(df, "y", k=3).collect()} == {0}
    assert B.adasyn(df, "y", k=3).count() == 0


def test_knn_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    x = np.vstack([rng.standard_normal((150, 3)), np.zeros((5, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")
    got = {}
    for r in B.knn(df, df, 4, block_rows=16).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.nb
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    for i in range(len(x)):
        assert [got[i][k] for k in range(1, 5)] == np.lexsort((np.arange(len(x)), d[i]))[:4].tolist()


def test_weights_of_a_model_without_weights(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 0.5), (3, 0.0)], "id int, weight double")
    assert {r.id: r["count"] for r in models.replicated(df).groupBy("id").count().collect()} == {1: 4, 2: 1, 3: 1}


def test_codes_of_a_long_vocabulary(spark):
    values = sorted({f"v{i * 7919 % 100_003}" for i in range(1500)} | {"é", "", "Z"})
    rows = [(v,) for v in values] + [("zz",), ("v",), (None,), ("a",)]
    got = N.ordinal_encode(spark.createDataFrame([(r[0], r[0]) for r in rows], "f string, g string"), {"f": values}).collect()
    assert {r.g: r.f for r in got} == {v: values.index(v) + 1 if v in values else -1 for v, in rows}

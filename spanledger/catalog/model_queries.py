"""Split, balance, metric, model, explanation and clustering queries."""

from __future__ import annotations

from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import functions as F

from spanledger.catalog.registry import query
from spanledger.config import HorizonSettings, Settings
from spanledger.operators import cluster as K, encode as N, explain as L, metrics as M, models, neighbours as B, split
from spanledger.plans import dataset as D, jobs
from spanledger.session import cut_lineage
from spanledger.sources.adapters import EVENT_CFG as CFG, Tables

SEED = 7


def mix_sql(c: str, seed: int = SEED) -> str:
    """The portable id hash, step by step."""
    p = 2_147_483_647
    x = f"((({c}) % 1000003) * 7919 + (({c}) // 1000003) % 1000000007 * 104729 + {seed % 1_000_003 * 15_485_863}) % {p}"
    x = f"(({x}) * 48271 + 11) % {p}"
    x = f"(({x}) * (({x}) % 65537) + 12345) % {p}"
    return f"(({x}) * 69621 + 7) % {p}"


# --- splits --------------------------------------------------------------------------------------

@query("hash_split", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {mix_sql('o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders),
s AS (SELECT *, ceil(n * 0.05::DOUBLE) AS t FROM r)
SELECT o_orderkey, CASE WHEN r <= t THEN 'test' WHEN r <= t + ceil((n - t) * {0.05 / (0.9 + 0.05)!r}::DOUBLE) THEN 'val' ELSE 'train' END AS role FROM s""")
def hash_split(t: Tables):
    return split.hash_split(t.orders.select("o_orderkey"), "o_orderkey", 0.9, 0.05, 0.05, SEED)


_DATES = """d AS (SELECT DISTINCT o_orderdate AS d FROM orders), a AS (SELECT d, row_number() OVER (ORDER BY d DESC) AS age, count(*) OVER () AS n FROM d),
z AS (SELECT *, greatest(CAST(floor(n * 0.05::DOUBLE) AS BIGINT), 1) AS m FROM a)"""


@query("date_split", f"""WITH {_DATES} SELECT role, count(*)::BIGINT AS n, min(o_orderkey) AS lo FROM orders JOIN (
 SELECT d, CASE WHEN age <= m THEN 'test' WHEN age <= 2 * m THEN 'val' ELSE 'train' END AS role FROM z) ON d = o_orderdate GROUP BY 1""")
def date_split(t: Tables):
    roles = split.date_split(t.orders, "o_orderdate")
    return split.apply_dates(t.orders, roles, "o_orderdate").groupBy("role").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("lo"))


@query("forward_chain_folds", f"""WITH {_DATES} SELECT fold::INT AS fold, strftime(d, '%Y-%m-%d') AS "Date", CASE WHEN age - fold * m <= m THEN 'test'
 WHEN age - fold * m <= 2 * m THEN 'val' ELSE 'train' END AS role FROM z, range(5) f(fold) WHERE age - fold * m > 0""")
def forward_chain_folds(t: Tables):
    return (split.forward_chain_folds(t.orders, "o_orderdate", 5)
            .select("fold", F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), "role"))


@query("kfold_assign", f"""SELECT o_orderkey, (ntile(7) OVER (ORDER BY {mix_sql('o_orderkey')}, o_orderkey) - 1)::INT AS fold FROM orders""")
def kfold_assign(t: Tables):
    return split.kfold_assign(t.orders.select("o_orderkey"), "o_orderkey", 7, SEED)


@query("class_weights", """WITH s AS (SELECT sum(toxic) AS p, count(*) - sum(toxic) AS q FROM labels)
SELECT 0 AS toxic, round((1 - 0.4::DOUBLE) * (p + q) / q, 9) AS weight FROM s UNION ALL SELECT 1, round(0.4::DOUBLE * (p + q) / p, 9) FROM s""")
def class_weights(t: Tables):
    return split.class_weights(t.labels, "toxic", 0.4).withColumn("weight", F.round("weight", 9))


@query("log_odds", "SELECT round(ln(sum(quality)::DOUBLE / (count(*) - sum(quality))), 9) AS log_odds FROM labels")
def log_odds(t: Tables):
    return split.log_odds(t.labels, "quality").select(F.round("log_odds", 9).alias("log_odds"))


@query("oversample_parity", f"""WITH s AS (SELECT sum(toxic) AS p, count(*) - sum(toxic) AS q FROM labels),
r AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {mix_sql('doc_id')}, doc_id) AS r FROM labels),
c AS (SELECT doc_id, toxic, CASE WHEN toxic = CASE WHEN p <= q THEN 1 ELSE 0 END
 THEN greatest(p, q) // least(p, q) + CASE WHEN r <= greatest(p, q) % least(p, q) THEN 1 ELSE 0 END ELSE 1 END AS times FROM r, s)
SELECT doc_id, toxic, copy::INT AS copy FROM c, range(1, 100000) t(copy) WHERE copy <= times""")
def oversample_parity(t: Tables):
    return split.oversample_parity(t.labels.select("doc_id", "toxic"), "doc_id", "toxic", SEED)


# --- neighbours ----------------------------------------------------------------------------------

def _points(t: Tables):
    return t.vectors().select(F.col("vec_id").alias("id"), "x", F.when(F.col("label") < 3, 1).otherwise(0).alias("y"))


_KNN = """v AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS x, CASE WHEN label < 3 THEN 1 ELSE 0 END AS y FROM embeddings),
n AS (SELECT a.id, b.id AS nb, b.y AS nb_y, array_distance(a.x, b.x) AS d, row_number() OVER (PARTITION BY a.id ORDER BY array_distance(a.x, b.x), b.id) AS rank
 FROM v a JOIN v b ON a.id <> b.id WHERE a.y = 1 {same})"""


@query("minority_knn", "WITH " + _KNN.format(same="AND b.y = 1") + " SELECT id, nb, rank::INT AS rank, round(d * d, 6) AS d2 FROM n WHERE rank <= 5")
def minority_knn(t: Tables):
    return B.minority_knn(_points(t), "y", 5).select("id", "nb", "rank", F.round("d2", 6).alias("d2"))


_UNIT = lambda seed: f"({mix_sql('(id * 65536 + copy)', seed)} / 2147483647.0::DOUBLE)"
_BETWEEN = f"""deg AS (SELECT id, max(rank) AS deg FROM k GROUP BY 1),
pick AS (SELECT id, copy, (floor({_UNIT(SEED)} * deg) + 1)::INT AS rank, {_UNIT(SEED + 1)} AS g FROM times JOIN deg USING (id), range(1, 100000) t(copy) WHERE copy <= t),
new AS (SELECT id, copy::INT AS copy, nb, list_transform(list_zip(a.x::DOUBLE[], b.x::DOUBLE[]), lambda z: z[1] + g * (z[2] - z[1])) AS x
 FROM pick JOIN k USING (id, rank) JOIN v a USING (id) JOIN v b ON b.id = nb)
SELECT id, copy, nb, round(x[1], 6) AS x_first, round(list_sum(x), 6) AS x_sum FROM new"""


def _drawn(new):
    return new.select("id", "copy", "nb", F.round(F.col("x")[0], 6).alias("x_first"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 6).alias("x_sum"))


@query("smote", "WITH " + _KNN.format(same="AND b.y = 1") + f""", k AS (SELECT id, nb, rank FROM n WHERE rank <= 5),
m AS (SELECT id, row_number() OVER (ORDER BY {mix_sql('id')}, id) AS r, count(*) OVER () AS few FROM v WHERE y = 1), d AS (SELECT sum(1 - y) - sum(y) AS need FROM v),
times AS (SELECT id, need // few + CASE WHEN r <= need % few THEN 1 ELSE 0 END AS t FROM m, d), """ + _BETWEEN)
def smote(t: Tables):
    return _drawn(B.smote(_points(t), "y", 5))


@query("adasyn_weights", "WITH " + _KNN.format(same="") + """, r AS (SELECT id, sum(1 - nb_y) / 5.0::DOUBLE AS ratio FROM n WHERE rank <= 5 GROUP BY 1),
s AS (SELECT sum(1 - y) - sum(y) AS need FROM v)
SELECT id, ratio, round_even(ratio / (SELECT sum(ratio) FROM r) * need, 0)::BIGINT AS n_new FROM r, s""")
def adasyn_weights(t: Tables):
    return B.adasyn_weights(_points(t), "y", 5)


@query("adasyn", "WITH " + _KNN.format(same="") + """, r AS (SELECT id, sum(1 - nb_y) / 5.0::DOUBLE AS ratio FROM n WHERE rank <= 5 GROUP BY 1),
s AS (SELECT sum(1 - y) - sum(y) AS need FROM v), times AS (SELECT id, round_even(ratio / (SELECT sum(ratio) FROM r) * need, 0)::BIGINT AS t FROM r, s),
k AS (SELECT id, nb, place AS rank FROM (SELECT id, nb, row_number() OVER (PARTITION BY id ORDER BY d, nb) AS place FROM n WHERE nb_y = 1) WHERE place <= 5), """ + _BETWEEN)
def adasyn(t: Tables):
    return _drawn(B.adasyn(_points(t), "y", 5))


# --- metrics -------------------------------------------------------------------------------------

_SC = "s AS (SELECT (l_returnflag = 'R')::INT AS y, round(l_discount * 10, 6) AS p FROM lineitem)"


@query("prf_thresholds", f"""WITH {_SC}, c AS (SELECT th, count(*) FILTER (WHERE p >= th AND y = 1) AS tp, count(*) FILTER (WHERE p >= th AND y = 0) AS fp,
 count(*) FILTER (WHERE p < th AND y = 1) AS fn FROM s, (VALUES (0.3::DOUBLE), (0.4), (0.5), (0.6), (0.7), (2.0)) t(th) GROUP BY th),
q AS (SELECT th, coalesce(tp / nullif(tp + fp, 0), 0)::DOUBLE AS pr, coalesce(tp / nullif(tp + fn, 0), 0)::DOUBLE AS re FROM c)
SELECT th AS threshold, pr AS precision, re AS recall, coalesce(2 * pr * re / nullif(pr + re, 0), 0) AS f1score FROM q""")
def prf_thresholds(t: Tables):
    return M.prf_thresholds(t.scored(), [0.3, 0.4, 0.5, 0.6, 0.7, 2.0])


@query("accuracy_logloss", f"""WITH {_SC}, c AS (SELECT y, p, least(greatest(p, 1e-15::DOUBLE), 1 - 1e-15::DOUBLE) AS q FROM s)
SELECT round(avg(((p >= 0.5)::INT = y)::INT), 9) AS accuracy, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS loss FROM c""")
def accuracy_logloss(t: Tables):
    return M.accuracy_logloss(t.scored()).select(F.round("accuracy", 9).alias("accuracy"), F.round("loss", 6).alias("loss"))


@query("roc_auc", f"""WITH {_SC}, r AS (SELECT y, avg(rn) OVER (PARTITION BY p) AS rk FROM (SELECT y, p, row_number() OVER (ORDER BY p) AS rn FROM s))
SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))), 9) AS auc FROM r""")
def roc_auc(t: Tables):
    return M.roc_auc(t.scored()).select(F.round("auc", 9).alias("auc"))


@query("roc_auc_fine", """WITH s AS (SELECT (l_returnflag = 'R')::INT AS y, l_extendedprice AS p FROM lineitem),
r AS (SELECT y, avg(rn) OVER (PARTITION BY p) AS rk FROM (SELECT y, p, row_number() OVER (ORDER BY p) AS rn FROM s))
SELECT round((sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::DOUBLE * (count(*) - sum(y))), 9) AS auc FROM r""")
def roc_auc_fine(t: Tables):
    """Nearly every score distinct."""
    rows = t.lineitem.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_extendedprice").alias("p"))
    return M.roc_auc(rows).select(F.round("auc", 9).alias("auc"))


@query("roc_points", f"""WITH {_SC}, g AS (SELECT p, sum(y) AS a, sum(1 - y) AS b FROM s GROUP BY p)
SELECT p AS threshold, round(sum(b) OVER w / (SELECT sum(b) FROM g), 9)::DOUBLE AS fpr, round(sum(a) OVER w / (SELECT sum(a) FROM g), 9)::DOUBLE AS tpr
FROM g WINDOW w AS (ORDER BY p DESC)""")
def roc_points(t: Tables):
    return M.roc_points(t.scored()).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("confusion", f"WITH {_SC} SELECT y AS label, (p > 0.5)::INT AS predicted, count(*)::BIGINT AS n FROM s GROUP BY 1, 2")
def confusion(t: Tables):
    return M.confusion(t.scored())


@query("tag_outcomes", """SELECT l_returnflag, CASE WHEN p >= 0.5 AND y = 1 THEN 'TP' WHEN p >= 0.5 THEN 'FP' WHEN y = 1 THEN 'FN' ELSE 'TN' END AS outcome,
 count(*)::BIGINT AS n FROM (SELECT l_returnflag, (l_returnflag = 'R')::INT AS y, round(l_discount * 10, 6) AS p FROM lineitem) GROUP BY 1, 2""")
def tag_outcomes(t: Tables):
    y, p = (F.col("l_returnflag") == "R").cast("int"), F.round(F.col("l_discount") * 10, 6)
    return t.lineitem.withColumn("outcome", M.outcome(y, p)).groupBy("l_returnflag", "outcome").agg(F.count("*").alias("n"))


@query("weighted_soft_f1", f"""WITH {_SC}, a AS (SELECT sum(y * p) AS t, sum(p) AS s, sum(y) AS a FROM s),
r AS (SELECT (t + 1e-7::DOUBLE) / (s + 1e-7::DOUBLE) AS pr, (t + 1e-7::DOUBLE) / (a + 1e-7::DOUBLE) AS re, 2 / 5.5::DOUBLE AS w FROM a)
SELECT round(2 * pr * re / ((2 - w) * pr + w * re + 1e-7::DOUBLE), 6) AS wf1, round(1 - 2 * pr * re / ((2 - w) * pr + w * re + 1e-7::DOUBLE), 6) AS loss FROM r""")
def weighted_soft_f1(t: Tables):
    return M.weighted_soft_f1(t.scored()).select(F.round("wf1", 6).alias("wf1"), F.round("loss", 6).alias("loss"))


def _runs(t: Tables):
    """orders by year and status as a table of experiment runs."""
    return (t.orders.groupBy(F.year("o_orderdate").alias("n"), "o_orderstatus")
            .agg(F.round(F.avg("o_totalprice"), 4).alias("loss"), F.count("*").cast("double").alias("recall"),
                 F.round(F.max("o_totalprice"), 2).alias("auc")))


_RUNS = """r AS (SELECT year(o_orderdate)::INT AS n, o_orderstatus, round(avg(o_totalprice), 4) AS loss, count(*)::DOUBLE AS recall,
 round(max(o_totalprice), 2) AS auc FROM orders GROUP BY 1, 2)"""


@query("fold_summary", f"""WITH {_RUNS} SELECT 'loss' AS metric, round(avg(loss), 4) AS mean, round(stddev_samp(loss), 4) AS std FROM r
UNION ALL SELECT 'recall', round(avg(recall), 4), round(stddev_samp(recall), 4) FROM r""")
def fold_summary(t: Tables):
    return M.fold_summary(_runs(t), ["loss", "recall"]).select("metric", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


@query("horizon_trend", f"""WITH {_RUNS} SELECT round(regr_slope(loss, n), 4) AS slope, round(regr_intercept(loss, n), 1) AS intercept, round(regr_r2(loss, n), 6) AS r2 FROM r""")
def horizon_trend(t: Tables):
    return M.horizon_trend(_runs(t), "loss").select(F.round("slope", 4).alias("slope"), F.round("intercept", 1).alias("intercept"), F.round("r2", 6).alias("r2"))


@query("horizon_means", f"WITH {_RUNS} SELECT n, round(avg(loss), 4) AS loss FROM r GROUP BY 1")
def horizon_means(t: Tables):
    return M.horizon_means(_runs(t), "loss").withColumn("loss", F.round("loss", 4))


@query("best_run", f"WITH {_RUNS} SELECT n AS run, recall, loss, auc FROM r ORDER BY recall DESC, loss, auc DESC, n LIMIT 1")
def best_run(t: Tables):
    runs = _runs(t).select(F.col("n").alias("run"), "recall", "loss", "auc")
    return M.best_run(runs, ["recall", "loss", "auc"])


@query("classify_scores", """SELECT l_returnflag, CASE WHEN round(l_discount * 10, 6) >= 0.5 THEN 'at risk' ELSE 'not at risk' END AS class, count(*)::BIGINT AS n,
 round(sum(100 * round(l_discount * 10, 6)), 3) AS pct FROM lineitem GROUP BY 1, 2""")
def classify_scores(t: Tables):
    scored = t.lineitem.withColumn("p", F.round(F.col("l_discount") * 10, 6))
    table = models.prediction_table(scored, "l_orderkey", 26.0, CFG.class_names, 0.5, keep=["l_returnflag"])
    return table.groupBy("l_returnflag", "class").agg(F.count("*").alias("n"), F.round(F.sum("probability_pct"), 3).alias("pct"))


# --- models --------------------------------------------------------------------------------------

_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "late"]


def _train_rows(t: Tables):
    """lineitem rows with a binary label and five numerics."""
    df = t.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), *_X[:4],
        (F.unix_seconds("l_shipdate") / 86_400.0).alias("late"),
        ((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 40)).cast("int").alias("y"))
    return split.hash_split(df, "id", 0.8, 0.1, 0.1, SEED)


def _fit_score(t: Tables, kind: str, **kw):
    # The memory is for a network's blocks, which every step reads; its rows are read a few times only.
    rows = _train_rows(t).persist(StorageLevel.DISK_ONLY if kind == "mlp" else StorageLevel.MEMORY_AND_DISK_DESER)
    fitted = N.moments(rows.where("role = 'train'"), _X)
    model = models.fit(kind, N.standard_scale(rows.where("role = 'train'"), fitted), _X, "y", seed=SEED, **kw)
    scored = models.score(model, N.standard_scale(rows.where("role = 'test'"), fitted), _X).select("y", "p").persist()
    return models.evaluate(scored, CFG.train.thresholds)


@query("fit_score_logreg")
def fit_score_logreg(t: Tables):
    return _fit_score(t, "logreg", pos_weight=0.5)


@query("fit_score_forest")
def fit_score_forest(t: Tables):
    return _fit_score(t, "forest", pos_weight=0.5)


@query("fit_score_gbt")
def fit_score_gbt(t: Tables):
    return _fit_score(t, "gbt", pos_weight=0.5)


@query("fit_score_mlp")
def fit_score_mlp(t: Tables):
    return _fit_score(t, "mlp")


def _series(t: Tables):
    ds = D.series_dataset(t.raw_episodes(), CFG, n_anchors=7)
    cols = [c for c in ds.encoded.columns if c not in ("ClientID", "Date", "GroundTruth")]
    # Column names with dots or brackets are awkward to assemble; positions serve as well.
    names = {c: f"f{i}" for i, c in enumerate(cols)}
    df = ds.encoded.select("ClientID", "Date", F.col("GroundTruth").cast("int").alias("y"),
                           *[F.col(f"`{c}`").cast("double").alias(n) for c, n in names.items()])
    # Stored once: folds and fits read the table, not the plan that made it.
    return cut_lineage(df), list(names.values()), ds.meta


@query("fit_score_lags")
def fit_score_lags(t: Tables):
    df, cols, _ = _series(t)
    rows = split.apply_dates(df, split.date_split(df, "Date"), "Date")
    train = rows.where("role = 'train'")
    fitted = N.moments(train, cols)
    model = models.fit("logreg", N.standard_scale(train, fitted), cols, "y", seed=SEED, regParam=0.01)
    scored = models.score(model, N.standard_scale(rows.where("role = 'test'"), fitted), cols).select("y", "p").persist()
    return models.evaluate(scored, CFG.train.thresholds)


@query("multi_train")
def multi_train(t: Tables):
    parts = _train_rows(t).drop("id")
    runs = models.multi_run(parts, 3, kind="forest", columns=_X, label="y", scaled=_X, numTrees=10)
    return M.best_run(runs, CFG.train.metric_preference)


@query("hparam_trials")
def hparam_trials(t: Tables):
    trials = models.random_trials({"regParam": (-4.0, -1.0), "elasticNetParam": [0.0, 0.5, 1.0]}, 3, 2, SEED, log=("regParam",))
    return models.hparam_trials(_train_rows(t).drop("id"), trials, kind="logreg", columns=_X, label="y", scaled=_X)


@query("kfold_cv")
def kfold_cv(t: Tables):
    df = _train_rows(t).drop("role")
    return models.kfold_cv(df, "id", Settings().series.folds, kind="logreg", columns=_X, label="y", scaled=_X)


@query("forward_cv")
def forward_cv(t: Tables):
    df, cols, _ = _series(t)
    return models.forward_cv(df, "Date", CFG.series.folds, kind="logreg", columns=cols, label="y", scaled=cols, regParam=0.01)


@query("horizon_search")
def horizon_search(t: Tables):
    # The events span one month, so weeks 0 to 2 in place of the settings' 0 to 52.
    cfg = replace(CFG, horizon=HorizonSettings(0, 2, 1))
    return jobs.horizon_search(t.raw_episodes(), cfg, "logreg", series=True, n_anchors=7, regParam=0.01)


@query("batch_predict")
def batch_predict(t: Tables):
    rows = _train_rows(t)
    fitted = N.moments(rows.where("role = 'train'"), _X)
    model = models.fit("logreg", N.standard_scale(rows.where("role = 'train'"), fitted), _X, "y", seed=SEED)
    scored = models.score(model, N.standard_scale(rows, fitted), _X)
    return models.prediction_table(scored, "id", CFG.horizon_weeks, CFG.class_names, 0.5)


# --- explanations --------------------------------------------------------------------------------

@query("kernel_weights", """SELECT l_orderkey, l_linenumber, round(sqrt(exp(-(l_quantity * l_quantity) / (0.75::DOUBLE * sqrt(64)) ** 2)), 9) AS weight FROM lineitem""")
def kernel_weights(t: Tables):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(L.kernel_weight(F.col("l_quantity"), L.default_width(64)), 9).alias("weight"))


def _explained(t: Tables):
    """A fitted explainer over customers, and a score that needs no fitting."""
    df = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal", (F.col("c_custkey") % 1000).cast("double").alias("age"),
                           (F.col("c_nationkey") % 4).alias("kind"))
    ex = L.fit(df, ["c_acctbal", "age"], ["kind"], names={"kind": ["DUMMY_VAL", "a", "b", "c"]})
    p = 1 / (1 + F.exp(-(F.col("c_acctbal") / 4000 - F.col("age") / 400 + F.when(F.col("kind") == 2, 1.0).otherwise(0.0))))
    return df, ex, lambda rows: rows.withColumn("score", p)


_FEATURES = """f AS (SELECT c_custkey AS id, c_acctbal AS a, (c_custkey % 1000)::DOUBLE AS b, (c_nationkey % 4)::DOUBLE AS c FROM customer),
edges AS (SELECT list_distinct([quantile_cont(a, 0.25), quantile_cont(a, 0.5), quantile_cont(a, 0.75)]) AS ea, list_distinct([quantile_cont(b, 0.25), quantile_cont(b, 0.5), quantile_cont(b, 0.75)]) AS eb FROM f),
own AS (SELECT f.*, len(list_filter(ea, lambda e: e < a)) AS ba, len(list_filter(eb, lambda e: e < b)) AS bb FROM f, edges),
slots AS (SELECT 0 AS i, ba::INT AS slot, count(*) AS n, avg(a) AS m, stddev_pop(a) AS s, min(a) AS lo, max(a) AS hi FROM own GROUP BY 2
 UNION ALL SELECT 1, bb::INT, count(*), avg(b), stddev_pop(b), min(b), max(b) FROM own GROUP BY 2
 UNION ALL SELECT 2, c::INT, count(*), c, 0, c, c FROM own GROUP BY 2, 4),
-- Columns of equal height: the poorest slot is filled up from the richest one.
mass AS (SELECT i, slot, m, s, lo, hi, row_number() OVER (PARTITION BY i ORDER BY slot) - 1 AS k, n * count(*) OVER (PARTITION BY i) AS mass, sum(n) OVER (PARTITION BY i)::BIGINT AS whole FROM slots),
fill AS (SELECT i, NULL::BIGINT AS k, NULL::BIGINT AS cut, NULL::BIGINT AS other, list({'m': mass::BIGINT, 'k': k}) AS rest, any_value(whole) AS whole FROM mass GROUP BY i
 UNION ALL SELECT i, poor.k, (poor.m::HUGEINT * 2147483647 // whole)::BIGINT, rich.k,
  list_transform(list_filter(rest, lambda x: x.k <> poor.k), lambda x: {'m': CASE WHEN x.k = rich.k THEN x.m - (whole - poor.m) ELSE x.m END, 'k': x.k}), whole
 FROM (SELECT i, whole, rest, list_sort(rest)[1] AS poor, list_sort(list_transform(rest, lambda x: {'m': -x.m, 'k': x.k}))[1] AS rich FROM fill) WHERE poor.m < whole),
cols AS (SELECT mass.i, list(coalesce(cut, 2147483647) ORDER BY mass.k) AS cut, list(coalesce(other, mass.k) ORDER BY mass.k) AS other, list(slot ORDER BY mass.k) AS slot,
 list(m ORDER BY mass.k) AS m, list(s ORDER BY mass.k) AS s, list(lo ORDER BY mass.k) AS lo, list(hi ORDER BY mass.k) AS hi, count(*) AS n FROM mass LEFT JOIN fill ON mass.i = fill.i AND mass.k = fill.k GROUP BY 1)"""


def _near_sql(samples: int, where: str = "TRUE") -> str:
    """Drawn neighbours: one look at the columns of each feature."""
    draw = lambda i, j: mix_sql(f"(id * {samples} + sample)", SEED * 1_000 + 3 * i + j)
    cols = ", ".join(f"c{i} AS (SELECT * FROM cols WHERE i = {i})" for i in range(3))
    at = ", ".join(f"{draw(i, 0)} * c{i}.n AS x{i}, {draw(i, 1)} AS u{i}, {draw(i, 2)} AS v{i}" for i in range(3))
    pick = ", ".join(f"CASE WHEN x{i} % 2147483647 < c{i}.cut[(x{i} // 2147483647) + 1] THEN x{i} // 2147483647 ELSE c{i}.other[(x{i} // 2147483647) + 1] END + 1 AS k{i}, "
                     f"sqrt(-2 * ln((u{i} + 1) / 2147483647.0::DOUBLE)) * cos(v{i} * (2 * pi() / 2147483647)) AS z{i}" for i in range(3))
    value = lambda i, x: f"CASE WHEN sample = 0 THEN {x} ELSE greatest(c{i}.lo[k{i}], least(c{i}.hi[k{i}], c{i}.m[k{i}] + c{i}.s[k{i}] * z{i})) END"
    return f"""{_FEATURES}, {cols},
d AS (SELECT own.*, sample, {at} FROM own, c0, c1, c2, (SELECT unnest(range({samples})) AS sample) WHERE {where}),
p AS (SELECT d.*, {pick} FROM d, c0, c1, c2),
v AS (SELECT id, sample, {value(0, 'a')} AS a, {value(1, 'b')} AS b, CASE WHEN sample = 0 OR c = 0 THEN c ELSE c2.slot[k2] END AS kind,
 (sample = 0 OR c0.slot[k0] = ba)::INT AS sa, (sample = 0 OR c1.slot[k1] = bb)::INT AS sb, (sample = 0 OR c = 0 OR c2.slot[k2] = c)::INT AS sc FROM p, c0, c1, c2),
near AS (SELECT *, sqrt(exp(-(3 - sa - sb - sc) / (0.75::DOUBLE * sqrt(3)) ** 2)) AS w FROM v)"""


def _fit_sql(samples: int, where: str = "TRUE") -> str:
    """Ridge with all three features by determinants, its rules in order."""
    s = {f"g{n}": f"(sum(w * {a} * {b}) - sum(w * {a}) * sum(w * {b}) / sum(w))" for n, a, b in
         [("aa", "sa", "sa"), ("bb", "sb", "sb"), ("cc", "sc", "sc"), ("ab", "sa", "sb"), ("ac", "sa", "sc"), ("bc", "sb", "sc"), ("ay", "sa", "y"), ("by", "sb", "y"), ("cy", "sc", "y")]}
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"
    rows = [["(gaa + 1)", "gab", "gac"], ["gab", "(gbb + 1)", "gbc"], ["gac", "gbc", "(gcc + 1)"]]
    put = lambda j: [[y if i == j else x for i, x in enumerate(r)] for r, y in zip(rows, ("gay", "gby", "gcy"))]
    rule = lambda f, e, b: (f"CASE WHEN {b} = 0 THEN '{f} <= ' || printf('%.2f', {e}[1]) WHEN {b} = len({e}) THEN '{f} > ' || printf('%.2f', {e}[len({e})]) "  # noqa: E731
                            f"ELSE printf('%.2f', {e}[{b}]) || ' < {f} <= ' || printf('%.2f', {e}[{b} + 1]) END")
    return f"""WITH RECURSIVE {_near_sql(samples, where)},
y AS (SELECT *, 1 / (1 + exp(-(a / 4000 - b / 400 + CASE WHEN kind = 2 THEN 1.0 ELSE 0.0 END))) AS y FROM near),
g AS (SELECT id, {', '.join(f'{v} AS {n}' for n, v in s.items())} FROM y GROUP BY id),
b AS (SELECT id, unnest([0, 1, 2]) AS pos, unnest([{', '.join(f'{det(*put(j))} / {det(*rows)}' for j in range(3))}]) AS weight FROM g),
t AS (SELECT id, {rule('c_acctbal', 'list_sort(ea)', 'ba')} AS r0, {rule('age', 'list_sort(eb)', 'bb')} AS r1, 'kind=' || ['DUMMY_VAL', 'a', 'b', 'c'][c::INT + 1] AS r2 FROM own, edges)
SELECT id, row_number() OVER (PARTITION BY id ORDER BY abs(weight) DESC, pos)::INT AS rank, CASE pos WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END AS rule, round(weight, 6) AS weight FROM b JOIN t USING (id) JOIN (SELECT id, c FROM f) USING (id)
WHERE NOT (pos = 2 AND c = 0)"""  # a feature that never changes is on no path


@query("perturb_neighbourhood", f"""WITH RECURSIVE {_near_sql(60)} SELECT id, sample, round(a, 6) AS c_acctbal, round(b, 6) AS age, kind, [sa, sb, sc] AS same, 3 - sa - sb - sc AS differ, round(w, 9) AS weight FROM near""")
def perturb_neighbourhood(t: Tables):
    df, ex, _ = _explained(t)
    near = L.neighbour_weights(L.perturb(df, ex, "id", 60, SEED), L.default_width(3))
    return near.withColumns({"c_acctbal": F.round("c_acctbal", 6), "age": F.round("age", 6), "weight": F.round("weight", 9)})


@query("explain_batch", _fit_sql(200))
def explain_batch(t: Tables):
    df, ex, score = _explained(t)
    return L.explain(df, ex, score, "id", samples=200, num_features=3).withColumn("weight", F.round("weight", 6))


_CUT_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _entropy_sql(rounds: int) -> str:
    """Bins cut in two round by round: every cut between two values of a bin is tried."""
    e = lambda a, b: f"(CASE WHEN {a} > 0 THEN -({a} / ({a} + {b})) * log2({a} / ({a} + {b})) ELSE 0 END + CASE WHEN {b} > 0 THEN -({b} / ({a} + {b})) * log2({b} / ({a} + {b})) ELSE 0 END)"
    sql = "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value, (l_returnflag = 'R')::INT AS y FROM lineitem" for c in _CUT_COLUMNS) + """),
n AS (SELECT feature, value, count(*) - sum(y) AS n0, sum(y) AS n1, '' AS bin FROM l GROUP BY 1, 2)"""
    last = "n"
    for r in range(rounds):
        sql += f""",
c{r} AS (SELECT *, sum(n0) OVER w AS l0, sum(n1) OVER w AS l1, sum(n0) OVER b AS t0, sum(n1) OVER b AS t1, lead(value) OVER w AS after FROM {last}
 WINDOW w AS (PARTITION BY feature, bin ORDER BY value), b AS (PARTITION BY feature, bin)),
g{r} AS (SELECT *, round({e('t0', 't1')} - (l0 + l1) / (t0 + t1) * {e('l0', 'l1')} - (t0 + t1 - l0 - l1) / (t0 + t1) * {e('(t0 - l0)', '(t1 - l1)')}, 12) AS gain FROM c{r} WHERE after IS NOT NULL),
b{r} AS (SELECT feature, bin, value AS cut, (value + after) / 2 AS edge FROM g{r} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY feature, bin ORDER BY gain DESC, value) = 1),
n{r} AS (SELECT x.feature, value, n0, n1, x.bin || CASE WHEN cut IS NULL THEN '-' WHEN value <= cut THEN 'l' ELSE 'r' END AS bin FROM {last} x LEFT JOIN b{r} b ON x.feature = b.feature AND x.bin = b.bin)"""
        last = f"n{r}"
    return sql + " SELECT feature, list_transform(list_sort(list(edge)), lambda x: round(x, 6)) AS edges FROM (" + " UNION ALL ".join(f"SELECT feature, edge FROM b{r}" for r in range(rounds)) + ") GROUP BY 1"


@query("entropy_bins", _entropy_sql(3))
def entropy_bins(t: Tables):
    df = t.lineitem.withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return N.entropy_bins(df, _CUT_COLUMNS, "y").where(F.size("edges") > 0).withColumn("edges", F.transform("edges", lambda x: F.round(x, 6)))


@query("explain_select", """WITH s AS (SELECT event_id, (value > 60)::INT AS pred, (event_type = 'error')::INT AS y, lag((value > 60)::INT) OVER (ORDER BY event_id) AS before FROM events)
SELECT event_id, pred, y FROM s WHERE pred = 1 OR y = 1 OR before = 1""")
def explain_select(t: Tables):
    df = t.events.select("event_id", (F.col("value") > 60).cast("int").alias("pred"), (F.col("event_type") == "error").cast("int").alias("y"))
    return L.explain_select(df, "event_id", everything=False, chunk=2_000)


@query("explain_one", _fit_sql(Settings().explain.num_samples, "id = 42"))
def explain_one(t: Tables):
    df, ex, score = _explained(t)
    return L.explain_one(df, ex, score, "id", 42, samples=Settings().explain.num_samples, num_features=3).withColumn("weight", F.round("weight", 6))


_EXP = "e AS (SELECT l_orderkey AS exp_id, l_returnflag || l_linestatus || l_linenumber AS rule, l_tax - 0.04::DOUBLE AS weight FROM lineitem)"
_IMP = "w AS (SELECT exp_id, rule, sum(weight) AS w FROM e GROUP BY 1, 2), i AS (SELECT rule, sqrt(sum(abs(w))) AS imp FROM w GROUP BY 1)"


@query("avg_rule_weight", f"WITH {_EXP} SELECT rule, round(avg(weight), 9) AS weight FROM e GROUP BY 1")
def avg_rule_weight(t: Tables):
    return L.avg_rule_weight(t.explanations()).withColumn("weight", F.round("weight", 9))


@query("rule_importance", f"WITH {_EXP}, {_IMP} SELECT rule, round(imp, 6) AS importance FROM i")
def rule_importance(t: Tables):
    return L.rule_importance(t.explanations()).withColumn("importance", F.round("importance", 6))


def _pick_sql(steps: int) -> str:
    """Greedy cover unrolled: each step scores every remaining candidate over the rules still open."""
    sql = f"WITH {_EXP}, {_IMP}, n AS (SELECT exp_id, rule, imp FROM w JOIN i USING (rule) WHERE w <> 0), everyone AS (SELECT DISTINCT exp_id FROM w)"
    for s in range(1, steps + 1):
        chosen = " UNION ALL ".join(f"SELECT exp_id FROM p{j}" for j in range(1, s)) or "SELECT NULL::BIGINT AS exp_id WHERE FALSE"
        sql += f""", p{s} AS MATERIALIZED (SELECT exp_id, g FROM (SELECT exp_id, round(coalesce(sum(imp), 0), 9) AS g FROM everyone LEFT JOIN (
 SELECT * FROM n WHERE rule NOT IN (SELECT rule FROM n WHERE exp_id IN ({chosen}))) USING (exp_id)
 WHERE exp_id NOT IN ({chosen}) GROUP BY 1) ORDER BY g DESC, exp_id DESC LIMIT 1)"""
    return sql + " " + " UNION ALL ".join(
        f"SELECT {s} AS step, exp_id, round({' + '.join(f'(SELECT g FROM p{j})' for j in range(1, s + 1))}, 4) AS coverage FROM p{s}" for s in range(1, steps + 1))


@query("greedy_pick", _pick_sql(5))
def greedy_pick(t: Tables):
    return L.greedy_pick(t.explanations(), 5).withColumn("coverage", F.round("coverage", 4))


@query("top_rules_by_sign", f"""WITH {_EXP}, a AS (SELECT rule, round(avg(weight), 9) AS weight FROM e GROUP BY 1),
n AS (SELECT count(*) FILTER (WHERE weight >= 0) AS p, count(*) FILTER (WHERE weight < 0) AS q FROM a),
k AS (SELECT *, CASE WHEN p >= q THEN least(p, 7) ELSE floor(least(q, 7) * (p / q)) END AS kp, CASE WHEN p >= q THEN floor(least(p, 7) / (p / q)) ELSE least(q, 7) END AS kq FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY weight >= 0 ORDER BY abs(weight) DESC, rule) AS rn FROM a)
SELECT rule, weight FROM r, k WHERE rn <= CASE WHEN weight >= 0 THEN kp ELSE kq END""")
def top_rules_by_sign(t: Tables):
    return L.top_rules_by_sign(L.avg_rule_weight(t.explanations()).withColumn("weight", F.round("weight", 9)), 15)


# --- clustering ----------------------------------------------------------------------------------

_CENTS = [K.Centroid((0.0, 0.0), (1, 0)), K.Centroid((4000.0, 500.0), (0, 1)), K.Centroid((8000.0, 100.0), (2, 2))]
_GAMMA = 900_000.0
_MIXED = "m AS (SELECT c_custkey AS id, c_acctbal AS a, (c_custkey % 1000)::DOUBLE AS b, c_nationkey % 3 AS c, length(c_mktsegment) % 3 AS e FROM customer)"


def _dist_sql(cent: K.Centroid) -> str:
    (a, b), (c, e) = cent.x, cent.c
    return f"((a - {a}::DOUBLE) ** 2 + (b - {b}::DOUBLE) ** 2 + {_GAMMA}::DOUBLE * ((c <> {c})::INT + (e <> {e})::INT))"


_DISTS = ", ".join(f"{_dist_sql(c)} AS d{i}" for i, c in enumerate(_CENTS))
_ASSIGNED = f"{_MIXED}, d AS (SELECT *, {_DISTS} FROM m), s AS (SELECT *, least(d0, d1, d2) AS cost, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 1 WHEN d1 <= d2 THEN 2 ELSE 3 END AS cluster FROM d)"


def _mixed(t: Tables):
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.array("c_acctbal", (F.col("c_custkey") % 1000).cast("double")).alias("x"),
        F.array(F.col("c_nationkey") % 3, F.length("c_mktsegment") % 3).cast("array<int>").alias("c"))


@query("mixed_distance", f"WITH {_MIXED} SELECT id, round({_dist_sql(_CENTS[1])}, 4) AS d FROM m")
def mixed_distance(t: Tables):
    return _mixed(t).select("id", F.round(K.mixed_distance(F.col("x"), F.col("c"), _CENTS[1], _GAMMA), 4).alias("d"))


@query("kproto_assign", f"WITH {_ASSIGNED} SELECT id, cluster::INT AS cluster, round(cost, 4) AS cost FROM s")
def kproto_assign(t: Tables):
    return K.assign(_mixed(t), _CENTS, _GAMMA).select("id", "cluster", F.round("cost", 4).alias("cost"))


@query("kproto_update", f"""WITH {_ASSIGNED}, mc AS (SELECT cluster, c, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, c) AS rn FROM s GROUP BY cluster, c),
me AS (SELECT cluster, e, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, e) AS rn FROM s GROUP BY cluster, e)
SELECT cluster::INT AS cluster, round(avg(a), 4) AS a, round(avg(b), 4) AS b, any_value(mc.c)::INT AS c, any_value(me.e)::INT AS e, count(*)::BIGINT AS n
FROM s JOIN mc USING (cluster) JOIN me USING (cluster) WHERE mc.rn = 1 AND me.rn = 1 GROUP BY 1""")
def kproto_update(t: Tables):
    return K.update(K.assign(_mixed(t), _CENTS, _GAMMA), 2, 2).select(
        "cluster", F.round(F.col("x")[0], 4).alias("a"), F.round(F.col("x")[1], 4).alias("b"),
        F.col("c")[0].alias("c"), F.col("c")[1].alias("e"), "n")


def _scaled_mixed(t: Tables):
    df = t.customer.select(F.col("c_custkey").alias("id"), "c_acctbal", (F.col("c_custkey") % 1000).cast("double").alias("age"),
                           (F.col("c_nationkey") % 3).alias("kind"))
    fitted = N.moments(df, ["c_acctbal", "age"])
    rows = N.standard_scale(df, fitted)
    return df, fitted, rows.select("id", F.array("c_acctbal", "age").alias("x"), F.array("kind").cast("array<int>").alias("c"))


@query("kprototypes")
def kprototypes(t: Tables):
    _, _, rows = _scaled_mixed(t)
    model = K.kprototypes(rows, Settings().cluster.k, n_runs=Settings().cluster.n_runs, max_iter=30)
    return K.assign(rows, model.centroids, model.gamma).select("id", "cluster", "cost")


@query("centroid_report")
def centroid_report(t: Tables):
    df, fitted, rows = _scaled_mixed(t)
    model = K.kprototypes(rows, Settings().cluster.k, n_runs=Settings().cluster.n_runs, max_iter=30)
    share = K.cluster_share(K.assign(rows, model.centroids, model.gamma))
    table = N.inverse_scale(K.centroid_table(rows, model, ["c_acctbal", "age"], ["kind"]), fitted)
    table = table.withColumn("p", 1 / (1 + F.exp(-F.col("c_acctbal") / 4000)))
    named = N.decode_ordinal(table.withColumn("kind", F.col("kind") + 1), {"kind": ["a", "b", "c"]})
    return (named.join(share, "cluster").withColumn("class", models.classify(F.col("p"), CFG.class_names))
            .withColumn("probability_pct", 100 * F.col("p")).drop("p"))


@query("silhouette", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[64] AS x, label FROM embeddings),
d AS (SELECT a.id, a.label, b.label AS other, sum(array_distance(a.x, b.x) ** 2) AS s, count(*) AS n FROM v a JOIN v b ON TRUE GROUP BY 1, 2, 3),
m AS (SELECT id, max(CASE WHEN label = other AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY 1)
SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""")
def silhouette(t: Tables):
    return K.silhouette(t.vectors().withColumnRenamed("label", "cluster")).select(F.round("silhouette", 6).alias("silhouette"))


@query("best_k")
def best_k(t: Tables):
    _, _, rows = _scaled_mixed(t)
    return K.best_k(K.silhouette_by_k(rows, 2, 5, n_runs=2, max_iter=15))

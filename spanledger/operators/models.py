"""MLlib models, their scores, and how experiments are evaluated."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from math import ceil, sqrt
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassificationModel, RandomForestClassifier)
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from spanledger.functions.exprs import col
from spanledger.operators import encode, metrics as M, network, split

# Sizes of the models.
TREES = 100
ROUNDS = 100
LAYERS = (80, 60, 60)
# What one task of a fit keeps of its rows at most, and how many rows of a network, which reckons some microseconds on each, a hundred times.
TASK_BYTES = 1_000_000_000
NETWORK_ROWS = 30_000
# Every step of a network starts all its tasks anew: so many for each core are enough, unless their rows got larger than this.
NETWORK_TASKS = 4
NETWORK_TASK_BYTES = 24_000_000
# Trees read cells of rows from so many rows and up to so many columns on; values beyond those of a column's own bins are never cells.
CELL_ROWS = 100_000
CELL_COLUMNS = 20
TASK_CELLS = {"gbt": 30_000, "forest": 150_000}
# Trees of a forest over cells that are fitted at a time, and how many cells they may keep together.
TREES_AT_ONCE = 8
CELLS_AT_ONCE = 4_000_000


def _each(f: Callable, items: Sequence, parallel: int) -> list:
    if min(parallel, len(items)) <= 1:
        return [f(x) for x in items]
    with ThreadPool(min(parallel, len(items))) as pool:
        return pool.map(f, items, 1)


def assemble(df: DataFrame, columns: Sequence[str], out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(F.array(*[col(c).cast("double") for c in columns])))


def with_weights(df: DataFrame, label: str, pos_weight: float, of: DataFrame | None = None) -> DataFrame:
    """Class weight beside every row; two values, read once, from the rows themselves or from those they stand for."""
    w = {r[label]: r["weight"] for r in split.class_weights(df if of is None else of, label, pos_weight).collect()}
    return df.withColumn("weight", F.when(F.col(label) == 1, w[1]).otherwise(w[0]))


def replicated(df: DataFrame, weight: str = "weight") -> DataFrame:
    """Rows repeated in proportion to their weight, to the nearest whole number, for a model that takes no weights."""
    low = df.where(F.col(weight) > 0).agg(F.min(weight)).first()[0]
    if low is None:
        return df
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.round(F.col(weight) / low)).cast("int")))).drop("_copy")


def estimator(kind: str, label: str, seed: int, width: int, weight: str | None = None, **params):
    common = {"labelCol": label, "featuresCol": "features"}
    if weight and kind != "mlp":
        common["weightCol"] = weight
    if kind == "logreg":
        return LogisticRegression(**common, **({"maxIter": 100} | params))
    if kind == "forest":
        return RandomForestClassifier(**common, **({"numTrees": TREES, "seed": seed} | params))
    if kind == "gbt":
        return GBTClassifier(**common, **({"maxIter": ROUNDS, "seed": seed, "maxDepth": 3} | params))
    if kind == "mlp":
        layers = [width, *params.pop("nodes", LAYERS), 2]
        return MultilayerPerceptronClassifier(layers=layers, seed=seed, **common, **({"maxIter": 100} | params))
    raise ValueError(kind)


def task_rows(kind: str, **params) -> int | None:
    """Rows that one task of a fit may hold; none for fits that pack their rows. Trees keep a row as an object, a forest also a count per tree."""
    if kind == "mlp":
        return NETWORK_ROWS
    trees = {"forest": params.get("numTrees", TREES), "gbt": 1}.get(kind)
    return trees and max(1, TASK_BYTES // (150 + 5 * trees))


def spread(kind: str, df: DataFrame, **params) -> DataFrame:
    """Rows in tasks of bounded size. A fit keeps the tasks of its input, and large files are read by few; rows are moved only if a task has too many."""
    most = task_rows(kind, **params)
    if most is None:
        return df
    n, largest = df.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    if not n or largest <= most:
        return df
    tasks = -(-n // most)
    if kind == "mlp":
        cores = df.sparkSession.sparkContext.defaultParallelism
        enough = max(NETWORK_TASKS, -(-n * 8 * len(df.columns) // (NETWORK_TASK_BYTES * cores))) * cores
        if tasks > enough:
            return _dealt(df, n, min(enough, 100_000))
    return df.repartition(min(tasks, 100_000))


def _dealt(df: DataFrame, n: int, tasks: int) -> DataFrame:
    """Rows in ``tasks`` tasks by a hash of their values, which needs no sort as dealing them in turn does; that is left to rows too alike for a hash."""
    keyed = df.withColumn("_at", F.xxhash64(*[col(c) for c in df.columns], F.spark_partition_id()))
    largest = keyed.groupBy(F.pmod(F.hash("_at"), F.lit(tasks))).count().agg(F.max("count")).first()[0]
    return keyed.repartition(tasks, "_at").drop("_at") if largest * tasks <= 1.2 * n else df.repartition(tasks)


def _values(df: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """At most ``bins`` values of each column: all there are, or values that share the rows about evenly."""
    def spots(c, n, rest):
        return F.percentile_approx(F.when(~c.isin(rest), c) if rest else c, [(i + 0.5) / n for i in range(n)], 10_000)

    cs = [col(c) for c in columns]
    # Sketches are exact as long as there are few values.
    few = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(c))) for c in cs]).first()
    first = df.agg(*[F.collect_set(c) if n <= bins else spots(c, bins, []) for c, n in zip(cs, few)]).first()
    out = [sorted(set(v)) for v in first]
    # A value of many rows takes several places; those left go to the other values.
    short = [i for i, n in enumerate(few) if n > bins > len(out[i])]
    if short:
        more = df.agg(*[spots(cs[i], bins - len(out[i]), out[i]) for i in short]).first()
        for i, v in zip(short, more):
            out[i] = sorted({*out[i], *(v or [])})
    return out


def _nearest(c: Column, values: Sequence[float]) -> Column:
    """The nearest value, the lower one of two; a middle between values is where a tree may part them."""
    if len(values) == 1:
        return F.lit(values[0])
    half = len(values) // 2
    return (F.when(c <= (values[half - 1] + values[half]) / 2.0, _nearest(c, values[:half])).otherwise(_nearest(c, values[half:])))


def _ends(values: Sequence[float]) -> list[float]:
    """Ends of the bins of the same, each the first number of its bin."""
    v = np.array(values)
    return [-np.inf, *np.nextafter((v[:-1] + v[1:]) / 2.0, np.inf).tolist(), np.inf]


def cells(df: DataFrame, columns: Sequence[str], label: str, bins: int, task_cells: int = TASK_CELLS["gbt"]) -> DataFrame | None:
    """Rows whose values share all bins, and their label, as one row with their number ``_n``; none where that would not halve the rows.

    Trees see a value by its bin only, and a bin ends in the middle between two values kept; so a fit of the cells, weighted by their
    numbers, is the fit of the rows, and a row is scored in the bin that it was fitted in.
    """
    whole = df.agg(F.count("*"), *[F.count(F.when(F.abs(col(c)) < float("inf"), 1)) for c in columns]).first()
    if whole[0] < CELL_ROWS or len(columns) > CELL_COLUMNS or min(whole) < whole[0]:
        return None
    doubles = df.select(*[col(c).cast("double").alias(c) for c in columns], col(label))
    kept = _values(doubles, columns, bins)
    ends = [_ends(v) for v in kept]
    # A bin is looked up faster than a value; neighbouring numbers have no middle to look for.
    at = [i for i, e in enumerate(ends) if len(e) > 2 and np.diff(e).min() > 0]
    names = [f"_b{i}" for i in range(len(columns))]
    binned = doubles.select(*[(col(c) if i in at else _nearest(col(c), kept[i])).alias(names[i]) for i, c in enumerate(columns)], col(label))
    if at:
        places = Bucketizer(splitsArray=[ends[i] for i in at], inputCols=[names[i] for i in at], outputCols=[f"_at{i}" for i in at])
        binned = places.transform(binned).select(*[F.col(f"_at{i}").cast("int").alias(n) if i in at else n for i, n in enumerate(names)], col(label))
    n = binned.agg(F.approx_count_distinct(F.xxhash64(*[col(c) for c in binned.columns]))).first()[0]
    if 2 * n > whole[0]:
        return None
    values = [(F.lit(np.array(kept[i]))[F.col(names[i])] if i in at else F.col(names[i])).alias(c) for i, c in enumerate(columns)]
    return (binned.groupBy(*[col(c) for c in binned.columns]).agg(F.count("*").alias("_n"))
            .select(*values, col(label), "_n").coalesce(ceil(n / task_cells)))


def _fits_cells(kind: str, **params) -> bool:
    """Whether a fit of cells is one of their rows. Rows that are counted or, in boosting, drawn are not the same as weighted ones."""
    if params.get("minInstancesPerNode", 1) != 1 or params.get("minWeightFractionPerNode", 0.0) > 0:
        return False
    return kind == "forest" and params.get("bootstrap", True) or kind == "gbt" and params.get("subsamplingRate", 1.0) == 1.0


def _draws(df: DataFrame, trees: int, rate: float, seed: int) -> DataFrame:
    """Adds ``_k``: how many rows of a cell each tree draws.

    A forest draws every row a Poisson number of times, by itself for each tree. The draws of n rows together are a Poisson number of n
    times the rate, so they are drawn at once.
    """
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], "_k array<bigint>"])
    first = seed % 2 ** 32

    def draw(batches):
        rng = np.random.default_rng([first, TaskContext.get().partitionId()])
        for b in batches:
            k = rng.poisson(rate * b["_n"].to_numpy()[:, None], (b.num_rows, trees)).astype(np.int64)
            at = pa.array(np.arange(0, k.size + 1, trees, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(at, pa.array(k.ravel()))], [*b.schema.names, "_k"])

    return df.sortWithinPartitions(*[col(c) for c in df.columns]).mapInArrow(draw, schema)


def _forest(own: RandomForestClassifier, rows: DataFrame, columns: Sequence[str], label: str) -> RandomForestClassificationModel:
    """A forest over cells: what each tree drew of a cell is the cell's weight in it, so a tree is fitted by itself, without drawing again."""
    n, seed = own.getNumTrees(), own.getSeed()
    subset = "sqrt" if own.getFeatureSubsetStrategy() == "auto" and n > 1 else own.getFeatureSubsetStrategy()
    one = own.copy({own.numTrees: 1, own.bootstrap: False, own.subsamplingRate: 1.0, own.featureSubsetStrategy: subset})
    drawn = _draws(rows, n, own.getSubsamplingRate(), seed).persist()
    try:
        # A tree may draw no row of the rarest class.
        last, size = drawn.agg(F.max(label), F.count("*")).first()
        classes = int(last) + 1
        y = col(label).cast("double").alias(label, metadata={"ml_attr": {"type": "nominal", "num_vals": classes}})

        def tree(i: int):
            k = F.col("_k")[i]
            bag = assemble(drawn.where(k > 0).withColumn("weight", F.col("weight") * k), columns).select("features", y, "weight")
            return one.copy({one.seed: seed * n + i}).fit(bag).trees[0]

        trees = _each(tree, range(n), min(TREES_AT_ONCE, CELLS_AT_ONCE // size))
    finally:
        drawn.unpersist()
    # MLlib makes a forest of given trees, but has no Python name for it.
    sc = rows.sparkSession.sparkContext
    classes_ = sc._jvm.org.apache.spark.ml.classification
    made = sc._gateway.new_array(classes_.DecisionTreeClassificationModel, n)
    for i, t in enumerate(trees):
        made[i] = t._java_obj
    model = own._copyValues(RandomForestClassificationModel(classes_.RandomForestClassificationModel(own.uid, made, len(columns), classes)))
    model._transfer_params_to_java()
    return model


def fit(kind: str, df: DataFrame, columns: Sequence[str], label: str, seed: int = 7, pos_weight: float | None = None,
        val: DataFrame | None = None, **params):
    """Fitted model; ``pos_weight`` turns on class weights.

    Rows of ``val`` say when to stop: boosting ends when its loss on them no longer falls, and of networks trained for more and
    more iterations the one with the least loss on them is kept. Other models are fitted to their end and do not look at them.
    """
    return fits(kind, df, columns, label, [seed], 1, pos_weight, val, **params)[0]


def fits(kind: str, df: DataFrame, columns: Sequence[str], label: str, seeds: Sequence[int], parallel: int = 4,
         pos_weight: float | None = None, val: DataFrame | None = None, **params) -> list:
    """A model for each seed, several at a time; what they read is made once."""
    own = df.select(*[col(c) for c in dict.fromkeys([*columns, label])])
    if _fits_cells(kind, **params):
        few = cells(own, columns, label, params.get("maxBins", 32), TASK_CELLS[kind])
        if few is not None:
            few = few.persist()
            try:
                # Of a forest, trees are fitted side by side.
                return _each(lambda seed: _fit(kind, few, columns, label, seed, pos_weight, val, own, **params), seeds, 1 if kind == "forest" else parallel)
            finally:
                few.unpersist()
    rows = spread(kind, own, **params)
    # Moved once, read by every pass; a network's rows are read once, and packed.
    moved = rows is not own and not (kind == "mlp" and len(seeds) == 1 and pos_weight is None and params.get("solver", "l-bfgs") == "l-bfgs")
    if moved:
        rows = rows.persist()
    try:
        return _each(lambda seed: _fit(kind, rows, columns, label, seed, pos_weight, val, **params), seeds, parallel)
    finally:
        if moved:
            rows.unpersist()


def _fit(kind: str, df: DataFrame, columns: Sequence[str], label: str, seed: int, pos_weight: float | None, val: DataFrame | None,
         of: DataFrame | None = None, **params):
    """``of`` are the rows that cells in ``df`` stand for."""
    weighted = pos_weight is not None or of is not None

    def ready(part: DataFrame) -> DataFrame:
        return assemble(part, columns).withColumn(label, F.col(label).cast("double"))

    rows = df.withColumn(label, F.col(label).cast("int"))
    if pos_weight is not None:
        rows = with_weights(rows, label, pos_weight, of if of is None else of.withColumn(label, F.col(label).cast("int")))
    if of is not None:
        # What a forest draws of a cell stands for its number.
        each = F.col("weight") if pos_weight is not None else F.lit(1.0)
        rows = rows.withColumn("weight", each if kind == "forest" else each * F.col("_n"))
        # MLlib looks for bins in the square of this number of rows; all cells, so that it finds the values kept, and no others.
        params["maxBins"] = max(params.get("maxBins", 32), ceil(sqrt(rows.count())))
    if weighted:
        if kind == "mlp":
            rows = replicated(rows)
    own = estimator(kind, label, seed, len(columns), "weight" if weighted else None, **params)
    if kind == "forest" and of is not None:
        return _forest(own, rows, columns, label)
    if val is None or kind not in ("gbt", "mlp") or not val.limit(1).count():
        if kind == "mlp" and own.getSolver() == "l-bfgs":
            return network.fit(own, ready(rows), [own.getMaxIter()])[own.getMaxIter()]
        return own.fit(ready(rows))
    if kind == "gbt":
        check = val.withColumn("weight", F.lit(1.0)) if weighted else val
        keep = [*columns, label, *(["weight"] if weighted else [])]
        both = (rows.select(*[col(c) for c in keep], F.lit(False).alias("_val"))
                .unionByName(check.select(*[col(c) for c in keep], F.lit(True).alias("_val"))))
        return own.setValidationIndicatorCol("_val").fit(ready(both))
    most = own.getMaxIter()
    stops = sorted({max(1, most // 4), max(1, most // 2), most})
    rows = ready(rows)
    if own.getSolver() == "l-bfgs":
        fitted = network.fit(own, rows, stops)
    else:
        rows = rows.persist()
        fitted = {i: own.copy({own.maxIter: i}).fit(rows) for i in stops}
        rows.unpersist()
    models_ = [(M.accuracy_logloss(score(m, val, columns), label).first()["loss"], i, m) for i, m in fitted.items()]
    return min(models_, key=lambda m: m[:2])[2]


def score(model, df: DataFrame, columns: Sequence[str], out: str = "p") -> DataFrame:
    """Adds the probability of the positive class; a narrow transformation."""
    hidden = ("features", "rawPrediction", "probability", "prediction")
    return (model.transform(assemble(df, columns)).withColumn(out, vector_to_array("probability")[1]).drop(*hidden))


def classify(p: Column, names: Sequence[str], threshold: float = 0.5) -> Column:
    return F.when(p >= threshold, names[1]).otherwise(names[0])


def prediction_table(scored: DataFrame, key: str, horizon_weeks: float, names: Sequence[str], threshold: float,
                     keep: Sequence[str] = (), p: str = "p") -> DataFrame:
    """Result rows: id, horizon, class, probability in percent, feature values."""
    return scored.select(key, F.lit(horizon_weeks).alias("horizon_weeks"), classify(F.col(p), names, threshold).alias("class"),
                         (100.0 * F.col(p)).alias("probability_pct"), *keep)


def evaluate(scored: DataFrame, thresholds: Sequence[float], y: str = "y", p: str = "p") -> DataFrame:
    """(metric, threshold, value): all test metrics as one long table, few rows whatever the scores."""
    none = F.lit(None).cast("double").alias("threshold")
    prf, al, auc = M.prf_thresholds(scored, thresholds, y, p), M.accuracy_logloss(scored, y, p), M.roc_auc(scored, y, p)

    def long(df: DataFrame, threshold: Column, names: Sequence[str]) -> DataFrame:
        return df.select(threshold, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])))

    return (long(prf, F.col("threshold"), ("precision", "recall", "f1score")).unionByName(long(al, none, ("accuracy", "loss")))
            .unionByName(long(auc, none, ("auc",))))


METRICS = ("recall", "f1score", "precision", "auc", "loss", "accuracy")
AT_THRESHOLD = ("precision", "recall", "f1score")


def metric_names(thresholds: Sequence[float] = ()) -> list[str]:
    """Columns of run and fold tables: the metrics at one threshold, then those of each further threshold, ``recall_thr=0.3`` and so on."""
    return [*METRICS, *[f"{m}_thr={t}" for m in AT_THRESHOLD for t in thresholds]]


def run_metrics(scored: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5, thresholds: Sequence[float] = ()) -> dict[str, float]:
    """The same on the driver: six numbers at ``threshold``, three more for each of ``thresholds``. Undefined ones are 0."""
    scored = scored.select(y, p).persist()
    rows = evaluate(scored, sorted({threshold, *thresholds}), y, p).collect()
    scored.unpersist()
    value = {(r["metric"], r["threshold"]): float(r["value"]) if r["value"] is not None else 0.0 for r in rows}
    own = {m: value[m, float(threshold) if m in AT_THRESHOLD else None] for m in METRICS}
    return own | {f"{m}_thr={t}": value[m, float(t)] for m in AT_THRESHOLD for t in thresholds}


def train_rounds(parts: DataFrame, seeds: Sequence[int], kind: str, columns: Sequence[str], label: str, scaled: Sequence[str],
                 pos_weight: float | None = None, balance: Callable[[DataFrame], DataFrame] | None = None, thresholds: Sequence[float] = (),
                 parallel: int = 4, **params) -> list[dict[str, float]]:
    """Scale on train, balance it, fit (stopped by val) under each seed, measure on test. ``parts`` has a ``role`` column; who runs several
    rounds keeps it cached meanwhile."""
    train = parts.where("role = 'train'")
    fitted = encode.fixed_moments(encode.moments(train, list(scaled)))
    ready = encode.standard_scale(train, fitted)
    val = encode.standard_scale(parts.where("role = 'val'"), fitted)
    ready = balance(ready) if balance else ready
    if len(seeds) == 1:
        models_ = [fit(kind, ready, columns, label, seed=seeds[0], pos_weight=pos_weight, val=val, **params)]
    else:
        models_ = fits(kind, ready, columns, label, seeds, parallel, pos_weight, val=val, **params)
    test = encode.standard_scale(parts.where("role = 'test'"), fitted)
    return _each(lambda model: run_metrics(score(model, test, columns), label, thresholds=thresholds), models_, parallel)


def train_round(parts: DataFrame, kind: str, columns: Sequence[str], label: str, scaled: Sequence[str], seed: int = 7, **kw) -> dict[str, float]:
    """The same under one seed."""
    return train_rounds(parts, [seed], kind, columns, label, scaled, parallel=1, **kw)[0]


def _names(rows: list[dict]) -> list[str]:
    return [*METRICS, *[n for n in (rows[0] if rows else ()) if "_thr=" in n]]


def _table(spark, rows: list[dict], first: str) -> DataFrame:
    names = _names(rows)
    data = [(int(r[first]), *[float(r[m]) for m in names]) for r in rows]
    return spark.createDataFrame(data, f"{first} int, " + ", ".join(f"`{m}` double" for m in names))


def multi_run(parts: DataFrame, runs: int, parallel: int = 4, seed: int = 7, **kw) -> DataFrame:
    """(run, metrics...): the same round under different seeds, several at a time."""
    parts = parts.persist()
    rows = train_rounds(parts, [seed + i for i in range(1, runs + 1)], parallel=parallel, **kw)
    parts.unpersist()
    return _table(parts.sparkSession, [{"run": i} | r for i, r in enumerate(rows, 1)], "run")


def kfold_cv(df: DataFrame, key: str, k: int, seed: int = 7, parallel: int = 2, **kw) -> DataFrame:
    """(fold, metrics...) of a k-fold cross validation; validation folds are as large as test folds."""
    folds = split.kfold_assign(df, key, k, seed).persist()
    with ThreadPool(parallel) as pool:
        rows = pool.map(lambda i: {"fold": i + 1} | train_round(folds.withColumn("role", split.fold_role(F.col("fold"), i, k)).drop("fold"), **kw),
                        range(k))
    folds.unpersist()
    return _table(df.sparkSession, rows, "fold")


def forward_cv(df: DataFrame, date: str, folds: int, parallel: int = 2, **kw) -> DataFrame:
    """(fold, metrics...) of day-forward chaining over anchor dates."""
    df = df.persist()
    roles = {}
    for r in split.forward_chain_folds(df, date, folds).collect():
        roles.setdefault(r["fold"], {}).setdefault(r["role"], []).append(r[date])

    def one(i):
        role = F.lit(None).cast("string")
        for name, dates in roles[i].items():
            role = F.when(F.col(date).isin(dates), name).otherwise(role)
        return {"fold": i + 1} | train_round(df.withColumn("role", role).where(F.col("role").isNotNull()), **kw)

    with ThreadPool(parallel) as pool:
        rows = pool.map(one, [i for i in range(folds) if {"train", "test"} <= set(roles.get(i, {}))])
    df.unpersist()
    return _table(df.sparkSession, rows, "fold")


def random_trials(ranges: dict[str, Sequence], combinations: int, repeats: int, seed: int, log: Sequence[str] = ()) -> list[dict]:
    """Parameter sets: a pair of floats is a real range, anything else a choice; ``log`` ones are exponents of 10."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(combinations):
        pick = {}
        for name, r in ranges.items():
            real = len(r) == 2 and all(isinstance(v, float) for v in r)
            v = float(rng.uniform(r[0], r[1])) if real else r[int(rng.integers(len(r)))]
            pick[name] = 10 ** v if name in log else v
        out += [{"trial": c * repeats + i + 1, "params": pick} for i in range(repeats)]
    return out


def hparam_trials(parts: DataFrame, trials: list[dict], parallel: int = 4, seed: int = 7, **kw) -> DataFrame:
    """(trial, params, metrics...): one round per trial, several at a time."""
    parts = parts.persist()
    with ThreadPool(parallel) as pool:
        rows = pool.map(lambda t: t | train_round(parts, seed=seed + t["trial"], **kw, **t["params"]), trials)
    parts.unpersist()
    names = list(trials[0]["params"])
    measured = _names(rows)
    data = [(r["trial"], *[str(r["params"][n]) for n in names], *[float(r[m]) for m in measured]) for r in rows]
    return parts.sparkSession.createDataFrame(
        data, "trial int, " + ", ".join([f"{n} string" for n in names] + [f"`{m}` double" for m in measured]))


def horizon_search(build: Callable[[int], DataFrame], weeks: Sequence[int], validate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(n, fold, metrics...): features rebuilt and cross validated per horizon."""
    out = None
    for n in weeks:
        part = validate(build(n)).withColumn("n", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out.select("n", *[c for c in out.columns if c != "n"])

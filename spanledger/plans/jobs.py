"""End-to-end jobs: preprocess, train, predict and explain, cluster, horizon search."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.classification import (GBTClassificationModel, LogisticRegressionModel,
                                       MultilayerPerceptronClassificationModel, RandomForestClassificationModel)
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanledger.config import Settings
from spanledger.functions.exprs import col, mix
from spanledger.operators import cluster as K, encode, explain as L, metrics as M, models, neighbours, split
from spanledger.operators.answers import questionnaire
from spanledger.plans.dataset import Dataset, FeatureMeta, horizon_dataset, label_table, series_dataset, static_dataset
from spanledger.session import cut_lineage
from spanledger.sources import sinks

LABEL = "GroundTruth"
KINDS = {"logreg": LogisticRegressionModel, "forest": RandomForestClassificationModel, "gbt": GBTClassificationModel,
         "mlp": MultilayerPerceptronClassificationModel}


def preprocess(episodes: DataFrame, cfg: Settings, out: str, series: bool, answers: DataFrame | None = None) -> Dataset:
    """Builds the training dataset, stores both forms and the feature meta-data, returns what was stored.

    ``answers`` are raw questionnaire records (columns of ``read_answers``) or a table with one row per client. With
    ``include_answers`` or ``answers_only`` set they are needed, and in a static dataset they are joined as known at the label date."""
    spark = episodes.sparkSession
    answers = answer_table(answers, cfg, series)
    ds = series_dataset(episodes, cfg) if series else static_dataset(episodes, cfg, answers=answers)
    by = ["Date"] if series else []
    sinks.write_dataset(ds.features, f"{out}/features", by)
    ds.meta.save(spark, f"{out}/meta")
    # The one-hot form follows row by row from what was stored; the features are built once.
    stored = spark.read.parquet(f"{out}/features")
    hot = to_inputs(stored.select(*[col(c) for c in ds.features.columns]), ds.meta)
    sinks.write_dataset(hot.select(*[col(c) for c in ds.encoded.columns]), f"{out}/encoded", by)
    return load_dataset(spark, out)


def answer_table(answers: DataFrame | None, cfg: Settings, series: bool, when: str | None = None) -> DataFrame | None:
    """One row per client, from raw records where those are given; an error where the settings ask for answers and there are none."""
    if answers is None:
        if (cfg.include_answers or cfg.answers_only) and not series:
            raise ValueError("the settings ask for answers, but none are given")
        return None
    return questionnaire(answers, when or cfg.label_date) if "QuestionE" in answers.columns else answers


def load_dataset(spark: SparkSession, path: str) -> Dataset:
    features, encoded = spark.read.parquet(f"{path}/features"), spark.read.parquet(f"{path}/encoded")
    keys = ("ClientID", "Date") if "Date" in features.columns else ("ClientID",)
    # A partition column reads back last; keys go first again.
    features, encoded = (d.select(*keys, *[col(c) for c in d.columns if c not in keys]) for d in (features, encoded))
    return Dataset(features, encoded, FeatureMeta.load(spark, f"{path}/meta"), keys)


def inputs(ds: Dataset) -> list[str]:
    """Model columns: everything but keys and label, in table order."""
    return [c for c in ds.encoded.columns if c not in (*ds.keys, LABEL)]


def split_roles(ds: Dataset, cfg: Settings) -> DataFrame:
    """Encoded rows with ``role``: by date for series, by hashed client otherwise."""
    t = cfg.train
    if "Date" in ds.keys:
        return split.apply_dates(ds.encoded, split.date_split(ds.encoded, "Date", t.val_split, t.test_split), "Date")
    return split.hash_split(ds.encoded, "ClientID", t.train_split, t.val_split, t.test_split, cfg.seed)


def row_id(df: DataFrame):
    """One number per example: the client, or client and anchor day."""
    if "Date" not in df.columns:
        return F.col("ClientID").cast("long")
    return F.col("ClientID").cast("long") * 131_072 + F.datediff("Date", F.lit("1970-01-01").cast("date"))


def rebalance(train: DataFrame, columns: list[str], cfg: Settings) -> DataFrame:
    """Training rows after the chosen over-sampling; class weights and none leave them as they are."""
    how = cfg.train.imbalance
    if how in ("none", "class_weight"):
        return train
    if how in ("smote", "adasyn"):
        points = train.select(row_id(train).alias("id"), F.array(*[col(c).cast("double") for c in columns]).alias("x"), F.col(LABEL).alias("y"))
        points = points.persist()
        make = neighbours.smote if how == "smote" else neighbours.adasyn
        few = min(points.groupBy("y").count().collect(), key=lambda r: r["count"])["y"]
        new = make(points, "y", seed=cfg.seed)
        return (train.select(*[col(c).cast("double").alias(c) for c in columns], F.col(LABEL).cast("int").alias(LABEL))
                .unionByName(new.select(*[F.col("x")[i].alias(c) for i, c in enumerate(columns)], F.lit(few).cast("int").alias(LABEL))))
    if "Date" in train.columns:
        return split.oversample_random(train, LABEL, cfg.seed)
    return split.oversample_parity(train, "ClientID", LABEL, cfg.seed).drop("copy")


@dataclass(frozen=True)
class Trained:
    kind: str
    model: object
    moments: DataFrame
    columns: list[str]
    metrics: DataFrame | None = None

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/model")
        self.moments.coalesce(1).write.mode("overwrite").parquet(f"{path}/moments")
        spark = self.moments.sparkSession
        rows = [(i, c, self.kind) for i, c in enumerate(self.columns)]
        spark.createDataFrame(rows, "idx int, name string, kind string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Trained":
        rows = sorted(spark.read.parquet(f"{path}/columns").collect(), key=lambda r: r["idx"])
        return Trained(rows[0]["kind"], KINDS[rows[0]["kind"]].load(f"{path}/model"), spark.read.parquet(f"{path}/moments"),
                       [r["name"] for r in rows])

    def score(self, rows: DataFrame) -> DataFrame:
        return models.score(self.model, encode.standard_scale(rows, self.moments), self.columns)


def numeric_inputs(ds: Dataset) -> list[str]:
    return [c for c in inputs(ds) if c in set(ds.meta.numeric)]


def train(ds: Dataset, cfg: Settings, kind: str, **params) -> Trained:
    """Split, scale on the training part, balance, fit until the validation part says stop, and measure on the test part."""
    columns = inputs(ds)
    parts = split_roles(ds, cfg).persist()
    # One row per column: read once, and kept as values.
    fitted = encode.moments(parts.where("role = 'train'"), numeric_inputs(ds))
    fitted = parts.sparkSession.createDataFrame(fitted.collect(), fitted.schema)
    ready = rebalance(encode.standard_scale(parts.where("role = 'train'"), fitted), columns, cfg)
    pos_weight = cfg.train.pos_weight if cfg.train.imbalance == "class_weight" else None
    val = encode.standard_scale(parts.where("role = 'val'"), fitted)
    model = models.fit(kind, ready, columns, LABEL, cfg.seed, pos_weight, val=val, **params)
    out = Trained(kind, model, fitted, columns)
    scored = out.score(parts.where("role = 'test'"))
    metrics = models.evaluate(scored, cfg.train.thresholds, LABEL)
    metrics = parts.sparkSession.createDataFrame(metrics.collect(), metrics.schema)
    parts.unpersist()
    return replace(out, metrics=metrics)


def experiment(ds: Dataset, cfg: Settings, kind: str, what: str = "single_train", ranges: dict | None = None, **params):
    """Dispatch: single_train, multi_train, hparam_search or cross_validation."""
    columns = inputs(ds)
    # The strategy for unequal classes holds in every round of every experiment.
    common = dict(kind=kind, columns=columns, label=LABEL, thresholds=cfg.train.thresholds, scaled=numeric_inputs(ds), balance=lambda rows: rebalance(rows, columns, cfg),
                  pos_weight=cfg.train.pos_weight if cfg.train.imbalance == "class_weight" else None)
    if what == "single_train":
        return train(ds, cfg, kind, **params)
    if what == "multi_train":
        runs = models.multi_run(split_roles(ds, cfg), cfg.train.num_runs, **common, **params)
        return M.best_run(runs, cfg.train.metric_preference)
    if what == "hparam_search":
        trials = models.random_trials(ranges or {"regParam": (-7.0, -2.0)}, cfg.train.search_combinations, cfg.train.search_repeats,
                                      cfg.seed, log=("regParam",))
        return models.hparam_trials(split_roles(ds, cfg), trials, **common)
    if what == "cross_validation":
        folds = (models.forward_cv(ds.encoded, "Date", cfg.series.folds, **common, **params) if "Date" in ds.keys
                 else models.kfold_cv(ds.encoded, "ClientID", cfg.kfolds, **common, **params))
        return folds, M.fold_summary(folds, list(models.METRICS))
    raise ValueError(what)


def threshold_summary(folds: DataFrame, cfg: Settings) -> DataFrame:
    """(metric, mean, std) over folds for every metric, those at each threshold of the settings among them."""
    return M.fold_summary(folds, models.metric_names(cfg.train.thresholds))


def horizon_search(episodes: DataFrame, cfg: Settings, kind: str, series: bool, n_anchors: int | None = None, **params) -> DataFrame:
    """(n, fold, metrics...) for each horizon; labels and vocabularies are made once, at the first one.

    Series features of all horizons come from one pass over the records; the table is stored and each horizon's cross
    validation reads its own part. Static features are cut at one date per horizon, and are made horizon by horizon.
    """
    meta: FeatureMeta | None = None
    labels = label_table(episodes, cfg, series, n_anchors).persist()
    every = None
    if series:
        ds = horizon_dataset(episodes, cfg, cfg.horizon.weeks(), n_anchors=n_anchors, labels=labels)
        every, meta = cut_lineage(ds.encoded), ds.meta
    out = None
    for n in cfg.horizon.weeks():
        at = replace(cfg, horizon_weeks=n)
        if series:
            part = every.where(F.col("n") == n).drop("n")
            own = Dataset(part, part, meta, ("ClientID", "Date"))
        else:
            own = static_dataset(episodes, at, meta, labels=labels)
            meta = meta or own.meta
        folds = experiment(own, at, kind, "cross_validation", **params)[0].withColumn("n", F.lit(n))
        out = folds if out is None else out.unionByName(folds)
    labels.unpersist()
    return out


# --- prediction ----------------------------------------------------------------------------------

def to_inputs(features: DataFrame, meta: FeatureMeta) -> DataFrame:
    """Ordinal codes to the one-hot columns the model was fitted on."""
    return encode.onehot_single(features, {f: vs for f, vs in meta.single.items() if f in features.columns})


def fit_explainer(ds: Dataset) -> L.Explainer:
    """Bins and frequencies of the training table; categories are explained by their codes."""
    rest = [c for c in ds.features.columns if c not in (*ds.keys, LABEL)]
    numeric = [c for c in rest if c in set(ds.meta.numeric)]
    return L.fit(ds.features, numeric, [c for c in rest if c not in numeric],
                 names={f: [encode.DUMMY, *vs] for f, vs in ds.meta.single.items()})


def predict(episodes: DataFrame, cfg: Settings, meta: FeatureMeta, trained: Trained, series: bool,
            feature_values: bool = True, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(result table, ordinal features) for raw records, with everything fitted in training reused; ``answers`` as in ``preprocess``."""
    now = replace(cfg, horizon_weeks=0)
    ds = (series_dataset(episodes, now, meta, training=False) if series
          else static_dataset(episodes, now, meta, include_label=False, answers=answer_table(answers, now, series)))
    scored = trained.score(ds.encoded).select(*ds.keys, "p")
    rows = ds.features.join(scored, list(ds.keys))
    named = encode.decode_ordinal(rows, {f: vs for f, vs in meta.single.items() if f in rows.columns})
    keep = [col(c) for c in ds.features.columns if c != "ClientID"] if feature_values else []
    return models.prediction_table(named, "ClientID", meta.horizon_weeks, cfg.class_names, cfg.decision_threshold, keep=keep), ds.features


def explain_predictions(features: DataFrame, meta: FeatureMeta, trained: Trained, explainer: L.Explainer, cfg: Settings) -> DataFrame:
    """(example, ClientID, rank, rule, weight) for every row of the feature table."""
    keys = [k for k in ("ClientID", "Date") if k in features.columns]
    examples = features.withColumn("example", row_id(features))

    def score(rows: DataFrame) -> DataFrame:
        wide = trained.score(to_inputs(rows, meta))
        return wide.withColumnRenamed("p", "score")

    out = L.explain(examples, explainer, score, "example", cfg.explain.num_samples, cfg.explain.num_features, cfg.explain.kernel_width, cfg.seed)
    return out.join(examples.select("example", *keys), "example")


def trending_prediction(predictions: DataFrame, path: str, stamp: str) -> None:
    """Adds this run's predictions to the earlier ones."""
    sinks.append_run(predictions, path, stamp)


def representative_rules(exps: DataFrame, cfg: Settings, path: str | None = None, stamp: str | None = None) -> DataFrame:
    """Mean weight per rule over the greedily picked explanations, strongest first; appended if a path is given."""
    picked = L.greedy_pick(exps, cfg.explain.pick_explanations)
    avg = L.avg_rule_weight(exps.join(picked, "exp_id", "left_semi")).orderBy(F.desc(F.abs("weight")), "rule")
    if path:
        sinks.append_run(avg, path, stamp)
    return avg


def pick_sample(examples: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """The share of the training examples that is explained before picking."""
    return examples.where(mix(F.col(key), seed) < F.lit(int(fraction * 2_147_483_647)))


# --- clusters ------------------------------------------------------------------------------------

def cluster_clients(ds: Dataset, cfg: Settings, trained: Trained | None = None, k: int | None = None,
                    **kw) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroid report) of k-prototypes on scaled numerics and category codes."""
    rest = [c for c in ds.features.columns if c not in (*ds.keys, LABEL)]
    nums = [c for c in rest if c in set(ds.meta.numeric)]
    cats = [c for c in rest if c not in nums]
    fitted = encode.moments(ds.features, nums)
    scaled = encode.standard_scale(ds.features, fitted)
    rows = scaled.select(*ds.keys, F.array(*[col(c).cast("double") for c in nums]).alias("x"),
                         F.array(*[col(c).cast("int") for c in cats]).cast("array<int>").alias("c")).persist()
    kw = {"n_runs": cfg.cluster.n_runs, "seed": cfg.seed} | kw
    model = K.kprototypes(rows, k or cfg.cluster.k, **kw)
    assigned = K.assign(rows, model.centroids, model.gamma).select(*ds.keys, "cluster")
    centroids = encode.inverse_scale(K.centroid_table(rows, model, nums, cats), fitted)
    if trained is not None:
        inputs_ = to_inputs(centroids, ds.meta)
        scored = trained.score(inputs_).select("cluster", "p")
        centroids = centroids.join(scored, "cluster").withColumn("class", models.classify(F.col("p"), cfg.class_names, cfg.decision_threshold))
        centroids = centroids.withColumn("probability_pct", 100 * F.col("p")).drop("p")
    named = encode.decode_ordinal(centroids, {f: vs for f, vs in ds.meta.single.items() if f in centroids.columns})
    return assigned, named.join(K.cluster_share(assigned), "cluster")

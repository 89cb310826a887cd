"""Threshold, ranking and loss metrics, and tables of experiment results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from spanledger.functions.exprs import col
from spanledger.functions.ordered import running_sums

# Clipping of probabilities in the log loss, stabiliser of the soft F1, its recall factor.
CLIP = 1e-15
EPSILON = 1e-7
RECALL_FACTOR = 4.5


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf_thresholds(df: DataFrame, thresholds: Sequence[float], y: str = "y", p: str = "p", strict: bool = False) -> DataFrame:
    """(threshold, precision, recall, f1score), 0 where undefined. One pass for all thresholds."""
    pred = [F.col(p) > t if strict else F.col(p) >= t for t in thresholds]
    pos = F.col(y) == 1
    sums = df.agg(*[F.struct(F.count_if(h & pos).alias("tp"), F.count_if(h & ~pos).alias("fp"),
                             F.count_if(~h & pos).alias("fn")).alias(f"s{i}") for i, h in enumerate(pred)])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"s{i}").alias("s"))
                                          for i, t in enumerate(thresholds)])))
    prec, rec = _ratio(F.col("s.tp"), F.col("s.tp") + F.col("s.fp")), _ratio(F.col("s.tp"), F.col("s.tp") + F.col("s.fn"))
    return rows.select("threshold", prec.alias("precision"), rec.alias("recall")).withColumn(
        "f1score", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def accuracy_logloss(df: DataFrame, y: str = "y", p: str = "p", threshold: float = 0.5) -> DataFrame:
    q = F.least(F.greatest(F.col(p).cast("double"), F.lit(CLIP)), F.lit(1 - CLIP))
    right = ((F.col(p) >= threshold).cast("int") == F.col(y)).cast("double")
    return df.agg(F.avg(right).alias("accuracy"),
                  F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("loss"))


def score_counts(df: DataFrame, y: str, p: str) -> DataFrame:
    """Positives and negatives per distinct score, combined map-side."""
    return df.groupBy(F.col(p).alias("score")).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


def roc_auc(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """Area under the ROC curve by ranks: negatives below each positive, ties half; null with one class only."""
    cum = running_sums(score_counts(df, y, p), "score", ["neg"])
    wins = F.sum(F.col("pos") * (F.col("cum_neg") - F.col("neg") / 2.0))
    return cum.agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def roc_points(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, from the highest down, without the (0, 0) start."""
    counts = score_counts(df, y, p)
    total = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    return (running_sums(counts, "score", ["pos", "neg"], descending=True).withColumn("_t", total)
            .select(F.col("score").alias("threshold"), F.try_divide("cum_neg", "_t.n").alias("fpr"),
                    F.try_divide("cum_pos", "_t.p").alias("tpr")))


def confusion(df: DataFrame, threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """(label, predicted, n); a row is predicted positive above the threshold, not at it."""
    return (df.groupBy(F.col(y).alias("label"), (F.col(p) > threshold).cast("int").alias("predicted"))
            .agg(F.count("*").alias("n")))


def outcome(y: Column, p: Column, threshold: float = 0.5) -> Column:
    hit = p >= threshold
    return (F.when(hit & (y == 1), "TP").when(hit & (y == 0), "FP").when(~hit & (y == 1), "FN").otherwise("TN"))


def weighted_soft_f1(df: DataFrame, y: str = "y", p: str = "p", recall_factor: float = RECALL_FACTOR) -> DataFrame:
    """(wf1, loss) on probabilities, recall weighted by ``recall_factor``."""
    t, s, a = F.sum(F.col(y) * F.col(p)), F.sum(p), F.sum(y)
    sums = df.agg(((t + EPSILON) / (s + EPSILON)).alias("prec"), ((t + EPSILON) / (a + EPSILON)).alias("rec"))
    w_rec = 2.0 / (recall_factor + 1)
    wf1 = 2 * F.col("prec") * F.col("rec") / ((2 - w_rec) * F.col("prec") + w_rec * F.col("rec") + EPSILON)
    return sums.select(wf1.alias("wf1"), (1 - wf1).alias("loss"))


# --- experiment tables ---------------------------------------------------------------------------

def fold_summary(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, mean, std) over folds, sample standard deviation."""
    wide = df.agg(*[F.struct(F.avg(col(m)).alias("mean"), F.stddev_samp(col(m)).alias("std")).alias(f"m{i}") for i, m in enumerate(metrics)])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"m{i}.mean").alias("mean"),
                                                   F.col(f"m{i}.std").alias("std")) for i, m in enumerate(metrics)])))


def horizon_trend(df: DataFrame, metric: str, n: str = "n") -> DataFrame:
    """(slope, intercept, r2) of a metric over the horizon."""
    y, x = F.col(metric).cast("double"), F.col(n).cast("double")
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def horizon_means(df: DataFrame, metric: str, n: str = "n") -> DataFrame:
    return df.groupBy(n).agg(F.avg(metric).alias(metric))


def best_run(df: DataFrame, preference: Sequence[str], run: str = "run") -> DataFrame:
    """The run that wins by the ordered preference: losses low, other metrics high; earliest on ties."""
    order = [F.asc(m) if m == "loss" else F.desc(m) for m in preference]
    return df.orderBy(*order, F.asc(run)).limit(1)

"""Splits, folds, class weights and balancing by repetition. All seeded, none random at run time."""

from __future__ import annotations

from math import ceil, exp

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.functions.exprs import col, total
from spanledger.functions.ordered import rank_cuts, up_to

# Fixed value: draws are whole numbers below this.
DRAWS = 2_147_483_647


def with_count(df: DataFrame, name: str = "_n") -> DataFrame:
    """Row count beside every row, as a scalar subquery."""
    return df.withColumn(name, df.agg(F.count("*")).scalar())


def hash_split(df: DataFrame, key: str, train: float, val: float, test: float, seed: int) -> DataFrame:
    """Adds ``role``. Sizes are exact: the test share is rounded up, then the validation share of the rest.

    The role depends on the key alone, so encoded and raw tables of the same keys split alike. The rows of
    the shares' ends are looked up first; then each row knows its role by itself, and none is moved.
    """
    n_test = lambda n: ceil(n * test)
    n_both = lambda n: n_test(n) + ceil((n - n_test(n)) * (val / (train + val)))
    _, (last_test, last_val) = rank_cuts(df, key, seed, [n_test, n_both])
    return df.withColumn("role", F.when(up_to(key, seed, last_test), "test").when(up_to(key, seed, last_val), "val").otherwise("train"))


def _sizes(n: Column, val: float, test: float) -> tuple[Column, Column]:
    def size(f):
        return F.greatest(F.floor(n * F.lit(f)), F.lit(1))
    return size(val), size(test)


def forward_chain_folds(df: DataFrame, date: str, folds: int, val: float = 0.05, test: float = 0.05) -> DataFrame:
    """(fold, date, role): fold i ends i test sizes before the newest date; its dates before are val, then train.

    Only the distinct dates are ordered, one per anchor.
    """
    dates = df.select(date).distinct()
    age = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(date)))
    dates = with_count(dates.withColumn("_age", age))
    n_val, n_test = _sizes(F.col("_n"), val, test)
    at = F.col("_age") - F.col("fold") * n_test
    role = F.when(at <= 0, None).when(at <= n_test, "test").when(at <= n_test + n_val, "val").otherwise("train")
    return (dates.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
            .withColumn("role", role).where(F.col("role").isNotNull()).select("fold", date, "role"))


def date_split(df: DataFrame, date: str, val: float = 0.05, test: float = 0.05) -> DataFrame:
    """(date, role): the newest dates are the test set, the next ones validation, at least one date each."""
    return forward_chain_folds(df, date, 1, val, test).drop("fold")


def apply_dates(df: DataFrame, roles: DataFrame, date: str) -> DataFrame:
    """Rows with their role; the role table has one row per date."""
    return df.join(roles, date)


def kfold_assign(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """Adds ``fold`` 0..k-1 in hash order; the first n mod k folds have one row more. No row is moved."""
    ends = [lambda n, i=i: n // k * i + min(n % k, i) for i in range(1, k)]
    _, cuts = rank_cuts(df, key, seed, ends)
    return df.withColumn("fold", total([(~up_to(key, seed, c)).cast("int") for c in cuts]) if cuts else F.lit(0))


def fold_role(fold: Column, i: int, k: int) -> Column:
    """Role in round i: fold i tests, the next one validates, the others train."""
    return F.when(fold == i, "test").when(fold == (i + 1) % k, "val").otherwise("train")


# --- class balance -------------------------------------------------------------------------------

def class_weights(df: DataFrame, label: str, pos_weight: float = 0.5) -> DataFrame:
    """(label, weight): shares of the loss by class, one row per class."""
    pos, n = F.sum(label), F.count("*")
    return (df.agg(pos.alias("p"), (n - pos).alias("q"))
            .select(F.inline(F.array(
                F.struct(F.lit(0).alias(label), F.try_divide((1 - pos_weight) * (F.col("p") + F.col("q")), F.col("q")).alias("weight")),
                F.struct(F.lit(1).alias(label), F.try_divide(pos_weight * (F.col("p") + F.col("q")), F.col("p")).alias("weight"))))))


def log_odds(df: DataFrame, label: str) -> DataFrame:
    pos, n = F.sum(label), F.count("*")
    return df.agg(F.log(F.try_divide(pos, n - pos)).alias("log_odds"))


def oversample_parity(df: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Minority rows repeated to the size of the majority, as evenly as possible.

    Every minority row comes M div m times, the first M mod m in hash order once more. Repeating
    happens in place: no row moves for it.
    """
    sizes = {int(r[label]): r["count"] for r in df.groupBy(label).count().where(F.col(label).isNotNull()).collect()}
    p, q = sizes.get(1, 0), sizes.get(0, 0)
    rare, few, big = (1, p, q) if p <= q else (0, q, p)
    if not few:
        return df.withColumn("copy", F.lit(1))
    minority = F.col(label) == rare
    _, (last,) = rank_cuts(df.where(minority), key, seed, [big % few])
    times = F.when(minority, big // few + up_to(key, seed, last).cast("int")).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def _poisson(rate: float) -> list[float]:
    """Shares of 0, at most 1, at most 2, ... draws, as far as a draw of 31 bits can tell."""
    out, term, have, i = [], exp(-rate), 0.0, 0
    while have < 1 - 2.0 ** -31 and i < 40 + 4 * rate:
        have += term
        out.append(have)
        i += 1
        term *= rate / i
    return out


def oversample_random(df: DataFrame, label: str, seed: int) -> DataFrame:
    """Minority rows drawn with replacement to about the size of the majority.

    How often a row is drawn follows from a hash of its values, so the same rows are drawn however they are stored.
    """
    sizes = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    few = min(sizes, key=sizes.get)
    rate = max(sizes.values()) / sizes[few] - 1
    # Drawn in parts that the exponential can hold.
    parts = max(1, ceil(rate / 50))
    row = F.xxhash64(*[col(c) for c in df.columns])
    draws = [F.size(F.filter(F.lit(np.array(_poisson(rate / parts))), lambda x, i=i: x <= F.pmod(F.xxhash64(row, F.lit(seed), F.lit(i)), F.lit(DRAWS)) / float(DRAWS))) for i in range(parts)]
    extra = F.explode(F.array_repeat(F.lit(0), total(draws)))
    return df.unionByName(df.where(F.col(label) == few).withColumn("_again", extra).drop("_again"))

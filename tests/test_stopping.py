"""Validation rows stop the models that can be stopped; silhouettes of tables with very many codes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.operators import cluster as K, models


@pytest.fixture(scope="module")
def parts(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        x = [rng.gauss(0, 1) for _ in range(4)]
        # Labels are mostly noise, so a long fit gets worse on rows it has not seen.
        y = int(x[0] + 3 * rng.gauss(0, 1) > 0)
        rows.append((i, *x, y, "train" if i % 3 == 0 else "val" if i % 3 == 1 else "test"))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y int, role string").persist()


COLUMNS = ["a", "b", "c", "d"]


@pytest.mark.parametrize("pos_weight", [None, 0.6])
def test_boosting_stops_where_validation_says(parts, pos_weight):
    train, val = parts.where("role = 'train'"), parts.where("role = 'val'")
    whole = models.fit("gbt", train, COLUMNS, "y", pos_weight=pos_weight, maxIter=25)
    stopped = models.fit("gbt", train, COLUMNS, "y", pos_weight=pos_weight, val=val, maxIter=25)
    assert whole.getNumTrees == 25 and stopped.getNumTrees < 25
    assert models.fit("gbt", train, COLUMNS, "y", val=val.limit(0), maxIter=3).getNumTrees == 3


def test_network_of_least_validation_loss_is_kept(parts):
    train, val = parts.where("role = 'train'"), parts.where("role = 'val'")
    kept = models.fit("mlp", train, COLUMNS, "y", val=val, nodes=(12,), maxIter=80)
    loss = lambda m: models.M.accuracy_logloss(models.score(m, val, COLUMNS), "y").first()["loss"]
    every = [loss(models.fit("mlp", train, COLUMNS, "y", nodes=(12,), maxIter=n)) for n in (20, 40, 80)]
    assert abs(loss(kept) - min(every)) < 1e-9


def test_a_round_reads_its_validation_rows(parts):
    common = dict(kind="gbt", columns=COLUMNS, label="y", scaled=COLUMNS, maxIter=12)
    with_val = models.train_round(parts, **common)
    without = models.train_round(parts.where("role <> 'val'"), **common)
    assert with_val != without and with_val["loss"] < without["loss"]


def test_silhouette_with_fifty_thousand_codes(spark):
    n = 60_000
    df = spark.range(n).select("id", F.array((F.col("id") % 5).cast("double")).alias("x"),
                               F.array((F.col("id") % 50_000).cast("int"), (F.col("id") % 3).cast("int"), F.lit(None).cast("int")).alias("c"), (F.col("id") % 2).cast("int").alias("cluster"))
    got = {r["id"]: r["silhouette"] for r in K.silhouette_rows(df, gamma=2.0).where("id % 20000 = 7").collect()}
    i = np.arange(n)
    for k, v in got.items():
        d = (k % 5 - i % 5) ** 2 + 2.0 * ((k % 50_000 != i % 50_000).astype(int) + (k % 3 != i % 3) + 1)
        # A missing code is equal to none, not even to its own.
        a, other = d[i % 2 == k % 2].sum() / (n // 2 - 1), d[i % 2 != k % 2].mean()
        assert abs(v - (other - a) / max(a, other)) < 1e-9
    assert len(got) == 3

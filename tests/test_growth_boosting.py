"""Boosting reads each cell of bins once, with the number of its rows."""

import pytest
from pyspark.sql import functions as F

from spanledger.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    # Three columns of few values: MLlib's own bins are the values.
    i = F.col("id")
    df = spark.range(0, 6000, 1, 4).select((i % 17).cast("double").alias("a"), (F.floor(i / 17) % 9).cast("double").alias("b"), (i % 2).cast("double").alias("c"),
                                           ((i % 17 + F.floor(i / 17) % 9 + F.floor(i / 700) * 2) % 13 > 6).cast("int").alias("y"))
    return df.persist()


@pytest.mark.parametrize("pos_weight", [None, 0.6])
def test_cells_give_the_trees_of_all_rows(rows, monkeypatch, pos_weight):
    seen, own = [], models._fit
    monkeypatch.setattr(models, "_fit", lambda kind, df, *a, **kw: seen.append(df.count()) or own(kind, df, *a, **kw))
    fits = []
    for least in (10_000, 1):
        monkeypatch.setattr(models, "CELL_ROWS", least)
        fits.append(models.fit("gbt", rows, list("abc"), "y", pos_weight=pos_weight, maxIter=4))
    assert seen[0] == 6000 and seen[1] == rows.select("a", "b", "c", "y").distinct().count() < 3000
    p = [[r["p"] for r in models.score(m, rows, list("abc")).orderBy("a", "b", "c", "y").select("p").collect()] for m in fits]
    assert max(abs(x - y) for x, y in zip(*p)) < 1e-9


def test_rows_are_scored_in_the_bin_they_were_fitted_in(spark, monkeypatch):
    monkeypatch.setattr(models, "CELL_ROWS", 1)
    df = spark.range(0, 5000, 1, 4).select(F.when(F.col("id") % 3 > 0, 0.0).otherwise(F.sin("id")).alias("a"), (F.col("id") % 2).alias("y"))
    (kept,) = models._values(df, ["a"], 8)
    assert len(kept) == 8 and 0.0 in kept
    cells = models.cells(df, ["a"], "y", 8)
    assert cells.agg(F.sum("_n")).first()[0] == 5000 and cells.count() <= 16
    model = models.fit("gbt", df, ["a"], "y", maxIter=2, maxBins=8)
    # Rows score as the value that stands for them.
    near = df.withColumn("b", models._nearest(F.col("a"), kept))
    p = models.score(model, near, ["a"]).withColumnRenamed("p", "q").drop("features")
    assert models.score(model, p.withColumn("id", F.col("a")), ["b"]).where("p <> q").count() == 0


def test_cells_that_save_little_and_bad_values_leave_the_rows(spark, monkeypatch):
    monkeypatch.setattr(models, "CELL_ROWS", 1)
    one = spark.range(50).select(F.col("id").cast("double").alias("a"), F.lit(1).alias("y"))
    assert models.cells(one.where("a < 20"), ["a"], "y", 32) is None
    assert models.cells(one.unionByName(one).unionByName(one).withColumn("a", F.when(F.col("a") > 1, 1.0)), ["a"], "y", 32) is None

"""A forest reads each cell of bins with the number of its rows, and runs under several seeds share the cells."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanledger.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    # Three columns of few values: MLlib's own bins are the values.
    i = F.col("id")
    noise = F.pmod(F.xxhash64("id"), F.lit(10)) < 2
    df = spark.range(0, 9000, 1, 4).select((i % 17).cast("double").alias("a"), (F.floor(i / 17) % 9).cast("double").alias("b"), (i % 2).cast("double").alias("c"),
                                           ((i % 17 + F.floor(i / 17) % 9 > 12) != noise).cast("int").alias("y"))
    return df.persist()


def scores(model, df):
    return np.array([r["p"] for r in models.score(model, df.select("a", "b", "c").distinct(), list("abc")).orderBy("a", "b", "c").select("p").collect()])


@pytest.mark.parametrize("pos_weight", [None, 0.7])
def test_a_forest_of_cells_is_like_one_of_rows(rows, monkeypatch, pos_weight, tmp_path):
    seen, own = [], models._fit
    monkeypatch.setattr(models, "_fit", lambda kind, df, *a, **kw: seen.append(df.count()) or own(kind, df, *a, **kw))
    fits = []
    for least in (10_000, 1):
        monkeypatch.setattr(models, "CELL_ROWS", least)
        fits.append(models.fit("forest", rows, list("abc"), "y", pos_weight=pos_weight, numTrees=10))
    assert seen == [9000, rows.distinct().count()] and seen[1] < 4500
    of_rows, of_cells = fits
    assert type(of_cells) is type(of_rows) and of_cells.getNumTrees == 10 and of_cells.numFeatures == 3 and of_cells.numClasses == 2
    assert len({t.toDebugString for t in of_cells.trees}) > 5
    p, q = scores(of_rows, rows), scores(of_cells, rows)
    assert np.abs(p - q).mean() < 0.05 and np.corrcoef(p, q)[0, 1] > 0.95
    of_cells.write().save(str(tmp_path / "m"))
    assert np.array_equal(q, scores(models.RandomForestClassificationModel.load(str(tmp_path / "m")), rows))
    # The same seed gives the same forest.
    again = models.fit("forest", rows, list("abc"), "y", pos_weight=pos_weight, numTrees=10)
    assert np.array_equal(q, scores(again, rows))


def test_rows_of_a_cell_are_drawn_by_themselves(spark):
    df = spark.range(0, 4000, 1, 4).select(F.col("id"), F.when(F.col("id") % 2 == 0, 1).otherwise(50).cast("long").alias("_n"))
    drawn = models._draws(df, 3, 0.5, 11)
    k = {n: np.array([r["_k"] for r in drawn.where(F.col("_n") == n).orderBy("id").collect()]) for n in (1, 50)}
    for n, got in k.items():
        assert got.shape == (2000, 3)
        # Mean and variance of a sum of single draws; one draw for the whole cell would have n times the variance.
        assert np.allclose(got.mean(0), 0.5 * n, rtol=0.1) and np.allclose(got.var(0), 0.5 * n, rtol=0.15)
    assert np.abs(np.corrcoef(k[50].T) - np.eye(3)).max() < 0.1


def test_trees_without_the_rarest_class_count_its_votes(spark, monkeypatch):
    monkeypatch.setattr(models, "CELL_ROWS", 1)
    df = spark.range(0, 400, 1, 2).select((F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("b"), F.lit(0.0).alias("c"), (F.col("id") == 7).cast("int").alias("y"))
    model = models.fit("forest", df, list("abc"), "y", numTrees=6)
    assert {t.numClasses for t in model.trees} == {2}
    p = scores(model, df)
    assert (p >= 0).all() and 0 < p.max() < 0.5


def test_runs_share_their_cells(rows, monkeypatch):
    made, own = [], models.cells
    monkeypatch.setattr(models, "CELL_ROWS", 1)
    monkeypatch.setattr(models, "cells", lambda *a, **kw: made.append(1) or own(*a, **kw))
    role = F.when(F.pmod(F.xxhash64("a", "b"), F.lit(10)) == 0, "test").otherwise("train")
    parts = rows.withColumn("role", role)
    kw = {"kind": "forest", "columns": list("abc"), "label": "y", "scaled": list("abc"), "numTrees": 3}
    runs = models.multi_run(parts, 3, **kw).orderBy("run").collect()
    assert [r["run"] for r in runs] == [1, 2, 3] and len(made) == 1
    # Each run is the round of its own seed.
    alone = models.train_round(parts, seed=7 + 2, **kw)
    assert {m: runs[1][m] for m in models.METRICS} == pytest.approx(alone)


def test_counted_and_undrawn_rows_stay(rows, monkeypatch):
    monkeypatch.setattr(models, "CELL_ROWS", 1)
    seen, own = [], models._fit
    monkeypatch.setattr(models, "_fit", lambda kind, df, *a, **kw: seen.append(df.count()) or own(kind, df, *a, **kw))
    for odd in ({"minInstancesPerNode": 3}, {"bootstrap": False}, {"minWeightFractionPerNode": 0.01}):
        models.fit("forest", rows, list("abc"), "y", numTrees=2, **odd)
    assert seen == [9000] * 3


def test_few_values_are_counted_exactly(spark):
    df = spark.range(0, 6400, 1, 4).select((F.col("id") % 32).cast("double").alias("a"), (F.col("id") % 33).cast("double").alias("b"))
    assert [len(v) for v in models._values(df, ["a", "b"], 32)] == [32, 32]


def test_values_without_a_middle_are_still_parted(spark, monkeypatch):
    monkeypatch.setattr(models, "CELL_ROWS", 1)
    near = [1.0, np.nextafter(1.0, 2), np.nextafter(np.nextafter(1.0, 2), 2)]
    df = spark.range(0, 300, 1, 2).select(F.lit(np.array(near))[(F.col("id") % 3).cast("int")].alias("a"), (F.col("id") % 2).alias("y"))
    got = models.cells(df, ["a"], "y", 32)
    assert got.agg(F.sum("_n")).first()[0] == 300 and {r["a"] for r in got.collect()} <= set(near)

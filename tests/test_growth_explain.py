"""Neighbourhoods are drawn by as many tasks as their rows ask for."""

from pyspark.sql import functions as F

from spanledger.operators import explain as L


def test_few_examples_are_spread_and_draw_the_same(spark, monkeypatch):
    df = spark.range(0, 40, 1, 1).select("id", (F.col("id") * 1.5).alias("a"), (F.col("id") % 3).alias("c"))
    ex = L.fit(df, ["a"], ["c"])
    drawn = lambda: L.perturb(df, ex, "id", 25)
    alone = drawn()
    want = sorted(map(str, alone.collect()))
    assert len(want) == 1000 and alone.rdd.getNumPartitions() == 1
    monkeypatch.setattr(L, "TASK_ROWS", 100)
    spread = drawn()
    assert spread.rdd.getNumPartitions() == 10 and sorted(map(str, spread.collect())) == want
    # One example's samples lie in several parts as well.
    monkeypatch.setattr(L, "PART_SAMPLES", 10)
    split = drawn()
    assert split.rdd.getNumPartitions() == 10 and sorted(map(str, split.collect())) == want

"""The tables of a fit have as many tasks as their rows ask for."""

import pytest
from pyspark.sql import functions as F

from spanledger.operators import models


@pytest.mark.parametrize("kind", ["forest", "gbt", "mlp", "logreg"])
def test_one_file_is_fitted_by_many_tasks(spark, monkeypatch, kind):
    df = spark.range(0, 600, 1, 1).select((F.col("id") % 20).cast("double").alias("x"), (F.col("id") % 20 > 9).cast("int").alias("y"), F.lit("other").alias("z"))
    monkeypatch.setattr(models, "NETWORK_ROWS", 20)
    monkeypatch.setattr(models, "TASK_BYTES", {"forest": 20 * 165, "gbt": 20 * 155}.get(kind, 1))
    seen, own = [], models._fit

    def spy(kind, df, *args, **kw):
        seen.append((df.rdd.getNumPartitions(), df.count(), df.columns))
        return own(kind, df, *args, **kw)
    monkeypatch.setattr(models, "_fit", spy)
    small = {"forest": {"numTrees": 3}, "gbt": {"maxIter": 3}, "mlp": {"maxIter": 30}, "logreg": {}}[kind]
    model = models.fit(kind, df, ["x"], "y", **small)
    assert seen == [(1 if kind == "logreg" else 30, 600, ["x", "y"])]
    right = models.score(model, df, ["x"]).where((F.col("p") >= 0.5) == (F.col("y") == 1)).count()
    assert right >= 570
    # Rows that a task can hold stay.
    monkeypatch.setattr(models, "NETWORK_ROWS", 600)
    monkeypatch.setattr(models, "TASK_BYTES", 600 * 165)
    models.fit(kind, df, ["x"], "y", **small)
    assert seen[1][0] == 1

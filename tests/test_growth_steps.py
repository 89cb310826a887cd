"""A step of a network starts few tasks, over rows dealt without a sort, and reckons many blocks of rows at a time."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanledger.operators import models, network


def dealt(df):
    out = models.spread("mlp", df)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    return out, sizes


def test_tasks_are_as_many_as_the_cores_ask_for(spark, monkeypatch):
    monkeypatch.setattr(models, "NETWORK_ROWS", 100)
    df = spark.range(0, 64_000, 1, 1).select((F.col("id") * 0.5).alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    out, sizes = dealt(df)
    assert len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) <= 1.2 * 64_000 / len(sizes)
    plan = out._jdf.queryExecution().toString()
    assert "RoundRobin" not in plan
    assert out.columns == df.columns and out.exceptAll(df).isEmpty() and out.count() == 64_000
    # Tasks of bounded bytes come first.
    monkeypatch.setattr(models, "NETWORK_TASK_BYTES", 16_000)
    assert len(dealt(df)[1]) == 64


def test_rows_that_are_all_alike_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(models, "NETWORK_ROWS", 100)
    df = spark.range(0, 6_400, 1, 1).select(F.lit(None).cast("double").alias("x"), (F.col("id") % 2).cast("int").alias("y"))
    out, sizes = dealt(df)
    assert sum(sizes) == 6_400 and len(sizes) == 4 * spark.sparkContext.defaultParallelism and max(sizes) <= 1.2 * 6_400 / len(sizes)


def plain(w, layers, x, y):
    """Cross entropy of the rows, as it is defined."""
    out, at = x, 0
    for k, (n, m) in enumerate(zip(layers, layers[1:])):
        z = out @ w[at:at + n * m].reshape(n, m) + w[at + n * m:at + n * m + m]
        at += n * m + m
        with np.errstate(over="ignore"):
            out = 1.0 / (1.0 + np.exp(-z)) if k < len(layers) - 2 else z
    z = out - out.max(axis=1, keepdims=True)
    return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).sum())


@pytest.mark.parametrize("rows", [1, 7, 8, 900, 40_003])
@pytest.mark.parametrize("layers", [[3, 6, 4, 2], [3, 2]])
def test_sums_are_those_of_the_blocks(rows, layers):
    rng, size = np.random.default_rng(rows), 7
    x, y = rng.normal(size=(rows, 3)), rng.integers(0, 2, rows)
    # One row saturates all units.
    x[0] *= 1e4
    w = rng.normal(size=sum(n * m + m for n, m in zip(layers, layers[1:])))
    batch = pa.RecordBatch.from_pydict({"x": pa.array(x.tolist(), pa.list_(pa.float64())), "y": pa.array(y.astype(float))})
    values = list(network._packed(3, size)([batch.slice(0, rows // 3), batch.slice(rows // 3)]))
    assert sum(v.num_rows for v in values) <= 1 + rows // 4_000
    (out,) = network._sums(w, layers, size)(values)
    got = np.frombuffer(out.column("sums")[0].as_py())
    full = rows - rows % size

    def want(w):
        return plain(w, layers, x[:full], y[:full]) / size + (plain(w, layers, x[full:], y[full:]) / (rows - full) if full < rows else 0.0)

    assert abs(got[0] - want(w)) < 1e-9 * max(1.0, want(w))
    if rows > 1:
        for i in rng.integers(0, len(w), 6):
            h = np.zeros(len(w))
            h[i] = 1e-6
            slope = (want(w + h) - want(w - h)) / 2e-6
            assert abs(got[1 + i] - slope) < 1e-4 * max(1.0, abs(want(w)))

"""Rows learn their block pairs where they are."""

from pyspark.sql import functions as F

from spanledger.operators import neighbours as B
from spanledger.session import cut_lineage


def test_pairs_are_sent_to_the_rows(spark, monkeypatch):
    made = lambda: cut_lineage(spark.range(60).select("id", F.array(F.col("id") * 1.0).alias("x"), F.lit(0).alias("cell"), (F.col("id") / 30).cast("int").alias("chunk")))
    rows, base = made(), made()
    pairs = cut_lineage(spark.sql("SELECT 0 AS lcell, CAST(l.id AS int) AS lchunk, 0 AS rcell, CAST(r.id AS int) AS rchunk FROM range(2) l, range(2) r"))
    sent = B._compare(rows, base, pairs, 2)
    assert "SortMergeJoin" not in sent._jdf.queryExecution().executedPlan().toString()
    want = sorted(map(tuple, sent.collect()))
    near = {(i, j) for i, j, _ in want}
    assert len(want) == 240 and all((i, i + 1) in near for i in range(59))
    monkeypatch.setattr(B, "MOST_PAIRS", 0)
    assert sorted(map(tuple, B._compare(rows, base, pairs, 2).collect())) == want

"""Looking up ranks reads a row's hash once, and ranks are joined without moving the rows again."""

from pyspark.sql import functions as F

from spanledger.functions import ordered as O
from spanledger.functions.exprs import mix


def test_cuts_do_not_filter_by_the_hash(spark, monkeypatch):
    df = spark.range(3000).unionByName(spark.createDataFrame([(5,), (5,), (None,)], "id long"))
    order = sorted([i for i in range(3000)] + [5, 5], key={r["id"]: (r["h"], r["id"]) for r in spark.range(3000).select("id", mix(F.col("id"), 5).alias("h")).collect()}.get)

    def none(self, condition):
        raise AssertionError("a filter works out the hash once for every comparison")
    for name in ("where", "filter"):
        monkeypatch.setattr(type(df), name, none)
    monkeypatch.setattr(O, "FEW_ROWS", 20)
    ranks = [0, 1, 400, 1500, lambda n: n, 9999]
    n, cuts = O.rank_cuts(df, "id", 5, ranks, slices=8)
    assert n == 3002 and cuts[0] is None and [c[1] for c in cuts[1:]] == [order[i] for i in (0, 399, 1499, 3001, 3001)]


def test_ranks_move_rows_once(spark, monkeypatch):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("g"))
    ranked = O.range_rank(df, "g", ["id"], "r")
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()
    want = {i: i // 3 + 1 for i in range(2000)}
    assert {r["id"]: r["r"] for r in ranked.collect()} == want
    monkeypatch.setattr(O, "MOST_COUNTS", 0)
    assert {r["id"]: r["r"] for r in O.range_rank(df, "g", ["id"], "r").collect()} == want

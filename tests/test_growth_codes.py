"""Short lists of terms are sent to the rows; no row per cell is made."""

from pyspark.sql import functions as F

from spanledger.operators import collapse as C, sparse as S


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _rows(spark):
    return spark.range(500).select((F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, "hot").alias("a"), F.col("id").cast("string").alias("b"))


def test_hot_values_of_a_short_list_are_not_moved(spark, monkeypatch):
    df = _rows(spark)
    vocab = C.vocabulary(df, ["a", "b"])
    plan = _plan(S.ordinal_wide(df, ["a", "b"], vocab))
    assert plan.count("BroadcastHashJoin") >= 2 and "SortMergeJoin" not in plan
    want = sorted(map(tuple, S.ordinal_wide(df, ["a", "b"], vocab).collect()))
    monkeypatch.setattr(S, "FEW_TERMS", 10)
    assert sorted(map(tuple, S.ordinal_wide(df, ["a", "b"], vocab).collect())) == want
    codes = {str(v): i + 1 for i, v in enumerate(sorted(map(str, range(500))))}
    assert want == sorted((i % 7, 1 if i % 3 else -1, codes[str(i)]) for i in range(500))


def test_sparse_rows_of_both_ways_agree_and_make_no_cells(spark, monkeypatch):
    df = _rows(spark).unionByName(spark.createDataFrame([(None, None, "new"), (9, None, None)], "k long, a string, b string"))
    known = S.dictionary(S.terms_of(_rows(spark), ["a", "b"]))
    made = lambda: S.onehot_sparse(df, ["k"], ["a", "b"], known)
    assert "Generate inline" not in _plan(made())
    want = sorted(map(str, made().collect()))
    monkeypatch.setattr(S, "FEW_TERMS", 10)
    assert sorted(map(str, made().collect())) == want and len(want) == 9
    named = S.onehot_sparse(df, ["k"], ["a"], S.dictionary(spark.createDataFrame([("a", "none"), ("a", "hot")], "feature string, value string")), "none")
    assert {r["k"]: list(r["indices"]) for r in named.collect()} == {None: [1], 9: [1]} | {k: [0, 1] for k in range(7)}

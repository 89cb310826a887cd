"""Dictionaries and sparse rows against plain definitions; more values than a table has columns."""

import random

from pyspark.sql import functions as F

from spanledger.operators import collapse as C, sparse as S


def _plain(rows, columns):
    """(places by term, set of places per key) of dicts."""
    terms = sorted({(c, r[c]) for r in rows for c in columns if r[c] is not None})
    place = {t: i for i, t in enumerate(terms)}
    out: dict = {}
    for r in rows:
        out.setdefault(r["k"], set()).update(place[c, r[c]] for c in columns if r[c] is not None)
    return place, {k: sorted(v) for k, v in out.items()}


def test_rows_equal_a_plain_dictionary(spark):
    rng = random.Random(3)
    # One key and one value hold a third of all rows; nulls, repeats, a key without any value.
    rows = [{"k": 0 if i % 3 == 0 else rng.randrange(40), "a": "hot" if i % 3 == 1 else rng.choice(["x", "", "é", None, "Z"]), "b": f"v{rng.randrange(60)}"}
            for i in range(900)] + [{"k": 99, "a": None, "b": None}]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    place, want = _plain(rows, ["a", "b"])
    known = S.dictionary(S.terms_of(df, ["a", "b"]))
    assert {(r["feature"], r["value"]): r["at"] for r in known.collect()} == place
    got = S.onehot_sparse(df, ["k"], ["a", "b"], known).collect()
    assert {r["k"]: list(r["indices"]) for r in got} == want and {r["size"] for r in got} == {len(place)}
    assert all(list(r["values"]) == [1.0] * len(r["indices"]) for r in got)


def test_fifty_thousand_values(spark):
    n = 50_000
    df = spark.range(n).select((F.col("id") % 500).alias("k"), F.format_string("w%06d", F.col("id")).alias("w"))
    known = S.dictionary(S.terms_of(df, ["w"]))
    rows = S.onehot_sparse(df, ["k"], ["w"], known)
    # Value w<i> has place i, so a key k holds the places k, k + 500, ...
    wrong = rows.where((F.col("size") != n) | (F.col("indices") != F.expr("sequence(k, 49999, 500)")))
    assert rows.count() == 500 and wrong.count() == 0
    codes = C.vocabulary(df, ["w"])
    assert codes.where(F.col("code") != F.substring("value", 2, 6).cast("int") + 1).count() == 0
    back = S.ordinal_wide(df, ["w"], codes)
    assert back.columns == df.columns and back.agg(F.min("w"), F.max("w"), F.count_distinct("w")).first()[:] == (1, n, n)


def test_terms_outside_the_dictionary(spark):
    known = S.dictionary(spark.createDataFrame([("f", "a"), ("n", None)], "feature string, value string"))
    cells = spark.createDataFrame([(1, "f", "a", 1.0), (1, "f", "new", 1.0), (1, "n", None, 2.5), (2, "f", "new", 1.0), (3, None, None, None),
                                   (4, "n", None, 0.0), (5, "n", None, 1.0), (5, "n", None, 3.0)], "k int, feature string, value string, x double")
    got = {r["k"]: (list(r["indices"]), list(r["values"])) for r in S.sparse_rows(cells, ["k"], known).collect()}
    assert got == {1: ([0, 1], [1.0, 2.5]), 2: ([], []), 3: ([], []), 4: ([], []), 5: ([1], [3.0])}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, a string")
    known = S.dictionary(S.terms_of(none, ["a"]))
    assert known.count() == 0 and S.onehot_sparse(none, ["k"], ["a"], known).count() == 0
    one = S.onehot_sparse(spark.createDataFrame([(1, "x")], "k int, a string"), ["k"], ["a"], known).first()
    assert (one["size"], list(one["indices"])) == (0, [])


def test_a_model_reads_the_vectors(spark):
    from pyspark.ml.classification import LogisticRegression

    df = spark.range(400).select("id", F.format_string("c%03d", F.col("id") % 200).alias("c"), (F.col("id") % 200 < 50).cast("double").alias("label"))
    rows = S.as_vectors(S.onehot_sparse(df, ["id"], ["c"], S.dictionary(S.terms_of(df, ["c"])))).join(df.select("id", "label"), "id")
    scored = LogisticRegression(maxIter=10, regParam=0.001).fit(rows).transform(rows)
    assert scored.where("prediction = label").count() == 400


def test_nothing_wide_comes_to_the_driver(spark):
    """The plan of a row has no column per value, and joins the dictionary instead of literals."""
    df = spark.range(3000).select("id", F.col("id").cast("string").alias("w"))
    plan = S.onehot_sparse(df, ["id"], ["w"], S.dictionary(S.terms_of(df, ["w"])))._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and len(plan) < 20_000

"""The whole export on the supplied tables."""

from spanledger.catalog import REGISTRY
from spanledger.operators import export as X
from spanledger.sources.adapters import NOW, Tables
from spanledger.sources.readers import EXPORT_COLUMNS
from spanledger.sources.records import SECOND_CHOICE, export_tables

ROOT = "/root/testdata/sf0.01"


def test_every_branch_reaches_the_export(spark):
    src = export_tables(Tables(spark, ROOT))
    out = X.export(src, NOW, SECOND_CHOICE)
    assert tuple(out.columns) == EXPORT_COLUMNS
    kinds = {r["ServiceType"] for r in out.select("ServiceType").distinct().collect()}
    served = {r["ServiceType"] for r in src["client_services"].select("ServiceType").distinct().collect()}
    assert kinds == served | {"Income", "Expenses", "Education", "HealthIssues", "Medications", "Contributing Factor", "Behavioral Risk Factor",
                              "Life Events", "Diet", "VISPDAT", "Service Restriction"}
    # Columns of the record branches are all filled somewhere.
    filled = out.selectExpr(*[f"count({c}) AS {c}" for c in EXPORT_COLUMNS]).first()
    assert [c for c in EXPORT_COLUMNS if filled[c] == 0] == []


def test_code_tables_are_sent_out(spark):
    """No exchange for a code table: they fall under the broadcast threshold by size."""
    plan = X.detail_branches(export_tables(Tables(spark, ROOT)))["Behavioral Risk Factor"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in plan


def test_answers_have_no_commas(spark):
    rows = REGISTRY["whole_answers"].run(spark, ROOT).collect()
    assert rows and not any("," in r[c] for r in rows for c in ("QuestionE", "DescriptionE", "ScoreValue"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_are_cut_without_a_table_of_pairs(spark):
    rows = [(1, "b"), (1, "a"), (1, "b"), (1, None), (2, None), (None, "z"), (None, "z"), *[(3, "")] * 50, (3, "x"), *[(4, f"i{i:02}") for i in range(60)]]
    out = X.text_list(spark.createDataFrame(rows, "k long, m string").repartition(5), "k", "m", "t")
    assert "Aggregate" not in _plan(out)
    want = {}
    for k, m in rows:
        if m is not None:
            want.setdefault(k, []).append(m)
    assert {r["k"]: r["t"] for r in out.collect()} == {k: "|".join(sorted(v))[:30] for k, v in want.items()}


def _small(spark, root):
    """Two clients with consent, one of them with services, and an order each with lines."""
    day = "1998-03-01"
    tables = {
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(i, f"N{i}", i % 5) for i in range(25)]),
        "region": ("r_regionkey int, r_name string", [(i, f"R{i}") for i in range(5)]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey int, s_acctbal double", [(5, "five", 0), (10, "ten", 2)]),
        "customer": ("c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", [(1, "one", 3, 1.0, "A"), (2, "two", 4, 2.0, "B")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double", [(3, "p", "b", "t", 1, 1.0)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string",
                   [(5, 1, "F", 9.0, day, "1"), (10, 2, "F", 9.0, day, "1")]),
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate string",
                     [(5, 3, 4, 1, 1.0, 7.0, "R", day), (5, 3, 3, 2, 1.0, 8.0, "N", day), (5, 3, 26, 3, 1.0, 6.0, "N", day), (5, 3, 4, 4, 1.0, 5.0, "N", day),
                      (10, 3, 3, 1, 1.0, 4.0, "N", day)]),
        "events": ("event_id long, ts string, user_id long, event_type string, value double, props string", [(1, "2024-01-01", 1, "click", 1.0, "{}")]),
    }
    for name, (schema, rows) in tables.items():
        n = len(schema.split(","))
        df = spark.createDataFrame([(*r, 0.0) if len(r) < n else r for r in rows], schema)
        for c in ("o_orderdate", "l_shipdate", "ts"):
            if c in df.columns:
                df = df.withColumn(c, df[c].cast("timestamp"))
        df.write.parquet(f"{root}/{name}.parquet")
    return export_tables(Tables(spark, str(root)))


def test_records_are_not_sorted_for_joins(spark, tmp_path):
    src = _small(spark, tmp_path)
    out = X.export(src, NOW, SECOND_CHOICE)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines, whole = _plan(src["expenses"]), _plan(X.export(src, NOW, SECOND_CHOICE))
        rows = out.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in lines and "SortMergeJoin" not in lines
    # Clients to records, services to consents, modules to restrictions, lines to orders.
    assert whole.count("ShuffledHashJoin") >= 4
    assert next(x for x in whole.splitlines() if "Join" in x).lstrip("+-* (0123456789)").startswith("ShuffledHashJoin")
    assert {r["ClientID"] for r in rows} == {1}
    # A module without a name is in no list, but its line without a name is no expense either.
    assert [(r["ClientBarredPeriodID"], r["Modules"]) for r in rows if r["ServiceType"] == "Service Restriction"] == [(5, "N3|N4|N4")]
    assert sorted(r["ExpenseAmount"] for r in rows if r["ServiceType"] == "Expenses") == [5.0, 7.0, 8.0]
    assert [r["ServiceID"] for r in rows if r["ServiceType"] == "click"] == [1]

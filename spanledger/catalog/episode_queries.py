"""Sources, cleansing and episode operators over the event episodes."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from spanledger.catalog import sqlparts as S
from spanledger.catalog.registry import query
from spanledger.functions.exprs import secs
from spanledger.operators import cleanse, grid as G
from spanledger.operators.collapse import Collapse, collapse
from spanledger.operators.series import lag_assembly
from spanledger.operators.spans import intervals
from spanledger.plans import dataset as D
from spanledger.session import shared_folder
from spanledger.sources import checks, readers, sinks
from spanledger.sources.adapters import EVENT_CFG as CFG, Tables

EP = "WITH " + S.episodes()
SERIES = G.Grid.ending(CFG.label_date, S.N, CFG.series.step_days, CFG.horizon_days)
STATIC = G.Grid.static(CFG)
CUT = S.GT - S.HORIZON


def scratch(t: Tables, name: str) -> str:
    """A new folder for a round trip through storage."""
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ---------------------------------------------------------------------------

@query("scan_episodes", EP + """
SELECT client AS "ClientID", event_id AS "ServiceID", service AS "ServiceType", s AS start_s, coalesce(e0, -1) AS end_s,
 reason AS "ReasonForService", amount AS "MonthlyAmount" FROM ep""")
def scan_episodes(t: Tables):
    path = scratch(t, "csv")
    raw = t.raw_episodes()
    sinks.write_csv(raw, path)
    df = readers.read_episodes(t.spark, path, columns=raw.columns)
    return df.select("ClientID", "ServiceID", "ServiceType", secs("DateStart").alias("start_s"),
                     F.coalesce(secs("DateEnd"), F.lit(-1)).alias("end_s"), "ReasonForService", "MonthlyAmount")


@query("scan_answers", """
SELECT user_id AS "ClientID", CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, count(*)::BIGINT AS n
FROM events GROUP BY ALL""")
def scan_answers(t: Tables):
    """events written as UTF-16 documents of 2,000 answers each and read back in ranges."""
    path = scratch(t, "answers")
    k = F.from_json("props", "k long")["k"]
    rows = t.events.select(F.col("event_id").alias("IntakeID"), F.col("user_id").alias("ClientID"), F.col("props").alias("QuestionE"), k.cast("string").alias("ScoreValue"))
    sinks.write_documents(rows, path, "VISPDATS", F.floor(F.col("IntakeID") / 2000))
    return (readers.read_answers(t.spark, path, range_bytes=1 << 16).groupBy("ClientID", F.col("ScoreValue").cast("long").alias("k"))
            .agg(F.count("*").alias("n")))


@query("trending_append", """
SELECT '2024-01-01' AS "Stamp", o_orderstatus AS status, count(*)::BIGINT AS n, NULL::DOUBLE AS total FROM orders GROUP BY ALL
UNION ALL
SELECT '2024-01-08', o_orderstatus, count(*)::BIGINT, round(sum(o_totalprice), 2) FROM orders GROUP BY ALL""")
def trending_append(t: Tables):
    path = scratch(t, "trend")
    base = t.orders.groupBy(F.col("o_orderstatus").alias("status"))
    sinks.append_run(base.agg(F.count("*").alias("n")), path, "2024-01-01")
    sinks.append_run(base.agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")), path, "2024-01-08")
    return sinks.read_runs(t.spark, path).select(F.date_format("Timestamp", "yyyy-MM-dd").alias("Stamp"), "status", "n", "total")


@query("snapshot_checks", f"""
SELECT count(*)::BIGINT AS n_rows, 6::BIGINT AS n_cols,
 (count(*) FILTER (WHERE epoch_us(ts) // 1000000 > {S.GT}))::BIGINT AS recent,
 (count(*) FILTER (WHERE epoch_us(ts) // 1000000 > {S.GT}) = 0) AS no_recent,
 count(*) < (SELECT count(*) + 1 FROM events) AS fewer_rows, 6 < 7 AS fewer_cols FROM events""")
def snapshot_checks(t: Tables):
    ev = t.events
    previous = ev.agg((F.count("*") + 1).alias("n_rows")).withColumn("n_cols", F.lit(7))
    return checks.snapshot_checks(ev, "ts", "2024-01-31 00:00:00", previous)


# --- cleansing -----------------------------------------------------------------------------------

@query("exclude_clients", """
SELECT n_name, count(*)::BIGINT AS n, round(sum(c_acctbal), 4) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE c_custkey NOT IN (3, 5, 8, 13, 21, 34) AND c_custkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY n_name""")
def exclude_clients(t: Tables):
    listed = t.supplier.where("s_acctbal < 0").select(F.col("s_suppkey").alias("ClientID"))
    df = cleanse.exclude_clients(cleanse.exclude_clients(t.clients(), [3, 5, 8, 13, 21, 34]), listed)
    return df.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 4).alias("bal"))


@query("exclude_declined", EP + """
SELECT client AS "ClientID", count(*)::BIGINT AS n FROM ep WHERE consent IS NULL OR consent NOT LIKE '%Declined%' GROUP BY 1""")
def exclude_declined(t: Tables):
    return cleanse.exclude_declined(t.episodes()).groupBy("ClientID").agg(F.count("*").alias("n"))


@query("drop_features", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def drop_features(t: Tables):
    return cleanse.drop_features(t.customer, ["c_name", "c_nationkey", "not_there"])


@query("derived_flag", EP + """
SELECT client AS "ClientID", CASE WHEN client % 4 = 0 THEN 'Y' ELSE 'N' END AS "HasFamily", count(*)::BIGINT AS n
FROM ep GROUP BY 1, 2""")
def derived_flag(t: Tables):
    return (cleanse.flag_present(t.episodes(), "FamilyID", "HasFamily").groupBy("ClientID", "HasFamily")
            .agg(F.count("*").alias("n")))


@query("close_open_intervals", EP + 'SELECT event_id AS "ServiceID", s AS start_s, e AS end_s FROM ep')
def close_open_intervals(t: Tables):
    df = cleanse.close_open_intervals(t.raw_episodes(), CFG.run_ts)
    return df.select("ServiceID", secs("DateStart").alias("start_s"), secs("DateEnd").alias("end_s"))


@query("coerce_timestamps", """
SELECT event_id, CASE WHEN event_id % 13 <> 0 THEN (epoch_us(ts) // 1000000)::BIGINT ELSE -1 END AS start_s,
 event_type AS "Kind" FROM events""")
def coerce_timestamps(t: Tables):
    text = F.when(F.col("event_id") % 13 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    df = cleanse.coerce_timestamps(t.events.select("event_id", text.alias("DateStart"), F.col("event_type").alias("Kind")))
    return df.select("event_id", F.coalesce(secs("DateStart"), F.lit(-1)).alias("start_s"), "Kind")


@query("asof_cut", EP + f"""
SELECT event_id AS "ServiceID", s AS start_s, least(e, {CUT})::BIGINT AS end_s,
 floor(({CUT} - dob) / (365.2425 * 86400))::BIGINT AS "CurrentAge" FROM ep WHERE s <= {CUT}""")
def asof_cut(t: Tables):
    df = cleanse.asof_cut(t.episodes(), "2024-01-24 00:00:00")
    return df.select("ServiceID", secs("DateStart").alias("start_s"), secs("DateEnd").alias("end_s"), "CurrentAge")


@query("age_at", """
SELECT o_orderkey, floor((1704067200 - epoch_us(o_orderdate) // 1000000) / (365.2425 * 86400))::BIGINT AS age FROM orders""")
def age_at(t: Tables):
    return t.orders.select("o_orderkey", cleanse.age_at(F.col("o_orderdate"), F.lit("2024-01-01").cast("timestamp")).alias("age"))


@query("fill_policy", EP + """
SELECT event_id AS "ServiceID", coalesce(reason, 'None') AS "ReasonForService", coalesce(gender, 'Unknown') AS "Gender",
 coalesce(score, -1) AS "TotalScore", coalesce(expense, 0) AS "ExpenseAmount" FROM ep""")
def fill_policy(t: Tables):
    df = cleanse.parse_amounts(t.episodes(), "TotalScore", "ExpenseAmount")
    return cleanse.fill_policy(df, ["ReasonForService"], ["Gender"], ["TotalScore"], ["ExpenseAmount"]).select(
        "ServiceID", "ReasonForService", "Gender", "TotalScore", "ExpenseAmount")


@query("parse_amounts", """
SELECT c_custkey, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS amount FROM customer""")
def parse_amounts(t: Tables):
    text = F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    return cleanse.parse_amounts(t.customer.select("c_custkey", text.alias("amount")), "amount")


# --- episodes ------------------------------------------------------------------------------------

def _rows(t: Tables, unit: str = "second"):
    return intervals(t.episodes(unit))


def _label_sql(unit: str) -> str:
    return "WITH " + S.episodes(unit) + f""",
st AS (SELECT client, s, least(e, {S.GT}) AS e FROM ep WHERE service = 'signup'),
d AS ({S.label_sql('st', 'client', str(S.GT))})
SELECT client AS "ClientID", (coalesce(days, 0) >= {S.THRESHOLD})::INT AS "GroundTruth"
FROM (SELECT DISTINCT client FROM ep) LEFT JOIN d USING (client)"""


def _label(t: Tables, unit: str):
    return (G.static_labels(_rows(t, unit), STATIC, CFG)
            .select(F.col("client").alias("ClientID"), "GroundTruth"))


@query("future_label", _label_sql("second"))
def future_label(t: Tables):
    return _label(t, "second")


@query("future_label_ties", _label_sql("hour"))
def future_label_ties(t: Tables):
    return _label(t, "hour")


@query("label_days", "WITH " + S.episodes() + f""",
st AS (SELECT client, s, least(e, {S.GT}) AS e FROM ep WHERE service = 'signup'),
d AS ({S.label_sql('st', 'client', str(S.GT))}) SELECT client AS "ClientID", days FROM d WHERE days > 0""")
def label_days(t: Tables):
    return G.label_days(_rows(t), STATIC, CFG).where("days > 0").select(F.col("client").alias("ClientID"), "days")


def _one_service(t: Tables, unit: str, service: str):
    rows = _rows(t, unit).where(F.col("service") == service)
    rows = rows.where(F.col("s") <= CUT)
    flows = G.timed_flows(G.timed_spans(rows, CFG), STATIC, CFG)
    out = G.running_totals(G.presence(rows, STATIC, CFG, True), flows, STATIC, {service: "days"})
    return out.select(F.col("client").alias("ClientID"), "days")


def _one_sql(unit: str, service: str, fold: str) -> str:
    return "WITH " + S.episodes(unit) + f""",
c AS (SELECT client, s, least(e, {CUT}) AS e FROM ep WHERE service = '{service}' AND s <= {CUT})
SELECT client AS "ClientID", {fold} AS days FROM c GROUP BY client"""


@query("timed_totals", _one_sql("second", "purchase", S.PLAIN))
def timed_totals(t: Tables):
    return _one_service(t, "second", "purchase")


@query("timed_totals_ties", _one_sql("hour", "purchase", S.PLAIN))
def timed_totals_ties(t: Tables):
    return _one_service(t, "hour", "purchase")


@query("stay_totals_fold", _one_sql("second", "signup", S.STAY))
def stay_totals_fold(t: Tables):
    return _one_service(t, "second", "signup")


@query("stay_totals_fold_ties", _one_sql("hour", "signup", S.STAY))
def stay_totals_fold_ties(t: Tables):
    return _one_service(t, "hour", "signup")


def _counted_sql(unit: str) -> str:
    return "WITH " + S.episodes(unit) + f""",
c AS (SELECT client, service, s, least(e, {CUT}) AS e FROM ep WHERE service IN ('click', 'view', 'error') AND s <= {CUT})
SELECT client AS "ClientID", {S.visits('click')} AS "Num_click", {S.visits('view')} AS "Num_view",
 {S.visits('error')} AS "Num_error" FROM c GROUP BY client"""


def _counted(t: Tables, unit: str):
    rows = _rows(t, unit).where(F.col("service").isin(list(CFG.counted_services)))
    names = {s: "Num_" + s for s in CFG.counted_services}
    flows = G.counted_flows(G.counted_since(rows, CFG), STATIC)
    return (G.running_totals(G.presence(rows, STATIC, CFG, True), flows, STATIC, names)
            .drop("k").withColumnRenamed("client", "ClientID"))


@query("counted_services", _counted_sql("second"))
def counted_services(t: Tables):
    return _counted(t, "second")


@query("counted_services_ties", _counted_sql("day"))
def counted_services_ties(t: Tables):
    return _counted(t, "day")


@query("income_total", """
SELECT o_custkey AS "ClientID", round(sum(a), 2) AS "IncomeTotal" FROM (
 SELECT o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_totalprice END AS a, row_number() OVER (
  PARTITION BY o_custkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END
  ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1 GROUP BY 1""")
def income_total(t: Tables):
    df = t.incomes()
    rows = df.select(F.col("ClientID").alias("client"), secs("DateStart").alias("s"), "ServiceID",
                     F.when(F.col("IncomeType") != "5-LOW", F.col("IncomeType")).alias("kind"),
                     F.when(F.col("ServiceID") % 7 != 0, F.col("MonthlyAmount")).alias("amount"))
    late = G.Grid.ending("2100-01-01", 1, 1, 0, close=0)
    return (G.income_totals(rows, late, ["ServiceID"])
            .select(F.col("client").alias("ClientID"), F.round("IncomeTotal", 2).alias("IncomeTotal")))


W0, W1 = CUT - S.STEP, CUT - 1
_WINDOW_SQL = EP + f""",
w AS (SELECT client, service, greatest(s, {W0}) AS s, least(e, {W1}) AS e FROM ep WHERE e >= {W0} AND s <= {W1}),
a AS (SELECT client, {S.STAY} AS x FROM w WHERE service = 'signup' GROUP BY client),
b AS (SELECT client, {S.PLAIN} AS x FROM w WHERE service = 'purchase' GROUP BY client),
c AS (SELECT client, {S.visits('click')} AS n, {S.visits('view')} AS v, {S.visits('error')} AS p FROM w
 WHERE service IN ('click', 'view', 'error') GROUP BY client)
SELECT client AS "ClientID", coalesce(a.x, 0) AS "3-Day_signup", coalesce(b.x, 0) AS "3-Day_purchase",
 coalesce(c.n, 0) AS "3-Day_click", coalesce(c.v, 0) AS "3-Day_view", coalesce(c.p, 0) AS "3-Day_error"
FROM (SELECT DISTINCT client FROM w) LEFT JOIN a USING (client) LEFT JOIN b USING (client) LEFT JOIN c USING (client)"""


@query("window_features", _WINDOW_SQL)
def window_features(t: Tables):
    rows, grid = _rows(t), replace(STATIC, step=S.STEP, close=1)
    names = D.service_names(CFG, "3-Day_", "3-Day_")
    values = G.window_timed(rows, grid, CFG).unionByName(G.window_counted(rows, grid, CFG))
    touched = rows.where((F.col("e") >= W0) & (F.col("s") <= W1)).select("client").distinct()
    return (touched.join(G.step_features(values, names).drop("k"), "client", "left").fillna(0)
            .withColumnRenamed("client", "ClientID"))


_COLS = {"signup": "signup", "purchase": "purchase"}


def _grid_sql(horizon: int = S.HORIZON) -> str:
    """Every anchor recomputed from the history cut there."""
    n = {s: S.visits(s) for s in ("click", "view", "error")}
    return EP + f""", {S.anchors(horizon)},
la AS (SELECT client, k, cut, s, least(e, cut + {horizon}) AS e FROM ep, anchors WHERE service = 'signup' AND s <= cut + {horizon}),
ld AS ({S.label_sql('la', 'client, k, cut', f'(cut + {horizon})')}),
h AS (SELECT client, service, k, cut, s, least(e, cut - 1) AS e, kind, amount, e AS e_full FROM ep, anchors WHERE s <= cut - 1),
seen AS (SELECT client, k, cut FROM ep, anchors GROUP BY ALL
 HAVING bool_or(s <= cut) AND bool_or(s <= cut - 1)),
t1 AS (SELECT client, k, {S.STAY} AS x FROM h WHERE service = 'signup' GROUP BY client, k),
t2 AS (SELECT client, k, {S.PLAIN} AS x FROM h WHERE service = 'purchase' GROUP BY client, k),
t3 AS (SELECT client, k, {n['click']} AS a, {n['view']} AS b, {n['error']} AS c FROM h
 WHERE service IN ('click', 'view', 'error') GROUP BY client, k),
inc AS (SELECT client, k, sum(coalesce(amount, 0)) AS x FROM (SELECT *, row_number() OVER (
 PARTITION BY client, k, kind ORDER BY s DESC, e_full DESC, coalesce(amount, -1) DESC) AS rn FROM h) WHERE rn = 1 GROUP BY client, k),
w AS (SELECT client, service, k, greatest(s, cut - {S.STEP}) AS s, e FROM h WHERE e >= cut - {S.STEP}),
w1 AS (SELECT client, k, {S.STAY} AS x FROM w WHERE service = 'signup' GROUP BY client, k),
w2 AS (SELECT client, k, {S.PLAIN} AS x FROM w WHERE service = 'purchase' GROUP BY client, k),
w3 AS (SELECT client, k, {n['click']} AS a, {n['view']} AS b, {n['error']} AS c FROM w
 WHERE service IN ('click', 'view', 'error') GROUP BY client, k),
g AS (SELECT client AS "ClientID", strftime(make_timestamp(seen.cut * 1000000), '%Y-%m-%d') AS "Date",
 coalesce(t1.x, 0) AS "Total_signup", coalesce(t2.x, 0) AS "Total_purchase", coalesce(t3.a, 0) AS "Total_click",
 coalesce(t3.b, 0) AS "Total_view", coalesce(t3.c, 0) AS "Total_error", round(coalesce(inc.x, 0), 2) AS "IncomeTotal",
 coalesce(w1.x, 0) AS "3-Day_signup", coalesce(w2.x, 0) AS "3-Day_purchase", coalesce(w3.a, 0) AS "3-Day_click",
 coalesce(w3.b, 0) AS "3-Day_view", coalesce(w3.c, 0) AS "3-Day_error",
 (coalesce(ld.days, 0) >= {S.THRESHOLD})::INT AS "GroundTruth"
FROM seen LEFT JOIN t1 USING (client, k) LEFT JOIN t2 USING (client, k) LEFT JOIN t3 USING (client, k)
 LEFT JOIN inc USING (client, k) LEFT JOIN w1 USING (client, k) LEFT JOIN w2 USING (client, k)
 LEFT JOIN w3 USING (client, k) LEFT JOIN ld USING (client, k))"""


def _grid(t: Tables):
    df = cleanse.parse_amounts(t.episodes(), "MonthlyAmount")
    out = D.series_features(df.drop("DOB"), SERIES, CFG)
    lab = G.labels(intervals(df), SERIES, CFG)
    return (out.join(lab, ["client", "k"], "left").fillna({"GroundTruth": 0})
            .withColumn("IncomeTotal", F.round("IncomeTotal", 2)))


def _dated(df):
    return (df.withColumn("Date", F.date_format(SERIES.date(F.col("k")), "yyyy-MM-dd")).drop("k")
            .withColumnRenamed("client", "ClientID"))


@query("anchor_grid", _grid_sql() + " SELECT * FROM g")
def anchor_grid(t: Tables):
    return _dated(_grid(t))


_WEEKS = (0, 1, 2)


@query("horizon_grid", " UNION ALL ".join(f"SELECT {n} AS n, * FROM ({_grid_sql(n * 7 * S.DAY)} SELECT * FROM g)" for n in _WEEKS))
def horizon_grid(t: Tables):
    """The anchor grid of every horizon, from one pass over the records."""
    base = G.Grid.ending(CFG.label_date, S.N, CFG.series.step_days, 0)
    grid = G.HorizonGrid.of(base, tuple(7 * n for n in _WEEKS))
    df = cleanse.parse_amounts(t.episodes(), "MonthlyAmount")
    out = D.series_features(df.drop("DOB"), grid, CFG)
    lab = grid.spread(G.labels(intervals(df), base, CFG))
    out = (out.join(lab, ["client", "k"], "left").fillna({"GroundTruth": 0}).withColumn("IncomeTotal", F.round("IncomeTotal", 2))
           .withColumn("Date", F.date_format(grid.date(F.col("k")), "yyyy-MM-dd")).drop("k"))
    n = F.get(F.array(*[F.lit(w) for w in _WEEKS]), grid.horizon_of())
    return out.select(n.alias("n"), grid.client_of().alias("ClientID"), *[F.col(f"`{c}`") for c in out.columns if c != "client"])


_STEPS = [f"3-Day_{s}" for s in ("signup", "purchase", "click", "view", "error")]
_LAGS = ", ".join(f'coalesce(lag("{f}", {i}) OVER (PARTITION BY "ClientID" ORDER BY "Date"), 0) AS "(-{i}){f}"'
                  for i in range(S.TX - 1, 0, -1) for f in _STEPS)


@query("lag_assembly", _grid_sql() + f""", l AS (SELECT "ClientID", "Date", {_LAGS}, {', '.join(f'"{f}"' for f in _STEPS)} FROM g)
SELECT * FROM l WHERE "Date" >= '2024-01-15'""")
def lag_assembly_query(t: Tables):
    df = _grid(t).select("client", "k", *_STEPS)
    return _dated(lag_assembly(df, _STEPS, CFG.series.t_x, since=F.lit(S.N - 1 - 3), client="client", date="k"))


_COLLAPSE_SQL = f"""
SELECT client AS "ClientID", max(kk) AS "MaxK", coalesce(sum(expense), 0) AS "ExpenseAmount",
 (list(score ORDER BY s DESC, e DESC, score DESC) FILTER (WHERE score IS NOT NULL))[1] AS "TotalScore",
 (list(gender ORDER BY s DESC, e DESC, gender DESC) FILTER (WHERE gender IS NOT NULL))[1] AS "Gender",
 max((reason = 'r0')::INT) AS "ReasonForService_r0", max((reason = 'r1')::INT) AS "ReasonForService_r1",
 max((reason = 'r2')::INT) AS "ReasonForService_r2", max((reason = 'r3')::INT) AS "ReasonForService_r3" FROM c GROUP BY client"""


@query("client_collapse", EP + ", c AS (SELECT * FROM ep)" + f"""
SELECT "ClientID", "MaxK", round("ExpenseAmount", 2) AS "ExpenseAmount", "TotalScore", "Gender", "ReasonForService_r0",
 "ReasonForService_r1", "ReasonForService_r2", "ReasonForService_r3" FROM ({_COLLAPSE_SQL})""")
def client_collapse(t: Tables):
    df = cleanse.parse_amounts(t.episodes(), "ExpenseAmount", "TotalScore")
    k = t.events.select(F.col("event_id").alias("ServiceID"), F.get_json_object("props", "$.k").cast("int").alias("MaxK"))
    spec = Collapse(["MaxK"], ["ExpenseAmount"], ["TotalScore", "Gender"], {"ReasonForService": ["r0", "r1", "r2", "r3"]})
    out = collapse(df.join(k, "ServiceID"), ["ClientID"], spec)
    return out.withColumn("ExpenseAmount", F.round("ExpenseAmount", 2))


_STATIC_SQL = EP + f""",
ok AS (SELECT * FROM ep WHERE consent IS NULL OR consent NOT LIKE '%Declined%'),
c AS (SELECT client, service, s, least(e, {CUT}) AS e, kk, expense, score, gender, coalesce(reason, 'None') AS reason,
 kind, amount, dob FROM ok WHERE s <= {CUT}),
base AS ({_COLLAPSE_SQL}),
extra AS (SELECT client, max((reason = 'None')::INT) AS rn, min(floor(({CUT} - dob) / (365.2425 * 86400))) AS age FROM c GROUP BY client),
t1 AS (SELECT client, {S.STAY} AS x FROM c WHERE service = 'signup' GROUP BY client),
t2 AS (SELECT client, {S.PLAIN} AS x FROM c WHERE service = 'purchase' GROUP BY client),
t3 AS (SELECT client, {S.visits('click')} AS a, {S.visits('view')} AS b, {S.visits('error')} AS p FROM c
 WHERE service IN ('click', 'view', 'error') GROUP BY client),
inc AS (SELECT client, sum(coalesce(amount, 0)) AS x FROM (SELECT *, row_number() OVER (
 PARTITION BY client, kind ORDER BY s DESC, e DESC, coalesce(amount, -1) DESC) AS rn FROM c) WHERE rn = 1 GROUP BY client),
st AS (SELECT client, s, least(e, {S.GT}) AS e FROM ok WHERE service = 'signup'),
d AS ({S.label_sql('st', 'client', str(S.GT))})
SELECT "ClientID", round("ExpenseAmount", 2) AS "ExpenseAmount", coalesce("TotalScore", -1) AS "TotalScore",
 CASE "Gender" WHEN 'g0' THEN 1 WHEN 'g1' THEN 2 WHEN 'g2' THEN 3 END AS "Gender",
 (client % 4 <> 0)::INT * -1 + 2 AS "HasFamily", "ReasonForService_r0", "ReasonForService_r1", "ReasonForService_r2",
 "ReasonForService_r3", rn AS "ReasonForService_None",
 MTYPES,
 coalesce(t1.x, 0) AS "Total_signup", coalesce(t2.x, 0) AS "Total_purchase", coalesce(t3.a, 0) AS "Num_click",
 coalesce(t3.b, 0) AS "Num_view", coalesce(t3.p, 0) AS "Num_error", round(inc.x, 2) AS "IncomeTotal",
 age::BIGINT AS "CurrentAge", (coalesce(days, 0) >= {S.THRESHOLD})::INT AS "GroundTruth"
FROM base JOIN extra ON client = "ClientID" LEFT JOIN t1 USING (client) LEFT JOIN t2 USING (client) LEFT JOIN t3 USING (client)
 LEFT JOIN inc USING (client) LEFT JOIN d USING (client) LEFT JOIN types USING (client)"""
_STATIC_SQL = (_STATIC_SQL.replace("MTYPES", "it0 AS \"IncomeType_t0\", it1 AS \"IncomeType_t1\", it2 AS \"IncomeType_t2\", itn AS \"IncomeType_None\"")
               .replace("base AS (", """types AS (SELECT client, max((coalesce(kind, 'None') = 't0')::INT) AS it0,
 max((coalesce(kind, 'None') = 't1')::INT) AS it1, max((coalesce(kind, 'None') = 't2')::INT) AS it2,
 max((coalesce(kind, 'None') = 'None')::INT) AS itn FROM c GROUP BY client),
base AS ("""))


@query("static_features", _STATIC_SQL)
def static_features(t: Tables):
    out = D.static_dataset(t.raw_episodes(), CFG).features
    return out.withColumns({c: F.round(c, 2) for c in ("ExpenseAmount", "IncomeTotal")})


@query("series_dataset")
def series_dataset(t: Tables):
    return D.series_dataset(t.raw_episodes(), CFG, n_anchors=S.N).encoded.withColumn("Date", F.col("Date").cast("string"))

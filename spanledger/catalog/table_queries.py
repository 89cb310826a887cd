"""Export, aggregation, join, encoding and questionnaire queries over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanledger.catalog.registry import query
from spanledger.operators import answers as Q, collapse as C, encode as N, export as X
from spanledger.sources.adapters import NOW, Tables

CONSENT = f"""consents AS (SELECT o_custkey AS client, o_orderkey AS id, o_orderstatus AS type, o_orderdate AS start,
 CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 365 DAY END AS expiry FROM orders),
consent AS (SELECT client, id, type, expiry FROM (SELECT *, row_number() OVER (PARTITION BY client ORDER BY
 CASE WHEN type <> 'O' THEN 1 ELSE 2 END, expiry NULLS LAST, id) AS rn FROM consents
 WHERE start <= TIMESTAMP '{NOW}' AND (expiry IS NULL OR expiry >= TIMESTAMP '{NOW}')) WHERE rn = 1)"""
PLACEMENT = """placement AS (SELECT o_custkey AS client, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS moved
 FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders
 WHERE o_orderstatus = 'O') WHERE rn = 1)"""
FAMILY = """family AS (SELECT c_custkey AS person, c_nationkey AS grp, n_name AS rel FROM customer JOIN nation ON n_nationkey = c_nationkey
 WHERE c_custkey % 7 NOT IN (1, 2) AND c_custkey % 11 <> 9 AND n_nationkey % 5 <> 0
 AND c_custkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey % 2 = 0))"""


def _consent(t: Tables):
    return X.consent_pick(t.consents(), NOW, "O")


def _placements(t: Tables):
    return t.orders.select(
        F.col("o_custkey").alias("ClientID"), F.col("o_orderkey").alias("HousePlacementID"),
        F.col("o_orderdate").alias("DateSearchStarted"), F.col("o_orderdate").alias("MovedInDate"),
        F.when(F.col("o_orderstatus") == "O", "N").otherwise("Y").alias("PlacementEndedYN"))


def _families(t: Tables):
    k = F.col("c_custkey")
    members = t.customer.select(
        k.alias("PersonID"), F.col("c_nationkey").alias("GroupID"), F.col("c_nationkey").alias("PeopleRelationshipTypeID"),
        F.when(k % 7 == 0, None).when((k % 7).isin(1, 2), F.lit("1998-01-01").cast("timestamp"))
        .otherwise(F.lit("2000-01-01").cast("timestamp")).alias("DateEnd"), (k % 11).alias("GroupRoleTypeID"))
    groups = t.nation.select(F.col("n_nationkey").alias("GroupID"),
                             F.when(F.col("n_nationkey") % 5 == 0, F.lit("1998-06-01").cast("timestamp")).alias("DateEnd"))
    people = t.supplier.where("s_nationkey % 2 = 0").select(F.col("s_suppkey").alias("PersonID"))
    active = X.active_groups(members, groups, people, NOW, left_role=9)
    return X.lookup(active, _codes(t), "PeopleRelationshipTypeID", "RelationshipType")


def _codes(t: Tables):
    return t.nation.select(F.col("n_nationkey").alias("ID"), F.col("n_name").alias("NameE"))


@query("consent_pick", f"WITH {CONSENT} " + """
SELECT client AS "ClientID", id AS "ConsentID", type AS "ConsentType", coalesce(strftime(expiry, '%Y-%m-%d'), 'open') AS "Expiry" FROM consent""")
def consent_pick(t: Tables):
    return _consent(t).select("ClientID", "ConsentID", "ConsentType",
                              F.coalesce(F.date_format("ExpiryDate", "yyyy-MM-dd"), F.lit("open")).alias("Expiry"))


@query("latest_placement", f"WITH {PLACEMENT} " + 'SELECT client AS "ClientID", id AS "HousePlacementID", moved AS "Moved" FROM placement')
def latest_placement(t: Tables):
    return X.latest_placement(_placements(t), "HousePlacementID").select(
        "ClientID", "HousePlacementID", F.date_format("MovedInDate", "yyyy-MM-dd").alias("Moved"))


@query("active_groups", f"WITH {FAMILY} " + 'SELECT person AS "PersonID", grp AS "GroupID", rel AS "RelationshipType" FROM family')
def active_groups(t: Tables):
    return _families(t).select("PersonID", "GroupID", "RelationshipType")


BASICS = f"""{CONSENT}, {PLACEMENT}, {FAMILY},
basics AS (SELECT c_custkey AS client, type AS consent, n_name AS country, grp AS family, rel, moved, c_acctbal AS weight,
 CASE WHEN moved IS NOT NULL THEN 'Y' ELSE 'N' END AS housed
FROM customer JOIN consent ON client = c_custkey LEFT JOIN nation ON n_nationkey = CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END
 LEFT JOIN placement p ON p.client = c_custkey LEFT JOIN family ON person = c_custkey)"""


def _basics(t: Tables):
    people = t.customer.select(
        F.col("c_custkey").alias("ClientID"), F.col("c_custkey").alias("PersonID"), F.col("c_acctbal").alias("ClientWeightKG"),
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("CountryID"))
    return X.client_basics(people, _consent(t), X.latest_placement(_placements(t), "HousePlacementID"), _families(t),
                           {"CountryOfBirth": (_codes(t), "CountryID")})


@query("client_basics", f"WITH {BASICS} " + """
SELECT client AS "ClientID", consent AS "ConsentType", coalesce(country, '') AS "CountryOfBirth", coalesce(family, -1) AS "FamilyID",
 coalesce(rel, '') AS "RelationshipType", coalesce(moved, '') AS "Moved", housed AS "InHousing" FROM basics""")
def client_basics(t: Tables):
    e = F.lit("")
    return _basics(t).select(
        "ClientID", "ConsentType", F.coalesce("CountryOfBirth", e).alias("CountryOfBirth"),
        F.coalesce("FamilyID", F.lit(-1)).alias("FamilyID"), F.coalesce("RelationshipType", e).alias("RelationshipType"),
        F.coalesce(F.date_format("MovedInDate", "yyyy-MM-dd"), e).alias("Moved"), "InHousing")


@query("services_semi", f"WITH {CONSENT} " + """
SELECT o_custkey AS "ClientID", o_orderkey AS "ServiceID" FROM orders WHERE EXISTS (SELECT 1 FROM consent WHERE client = o_custkey)""")
def services_semi(t: Tables):
    services = t.orders.select(F.col("o_custkey").alias("ClientID"), F.col("o_orderkey").alias("ServiceID"))
    return X.known_only(services, _consent(t))


def _incomes(t: Tables):
    k = F.col("o_orderkey")
    return t.orders.select(F.col("o_custkey").alias("ClientID"), k, (k % 27).alias("IncomeTypeID"), F.col("o_totalprice").alias("MonthlyAmount"),
                           F.col("o_orderdate").alias("DateStart"), F.when(k % 3 == 0, F.col("o_orderdate")).alias("createdDate"))


def _regions(t: Tables):
    return t.region.select(F.col("r_regionkey").alias("ID"), F.col("r_name").alias("NameE"))


@query("detail_branches", """
SELECT 'Income' AS kind, n_name AS name, count(*)::BIGINT AS n FROM orders JOIN nation ON n_nationkey = o_orderkey % 27 WHERE o_orderkey % 3 <> 0 GROUP BY ALL
UNION ALL SELECT 'Expenses', n_name || '/' || r_name, count(*)::BIGINT FROM orders JOIN nation ON n_nationkey = o_orderkey % 27
 JOIN region ON r_regionkey = o_orderkey % 6 GROUP BY ALL
UNION ALL SELECT 'HealthIssues', n_name || '/' || coalesce(p_brand, 'none'), count(*)::BIGINT FROM supplier JOIN nation ON n_nationkey = s_nationkey
 LEFT JOIN part ON (CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 50 END) = s_suppkey GROUP BY ALL
UNION ALL SELECT 'Medications', p_brand, count(*)::BIGINT FROM part WHERE p_partkey % 4 = 0 GROUP BY ALL
UNION ALL SELECT 'Life Events', n_name, count(*)::BIGINT FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = o_orderkey % 25
 WHERE o_orderkey % 25 <> 5 GROUP BY ALL""")
def detail_branches(t: Tables):
    k = F.col("o_orderkey")
    codes, regions = _codes(t), _regions(t)
    spent = t.orders.select((k % 27).alias("ExpenseTypeID"), (k % 6).alias("PayFrequencyTypeID"))
    meds = t.part.select(F.when(F.col("p_partkey") % 4 != 0, F.col("p_partkey") % 50).alias("HealthIssueID"),
                         F.col("p_brand").alias("MedicationName"))
    issues = t.supplier.select(F.col("s_suppkey").alias("HealthIssueID"), F.col("s_nationkey").alias("HealthIssueTypeID"))
    events = t.orders.select(F.col("o_custkey").alias("PersonID"), (k % 25).alias("LifeEventTypeID"))
    people = t.customer.select(F.col("c_custkey").alias("PersonID"), F.col("c_custkey").alias("ClientID"))
    named = {
        "Income": X.incomes(_incomes(t), codes).select(F.col("IncomeType").alias("name")),
        "Expenses": X.expenses(spent, codes, regions).select(F.concat_ws("/", "ExpenseType", "ExpenseFrequency").alias("name")),
        "HealthIssues": X.health_issues(issues, codes, meds).select(
            F.concat_ws("/", "HealthIssue", F.coalesce("HealthIssuesMedicationName", F.lit("none"))).alias("name")),
        "Medications": X.free_medications(meds).select(F.col("MedicationName").alias("name")),
        "Life Events": X.life_events(events, codes, people, ignored=5).select(F.col("LifeEvent").alias("name")),
    }
    out = None
    for kind, df in named.items():
        part = df.groupBy("name").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out


@query("assessment_export", """
SELECT o_custkey AS "ClientID", o_orderkey AS "IntakeID", l_linenumber AS "QuestionID", n_name AS "ServiceProvider",
 replace(p_name || ', ' || p_type, ',', '') AS "QuestionE",
 replace(coalesce(CASE WHEN l_quantity > 25 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END, CASE WHEN l_returnflag = 'R' THEN 'Y,es' END,
  CASE WHEN l_linestatus = 'O' THEN p_brand END, 'none, given'), ',', '') AS "ScoreValue"
FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
 LEFT JOIN nation ON n_nationkey = s_nationkey
WHERE o_orderpriority <> '5-LOW' AND o_orderstatus = 'F' AND p_type LIKE '%M%'""")
def assessment_export(t: Tables):
    rows = (t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")))
    rows = (X.lookup(rows, _codes(t), "s_nationkey", "ServiceProvider", "left")
            .withColumn("TotalScore", F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_totalprice")))
            .withColumn("ClientStateTypeID", (F.col("o_orderstatus") == "F").cast("int")).withColumn("SPDAT_Type", F.col("p_type")))
    score = X.answer_text(F.when(F.col("l_quantity") > 25, F.col("l_quantity").cast("int")), F.when(F.col("l_returnflag") == "R", "Y,es"),
                          F.when(F.col("l_linestatus") == "O", F.col("p_brand")), F.lit("none, given"))
    return X.assessments(rows, "M").select(
        F.col("o_custkey").alias("ClientID"), F.col("o_orderkey").alias("IntakeID"), F.col("l_linenumber").alias("QuestionID"),
        "ServiceProvider", F.regexp_replace(F.concat("p_name", F.lit(", "), "p_type"), ",", "").alias("QuestionE"), score.alias("ScoreValue"))


@query("restrictions", f"WITH {CONSENT} " + """
SELECT o_orderkey AS "ClientBarredPeriodID", o_custkey AS "ClientID", n_name AS "Reason", s_name AS "ServiceRestricitonOrganizationName"
FROM orders JOIN nation ON n_nationkey = o_orderkey % 25 JOIN supplier ON s_suppkey = o_orderkey % 100
WHERE CAST(o_orderdate AS DATE) >= DATE '1998-07-01' AND EXISTS (SELECT 1 FROM consent WHERE client = o_custkey)""")
def restrictions(t: Tables):
    k = F.col("o_orderkey")
    barred = t.orders.select(k.alias("ClientBarredPeriodID"), F.col("o_custkey").alias("ClientID"), F.col("o_orderdate").alias("DateStart"),
                             (k % 25).alias("ReasonBarredTypeID"), (k % 100).alias("OrganizationID"))
    orgs = t.supplier.select(F.col("s_suppkey").alias("OrganizationID"), F.col("s_name").alias("Name"))
    return X.restrictions(barred, _codes(t), orgs, _consent(t), since="1998-07-01").select(
        "ClientBarredPeriodID", "ClientID", "Reason", "ServiceRestricitonOrganizationName")


@query("modules_listagg", """
SELECT l_orderkey, left(string_agg(p_brand, '|' ORDER BY p_brand), 30) AS "Modules" FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def modules_listagg(t: Tables):
    return X.text_list(t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")), "l_orderkey", "p_brand", "Modules")


_WIDE = ("ClientID", "ConsentType", "FamilyID", "RelationshipType", "CountryOfBirth", "ClientWeightKG", "InHousing", "ServiceID",
         "ServiceType", "DateStart", "DateEnd", "ReasonForService", "IncomeType", "MonthlyAmount", "ExpenseType", "ExpenseAmount",
         "HealthIssue", "TotalScore")
_UNION = f"""{BASICS}, recs AS (
SELECT user_id AS client, event_id AS id, event_type AS kind, (epoch_us(ts) // 1000000)::BIGINT AS s, NULL AS reason, NULL AS itype, NULL::DOUBLE AS amount,
 NULL AS etype, NULL::DOUBLE AS spent, NULL AS issue, NULL::DOUBLE AS score FROM events
UNION ALL SELECT o_custkey, NULL, 'Income', (epoch_us(o_orderdate) // 1000000)::BIGINT, n_name, n_name, o_totalprice, NULL, NULL, NULL, NULL
 FROM orders JOIN nation ON n_nationkey = o_orderkey % 27 WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_custkey, NULL, 'Expenses', (epoch_us(l_shipdate) // 1000000)::BIGINT, NULL, NULL, NULL, n_name, l_extendedprice, NULL, NULL
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN nation ON n_nationkey = l_suppkey % 25
UNION ALL SELECT c_custkey, NULL, 'VISPDAT', NULL, NULL, NULL, NULL, NULL, NULL, NULL, c_acctbal FROM customer)"""
_UNION_OUT = """SELECT client AS "ClientID", consent AS "ConsentType", coalesce(family, -1) AS "FamilyID", coalesce(country, '') AS "CountryOfBirth",
 housed AS "InHousing", weight AS "ClientWeightKG", coalesce(id, -1) AS "ServiceID", kind AS "ServiceType", coalesce(s, -1) AS start_s,
 coalesce(reason, '') AS "ReasonForService", coalesce(itype, '') AS "IncomeType", amount AS "MonthlyAmount", coalesce(etype, '') AS "ExpenseType",
 spent AS "ExpenseAmount", coalesce(issue, '') AS "HealthIssue", score AS "TotalScore" FROM recs JOIN basics USING (client)"""


def _union(t: Tables):
    services = t.events.select(F.col("user_id").alias("ClientID"), F.col("event_id").alias("ServiceID"),
                               F.col("event_type").alias("ServiceType"), F.date_trunc("second", "ts").alias("DateStart"))
    incomes = X.incomes(_incomes(t), _codes(t)).withColumn("ReasonForService", F.col("IncomeType"))
    spent = (t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
             .select(F.col("o_custkey").alias("ClientID"), F.col("l_shipdate").alias("DateStart"), F.col("l_extendedprice").alias("ExpenseAmount"),
                     (F.col("l_suppkey") % 25).alias("ExpenseTypeID")))
    spent = X.lookup(spent, _codes(t), "ExpenseTypeID", "ExpenseType")
    scored = t.customer.select(F.col("c_custkey").alias("ClientID"), F.col("c_acctbal").alias("TotalScore"))
    basics = _basics(t).select("ClientID", "ConsentType", "FamilyID", "RelationshipType", "CountryOfBirth", "ClientWeightKG", "InHousing")
    return services, X.episode_union(basics, {None: services, "Income": incomes, "Expenses": spent, "VISPDAT": scored}, _WIDE)


def _flat(df):
    e = F.lit("")
    return df.select("ClientID", "ConsentType", F.coalesce("FamilyID", F.lit(-1)).alias("FamilyID"),
                     F.coalesce("CountryOfBirth", e).alias("CountryOfBirth"), "InHousing", "ClientWeightKG",
                     F.coalesce("ServiceID", F.lit(-1)).alias("ServiceID"), "ServiceType",
                     F.coalesce(F.unix_seconds("DateStart"), F.lit(-1)).alias("start_s"),
                     *[F.coalesce(c, e).alias(c) for c in ("ReasonForService", "IncomeType", "ExpenseType", "HealthIssue")],
                     "MonthlyAmount", "ExpenseAmount", "TotalScore")


@query("episode_union", f"WITH {_UNION} {_UNION_OUT}")
def episode_union(t: Tables):
    return _flat(_union(t)[1])


@query("episode_export", f"WITH {_UNION} {_UNION_OUT} WHERE client IN (SELECT user_id FROM events) ORDER BY client, s")
def episode_export(t: Tables):
    services, rows = _union(t)
    return _flat(X.episode_export(rows, services, ordered=True))


# --- aggregation and joins -----------------------------------------------------------------------

@query("classify_cats", """
SELECT feature, CASE WHEN max(n) > 1 THEN 'multi' ELSE 'single' END AS kind FROM (
 SELECT 'o_orderstatus' AS feature, o_custkey, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 2
 UNION ALL SELECT 'segment', o_custkey, count(DISTINCT c_mktsegment) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 2
 UNION ALL SELECT 'maybe', o_custkey, count(DISTINCT CASE WHEN o_orderkey % 2 = 0 THEN c_mktsegment END) FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 2
) GROUP BY 1""")
def classify_cats(t: Tables):
    df = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("ClientID"), "o_orderstatus", F.col("c_mktsegment").alias("segment"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("c_mktsegment")).alias("maybe"))
    return C.classify_cats(df, ["o_orderstatus", "segment", "maybe"])


_VOCAB = """v AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value)::INT AS code FROM (
 SELECT DISTINCT 'l_returnflag' AS feature, l_returnflag AS value FROM lineitem
 UNION SELECT DISTINCT 'l_linestatus', l_linestatus FROM lineitem))"""


@query("category_vocab", f"WITH {_VOCAB} SELECT * FROM v")
def category_vocab(t: Tables):
    return C.vocabulary(t.lineitem, ["l_returnflag", "l_linestatus"])


@query("label_balance", """SELECT sum(toxic)::BIGINT AS num_pos, (count(*) - sum(toxic))::BIGINT AS num_neg,
 100.0::DOUBLE * sum(toxic) / count(*) AS pct_pos FROM labels""")
def label_balance(t: Tables):
    return C.label_balance(t.labels, "toxic")


_NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_LONG = "x AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS value FROM lineitem" for c in _NUMS) + ")"


@query("feature_stats", f"WITH {_LONG} " + """SELECT feature, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
 round(stddev_pop(value), 6) AS std FROM x GROUP BY 1""")
def feature_stats(t: Tables):
    return N.feature_stats(t.lineitem, _NUMS).select("feature", F.round("mean", 6).alias("mean"), "min", "max", F.round("std", 6).alias("std"))


@query("value_freqs", """WITH x AS (SELECT 'l_returnflag' AS feature, l_returnflag AS value FROM lineitem
 UNION ALL SELECT 'l_linestatus', l_linestatus FROM lineitem)
SELECT feature, value, count(*)::BIGINT AS n, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS freq FROM x GROUP BY 1, 2""")
def value_freqs(t: Tables):
    return N.value_freqs(t.lineitem, ["l_returnflag", "l_linestatus"])


def _edges_sql(parts: int) -> str:
    """Quantile positions as literals, since they must be constant."""
    return f"WITH {_LONG} SELECT DISTINCT feature, edge FROM (" + " UNION ALL ".join(
        f"SELECT feature, round(quantile_cont(value, {i / parts!r}), 6) AS edge FROM x GROUP BY feature" for i in range(1, parts)) + ")"


def _edges(t: Tables, parts: int):
    return (N.bin_edges(t.lineitem, _NUMS, parts).select("feature", F.explode("edges").alias("edge"))
            .select("feature", F.round("edge", 6).alias("edge")).distinct())


@query("quartile_bins", _edges_sql(4))
def quartile_bins(t: Tables):
    return _edges(t, 4)


@query("decile_bins", _edges_sql(10))
def decile_bins(t: Tables):
    return _edges(t, 10)


@query("cluster_share", "SELECT label + 1 AS cluster, 100.0::DOUBLE * count(*) / sum(count(*)) OVER () AS pct FROM embeddings GROUP BY 1")
def cluster_share(t: Tables):
    from spanledger.operators.cluster import cluster_share as share

    return share(t.embeddings.select((F.col("label") + 1).alias("cluster")))


@query("join_label", """SELECT doc_id, n_chars, coalesce(toxic, 0) AS "GroundTruth" FROM documents LEFT JOIN labels USING (doc_id)""")
def join_label(t: Tables):
    return C.join_label(t.documents.select("doc_id", "n_chars"), t.labels.select("doc_id", F.col("toxic").alias("GroundTruth")), ["doc_id"])


def _answer_table(t: Tables):
    return (t.orders.groupBy(F.col("o_custkey").alias("ClientID"))
            .agg(F.max("o_orderpriority").alias("Q1"), F.round(F.max("o_totalprice"), 2).alias("Q2")))


_ANS = "a AS (SELECT o_custkey AS id, max(o_orderpriority) AS q1, round(max(o_totalprice), 2) AS q2 FROM orders GROUP BY 1)"


@query("join_answers_inner", f'WITH {_ANS} SELECT c_custkey AS "ClientID", q1 AS "Q1", q2 AS "Q2" FROM customer JOIN a ON id = c_custkey')
def join_answers_inner(t: Tables):
    base = t.customer.select(F.col("c_custkey").alias("ClientID"), "c_acctbal")
    return C.join_answers(base, _answer_table(t), "ClientID", clients_only=True, answers_only=True)


@query("join_answers_left", f"""WITH {_ANS} SELECT c_custkey AS "ClientID", c_acctbal, coalesce(q1, '') AS "Q1", coalesce(q2, -1) AS "Q2"
FROM customer LEFT JOIN a ON id = c_custkey""")
def join_answers_left(t: Tables):
    base = t.customer.select(F.col("c_custkey").alias("ClientID"), "c_acctbal")
    return C.join_answers(base, _answer_table(t), "ClientID", clients_only=False).fillna({"Q1": "", "Q2": -1.0})


@query("coalesce_update", """SELECT c_custkey, c_name, coalesce(bal, c_acctbal) AS c_acctbal, coalesce(seg, c_mktsegment) AS c_mktsegment
FROM customer LEFT JOIN (SELECT o_custkey, round(max(o_totalprice), 2) AS bal, max(CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END) AS seg
 FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def coalesce_update(t: Tables):
    new = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.round(F.max("o_totalprice"), 2).alias("c_acctbal"),
        F.max(F.when(F.col("o_orderstatus") == "O", F.col("o_orderpriority"))).alias("c_mktsegment"))
    return C.coalesce_update(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), new, ["c_custkey"])


# --- encoding ------------------------------------------------------------------------------------

_PRIO = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("onehot_multi", 'SELECT o_custkey AS "ClientID", ' + ", ".join(
    f"max((coalesce(o_orderpriority, 'None') = '{p}')::INT) AS \"o_orderpriority_{p}\"" for p in _PRIO[:4]) + " FROM orders GROUP BY 1")
def onehot_multi(t: Tables):
    # The vocabulary lacks one value, as when scoring data with an unknown category.
    return N.onehot_multi(t.orders.withColumnRenamed("o_custkey", "ClientID"), ["ClientID"], {"o_orderpriority": _PRIO[:4]})


def _flags(t: Tables):
    vocab = C.vocabulary_lists(C.vocabulary(t.lineitem.where("l_returnflag <> 'R'"), ["l_returnflag", "l_linestatus"]), ["l_returnflag", "l_linestatus"])
    rows = t.lineitem.groupBy("l_orderkey").agg(F.max("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus"))
    return vocab, rows


_FLAGS = """f AS (SELECT l_orderkey, max(l_returnflag) AS r, min(l_linestatus) AS s FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey, CASE r WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE -1 END AS r, CASE s WHEN 'F' THEN 1 ELSE 2 END AS s FROM f)"""


@query("ordinal_encode", f"WITH {_FLAGS} SELECT l_orderkey, r AS l_returnflag, s AS l_linestatus FROM c")
def ordinal_encode(t: Tables):
    vocab, rows = _flags(t)
    return N.ordinal_encode(rows, vocab)


@query("onehot_single", f"""WITH {_FLAGS} SELECT l_orderkey, (r = 1)::INT AS "l_returnflag_A", (r = 2)::INT AS "l_returnflag_N",
 (s = 1)::INT AS "l_linestatus_F", (s = 2)::INT AS "l_linestatus_O" FROM c""")
def onehot_single(t: Tables):
    vocab, rows = _flags(t)
    return N.onehot_single(N.ordinal_encode(rows, vocab), vocab)


@query("decode_ordinal", f"""WITH {_FLAGS} SELECT l_orderkey, CASE r WHEN 1 THEN 'A' WHEN 2 THEN 'N' ELSE '?' END AS l_returnflag,
 CASE s WHEN 1 THEN 'F' WHEN 2 THEN 'O' END AS l_linestatus FROM c""")
def decode_ordinal(t: Tables):
    vocab, rows = _flags(t)
    return N.decode_ordinal(N.ordinal_encode(rows, vocab), vocab).fillna("?", ["l_returnflag"])


_SCALE_SQL = """WITH m AS (SELECT avg(c_acctbal) AS mu, stddev_pop(c_acctbal) AS sd FROM customer WHERE c_mktsegment <> 'MACHINERY')"""


@query("standard_scale", _SCALE_SQL + """ SELECT round((c_acctbal - mu) / sd, 6) AS c_acctbal, 0.0::DOUBLE AS flat, c_custkey FROM customer, m""")
def standard_scale(t: Tables):
    df = t.customer.select("c_custkey", "c_acctbal", "c_mktsegment", F.lit(3.0).alias("flat"))
    # Moments come from the training part alone, every row is scaled with them.
    fitted = N.moments(df.where("c_mktsegment <> 'MACHINERY'"), ["c_acctbal", "flat"])
    return N.standard_scale(df, fitted).drop("c_mktsegment").withColumn("c_acctbal", F.round("c_acctbal", 6))


@query("inverse_scale", "SELECT c_custkey, round_even(c_acctbal, 0) AS c_acctbal FROM customer")
def inverse_scale(t: Tables):
    df = t.customer.select("c_custkey", "c_acctbal")
    fitted = N.moments(df, ["c_acctbal"])
    return N.inverse_scale(N.standard_scale(df, fitted), fitted)


@query("rule_text", """WITH e AS (SELECT quantile_cont(l_quantity, [0.25, 0.5, 0.75]) AS q FROM lineitem)
SELECT rule, count(*)::BIGINT AS n FROM (SELECT CASE WHEN l_quantity <= q[1] THEN 'l_quantity <= ' || printf('%.2f', q[1])
 WHEN l_quantity <= q[2] THEN printf('%.2f', q[1]) || ' < l_quantity <= ' || printf('%.2f', q[2])
 WHEN l_quantity <= q[3] THEN printf('%.2f', q[2]) || ' < l_quantity <= ' || printf('%.2f', q[3])
 ELSE 'l_quantity > ' || printf('%.2f', q[3]) END AS rule FROM lineitem, e
UNION ALL SELECT 'l_returnflag=' || l_returnflag FROM lineitem) GROUP BY 1""")
def rule_text(t: Tables):
    edges = N.bin_edges(t.lineitem, ["l_quantity"], 4)
    q = edges.select("edges").scalar()
    rows = t.lineitem.select("l_quantity", "l_returnflag").withColumn("_e", q)
    bins = rows.select(N.bin_rule(F.lit("l_quantity"), F.col("_e"), N.bin_index(F.col("l_quantity"), F.col("_e"))).alias("rule"))
    values = t.lineitem.select(N.value_rule(F.lit("l_returnflag"), F.col("l_returnflag")).alias("rule"))
    return bins.unionByName(values).groupBy("rule").agg(F.count("*").alias("n"))


# --- questionnaire -------------------------------------------------------------------------------

_QA = """a AS (SELECT user_id AS client, event_id AS pos, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type, value FROM events),
q AS (SELECT client, pos, ts, k % 3 = 0 AS num, CASE WHEN k % 5 = 0 THEN event_type || '...' ELSE event_type END AS question,
 'about ' || event_type || ' 100%' AS descr, CASE WHEN event_type = 'error' THEN CASE WHEN k % 2 = 0 THEN 'Yes' ELSE '0' END
 ELSE CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END AS answer FROM a)"""
_ASOF = "ok AS (SELECT * FROM q WHERE ts <= TIMESTAMP '2024-01-24')"
_ROOTS = """s AS (SELECT *, CASE WHEN contains(question, '...') THEN descr ELSE question END AS text FROM ok),
r AS (SELECT *, coalesce(last_value(CASE WHEN num THEN text END IGNORE NULLS) OVER (PARTITION BY client ORDER BY pos
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS root, lead(num) OVER (PARTITION BY client ORDER BY pos) AS nxt FROM s),
roots AS (SELECT DISTINCT text FROM r WHERE num AND NOT nxt),
f AS (SELECT client, pos, num, CASE WHEN num THEN text ELSE root || text END AS full_text, answer FROM r)"""


def _asked(t: Tables):
    return Q.answers_asof(t.answers(), "2024-01-24 00:00:00")


@query("answers_asof", f'WITH {_QA}, {_ASOF} SELECT client AS "ClientID", pos, answer AS "ScoreValue" FROM ok')
def answers_asof(t: Tables):
    return _asked(t).select("ClientID", "pos", "ScoreValue")


@query("question_subst", f"""WITH {_QA}, {_ASOF} SELECT pos, descr AS "QuestionE",
 CASE WHEN contains(question, '...') THEN descr ELSE question END AS "Literal" FROM ok""")
def question_subst(t: Tables):
    df = _asked(t)
    literal = Q.question_subst(df, literal=True).select("pos", F.col("QuestionE").alias("Literal"))
    return Q.question_subst(df).select("pos", "QuestionE").join(literal, "pos")


def _full(t: Tables):
    return Q.question_roots(Q.question_subst(_asked(t), literal=True), chunk=1000)


@query("question_roots", f"""WITH {_QA}, {_ASOF}, {_ROOTS} SELECT client AS "ClientID", pos, full_text AS "QuestionE",
 full_text IN (SELECT text FROM roots) AS heading FROM f""")
def question_roots(t: Tables):
    full, roots = _full(t)
    return (full.join(roots.withColumn("heading", F.lit(True)), "QuestionE", "left")
            .select("ClientID", "pos", "QuestionE", F.coalesce("heading", F.lit(False)).alias("heading")))


_LAST = f"""WITH {_QA}, {_ASOF}, {_ROOTS},
l AS (SELECT client, full_text AS question, arg_max(answer, pos) AS answer FROM f WHERE full_text NOT IN (SELECT text FROM roots) GROUP BY 1, 2)"""


@query("answer_types", _LAST + """ SELECT question, CASE WHEN bool_and(regexp_full_match(answer, '[0-9]+')) THEN 'numeric' ELSE 'categorical' END AS kind
FROM l GROUP BY 1""")
def answer_types(t: Tables):
    return Q.answer_types(Q.last_answers(*_full(t)))


_PLAIN_Q = ["click", "error", "purchase", "signup", "view"]


@query("answers_pivot", f"""WITH {_QA}, {_ASOF}, l AS (SELECT client, 'about ' || event_type || ' 100' AS question, arg_max(answer, pos) AS answer FROM
 (SELECT ok.*, a.event_type FROM ok JOIN a USING (pos)) GROUP BY 1, 2) SELECT client AS "ClientID", """ + ", ".join(
    f"""max(CASE WHEN question = 'about {e} 100' THEN {"CASE WHEN answer = '0' THEN 'Unknown' ELSE answer END" if e == "error" else "answer::DOUBLE"} END) AS "about {e} 100" """
    for e in _PLAIN_Q) + "FROM l GROUP BY 1")
def answers_pivot(t: Tables):
    df = Q.question_subst(_asked(t))
    none = df.select("QuestionE").where("false")
    return Q.answers_pivot(Q.last_answers(df, none))

"""The whole export: all record branches over normalised tables, the scored answers, the questionnaire table."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from spanledger.catalog.registry import query
from spanledger.catalog.table_queries import _ASOF, _QA, _ROOTS
from spanledger.operators import answers as Q, export as X
from spanledger.sources.adapters import NOW, Tables
from spanledger.sources.readers import EXPORT_COLUMNS, episode_schema
from spanledger.sources.records import SECOND_CHOICE, SHIFT_DAYS, export_tables

_SQL_TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "timestamp": "TIMESTAMP", "string": "VARCHAR"}
_FIELDS = episode_schema().fields
# The columns of a record; clients bring the rest.
_RECORD = EXPORT_COLUMNS[20:]


def _flat(df):
    """Nulls as values and times as seconds, so that any engine writes the rows alike."""
    fill = {T.LongType(): lambda c: F.coalesce(c, F.lit(-1)), T.StringType(): lambda c: F.coalesce(c, F.lit("")),
            T.TimestampType(): lambda c: F.coalesce(F.unix_seconds(c), F.lit(-1)), T.DoubleType(): lambda c: F.coalesce(c, F.lit(-1.0))}
    return df.select(*[fill[f.dataType](F.col(f.name)).alias(f.name) for f in _FIELDS])


_FILL_SQL = {"bigint": "coalesce({c}, -1)", "string": "coalesce({c}, '')", "double": "coalesce({c}, -1)::DOUBLE",
             "timestamp": "coalesce((epoch_us({c}) // 1000000)::BIGINT, -1)"}
_FLAT_SQL = ", ".join(_FILL_SQL[f.dataType.simpleString()].format(c=f'"{f.name}"') + f' AS "{f.name}"' for f in _FIELDS)
_EMPTY_SQL = "SELECT " + ", ".join(f'NULL::{_SQL_TYPES[f.dataType.simpleString()]} AS "{f.name}"' for f in _FIELDS
                                   if f.name in ("ClientID", *_RECORD)) + " WHERE false"
# Memberships past their end: keys 1 and 2 of every 7.
_PARTS_SQL = f"""code AS (SELECT n_nationkey AS id, n_name AS name FROM nation), rcode AS (SELECT r_regionkey AS id, r_name AS name FROM region),
org AS (SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_nationkey % 2 = 0),
consent AS (SELECT client, type FROM (SELECT o_custkey AS client, name AS type, row_number() OVER (PARTITION BY o_custkey
  ORDER BY CASE WHEN name = '{SECOND_CHOICE}' THEN 2 ELSE 1 END, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate + INTERVAL 365 DAY END NULLS LAST, o_orderkey) AS rn
 FROM orders JOIN code ON code.id = o_orderkey % 25 WHERE o_orderkey % 100 IN (SELECT id FROM org) AND o_orderdate <= TIMESTAMP '{NOW}'
  AND (o_orderkey % 5 = 0 OR o_orderdate + INTERVAL 365 DAY >= TIMESTAMP '{NOW}')) WHERE rn = 1),
placed AS (SELECT client, moved FROM (SELECT o_custkey AS client, o_orderdate AS moved, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
 FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 6 <> 0 AND o_orderkey % 100 IN (SELECT id FROM org)) WHERE rn = 1),
family AS (SELECT person, grp, name AS rel FROM (
  SELECT 2 * c_custkey + 1 AS person, c_nationkey AS grp, c_custkey % 27 AS kind FROM customer WHERE c_custkey % 7 NOT IN (1, 2) AND c_custkey % 11 <> 9
  UNION ALL SELECT 2 * s_suppkey + 1, s_nationkey, s_suppkey FROM supplier WHERE s_suppkey % 7 NOT IN (1, 2)) m
 JOIN nation ON n_nationkey = grp AND n_nationkey % 5 <> 0 JOIN code ON code.id = kind
 WHERE person IN (SELECT 2 * c_custkey + 1 FROM customer WHERE c_custkey % 3 <> 0)),
basics AS (SELECT c_custkey AS "ClientID", 2 * c_custkey + 1 AS "PersonID", type AS "ConsentType", grp::BIGINT AS "FamilyID", rel AS "RelationshipType",
 TIMESTAMP '1970-01-01' + INTERVAL 1 DAY * (c_custkey % 9000) AS "DOB", (c_custkey % 90)::DOUBLE AS "CurrentAge", c_mktsegment AS "Gender",
 CASE WHEN c_custkey % 5 = 0 THEN 'Y' ELSE 'N' END AS "AboriginalIndicator", 'status ' || c_custkey % 4 AS "Citizenship",
 CASE WHEN c_custkey % 13 = 0 THEN 'Y' ELSE 'N' END AS "VeteranStatus", country.name AS "CountryOfBirth", province.name AS "ProvinceOfBirth", city.name AS "CityOfBirth",
 eye.name AS "EyeColour", hair.name AS "HairColour", (150 + c_custkey % 50)::DOUBLE AS "ClientHeightCM", c_acctbal AS "ClientWeightKG",
 CASE WHEN moved IS NULL THEN 'N' ELSE 'Y' END AS "InHousing", moved AS "MovedInDate"
 FROM customer JOIN consent ON consent.client = c_custkey LEFT JOIN placed ON placed.client = c_custkey LEFT JOIN family ON person = 2 * c_custkey + 1
 LEFT JOIN code country ON country.id = c_custkey % 27 LEFT JOIN code province ON province.id = CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END
 LEFT JOIN code city ON city.id = c_custkey % 26 LEFT JOIN rcode eye ON eye.id = c_custkey % 7 LEFT JOIN rcode hair ON hair.id = c_custkey % 6),
scored AS (SELECT o_orderkey AS intake, o_custkey AS client, org.id AS org_id, org.name AS org, CASE WHEN k.id % 2 = 0 THEN 'VI-' ELSE '' END || k.name AS kind, pre.name AS pre,
 o_orderdate AS start, (o_orderkey % 18)::DOUBLE AS score FROM orders JOIN code k ON k.id = o_orderkey % 26 JOIN org ON org.id = o_orderkey % 100
 JOIN customer ON c_custkey = o_custkey LEFT JOIN rcode pre ON pre.id = o_orderkey % 7
 WHERE o_orderpriority <> '5-LOW' AND c_custkey % 4 <> 0 AND (k.id % 2 = 0 OR k.name LIKE '%VI%'))"""
_RECORDS_SQL = f"""recs AS ({_EMPTY_SQL}
UNION ALL BY NAME SELECT user_id AS "ClientID", event_id AS "ServiceID", event_type AS "ServiceType", date_trunc('second', ts) AS "DateStart",
 CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts) + INTERVAL 1 DAY END AS "DateEnd", 'reason ' || event_id % 5 AS "ReasonForService", 'site ' || user_id % 3 AS "OrganizationName" FROM events
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'Income' AS "ServiceType", name AS "IncomeType", name AS "ReasonForService", o_totalprice AS "MonthlyAmount", o_orderdate AS "DateStart"
 FROM orders JOIN code ON id = o_orderkey % 27 WHERE o_orderkey % 3 <> 0
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'Expenses' AS "ServiceType", 10 * o_orderkey + l_linenumber AS "ClientExpenseID", e.name AS "ExpenseType", f.name AS "ExpenseFrequency",
 l_extendedprice AS "ExpenseAmount", l_shipdate AS "DateStart", CASE WHEN l_returnflag = 'R' THEN 'Y' ELSE 'N' END AS "IsEssentialYN"
 FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN code e ON e.id = l_suppkey % 27 JOIN rcode f ON f.id = l_partkey % 6
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'Education' AS "ServiceType", name AS "EducationLevel", o_orderdate AS "EducationStartDate", o_orderdate + INTERVAL 30 DAY AS "EducationEndDate"
 FROM orders JOIN code ON id = o_orderkey % 27 WHERE o_orderkey % 4 = 1
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'HealthIssues' AS "ServiceType", o_orderkey AS "HealthIssueID", name AS "HealthIssue", o_orderdate AS "DateStart",
 CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END AS "DateEnd", CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS "DiagnosedYN",
 CASE WHEN o_orderkey % 3 = 0 THEN 'Y' ELSE 'N' END AS "SelfReportedYN", CASE WHEN o_orderkey % 5 = 0 THEN 'Y' ELSE 'N' END AS "SuspectedYN", p_brand AS "HealthIssuesMedicationName"
 FROM orders JOIN code ON id = o_orderkey % 27 LEFT JOIN part ON 2 * p_partkey = o_orderkey AND p_partkey % 4 <> 0 WHERE o_orderstatus = 'F'
UNION ALL BY NAME SELECT p_partkey % 500 AS "ClientID", 'Medications' AS "ServiceType", p_brand AS "OtherMedications" FROM part WHERE p_partkey % 4 = 0
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'Contributing Factor' AS "ServiceType", o_orderkey AS "clientContributingFactorID", name AS "ContributingFactor", o_orderdate AS "DateStart"
 FROM orders JOIN code ON id = o_orderkey % 26 WHERE o_orderkey % 4 = 2
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'Behavioral Risk Factor' AS "ServiceType", o_orderkey AS "ClientBehaviouralFactorID", code.name AS "BehavioralFactor", rcode.name AS "Severity",
 o_orderdate AS "DateStart" FROM orders JOIN code ON code.id = o_orderkey % 26 JOIN rcode ON rcode.id = o_orderkey % 6 WHERE o_orderkey % 4 = 3
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'Life Events' AS "ServiceType", o_orderkey AS "PeopleLifeEventID", name AS "LifeEvent", o_orderdate AS "DateStart"
 FROM orders JOIN customer ON c_custkey = o_custkey JOIN code ON id = o_orderkey % 26 WHERE o_orderkey % 10 <> 0
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'Diet' AS "ServiceType", o_orderkey AS "ClientDietID", code.name AS "DietCatetory", rcode.name AS "FoodType",
 CASE WHEN o_orderkey % 2 = 0 THEN 'Y' ELSE 'N' END AS "AvoidedDietYN", o_orderdate AS "DateStart"
 FROM orders JOIN code ON code.id = o_orderkey % 26 JOIN rcode ON rcode.id = o_orderkey % 6 WHERE o_orderkey % 7 = 0
UNION ALL BY NAME SELECT client AS "ClientID", 'VISPDAT' AS "ServiceType", intake AS "ServiceID", intake AS "IntakeID", pre AS "PreScreenPeriod", org AS "OrganizationName", score AS "TotalScore", start AS "DateStart" FROM scored
UNION ALL BY NAME SELECT o_custkey AS "ClientID", 'Service Restriction' AS "ServiceType", o_orderkey AS "ClientBarredPeriodID", code.name AS "Reason", modules AS "Modules",
 s_name AS "ServiceRestricitonOrganizationName", CAST(CAST(o_orderdate AS DATE) + {SHIFT_DAYS} AS TIMESTAMP) AS "DateStart"
 FROM orders JOIN code ON code.id = o_orderkey % 26 JOIN supplier ON s_suppkey = o_orderkey % 100
 LEFT JOIN (SELECT l_orderkey, left(string_agg(name, '|' ORDER BY name), 30) AS modules FROM lineitem JOIN code ON id = l_suppkey % 27 GROUP BY 1) ON l_orderkey = o_orderkey
 WHERE CAST(o_orderdate AS DATE) + {SHIFT_DAYS} >= DATE '2017-07-01' AND o_custkey IN (SELECT client FROM consent))"""


@query("whole_export", f"""WITH {_PARTS_SQL}, {_RECORDS_SQL}
SELECT {_FLAT_SQL} FROM recs JOIN basics USING ("ClientID") WHERE "ClientID" IN (SELECT user_id FROM events)""")
def whole_export(t: Tables):
    return _flat(X.export(export_tables(t), NOW, SECOND_CHOICE))


@query("whole_answers", f"""WITH {_PARTS_SQL}
SELECT intake AS "IntakeID", client AS "ClientID", client % 90 AS "CurrentAge", kind AS "SPDAT_Type", coalesce(pre, '') AS "PreScreenPeriod",
 strftime(start, '%Y-%m-%d') AS "SPDAT_Date", strftime(l_shipdate, '%Y-%m-%d') AS "LastUpdatedDate", org_id AS "OrganizationID", org AS "ServiceProvider",
 l_partkey AS "AssessmentQuestionID", CAST(p_size AS VARCHAR) AS "Component", replace(p_name || ', ' || p_type, ',', '') AS "QuestionE", replace(p_type || ',...', ',', '') AS "DescriptionE",
 coalesce(replace(coalesce(CASE WHEN l_quantity > 25 AND CAST(l_quantity AS INT) > 25 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END, CASE WHEN l_returnflag = 'R' THEN 'Y,es' END,
  a.name, b.name, c.name, d.name), ',', ''), '') AS "ScoreValue", CASE WHEN CAST(l_quantity AS INT) = 1 THEN 'Y' ELSE 'N' END AS "RefusedYN", score::BIGINT AS "TotalScore"
FROM scored JOIN lineitem ON l_orderkey = intake JOIN part ON p_partkey = l_partkey LEFT JOIN code a ON l_linenumber = 1 AND a.id = l_suppkey % 27
 LEFT JOIN code b ON l_linenumber = 2 AND b.id = l_suppkey % 27 LEFT JOIN rcode c ON l_linenumber = 3 AND c.id = CAST(l_quantity AS INT) % 6
 LEFT JOIN rcode d ON d.id = CAST(l_quantity AS INT) % 6""")
def whole_answers(t: Tables):
    e = F.lit("")
    return X.answers_export(export_tables(t)).withColumns(
        {"PreScreenPeriod": F.coalesce("PreScreenPeriod", e), "ScoreValue": F.coalesce("ScoreValue", e),
         "SPDAT_Date": F.date_format("SPDAT_Date", "yyyy-MM-dd"), "LastUpdatedDate": F.date_format("LastUpdatedDate", "yyyy-MM-dd")})


@query("detail_records", f"""WITH {_PARTS_SQL}, {_RECORDS_SQL} SELECT "ServiceType",
 concat_ws('/', "IncomeType", "ExpenseType", "ExpenseFrequency", "EducationLevel", "HealthIssue", "HealthIssuesMedicationName", "OtherMedications",
  "ContributingFactor", "BehavioralFactor", "Severity", "LifeEvent", "DietCatetory", "FoodType") AS name, count(*)::BIGINT AS n
FROM recs WHERE "ServiceType" IN ('Income', 'Expenses', 'Education', 'HealthIssues', 'Medications', 'Contributing Factor', 'Behavioral Risk Factor', 'Life Events', 'Diet') GROUP BY 1, 2""")
def detail_records(t: Tables):
    """All nine detail branches, by what they name."""
    names = ("IncomeType", "ExpenseType", "ExpenseFrequency", "EducationLevel", "HealthIssue", "HealthIssuesMedicationName", "OtherMedications",
             "ContributingFactor", "BehavioralFactor", "Severity", "LifeEvent", "DietCatetory", "FoodType")
    out = None
    for kind, df in X.detail_branches(export_tables(t)).items():
        rows = X.padded(df, kind, ("ServiceType", *names)).groupBy("ServiceType", F.concat_ws("/", *names).alias("name")).agg(F.count("*").alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


# Every kind of question after every kind of root; the roots alone are headings.
_KINDS = ("click", "error", "purchase", "signup", "view")
_PAIRS = [(a, b) for a in _KINDS for b in _KINDS]


def _answer_sql(root: str, kind: str) -> str:
    a = "CASE WHEN answer = '0' THEN 'Unknown' ELSE answer END" if kind == "error" else "answer::DOUBLE"
    return f"""max(CASE WHEN question = 'about {root} 100%about {kind} 100%' THEN {a} END) AS "about {root} 100about {kind} 100\""""


_QUESTIONS = f"WITH {_QA}, {_ASOF}, {_ROOTS.replace('''CASE WHEN contains(question, '...') THEN descr ELSE question END''', 'descr')}, " + """
l AS (SELECT client, full_text AS question, arg_max(answer, pos) AS answer FROM f WHERE full_text NOT IN (SELECT text FROM roots) GROUP BY 1, 2)"""


@query("questionnaire", _QUESTIONS + ' SELECT client AS "ClientID", ' + ", ".join(_answer_sql(a, b) for a, b in _PAIRS) + " FROM l GROUP BY 1")
def questionnaire(t: Tables):
    return Q.questionnaire(t.answers(), "2024-01-24 00:00:00")

"""Scans: the episode export (CSV), the questionnaire export (JSON), tables over JDBC."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from spanledger.sources.json_array import RANGE_BYTES, json_array, listed

# Columns of the episode export by type, in export order.
LONGS = ("ClientID", "PersonID", "FamilyID", "ServiceID", "ClientExpenseID", "HealthIssueID", "clientContributingFactorID",
         "ClientBehaviouralFactorID", "PeopleLifeEventID", "ClientDietID", "IntakeID", "ClientBarredPeriodID")
DOUBLES = ("CurrentAge", "ClientHeightCM", "ClientWeightKG", "MonthlyAmount", "ExpenseAmount", "TotalScore")
TIMES = ("DOB", "MovedInDate", "DateStart", "DateEnd", "EducationStartDate", "EducationEndDate")
EXPORT_COLUMNS = (
    "ClientID", "PersonID", "ConsentType", "FamilyID", "RelationshipType", "DOB", "CurrentAge", "Gender",
    "AboriginalIndicator", "Citizenship", "VeteranStatus", "CountryOfBirth", "ProvinceOfBirth", "CityOfBirth",
    "EyeColour", "HairColour", "ClientHeightCM", "ClientWeightKG", "InHousing", "MovedInDate", "ServiceID", "ServiceType",
    "DateStart", "DateEnd", "ReasonForService", "OrganizationName", "IncomeType", "MonthlyAmount", "ClientExpenseID",
    "ExpenseType", "ExpenseAmount", "ExpenseFrequency", "IsEssentialYN", "EducationLevel", "EducationStartDate",
    "EducationEndDate", "HealthIssueID", "HealthIssue", "DiagnosedYN", "SelfReportedYN", "SuspectedYN",
    "HealthIssuesMedicationName", "OtherMedications", "clientContributingFactorID", "ContributingFactor",
    "ClientBehaviouralFactorID", "BehavioralFactor", "Severity", "PeopleLifeEventID", "LifeEvent", "ClientDietID",
    "DietCatetory", "FoodType", "AvoidedDietYN", "IntakeID", "PreScreenPeriod", "TotalScore", "ClientBarredPeriodID",
    "Reason", "Modules", "ServiceRestricitonOrganizationName",
)
# Fields of one questionnaire answer.
ANSWER_FIELDS = ("IntakeID long, ClientID long, CurrentAge double, SPDAT_Type string, PreScreenPeriod string, "
                 "SPDAT_Date string, LastUpdatedDate string, OrganizationID long, ServiceProvider string, "
                 "AssessmentQuestionID long, Component string, QuestionE string, DescriptionE string, "
                 "ScoreValue string, RefusedYN string, TotalScore double")


def episode_schema(columns: Sequence[str] = EXPORT_COLUMNS) -> T.StructType:
    def kind(c):
        return (T.LongType() if c in LONGS else T.DoubleType() if c in DOUBLES
                else T.TimestampType() if c in TIMES else T.StringType())
    return T.StructType([T.StructField(c, kind(c)) for c in columns])


def read_episodes(spark: SparkSession, path: str, columns: Sequence[str] = EXPORT_COLUMNS,
                  encoding: str = "ISO-8859-1") -> DataFrame:
    """CSV export with a header and a fixed schema; unreadable cells become null."""
    return (spark.read.schema(episode_schema(columns)).option("header", True).option("encoding", encoding)
            .option("mode", "PERMISSIVE").csv(path))


def read_answers(spark: SparkSession, path: str, root: str = "VISPDATS", encoding: str = "UTF-16",
                 range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Questionnaire export: one JSON document whose root array holds the answers, in order.

    A document is read in ranges, by as many tasks (``json_array``). ``pos`` keeps the order within a file and, above that,
    the order of the paths: files have numbers 2**40 apart. Line breaks inside the document are dropped, as
    they are put in by the export and can stand inside strings.
    """
    # One row per file.
    files = listed(spark, path)
    records = json_array(spark, path, root, encoding, range_bytes, files)
    number = files.select("path", (F.row_number().over(W.orderBy("path")) - 1).cast("long").alias("_file"))
    answer = F.from_json(F.regexp_replace("text", "[\r\n]", ""), f"struct<{_ddl(ANSWER_FIELDS)}>")
    rows = (records.select("path", "pos", answer.alias("a")).join(number, "path")
            .select("path", (F.col("_file") * (1 << 40) + F.col("pos")).alias("pos"), "a.*"))
    numeric = [f.name for f in rows.schema.fields if isinstance(f.dataType, (T.LongType, T.DoubleType))]
    text = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.StringType) and f.name != "path"]
    return rows.fillna(0, numeric).fillna("0", text)


def _ddl(fields: str) -> str:
    return ", ".join(": ".join(f.split(" ")) for f in fields.split(", "))


def read_table(spark: SparkSession, url: str, table: str, partition: str | None = None, bounds: tuple[int, int] | None = None,
               parts: int = 64, **options: str) -> DataFrame:
    """Relational scan, split on a numeric column so that the read is parallel."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition and bounds:
        r = (r.option("partitionColumn", partition).option("lowerBound", bounds[0]).option("upperBound", bounds[1])
             .option("numPartitions", parts))
    return r.load()

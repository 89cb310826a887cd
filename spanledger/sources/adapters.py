"""The supplied tables read as the engine's inputs.

Event times are cut to whole seconds, the precision of the export.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanledger.config import SeriesSettings, Settings

# Parameters that fit the month the events span.
EVENT_CFG = replace(
    Settings(), label_date="2024-01-31", run_ts="2024-02-01 00:00:00", horizon_weeks=1, label_window_days=14,
    label_threshold_days=9, stay_service="signup", timed_services=("signup", "purchase"),
    counted_services=("click", "view", "error"), series=SeriesSettings(step_days=3, t_x=4, years_of_data=9 / 365.25, folds=3),
    categorical_features=("Gender", "ReasonForService", "ServiceType", "IncomeType"),
    numeric_features=("CurrentAge", "MonthlyAmount", "ExpenseAmount", "TotalScore"), drop_first=())
NOW = "1999-01-01 00:00:00"


class Tables:
    """Lazy access to the parquet tables of one directory, times as session timestamps."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        for f in df.schema.fields:
            if f.dataType.simpleString() == "timestamp_ntz":
                df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
        return df

    def raw_episodes(self, unit: str = "second") -> DataFrame:
        """events as episodes, DateEnd null while open."""
        start = F.date_trunc(unit, "ts")
        length = F.round(F.col("value") * 1800).cast("long")
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.col("event_type")
        return self.events.select(
            F.col("user_id").alias("ClientID"), F.col("event_id").alias("ServiceID"), kind.alias("ServiceType"),
            start.alias("DateStart"),
            F.when(F.col("event_id") % 97 != 0, F.timestamp_seconds(F.unix_seconds(start) + length)).alias("DateEnd"),
            F.when(F.col("user_id") % 19 == 0, "Declined for now").when(F.col("user_id") % 7 == 0, None)
            .otherwise("Explicit").alias("ConsentType"),
            F.when(F.col("user_id") % 4 == 0, F.floor(F.col("user_id") / 4)).alias("FamilyID"),
            F.timestamp_seconds(F.lit(631_152_000) + F.col("user_id") * 37 * 86_400).alias("DOB"),
            F.when(F.col("event_id") % 11 != 0, F.concat(F.lit("g"), F.col("user_id") % 3)).alias("Gender"),
            F.when(k % 10 != 0, F.concat(F.lit("r"), k % 4)).alias("ReasonForService"),
            F.when(kind == "view", F.concat(F.lit("t"), k % 3)).alias("IncomeType"),
            F.when(kind == "view", F.col("value").cast("string")).alias("MonthlyAmount"),
            F.when(kind == "purchase", F.col("value").cast("string")).alias("ExpenseAmount"),
            F.when((kind == "click") & (k % 4 == 0), k.cast("string")).alias("TotalScore"))

    def episodes(self, unit: str = "second") -> DataFrame:
        df = self.raw_episodes(unit)
        return df.withColumn("DateEnd", F.coalesce("DateEnd", F.lit(EVENT_CFG.run_ts).cast("timestamp")))

    def clients(self) -> DataFrame:
        return (self.customer.join(self.nation, F.col("c_nationkey") == F.col("n_nationkey"))
                .join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
                .select(F.col("c_custkey").alias("ClientID"), "c_name", "c_acctbal", "c_mktsegment", "n_name", "r_name"))

    def incomes(self) -> DataFrame:
        return self.orders.select(F.col("o_custkey").alias("ClientID"), F.col("o_orderpriority").alias("IncomeType"),
                                  F.col("o_totalprice").alias("MonthlyAmount"), F.col("o_orderdate").alias("DateStart"),
                                  F.col("o_orderkey").alias("ServiceID"))

    def consents(self) -> DataFrame:
        return self.orders.select(
            F.col("o_custkey").alias("ClientID"), F.col("o_orderkey").alias("ConsentID"),
            F.col("o_orderstatus").alias("ConsentType"), F.col("o_orderdate").alias("StartDate"),
            F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate") + F.expr("interval 365 days")).alias("ExpiryDate"))

    def answers(self) -> DataFrame:
        """events as questionnaire rows: one per answered question, ``pos`` in file order."""
        k = F.get_json_object("props", "$.k").cast("int")
        return self.events.select(
            F.col("user_id").alias("ClientID"), F.col("user_id").alias("IntakeID"), F.col("event_id").alias("pos"),
            F.col("ts").alias("SPDAT_Date"), F.when(k % 3 == 0, k.cast("string")).otherwise("a").alias("Component"),
            F.when(k % 5 == 0, F.concat("event_type", F.lit("..."))).otherwise(F.col("event_type")).alias("QuestionE"),
            F.concat(F.lit("about "), F.col("event_type"), F.lit(" 100%")).alias("DescriptionE"),
            F.when(F.col("event_type") == "error", F.when(k % 2 == 0, "Yes").otherwise("0"))
            .otherwise(F.floor("value").cast("string")).alias("ScoreValue"))

    def scored(self) -> DataFrame:
        """lineitem as scored rows: label ``y``, probability ``p``."""
        return self.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("y"),
                                    F.round(F.col("l_discount") * 10, 6).alias("p"))

    def explanations(self) -> DataFrame:
        """lineitem as explanation rows: example, rule text, weight."""
        return self.lineitem.select(
            F.col("l_orderkey").alias("exp_id"), F.concat("l_returnflag", "l_linestatus", "l_linenumber").alias("rule"),
            (F.col("l_tax") - 0.04).alias("weight"))

    def vectors(self) -> DataFrame:
        return self.embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")

"""Drift checks of a new raw snapshot against the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def snapshot_stats(df: DataFrame, start: str, since: str) -> DataFrame:
    recent = F.count_if(F.col(start) > F.lit(since).cast("timestamp"))
    return df.agg(F.count("*").alias("n_rows"), recent.alias("recent")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def snapshot_checks(df: DataFrame, start: str, since: str, previous: DataFrame) -> DataFrame:
    """One row: new statistics, and whether there are no recent rows, fewer rows, fewer columns.

    ``previous`` is the statistics row of the last snapshot (n_rows, n_cols).
    """
    old = previous.select(F.struct("n_rows", "n_cols"))
    stats = snapshot_stats(df, start, since).withColumn("_old", old.scalar())
    return stats.select("n_rows", "n_cols", "recent", (F.col("recent") == 0).alias("no_recent"),
                        (F.col("n_rows") < F.col("_old.n_rows")).alias("fewer_rows"),
                        (F.col("n_cols") < F.col("_old.n_cols")).alias("fewer_cols"))


def messages(checks: DataFrame) -> DataFrame:
    """The checks that failed, as text."""
    texts = F.array_compact(F.array(
        F.when(F.col("no_recent"), "no record started within the last week"),
        F.when(F.col("fewer_rows"), F.concat(F.lit("fewer rows than last time: "), F.col("n_rows").cast("string"))),
        F.when(F.col("fewer_cols"), F.concat(F.lit("fewer columns than last time: "), F.col("n_cols").cast("string")))))
    return checks.select(F.explode(texts).alias("message"))


def save_stats(checks: DataFrame, path: str) -> None:
    checks.select("n_rows", "n_cols").coalesce(1).write.mode("overwrite").parquet(path)


def load_stats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)

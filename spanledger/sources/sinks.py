"""Sinks: datasets, appended runs, JSON results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def write_csv(df: DataFrame, path: str, encoding: str = "ISO-8859-1") -> None:
    """One CSV file per task, header in each, times to the second."""
    (df.write.mode("overwrite").option("header", True).option("encoding", encoding)
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def write_dataset(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Parquet, laid out by anchor date when given, so that date splits prune whole folders.

    Rows of a date stay spread over all tasks: a date is not sent to a single writer.
    """
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def append_run(df: DataFrame, path: str, stamp: str) -> None:
    """Adds a run with its time stamp; earlier runs are not read or rewritten."""
    df.select(F.lit(stamp).cast("timestamp").alias("Timestamp"), "*").write.mode("append").parquet(path)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """All appended runs; columns a run did not have are null."""
    return spark.read.option("mergeSchema", True).parquet(path)


def without_commas(c: Column) -> Column:
    return F.regexp_replace(c, ",", "")


def json_rows(df: DataFrame) -> DataFrame:
    """One JSON object per row, commas removed from its texts."""
    cols = [without_commas(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
            for f in df.schema.fields]
    return df.select(F.to_json(F.struct(*cols)).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    json_rows(df).write.mode("overwrite").text(path)


def write_documents(df: DataFrame, path: str, root: str, number: Column, encoding: str = "UTF-16") -> None:
    """One JSON document per ``number``, in a folder of its own, with its rows in array ``root``; a document must fit one task."""
    docs = df.groupBy(number.alias("document")).agg(F.collect_list(F.struct(*df.columns)).alias(root))
    docs.write.mode("overwrite").partitionBy("document").option("encoding", encoding).option("lineSep", "\n").json(path)

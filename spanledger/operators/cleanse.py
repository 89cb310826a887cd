"""Row-local cleansing of the episode table. All narrow: no shuffle anywhere in this module."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from spanledger.functions.exprs import YEAR_DAYS, fill_null, secs


def exclude_clients(df: DataFrame, ids: Iterable[int] | DataFrame) -> DataFrame:
    """Rows of clients not on the list: a literal list of ids, or a table with ``ClientID``."""
    if isinstance(ids, DataFrame):
        return df.join(ids.select("ClientID").distinct(), "ClientID", "left_anti")
    ids = list(ids)
    return df.where(F.col("ClientID").isNull() | ~F.col("ClientID").isin(ids)) if ids else df


def exclude_declined(df: DataFrame, column: str = "ConsentType", word: str = "Declined") -> DataFrame:
    """Rows without a declined consent; an unknown consent is kept."""
    return df.where(~F.coalesce(F.col(column).contains(word), F.lit(False)))


def drop_features(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


def flag_present(df: DataFrame, source: str, flag: str) -> DataFrame:
    """Y/N flag from whether ``source`` is filled."""
    return df.withColumn(flag, F.when(F.col(source).isNotNull(), "Y").otherwise("N"))


def close_open_intervals(df: DataFrame, run_ts: str) -> DataFrame:
    return df.withColumn("DateEnd", F.coalesce("DateEnd", F.lit(run_ts).cast("timestamp")))


def is_time_name(name: str) -> bool:
    """The naming rule by which a column holds times."""
    return "Date" in name or "Start" in name or "End" in name or name == "DOB"


def coerce_timestamps(df: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Columns with a time-like name become timestamps, unreadable values null; ``keep`` is left alone."""
    def fix(f: T.StructField) -> Column:
        if not is_time_name(f.name) or f.name in keep or isinstance(f.dataType, T.TimestampType):
            return F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            return F.try_to_timestamp(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DateType, T.TimestampNTZType)):
            return F.col(f.name).cast("timestamp").alias(f.name)
        return F.lit(None).cast("timestamp").alias(f.name)

    return df.select(*[fix(f) for f in df.schema.fields])


def age_at(dob: Column, when: Column) -> Column:
    """Whole years between birth and ``when``."""
    return F.floor((secs(when) - secs(dob)) / (YEAR_DAYS * 86_400))


def asof_cut(df: DataFrame, when: str) -> DataFrame:
    """History as known at ``when``: later starts go, ends are clipped, the age is taken then."""
    t = F.lit(when).cast("timestamp")
    out = (df.where(F.col("DateStart") <= t)
           .withColumn("DateEnd", F.when(F.col("DateEnd") > t, t).otherwise(F.col("DateEnd"))))
    return out.withColumn("CurrentAge", age_at(F.col("DOB"), t)) if "DOB" in df.columns else out


def fill_policy(df: DataFrame, multi: Iterable[str] = (), single: Iterable[str] = (),
                numeric: Iterable[str] = (), zero: Iterable[str] = ()) -> DataFrame:
    values: dict = {c: "None" for c in multi}
    values |= {c: "Unknown" for c in single}
    values |= {c: -1 for c in numeric}
    values |= {c: 0 for c in zero}
    return fill_null(df, {k: v for k, v in values.items() if k in df.columns})


def parse_amounts(df: DataFrame, *columns: str) -> DataFrame:
    """Text amounts to double; what does not parse becomes null."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})

"""Column helpers: seconds, days, portable hashing, vector arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from spanledger.config import DAY

# Fixed value: mean Gregorian year used for ages, in days.
YEAR_DAYS = 365.2425


def col(name: str) -> Column:
    """Column by its exact name; category values in names may hold dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def fill_null(df: DataFrame, values: dict) -> DataFrame:
    """Nulls of the named columns replaced; types stay."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[F.coalesce(col(c), F.lit(values[c]).cast(types[c])).alias(c) if c in values else col(c) for c in df.columns])


def secs(c: Column | str) -> Column:
    """Whole epoch seconds of a timestamp, date or parsable string; null when it cannot be read."""
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_seconds(c.cast("timestamp"))


def ts_lit(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def secs_lit(text: str) -> Column:
    return F.unix_seconds(ts_lit(text))


def day(c: Column) -> Column:
    """UTC day number of an epoch second."""
    return F.call_function("div", c - F.pmod(c, F.lit(DAY)), F.lit(DAY).cast("long"))


def span_days(start: Column, end: Column, last_end: Column) -> Column:
    """Days from start to end, plus one unless the span resumes on the day the last one ended.

    ``last_end`` null stands for the epoch, the state before the first span.
    """
    fresh = day(start) != day(F.coalesce(last_end, F.lit(0)))
    return day(end) - day(start) + F.when(fresh, 1).otherwise(0)


def int_div(a: Column, b: int) -> Column:
    return F.call_function("div", a.cast("long"), F.lit(b).cast("long"))


def ceil_div(a: Column, b: int) -> Column:
    """Integer ceiling of a / b for b > 0, exact for negative a as well."""
    b_ = F.lit(b).cast("long")
    return F.call_function("div", a + F.pmod(-a, b_), b_)


def mix(c: Column, seed: int) -> Column:
    """Deterministic spread of a non-negative id over 0..2^31-2, plain arithmetic so that any SQL
    engine reproduces it. Rounds of a multiplicative congruential step with a square in between."""
    p = 2_147_483_647
    x = (F.pmod(c.cast("long"), F.lit(1_000_003)) * 7_919
         + int_div(c, 1_000_003) % 1_000_000_007 * 104_729 + (seed % 1_000_003) * 15_485_863)
    x = F.pmod(x, F.lit(p))
    x = F.pmod(x * 48_271 + 11, F.lit(p))
    x = F.pmod(x * F.pmod(x, F.lit(65_537)) + 12_345, F.lit(p))
    return F.pmod(x * 69_621 + 7, F.lit(p)).cast("long")


def sq_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two double arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)

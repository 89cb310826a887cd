"""Overlap-aware spans: which records count, and from where.

Records of one (client, service) are read in order of start, the longest first among equal starts.
A record counts only if it ends after everything counted before it; its counted part starts where
the last counted one ended. Two facts make this a set computation rather than a loop:

* Without a minimum length, the last counted end is the running maximum of earlier ends, so a
  record counts exactly when its end is a new maximum.
* With a minimum length (stays under 15 minutes are passed over), records that are no new maximum
  of the long-enough records can never count, and on the remaining ones ends rise with starts. What
  counts is then a thinning of a rising list of ends: take the first, and after ``x`` the first end
  at or after ``x + 900``. A day can be summarised without knowing where the thinning enters
  it, because it can only enter through ends of that day's first 15 minutes or the one that follows.

All rows are in whole epoch seconds (the precision of the export).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from spanledger.config import DAY, MIN_STAY_SECONDS
from spanledger.functions.exprs import day, secs
from spanledger.functions.ordered import BUCKET, bucket_of, prior_max


def intervals(episodes: DataFrame, *extra: str) -> DataFrame:
    """Narrow view of the episode table: client, service, start ``s`` and end ``e`` in seconds."""
    return (episodes.select(F.col("ClientID").alias("client"), F.col("ServiceType").alias("service"),
                            secs("DateStart").alias("s"), secs("DateEnd").alias("e"), *extra)
            .where(F.col("s").isNotNull() & F.col("e").isNotNull()))


def record_spans(rows: DataFrame, keys: list[str], min_seconds: int = 0,
                 bucket_seconds: int | None = BUCKET) -> DataFrame:
    """Rows whose end is a new maximum, with ``last`` = that earlier maximum (null before the first).

    Equal starts are first collapsed to the longest, with map-side combining, which bounds every
    later group by the number of seconds in it. Starts and ends at or before the epoch never count.
    """
    rows = rows.where((F.col("s") > 0) & (F.col("e") > 0))
    if min_seconds:
        rows = rows.where(F.col("e") - F.col("s") >= min_seconds)
    one = rows.groupBy(*keys, "s").agg(F.max("e").alias("e"))
    return (prior_max(one, keys, "s", "e", "last", bucket_seconds, raw=rows)
            .where(F.col("last").isNull() | (F.col("e") > F.col("last"))))


def _next(last, gap):
    """Fold step: jump to the end ``p`` if it lies at least ``gap`` after the last counted end."""
    return lambda p: F.when(last.isNull() | (p >= last + gap), p).otherwise(last)


def thin_spans(records: DataFrame, keys: list[str], gap: int = MIN_STAY_SECONDS,
               bucketed: bool = True) -> DataFrame:
    """Of record spans (ends rising with starts), those that count when each must add ``gap`` seconds.

    Output: keys, s, e and ``last``, the end counted before it (null for the first).
    Arrays hold one day of one key, at most 86,400 points whatever the data; the per-key step holds
    one entry list per day.
    """
    pts = F.sort_array(F.collect_list(F.struct("e", "s")))

    def selected(start):
        """Counted spans of a day, given the end counted last before it."""
        zero = F.struct(start.cast("long").alias("last"),
                        F.array().cast("array<struct<s:bigint,e:bigint,last:bigint>>").alias("out"))
        return F.aggregate(
            "pts", zero,
            lambda acc, p: F.when(
                acc["last"].isNull() | (p["e"] >= acc["last"] + gap),
                F.struct(p["e"].alias("last"),
                         F.concat(acc["out"], F.array(F.struct(p["s"].alias("s"), p["e"].alias("e"),
                                                               acc["last"].alias("last")))).alias("out")),
            ).otherwise(acc),
            lambda acc: acc["out"])

    if not bucketed:
        days = records.groupBy(*keys).agg(pts.alias("pts"))
        return days.select(*keys, F.inline(selected(F.lit(None))))

    days = (records.withColumn("_b", day(F.col("e"))).groupBy(*keys, "_b").agg(pts.alias("pts")))
    # Entry points of a day: ends within ``gap`` of its first, and the first one beyond.
    head = F.filter("pts", lambda p, i: (i == 0) | (F.get("pts", i - 1)["e"] < F.get("pts", F.lit(0))["e"] + gap))
    # Where the thinning leaves the day, for each entry point.
    lanes = F.aggregate(
        "pts", F.transform("head", lambda p: p["e"]),
        lambda acc, p: F.transform(acc, lambda x: F.when(p["e"] >= x + gap, p["e"]).otherwise(x)))
    summary = (days.withColumn("head", head)
               .select(*keys, "_b", F.arrays_zip(F.transform("head", lambda p: p["e"]).alias("entry"),
                                                 lanes.alias("leave")).alias("moves")))
    # Per key: walk its days in order and note the end counted last before each day.
    per_key = summary.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_b", "moves"))).alias("days"))

    def leave(d, last):
        hit = F.filter(d["moves"], lambda m: last.isNull() | (m["entry"] >= last + gap))
        return F.coalesce(F.get(hit, F.lit(0))["leave"], last)

    walk = F.aggregate(
        "days",
        F.struct(F.lit(None).cast("long").alias("last"),
                 F.array().cast("array<struct<_b:bigint,before:bigint>>").alias("out")),
        lambda acc, d: F.struct(leave(d, acc["last"]).alias("last"),
                                F.concat(acc["out"], F.array(F.struct(d["_b"].alias("_b"),
                                                                      acc["last"].alias("before")))).alias("out")),
        lambda acc: acc["out"])
    enter = per_key.select(*keys, F.inline(walk))
    return (days.join(enter, [*keys, "_b"])
            .select(*keys, F.inline(selected(F.col("before")))))

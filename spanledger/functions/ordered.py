"""Ordered work on keys that may be very hot.

A window partitioned by a client puts all of that client's rows in one task. Everything here works
in two levels instead: rows are split by (key, time bucket), each bucket is summarised with a
map-side combined aggregate, only the summaries are ordered per key, and what earlier buckets
contribute is joined back. A key with a third of all rows is then spread over its buckets, and the
per-key step sees one row per bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.config import DAY
from spanledger.functions.exprs import int_div, mix, total
from spanledger.session import cut_lineage

BUCKET = 30 * DAY


def bucket_of(c: Column, seconds: int = BUCKET) -> Column:
    return int_div(c - F.pmod(c, F.lit(seconds)), seconds)


def _carry(df: DataFrame, keys: list[str], summary: Column, combine, name: str) -> DataFrame:
    """Per (keys, _b): ``combine`` of ``summary`` over all earlier buckets of the keys."""
    w = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    return (df.groupBy(*keys, "_b").agg(summary.alias("_s"))
            .select(*keys, "_b", combine(F.col("_s")).over(w).alias(name)))


def prior_max(df: DataFrame, keys: list[str], order: str, value: str, out: str,
              bucket_seconds: int | None = BUCKET, raw: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the largest ``value`` among rows of the keys with a smaller ``order``.

    ``order`` must be unique per key and in epoch seconds, so a bucket holds at most
    ``bucket_seconds`` rows whatever the size of the key. ``bucket_seconds=None`` is for keys that
    are bounded in time already. ``raw`` are the rows ``df`` was collapsed from: the bucket summaries
    are the same over them, and taken map-side before any shuffle.
    """
    if bucket_seconds is None:
        w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return df.withColumn(out, F.max(value).over(w))
    bucket = bucket_of(F.col(order), bucket_seconds)
    rows = df.withColumn("_b", bucket)
    carry = _carry(rows if raw is None else raw.withColumn("_b", bucket), keys, F.max(value), F.max, "_c")
    w = W.partitionBy(*keys, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return (rows.join(carry, [*keys, "_b"])
            .withColumn(out, F.greatest(F.max(value).over(w), "_c")).drop("_b", "_c"))


def prior_row(df: DataFrame, keys: list[str], order: list[str], time: str, out: str,
              bucket_seconds: int = DAY, raw: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: struct of the ``order`` columns of the previous row of the keys (a two-level lag).

    ``time`` is the leading order column, in epoch seconds. ``raw`` as in ``prior_max``.
    """
    extra = {"_b": bucket_of(F.col(time), bucket_seconds), "_o": F.struct(*order)}
    rows = df.withColumns(extra)
    carry = _carry(rows if raw is None else raw.withColumns(extra), keys, F.max("_o"), F.max, "_c")
    w = W.partitionBy(*keys, "_b").orderBy("_o")
    return (rows.join(carry, [*keys, "_b"])
            .withColumn(out, F.coalesce(F.lag("_o").over(w), "_c")).drop("_b", "_c", "_o"))


def slice_count(df: DataFrame) -> int:
    """As many slices as the session has shuffle partitions, within what the quantile sketch resolves."""
    return max(16, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _slice(value: Column, cuts: Column, steps: int) -> Column:
    """Number of cuts below the value, found in two short scans: every ``steps``-th cut, then between."""
    coarse = F.size(F.filter(cuts["coarse"], lambda x: x < value))
    fine = F.slice(cuts["fine"], coarse * steps + 1, steps)
    return coarse * steps + F.size(F.filter(fine, lambda x: x < value))


def running_sums(df: DataFrame, order: str, sums: list[str], within: list[str] | None = None, slices: int | None = None,
                 descending: bool = False) -> DataFrame:
    """Adds ``cum_<c>`` for each column of ``sums``: inclusive running sum over the table, or per group.

    ``order`` must be unique within a group and not null. It is cut into slices of about equal row
    count by approximate quantiles, so no single task sees the table and no value range can be hot.
    There must be few groups (features, say): a group has ``slices`` summary rows, which are broadcast.
    """
    within, slices = within or [], slices or slice_count(df)
    steps = math.isqrt(slices) + 1
    points = F.percentile_approx(order, [i / slices for i in range(1, slices)], 10_000)
    cuts = F.struct(F.filter(points, lambda x, i: (i + 1) % steps == 0).alias("coarse"), points.alias("fine"))
    if within:
        rows = df.join(F.broadcast(df.groupBy(*within).agg(cuts.alias("_q"))), within)
    else:
        rows = df.withColumn("_q", df.agg(cuts).scalar())
    below = _slice(F.col(order), F.col("_q"), steps)
    rows = rows.withColumn("_b", -below if descending else below).drop("_q")
    first = F.desc(order) if descending else F.asc(order)
    before = W.partitionBy(*(within or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*within, "_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(sums)])
    carry = totals.select(*within, "_b", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_c{i}")
                                           for i in range(len(sums))])
    w = W.partitionBy(*within, "_b").orderBy(first).rowsBetween(W.unboundedPreceding, 0)
    cums = {f"cum_{c}": F.sum(c).over(w) + F.col(f"_c{i}") for i, c in enumerate(sums)}
    return rows.join(F.broadcast(carry), [*within, "_b"]).withColumns(cums).drop("_b", *[f"_c{i}" for i in range(len(sums))])


def exact_quantiles(counts: DataFrame, group: str, value: str, n: str, at: list[float]) -> DataFrame:
    """(group, p, q): exact quantiles with linear interpolation, from distinct values and their counts."""
    ranked = running_sums(counts, value, [n], within=[group])
    totals = F.broadcast(counts.groupBy(group).agg(F.sum(n).alias("_n")))
    points = F.explode(F.array(*[F.lit(float(p)) for p in at]))
    target = totals.withColumn("p", points).withColumn("_x", F.col("p") * (F.col("_n") - 1))
    lo, hi = F.floor("_x"), F.ceil("_x")
    first = F.col(f"cum_{n}") - F.col(n)
    has = lambda i: (first <= i) & (i < F.col(f"cum_{n}"))
    return (ranked.join(F.broadcast(target), group).where(has(lo) | has(hi))
            .groupBy(group, "p", "_x")
            .agg(F.max(F.when(has(lo), F.col(value))).alias("_lo"), F.max(F.when(has(hi), F.col(value))).alias("_hi"))
            .select(group, "p", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_x") - F.floor("_x"))).alias("q")))


#: Counts of parts that are sent out rather than joined by a shuffle.
MOST_COUNTS = 200_000


def range_rank(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Adds ``out``: 1-based rank of the row within its group, by ``order``.

    Rows are parted by ranges of (group, order), so a hot group lies in as many parts as it fills; a
    rank is the place in the part and what earlier parts hold of the group, one count per part and group. The
    table is stored in that order. A group lies in neighbouring parts, so there are fewer counts than parts and groups
    together; they are sent out, and the rows are not moved again, unless there are more than ``MOST_COUNTS``.
    """
    rows = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn("_part", F.shiftright("_at", 33)))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = cut_lineage(rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
                         .select(group, "_part", (F.col("_first") - F.coalesce(F.sum("_n").over(before), F.lit(0)) - 1).alias("_first")))
    few = starts.count() <= MOST_COUNTS
    return rows.join(F.broadcast(starts) if few else starts, [group, "_part"]).withColumn(out, F.col("_at") - F.col("_first")).drop("_at", "_part", "_first")


#: Rows of one hash range that are looked at one by one.
FEW_ROWS = 10_000


def rank_cuts(df: DataFrame, key: str, seed: int, ranks, slices: int = 4096) -> tuple[int, list[tuple[int, int] | None]]:
    """Row count, and for each function of it in ``ranks`` the (hash, id) of the row with that 1-based rank in hash order.

    None stands for a rank below 1; ranks beyond the end are the last row's. Rows are counted per hash range, then
    only the ranges with a wanted rank are divided further, until they hold few rows. So a rank is compared with, not
    carried by, the rows: whoever asks on which side of a cut a row lies needs no exchange. Ids are unique; rows that
    repeat one lie on the same side.
    """
    hashed = df.select(F.col(key).cast("long").alias("k"), mix(F.col(key), seed).alias("h"))

    def between(lo: int, hi: int) -> list[Column]:
        """1 and 0 if the hash lies in the range. A sum of these, unlike OR, reads the hash unconditionally, so it is worked out once a
        row. A filter would not share it either: rows outside are one group, which is dropped after counting."""
        return [(F.col("h") >= lo).cast("int"), -(F.col("h") >= hi).cast("int")]

    def counts(ranges: list[tuple[int, int]]) -> dict[tuple[int, int], dict[int, int]]:
        inside = [F.when(total(between(lo, lo + slices * w)) == 1, F.struct(F.lit(i).alias("i"), int_div(F.col("h") - lo, w).alias("b"))) for i, (lo, w) in enumerate(ranges)]
        out: dict = {r: {} for r in ranges}
        for r in hashed.groupBy(F.coalesce(*inside).alias("at")).agg(F.count("*").alias("n")).collect():
            if r["at"] is not None:
                out[ranges[r["at"]["i"]]][r["at"]["b"]] = r["n"]
        return out

    top = (0, -(-2_147_483_647 // slices))
    level = {top: counts([top])[top]}
    n = sum(level[top].values())
    wanted = [min(int(r(n) if callable(r) else r), n) for r in ranks]
    # Of each rank: the range it is in, and the rows before that range.
    open_, cuts = {r: (top, 0) for r in wanted if r > 0}, {}
    while open_:
        few: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for r, (where, before) in list(open_.items()):
            lo, w = where
            for b in sorted(level[where]):
                if before + level[where][b] >= r:
                    break
                before += level[where][b]
            if level[where][b] <= FEW_ROWS or w == 1:
                few.setdefault((lo + b * w, w), []).append((r, before))
                del open_[r]
            else:
                open_[r] = ((lo + b * w, -(-w // slices)), before)
        if few:
            here = total([c for lo, w in few for c in between(lo, lo + w)]) > 0
            found = hashed.groupBy(F.when(here, F.struct("h", "k")).alias("at")).agg(F.count("*").alias("n")).collect()
            rows = sorted((r["at"]["h"], r["at"]["k"], r["n"]) for r in found if r["at"] is not None)
            for (lo, w), asked in few.items():
                own = [x for x in rows if lo <= x[0] < lo + w]
                for r, before in asked:
                    for h, k, m in own:
                        before += m
                        if before >= r:
                            cuts[r] = (h, k)
                            break
        fresh = list({where for where, _ in open_.values()})
        level = counts(fresh) if fresh else {}
    return n, [cuts.get(r) for r in wanted]


def up_to(key: str, seed: int, cut: tuple[int, int] | None) -> Column:
    """Whether a row's rank is at most that of the cut."""
    if cut is None:
        return F.lit(False)
    h = mix(F.col(key), seed)
    return (h < cut[0]) | ((h == cut[0]) & (F.col(key).cast("long") <= cut[1]))


def hash_rank(df: DataFrame, key: str, seed: int, out: str, within: list[str] | None = None,
              slices: int = 1024, size: str | None = None) -> DataFrame:
    """Adds ``out``: 1-based rank of the row in hash order of a unique id, per ``within`` group, and
    the group's row count as ``size`` if named.

    Hash ranges are the buckets, so a hot group is spread evenly over ``slices`` tasks and the
    per-group step sees at most ``slices`` rows.
    """
    within = within or []
    width = -(-2_147_483_647 // slices)
    rows = df.withColumn("_h", mix(F.col(key), seed)).withColumn("_b", int_div(F.col("_h"), width))
    before = W.partitionBy(*(within or [F.lit(0)])).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*(within or [F.lit(0)]))
    counts = [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c")]
    counts += [F.sum("_n").over(whole).alias(size)] if size else []
    carry = rows.groupBy(*within, "_b").agg(F.count("*").alias("_n")).select(*within, "_b", *counts)
    w = W.partitionBy(*within, "_b").orderBy("_h", key)
    return (rows.join(carry, [*within, "_b"])
            .withColumn(out, F.row_number().over(w) + F.col("_c")).drop("_h", "_b", "_c"))

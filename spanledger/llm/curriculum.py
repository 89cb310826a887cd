"""Mixing sources to target weights by a time-varying curriculum.

Every source has a schedule: its weight as a line through points in time from 0 (start of the training) to 1 (end). The integral of the schedule is the
source's part of the mix. A source's demand for words grows with the integral of its schedule; documents stand one after the other in hash order, so
the time at which the demand reaches a document is its place in the training. Documents sorted by that time are the mix: whatever part of it is read,
the sources have the weights that their schedules have there. All is done with DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import cut_lineage, fresh_names

#: Rows of a source that are ordered in one task at most, on average.
BUCKET_ROWS = 4_096
#: Bits of the order hash that name a bucket at most.
MOST_BITS = 32
#: Sources whose facts are sent to all tasks; more are joined.
SENT_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"

Schedule = Sequence[tuple[float, float]]


def integral(schedule: Schedule) -> float:
    """Area below the line through the points (time, weight)."""
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:]))


def check_schedule(schedule: Schedule) -> None:
    times = [t for t, _ in schedule]
    if len(schedule) < 2 or times[0] != 0 or times[-1] != 1 or any(a >= b for a, b in zip(times, times[1:])):
        raise ValueError("a schedule has rising times from 0 to 1")
    if min(w for _, w in schedule) < 0 or integral(schedule) <= 0:
        raise ValueError("weights are not negative, and not all are zero")


def time_of(schedules: Sequence[Schedule], kind: str, part: str) -> str:
    """SQL of the time at which a source of ``kind`` (its place among the schedules) has met ``part`` (0 to 1) of its demand.

    Inside a stretch the integral is a square, whose root is taken in the form that does not cancel."""
    cases = []
    for k, schedule in enumerate(schedules):
        whole, before, steps = integral(schedule), 0.0, []
        for a, b in zip(schedule, schedule[1:]):
            width = b[0] - a[0]
            start, slope, area = a[1] / whole, (b[1] - a[1]) / whole / width, width * (a[1] + b[1]) / 2 / whole
            rest = f"({part} - {before!r}D)" if before else part
            steps.append((before + area, f"{a[0]!r}D + CASE WHEN {rest} <= 0 THEN 0D ELSE 2 * {rest} / ({start!r}D + sqrt(greatest(0D, {start * start!r}D + {2 * slope!r}D * {rest}))) END"))
            before += area
        inner = "".join(f"WHEN {part} < {edge!r}D THEN {text} " for edge, text in steps[:-1])
        cases.append(f"WHEN {k} THEN " + (f"CASE {inner}ELSE {steps[-1][1]} END" if inner else steps[-1][1]))
    return f"CASE {kind} {' '.join(cases)} END"


def ranked(df: DataFrame, order: list[Column], out: str = "place") -> DataFrame:
    """Adds the place of every row from 0 in the given order. Rows are parted by ranges; only one count per part is carried over."""
    at, part, ahead = fresh_names(df, "at", "part", "ahead")
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    rows = cut_lineage(rows.withColumn(part, F.expr(f"shiftright({at}, 33)")))
    before = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(part).agg(F.count("*").alias("n")).select(part, before.alias(ahead))  # one row per task
    return rows.join(F.broadcast(counts), part).withColumn(out, F.col(ahead) + F.col(at).bitwiseAND((1 << 33) - 1)).drop(at, part, ahead)


def fill_level(sources: DataFrame, total: float, most: float, words: str = "words", weight: str = "weight") -> float:
    """Words for a weight of one, so that the sources' level * weight, stopped at ``most`` times their words, make up ``total``.

    Each round gives what stopped sources leave to the others, until none more stops; only two sums are collected."""
    capped, level = -1, 0.0
    while True:
        over = F.col(words) * most < F.lit(level) * F.col(weight)
        r = sources.agg(F.count_if(over), F.sum(F.when(over, F.col(words) * most)), F.sum(F.when(~over, F.col(weight)))).first()
        if r[0] == capped or not r[2]:
            return level
        capped, level = r[0], (total - (r[1] or 0.0)) / r[2]


def curriculum(docs: DataFrame, schedules: Sequence[Schedule], share: float = 1.5, most: int = 2, key: str = "doc_id", source: str = "source",
               text: str = "text") -> DataFrame:
    """One row per row of ``docs``, sorted by ranges of the time of its first visit: key, source, size, source_size, target, taken, positions.

    Sources by code point, null last, have the schedules in turn. Their targets are in proportion to the schedules' integrals and make up ``share`` of all
    words, but none is above ``most`` times its source's words. ``taken``: words that all visits to the document take; a source's documents take
    its target (to the next whole word) exactly, so the last one is cut. ``positions``: the time of each visit, empty if there is none; visits come before
    a source's documents have all had one less. Null text has no words, is not visited, and has its row; so has empty text. Equal rows (key and text) of a
    source share their words alike: at the edge of the target less than a word per copy can be left. An empty table gives no rows. Of texts of any
    length only the word count and a hash go on. Columns of other names are not looked at."""
    for s in schedules:
        check_schedule(s)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("k"), F.col(source).cast("string").alias("src"), F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"),
                       F.regexp_count(whole, F.lit(WORD)).cast("long").alias("size"),
                       F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(":"), whole).cast("binary")).alias("h"))
    rows = cut_lineage(rows)
    own = ["none", "name"]
    sources = ranked(rows.groupBy(*own).agg(F.sum("size").alias("words"), F.count("*").alias("n_rows")), [F.col("none"), F.col("name")])
    weights = F.array(*[F.lit(float(integral(s))) for s in schedules])
    kind = F.pmod("place", F.lit(len(schedules))).cast("int")
    sources = cut_lineage(sources.select(*own, "words", "n_rows", kind.alias("kind"), F.get(weights, kind).alias("weight")))
    n_sources, words = sources.agg(F.count("*"), F.sum("words")).first()
    total = share * (words or 0)
    level = fill_level(sources, total, most)
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_rows") / BUCKET_ROWS)))).cast("int")
    sources = sources.select(*own, "words", "kind", bits.alias("bits"), F.least(F.lit(level) * F.col("weight"), F.col("words") * F.lit(float(most))).alias("target"))
    # Equal rows are one group from here on, so no group of copies is met in one task.
    groups = rows.groupBy(*own, "h").agg(F.max("size").alias("size"), F.count("*").alias("n")).join(F.broadcast(sources) if n_sources <= SENT_SOURCES else sources, own)
    groups = groups.withColumn("bucket", F.expr(f"shiftright(cast(conv(substr(h, 1, {MOST_BITS // 4}), 16, 10) AS long), {MOST_BITS} - bits)")).repartition(*own, "bucket")
    earlier = Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = groups.groupBy(*own, "bucket").agg(F.sum(F.col("n") * F.col("size")).alias("s"))
    ahead = sums.select(*own, "bucket", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("ahead"))
    inside = F.sum(F.col("n") * F.col("size")).over(Window.partitionBy(*own, "bucket").orderBy("h").rowsBetween(Window.unboundedPreceding, 0))
    groups = groups.withColumn("inside", inside - F.col("n") * F.col("size")).join(ahead.repartition(*own, "bucket"), [*own, "bucket"])  # else the join deals all rows by source, as the sums are
    begin, goal = F.col("ahead") + F.col("inside"), F.floor(F.col("target") + 0.5)
    first = [begin + F.col("words") * p for p in range(most)]
    part = [F.expr("x div n") for _ in first]
    visits = F.array(*[F.struct(F.greatest(F.lit(0), F.least(goal - a, F.col("n") * F.col("size"))).alias("x"), a.alias("a")) for a in first])
    groups = groups.select(*own, "h", F.col("words").alias("source_size"), "target", "kind", "n", goal.alias("goal"), F.inline(visits))
    groups = groups.select(*own, "h", "source_size", "target", part[0].alias("words"), F.when(F.expr("x div n > 0"), F.expr(time_of(schedules, "kind", "(a / goal)"))).alias("time"))
    groups = groups.groupBy(*own, "h").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("words").alias("taken"),
                                           F.array_sort(F.collect_list("time")).alias("positions"))  # at most ``most`` times
    out = rows.join(groups, [*own, "h"])
    # The hash and the row's own number part rows that are never visited, and copies.
    order = [F.get("positions", F.lit(0)).asc_nulls_last(), F.col("h"), F.monotonically_increasing_id()]
    return out.orderBy(*order).select(F.col("k").alias(key), F.col("src").alias(source), "size", "source_size", "target", "taken", "positions")


def training_order(mixed: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per visit in the order of the training: key, source, visit (from 0), position; sorted by ranges of the position."""
    rest = [c for c in mixed.columns if c not in ("positions", "taken", "target", "source_size")]
    return mixed.select(*rest, F.posexplode("positions").alias("visit", "position")).orderBy("position", key, "visit")

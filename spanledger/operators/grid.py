"""All anchor dates as one job.

An anchor grid is a row of equally spaced cut-off dates. Cutting the history at each of them and
recomputing would multiply the records by the number of anchors. Instead each counted span is
placed once, at the first cut-off that covers it whole; totals at a cut-off are then a running sum
over a client's anchor rows. Only the one span that straddles a cut-off needs its own clipped value
there, and a client has at most one such span per cut-off and service.

So the record side is row-local up to a map-side combined aggregate, and what is ordered per client
is one row per anchor.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.config import DAY, MIN_STAY_SECONDS, Settings
from spanledger.functions.exprs import ceil_div, day, int_div, span_days
from spanledger.functions.ordered import prior_row
from spanledger.operators.spans import record_spans, thin_spans


@dataclass(frozen=True)
class Grid:
    """Cut-offs ``first + k*step`` for k in 0..n-1, all in epoch seconds."""

    first: int
    step: int
    n: int
    horizon: int = 0
    # Seconds before the cut-off at which features close: 1 for series, 0 for a static cut.
    close: int = 0

    @staticmethod
    def ending(label_date: str, n: int, step_days: int, horizon_days: int, close: int = 1) -> "Grid":
        end = datetime.fromisoformat(label_date).replace(tzinfo=timezone.utc)
        first = end - timedelta(days=horizon_days + step_days * (n - 1))
        return Grid(int(first.timestamp()), step_days * DAY, n, horizon_days * DAY, close)

    @staticmethod
    def series(cfg: Settings, training: bool = True) -> "Grid":
        n = cfg.anchors_for_training() if training else cfg.series.t_x
        return Grid.ending(cfg.label_date, n, cfg.series.step_days, cfg.horizon_days if training else 0)

    @staticmethod
    def static(cfg: Settings) -> "Grid":
        return Grid.ending(cfg.label_date, 1, 1, cfg.horizon_days, close=0)

    def origin(self) -> Column:
        """The first cut-off of a row's client."""
        return F.lit(self.first)

    def spread(self, rows: DataFrame) -> DataFrame:
        """Rows as the grid's clients see them."""
        return rows

    def cutoff(self, k: Column) -> Column:
        return k.cast("long") * self.step + self.origin()

    def slot(self, t: Column, lag: int = 0) -> Column:
        """First k whose cut-off, less ``lag`` seconds, is at or after ``t``; n or more means none."""
        return F.greatest(F.lit(0), ceil_div(t + lag - self.origin(), self.step)).cast("int")

    def covering(self, t: Column) -> Column:
        """First k whose features can see time ``t``."""
        return self.slot(t, self.close)

    def date(self, k: Column) -> Column:
        return F.to_date(F.timestamp_seconds(self.cutoff(k)))


@dataclass(frozen=True)
class HorizonGrid(Grid):
    """The same label dates seen from several horizons, whose cut-offs lie that long before them.

    A client is known once for each horizon, under the number ``client * horizons + i``. What does not
    depend on cut-offs (which spans and visits count) is worked out per client and only then spread, so the
    records are read and ordered once however many horizons there are.
    """

    horizons: tuple[int, ...] = ()

    @staticmethod
    def of(base: Grid, horizon_days: tuple[int, ...]) -> "HorizonGrid":
        """``base`` has horizon 0."""
        return HorizonGrid(base.first, base.step, base.n, 0, base.close, tuple(d * DAY for d in horizon_days))

    def horizon_of(self, client: str = "client") -> Column:
        return F.pmod(F.col(client), F.lit(len(self.horizons))).cast("int")

    def client_of(self, client: str = "client") -> Column:
        """The client's own number; also right for negative ones."""
        return int_div(F.col(client) - self.horizon_of(client), len(self.horizons))

    def origin(self) -> Column:
        return F.lit(self.first) - F.get(F.array(*[F.lit(h) for h in self.horizons]), self.horizon_of())

    def spread(self, rows: DataFrame) -> DataFrame:
        h = F.explode(F.array(*[F.lit(i) for i in range(len(self.horizons))]))
        return rows.withColumn("_h", h).withColumn("client", F.col("client").cast("long") * len(self.horizons) + F.col("_h")).drop("_h")


def _range(lo: Column, hi: Column) -> Column:
    """Integers lo..hi, empty when hi < lo (``sequence`` would count down)."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


# --- counted spans -------------------------------------------------------------------------------

def timed_spans(rows: DataFrame, cfg: Settings) -> DataFrame:
    """Counted spans of every timed service: client, service, s, e, last."""
    keys = ["client", "service"]
    stay = F.col("service") == cfg.stay_service
    others = [s for s in cfg.timed_services if s != cfg.stay_service]
    plain = record_spans(rows.where(F.col("service").isin(others)), keys)
    stays = thin_spans(stay_records(rows, cfg), keys)
    return plain.where(~stay).unionByName(stays)


def stay_records(rows: DataFrame, cfg: Settings) -> DataFrame:
    return record_spans(rows.where(F.col("service") == cfg.stay_service), ["client", "service"], MIN_STAY_SECONDS)


def timed_flows(spans: DataFrame, grid: Grid, cfg: Settings) -> DataFrame:
    """(client, service, k, add, at): ``add`` counts from cut-off k on, ``at`` at k only."""
    a = F.greatest("s", F.coalesce("last", F.lit(0)))
    whole = grid.covering(F.col("e"))
    need = F.when(F.col("service") == cfg.stay_service, MIN_STAY_SECONDS).otherwise(F.lit(None))

    def clipped(k):
        c = grid.cutoff(k) - grid.close
        counts = F.when(F.col("need").isNotNull(), c - F.col("a") >= F.col("need")) \
            .otherwise(c > F.coalesce("last", F.lit(0)))
        return F.struct(k.cast("int").alias("k"), F.lit(0).cast("long").alias("add"),
                        F.when(counts, span_days(F.col("a"), c, F.col("last"))).otherwise(0).cast("long").alias("at"))

    straddled = _range(grid.covering(F.col("s")), F.least(F.col("whole") - 1, F.lit(grid.n - 1)))
    return (grid.spread(spans).withColumn("a", a).withColumn("whole", whole).withColumn("need", need)
            .select("client", "service", F.inline(F.concat(
                F.array(F.struct(F.col("whole").alias("k"),
                                 span_days(F.col("a"), F.col("e"), F.col("last")).cast("long").alias("add"),
                                 F.lit(0).cast("long").alias("at"))),
                F.transform(straddled, clipped))))
            .where(F.col("k") < grid.n))


def counted_since(rows: DataFrame, cfg: Settings) -> DataFrame:
    """(client, service, t): a counted visit is counted at every closing time ``>= t``.

    A visit repeats the previous counted row of the client if service and end are the same; ends
    are compared after clipping, so two open visits of one service look alike until the earlier ends.
    """
    visits = rows.where(F.col("service").isin(list(cfg.counted_services))).select("client", "s", "service", "e")
    prev = F.col("prev")
    same = prev.isNotNull() & (prev["service"] == F.col("service"))
    t = F.when(~same, F.col("s")).when(prev["e"] != F.col("e"), F.greatest("s", F.least("e", prev["e"]) + 1))
    return (prior_row(visits.distinct(), ["client"], ["s", "service", "e"], "s", "prev", raw=visits)
            .select("client", "service", t.alias("t")).where(F.col("t").isNotNull()))


def counted_flows(since: DataFrame, grid: Grid) -> DataFrame:
    return (grid.spread(since).select("client", "service", grid.covering(F.col("t")).alias("k"),
                         F.lit(1).cast("long").alias("add"), F.lit(0).cast("long").alias("at"))
            .where(F.col("k") < grid.n))


# --- incomes -------------------------------------------------------------------------------------

def income_totals(rows: DataFrame, grid: Grid, tie: list[str]) -> DataFrame:
    """(client, k, IncomeTotal): per income type (null is a type too) the latest row by start counts.

    ``rows`` has client, kind, s, amount and the tie-breakers. The latest row of a type holds from its
    cut-off to the next change, so a type gives at most n rows.
    """
    best = F.struct("s", *tie, F.coalesce("amount", F.lit(0.0)).alias("_amt"))
    w = W.partitionBy("client", "kind").orderBy("k")
    until = F.coalesce(F.lead("k").over(w), F.lit(grid.n)) - 1
    return (grid.spread(rows).withColumn("k", grid.covering(F.col("s"))).where(F.col("k") < grid.n)
            .groupBy("client", "kind", "k").agg(F.max(best).alias("best"))
            .select("client", "k", F.col("best._amt").alias("amount"), until.alias("until"))
            .select("client", F.explode(F.sequence("k", "until")).alias("k"), "amount")
            .groupBy("client", "k").agg(F.sum("amount").alias("IncomeTotal")))


# --- labels --------------------------------------------------------------------------------------

def label_days(rows: DataFrame, grid: Grid, cfg: Settings) -> DataFrame:
    """(client, k, days): stay days within the label window ending at cut-off k plus the horizon.

    Unlike the features, a short stay here still moves the state on, so all stays are records.
    """
    window = cfg.label_window_days * DAY
    spans = record_spans(rows.where(F.col("service") == cfg.stay_service), ["client"])
    a0 = grid.first + grid.horizon
    lo = F.greatest(F.lit(0), ceil_div(F.col("a") + MIN_STAY_SECONDS - a0, grid.step)).cast("int")
    hi = F.least(F.lit(grid.n - 1), _floor_div(F.col("e") - MIN_STAY_SECONDS + window - a0, grid.step)).cast("int")
    anchor = grid.cutoff(F.col("k")) + grid.horizon
    start, end = F.greatest(anchor - window, F.col("a")), F.least("e", anchor)
    return (spans.withColumn("a", F.greatest("s", F.coalesce("last", F.lit(0))))
            .where(F.col("e") - F.col("a") >= MIN_STAY_SECONDS)
            .select("client", "e", "a", "last", F.explode(_range(lo, hi)).alias("k"))
            .where(end - start >= MIN_STAY_SECONDS)
            .groupBy("client", "k").agg(F.sum(span_days(start, end, F.col("last"))).alias("days")))


def _floor_div(a: Column, b: int) -> Column:
    return int_div(a - F.pmod(a, F.lit(b).cast("long")), b)


def labels(rows: DataFrame, grid: Grid, cfg: Settings) -> DataFrame:
    """(client, k, GroundTruth) for every client that has a record by the anchor."""
    # Label windows end at cut-off plus horizon, so presence is tested there.
    seen = (rows.groupBy("client").agg(F.min("s").alias("s"))
            .select("client", F.explode(_range(grid.slot(F.col("s") - grid.horizon), F.lit(grid.n - 1))).alias("k")))
    return _flag(seen, label_days(rows, grid, cfg), cfg)


def static_labels(rows: DataFrame, grid: Grid, cfg: Settings) -> DataFrame:
    """(client, k=0, GroundTruth) for every client, also those first seen after the label date."""
    return _flag(rows.select("client").distinct().withColumn("k", F.lit(0)), label_days(rows, grid, cfg), cfg)


def _flag(seen: DataFrame, days: DataFrame, cfg: Settings) -> DataFrame:
    hit = (F.coalesce("days", F.lit(0)) >= cfg.label_threshold_days).cast("int")
    return seen.join(days, ["client", "k"], "left").select("client", "k", hit.alias("GroundTruth"))


# --- time-step windows ---------------------------------------------------------------------------

def _windows(rows: DataFrame, grid: Grid) -> DataFrame:
    """One row per window [cutoff - step, cutoff - 1 s] the record touches, clipped to it."""
    lo = F.greatest(F.lit(0), ceil_div(F.col("s") + 1 - grid.origin(), grid.step)).cast("int")
    hi = F.least(F.lit(grid.n - 1), _floor_div(F.col("e") + grid.step - grid.origin(), grid.step)).cast("int")
    return (grid.spread(rows).withColumn("k", F.explode(_range(lo, hi)))
            .withColumn("w0", grid.cutoff(F.col("k")) - grid.step)
            .withColumn("w1", grid.cutoff(F.col("k")) - 1))


def window_timed(rows: DataFrame, grid: Grid, cfg: Settings) -> DataFrame:
    """(client, service, k, value): days of each timed service within each time step.

    Only records that are a new maximum over the whole history can be one inside a window, so the
    windows are cut from those. State restarts in each window; of records open at its start only
    the longest counts.
    """
    others = [s for s in cfg.timed_services if s != cfg.stay_service]
    plain = _windows(record_spans(rows.where(F.col("service").isin(others)), ["client", "service"]), grid)
    early = F.col("s") <= F.col("w0")
    last = F.when(F.col("last") >= F.col("w0"), F.col("last"))
    end = F.least("e", "w1")
    at_start = F.when(early & (end > 0), span_days(F.col("w0"), end, F.lit(0)))
    later = F.when(~early & (F.coalesce("last", F.lit(0)) < F.col("w1")),
                   span_days(F.greatest("s", F.coalesce(last, F.lit(0))), end, last))
    timed = (plain.groupBy("client", "service", "k")
             .agg((F.coalesce(F.max(at_start), F.lit(0)) + F.coalesce(F.sum(later), F.lit(0))).alias("value")))

    cut = (_windows(stay_records(rows, cfg).where(F.col("service") == cfg.stay_service), grid)
           .where(F.coalesce("last", F.lit(0)) < F.col("w1"))
           .select("client", "service", "k", F.greatest("s", "w0").alias("s"), F.least("e", "w1").alias("e"))
           .where(F.col("e") - F.col("s") >= MIN_STAY_SECONDS)
           .groupBy("client", "service", "k", "s").agg(F.max("e").alias("e")))
    a = F.greatest("s", F.coalesce("last", F.lit(0)))
    stays = (thin_spans(cut, ["client", "service", "k"], bucketed=True)
             .groupBy("client", "service", "k").agg(F.sum(span_days(a, F.col("e"), F.col("last"))).alias("value")))
    return timed.unionByName(stays)


def window_counted(rows: DataFrame, grid: Grid, cfg: Settings) -> DataFrame:
    """(client, service, k, value): visits of each counted service within each time step."""
    visits = (_windows(rows.where(F.col("service").isin(list(cfg.counted_services))), grid)
              .select("client", "k", F.greatest("s", "w0").alias("s"), "service", F.least("e", "w1").alias("e")))
    prev = F.col("prev")
    fresh = prev.isNull() | (prev["service"] != F.col("service")) | (prev["e"] != F.col("e"))
    return (prior_row(visits.distinct(), ["client", "k"], ["s", "service", "e"], "s", "prev", raw=visits)
            .where(fresh).groupBy("client", "service", "k").agg(F.count("*").alias("value")))


# --- assembly ------------------------------------------------------------------------------------

def presence(rows: DataFrame, grid: Grid, cfg: Settings, any_service: bool) -> DataFrame:
    """(client, k) for every anchor at which the client has a row.

    A series row needs a timed or counted record by the cut-off; a static row needs any record.
    """
    kinds = list(cfg.timed_services + cfg.counted_services)
    served = F.col("service").isin(kinds) if not any_service else F.lit(True)
    first = rows.groupBy("client").agg(F.min("s").alias("s"), F.min(F.when(served, F.col("s"))).alias("t"))
    return (grid.spread(first.where(F.col("t").isNotNull()))
            .withColumn("k0", F.greatest(grid.slot(F.col("t")), grid.covering(F.col("s"))))
            .select("client", F.explode(_range(F.col("k0"), F.lit(grid.n - 1))).alias("k")))


def running_totals(seen: DataFrame, flows: DataFrame, grid: Grid, names: dict[str, str]) -> DataFrame:
    """(client, k, <name>...) totals per service at every anchor of ``seen``.

    ``names`` maps service to column. The window sees at most n rows per client.
    """
    items = list(names.items())
    w = W.partitionBy("client").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    base = seen.select("client", "k", F.lit(None).cast("string").alias("service"), F.lit(0).cast("long").alias("add"),
                       F.lit(0).cast("long").alias("at"), F.lit(1).alias("here"))
    summed = base.unionByName(flows.withColumn("here", F.lit(0))).groupBy("client", "k").agg(
        F.max("here").alias("here"),
        *[F.sum(F.when(F.col("service") == s, F.col(c)).otherwise(0)).alias(f"{c}{i}")
          for i, (s, _) in enumerate(items) for c in ("add", "at")])
    return (summed.select("client", "k", "here",
                          *[(F.sum(f"add{i}").over(w) + F.col(f"at{i}")).alias(name) for i, (_, name) in enumerate(items)])
            .where("here = 1").drop("here"))


def step_features(values: DataFrame, names: dict[str, str]) -> DataFrame:
    """Wide (client, k, <name>...) of the per-window values."""
    return values.groupBy("client", "k").agg(
        *[F.sum(F.when(F.col("service") == s, F.col("value")).otherwise(0)).alias(n) for s, n in names.items()])

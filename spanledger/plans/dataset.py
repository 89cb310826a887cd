"""Raw episodes to processed datasets: one row per client, or per client and anchor date."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from spanledger.config import Settings
from spanledger.functions.exprs import col, fill_null, secs
from spanledger.operators import cleanse, encode, grid as G
from spanledger.operators.collapse import (Collapse, collapse, collapse_asof, distinct_values, join_answers, join_label,
                                           split_kinds, vocabulary_lists)
from spanledger.operators.series import lag_assembly, lag_name
from spanledger.operators.spans import intervals


@dataclass(frozen=True)
class FeatureMeta:
    """What was learnt from the training table and is needed again at scoring time."""

    multi: dict[str, list[str]]
    single: dict[str, list[str]]
    numeric: list[str]
    horizon_weeks: float

    def to_rows(self) -> list[tuple[str, str, str, int]]:
        rows = [(f, "multi", v, i) for f, vs in self.multi.items() for i, v in enumerate(vs)]
        rows += [(f, "single", v, i) for f, vs in self.single.items() for i, v in enumerate(vs)]
        rows += [(f, "multi", None, -1) for f, vs in self.multi.items() if not vs]
        rows += [(f, "single", None, -1) for f, vs in self.single.items() if not vs]
        rows += [(f, "numeric", None, i) for i, f in enumerate(self.numeric)]
        return rows + [("horizon_weeks", "setting", str(self.horizon_weeks), 0)]

    def save(self, spark, path: str) -> None:
        (spark.createDataFrame(self.to_rows(), "feature string, kind string, value string, idx int")
         .coalesce(1).write.mode("overwrite").parquet(path))

    @staticmethod
    def load(spark, path: str) -> "FeatureMeta":
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["idx"])
        out = FeatureMeta({}, {}, [], 0.0)
        for r in rows:
            if r["kind"] in ("multi", "single"):
                values = getattr(out, r["kind"]).setdefault(r["feature"], [])
                if r["idx"] >= 0:
                    values.append(r["value"])
            elif r["kind"] == "numeric":
                out.numeric.append(r["feature"])
            else:
                out = replace(out, horizon_weeks=float(r["value"]))
        return out


@dataclass(frozen=True)
class Dataset:
    """``features`` holds ordinal codes, ``encoded`` one-hot columns; both carry the label if asked."""

    features: DataFrame
    encoded: DataFrame
    meta: FeatureMeta
    keys: tuple[str, ...]


def clean(episodes: DataFrame, cfg: Settings) -> DataFrame:
    df = cleanse.exclude_clients(episodes, cfg.client_exclusions)
    if "ConsentType" in df.columns:
        df = cleanse.exclude_declined(df)
    df = cleanse.drop_features(df, cfg.drop_first)
    if "FamilyID" in df.columns:
        df = cleanse.flag_present(df, "FamilyID", "HasFamily")
    df = cleanse.close_open_intervals(cleanse.coerce_timestamps(df), cfg.run_ts)
    amounts = [c for c in ("MonthlyAmount", "ExpenseAmount", "TotalScore") if c in df.columns]
    return cleanse.parse_amounts(df, *amounts)


def _columns(df: DataFrame, cfg: Settings, series: bool) -> tuple[list[str], list[str]]:
    cats = [c for c in cfg.categorical_features if c in df.columns]
    if "HasFamily" in df.columns:
        cats.append("HasFamily")
    if not series and "ServiceType" in cats:
        cats.remove("ServiceType")
    nums = [c for c in cfg.numeric_features if c in df.columns and c not in ("MonthlyAmount", "ServiceID", "CurrentAge")]
    return cats, nums


def _spec(cats_multi: dict[str, list[str]], single: list[str], nums: list[str]) -> Collapse:
    return Collapse(
        largest=[c for c in nums if c not in ("ExpenseAmount", "TotalScore")],
        summed=[c for c in nums if c == "ExpenseAmount"],
        newest=[c for c in nums if c == "TotalScore"] + single,
        present=cats_multi)


def _incomes(df: DataFrame) -> DataFrame:
    return df.select(F.col("ClientID").alias("client"), F.col("IncomeType").alias("kind"),
                     secs("DateStart").alias("s"), F.coalesce(secs("DateEnd"), F.lit(0)).alias("e"),
                     F.col("MonthlyAmount").alias("amount"))


def _finish(df: DataFrame, keys: list[str], numeric: list[str], single: list[str], multi: dict[str, list[str]],
            labels: DataFrame | None, meta: FeatureMeta | None, cfg: Settings, tail: list[str], attributes: DataFrame) -> Dataset:
    """Fill, encode, join the label. ``tail`` columns stay last; ``attributes`` holds the same values of
    the single-valued columns without the span features, so that learning codes costs one aggregation."""
    df = cleanse.fill_policy(df, single=single, numeric=numeric)
    codes = meta.single if meta else vocabulary_lists(distinct_values(cleanse.fill_policy(attributes, single=single), single), single)
    meta = meta or FeatureMeta(multi, codes, [c for c in df.columns if c in numeric or c in tail], cfg.horizon_weeks)
    coded = encode.ordinal_encode(df, codes)
    hot = encode.onehot_single(coded, codes)
    hot = hot.select(*keys, *[col(c) for c in hot.columns if c not in keys])
    if labels is not None:
        coded, hot = join_label(coded, labels, keys), join_label(hot, labels, keys)
    return Dataset(coded, hot, meta, tuple(keys))


def label_table(episodes: DataFrame, cfg: Settings, series: bool, n_anchors: int | None = None) -> DataFrame:
    """(client, k, GroundTruth). Depends on the label dates only, so one table serves every horizon."""
    rows = intervals(clean(episodes, cfg))
    if not series:
        return G.static_labels(rows, G.Grid.static(cfg), cfg)
    return G.labels(rows, _series_grid(cfg, True, n_anchors), cfg)


def _series_grid(cfg: Settings, training: bool, n_anchors: int | None) -> G.Grid:
    if n_anchors:
        return G.Grid.ending(cfg.label_date, n_anchors, cfg.series.step_days, cfg.horizon_days if training else 0)
    return G.Grid.series(cfg, training)


def static_dataset(episodes: DataFrame, cfg: Settings, meta: FeatureMeta | None = None, include_label: bool = True,
                   answers: DataFrame | None = None, labels: DataFrame | None = None) -> Dataset:
    """One row per client. With ``meta`` from training the fitted vocabularies are reused, with
    ``labels`` an existing label table."""
    grid = G.Grid.static(cfg)
    full = clean(episodes, cfg)
    cut = cleanse.asof_cut(full, _cut_text(grid))
    cats, nums = _columns(cut, cfg, series=False)
    single, multi = (list(meta.single), list(meta.multi)) if meta else split_kinds(cut, cats)
    single = [c for c in single if c in cats]
    # A filled-in None is a category of its own here.
    filled = cut.fillna("None", subset=multi) if multi else cut
    values = meta.multi if meta else vocabulary_lists(distinct_values(filled, multi), multi)
    base = collapse(filled, ["ClientID"], _spec(values, single, nums + (["CurrentAge"] if "CurrentAge" in cut.columns else [])))

    rows = intervals(cut)
    names = service_names(cfg, "Total_", "Num_")
    flows = G.timed_flows(G.timed_spans(rows, cfg), grid, cfg).unionByName(G.counted_flows(G.counted_since(rows, cfg), grid))
    totals = G.running_totals(G.presence(rows, grid, cfg, any_service=True), flows, grid, names).drop("k")
    df = base.join(totals.withColumnRenamed("client", "ClientID"), "ClientID", "left")
    if "IncomeType" in cut.columns:
        income = G.income_totals(_incomes(cut), grid, ["e", "amount"]).drop("k").withColumnRenamed("client", "ClientID")
        df = df.join(income, "ClientID", "left")
    if answers is not None:
        known = set(df.columns)
        df = join_answers(df, answers, "ClientID", cfg.answer_clients_only, cfg.answers_only)
        extra = [f for f in answers.schema.fields if f.name not in known]
        single += [f.name for f in extra if f.dataType.simpleString() == "string"]
        single = [c for c in single if c in df.columns]
    df = cleanse.drop_features(df, cfg.drop_last)
    numeric = [c for c in df.columns if c != "ClientID" and c not in single and c not in {n for _, _, n in Collapse(present=values).flags()}]
    if include_label:
        labels = labels if labels is not None else G.static_labels(intervals(full), grid, cfg)
        labels = labels.drop("k").withColumnRenamed("client", "ClientID")
    return _finish(df, ["ClientID"], numeric, single, values, labels if include_label else None, meta, cfg, [], df if answers is not None else base)


def series_dataset(episodes: DataFrame, cfg: Settings, meta: FeatureMeta | None = None, training: bool = True,
                   n_anchors: int | None = None, since_k: int | None = None, labels: DataFrame | None = None,
                   grid: G.Grid | None = None) -> Dataset:
    """One row per client and anchor date, every anchor in the same job, with lagged time steps.

    The label stands ``horizon`` after the cut-off in training and is left out when scoring.
    """
    grid = grid or _series_grid(cfg, training, n_anchors)
    since_k = since_k if since_k is not None else first_kept(cfg, grid, training)
    df = clean(episodes, cfg)
    cats, nums = _columns(df, cfg, series=True)
    single, multi = (list(meta.single), list(meta.multi)) if meta else split_kinds(df, cats)
    single = [c for c in single if c in cats]
    # Only observed values get a column here, a filled-in None does not.
    values = meta.multi if meta else vocabulary_lists(distinct_values(df, multi), multi)

    wide = series_features(df, grid, cfg, _spec(values, single, nums))
    wide = wide.withColumn("Date", grid.date(F.col("k"))).withColumnRenamed("client", "ClientID")
    wide = cleanse.drop_features(wide, [*cfg.drop_last])
    steps = list(service_names(cfg, step_prefix(cfg), step_prefix(cfg)).values())
    flags = {n for _, _, n in Collapse(present=values).flags()}
    numeric = [c for c in wide.columns if c not in ("ClientID", "k", "Date", *single) and c not in flags]
    wide = cleanse.fill_policy(wide, single=single, numeric=numeric)
    lagged = lag_assembly(wide, steps, cfg.series.t_x, since=F.lit(since_k), date="k").drop("k")
    if training:
        labels = labels if labels is not None else G.labels(intervals(df), grid, cfg)
        labels = (grid.spread(labels).withColumn("Date", grid.date(F.col("k"))).drop("k")
                  .withColumnRenamed("client", "ClientID"))
    tail = [lag_name(i, f) for i in range(cfg.series.t_x - 1, 0, -1) for f in steps] + steps
    attributes = (G.presence(intervals(df), grid, cfg, any_service=False).where(F.col("k") >= since_k)
                  .join(collapse_asof(df, grid, Collapse(newest=single)), ["client", "k"], "left"))
    if isinstance(grid, G.HorizonGrid):  # codes are those of the first horizon, as if it were the only one
        attributes = attributes.where(grid.horizon_of() == 0)
    return _finish(lagged, ["ClientID", "Date"], numeric, single, values, labels if training else None, meta, cfg, tail, attributes)


def horizon_dataset(episodes: DataFrame, cfg: Settings, weeks: Sequence[float], meta: FeatureMeta | None = None, n_anchors: int | None = None,
                    labels: DataFrame | None = None) -> Dataset:
    """``series_dataset`` for several horizons at once, told apart by ``n`` (weeks); vocabularies are those of the first.

    Label dates do not depend on the horizon, cut-offs do: the records are read, ordered and turned into counted spans
    once, then placed on the cut-offs of every horizon. Client numbers must be whole.
    """
    base = _series_grid(replace(cfg, horizon_weeks=0), True, n_anchors)
    grid = G.HorizonGrid.of(base, tuple(replace(cfg, horizon_weeks=w).horizon_days for w in weeks))
    labels = labels if labels is not None else G.labels(intervals(clean(episodes, cfg)), base, cfg)
    ds = series_dataset(episodes, replace(cfg, horizon_weeks=weeks[0]), meta, n_anchors=n_anchors, labels=labels, grid=grid)
    n = F.get(F.array(*[F.lit(w) for w in weeks]), grid.horizon_of("ClientID")).alias("n")

    def apart(df: DataFrame) -> DataFrame:
        return df.select(n, grid.client_of("ClientID").alias("ClientID"), *[col(c) for c in df.columns if c != "ClientID"])

    return Dataset(apart(ds.features), apart(ds.encoded), ds.meta, ("n", "ClientID", "Date"))


def series_features(df: DataFrame, grid: G.Grid, cfg: Settings, spec: Collapse | None = None) -> DataFrame:
    """(client, k, attributes, totals, IncomeTotal, time-step values) on every anchor of a client."""
    rows = intervals(df)
    totals, steps = service_names(cfg, "Total_", "Total_"), service_names(cfg, step_prefix(cfg), step_prefix(cfg))
    flows = G.timed_flows(G.timed_spans(rows, cfg), grid, cfg).unionByName(G.counted_flows(G.counted_since(rows, cfg), grid))
    windows = G.window_timed(rows, grid, cfg).unionByName(G.window_counted(rows, grid, cfg))
    on = ["client", "k"]
    out = G.running_totals(G.presence(rows, grid, cfg, any_service=False), flows, grid, totals)
    if spec is not None:
        out = out.join(collapse_asof(df, grid, spec), on, "left")
    if "IncomeType" in df.columns:
        out = out.join(G.income_totals(_incomes(df), grid, ["e", "amount"]), on, "left").fillna(0.0, ["IncomeTotal"])
    out = fill_null(out.join(G.step_features(windows, steps), on, "left"), dict.fromkeys(steps.values(), 0))
    if "DOB" in df.columns:
        born = df.groupBy(F.col("ClientID").alias("client")).agg(F.min(secs("DOB")).alias("_dob"))
        out = (out.join(grid.spread(born), "client", "left")
               .withColumn("CurrentAge", F.floor((grid.cutoff(F.col("k")) - F.col("_dob")) / (365.2425 * 86_400))).drop("_dob"))
    return out


def service_names(cfg: Settings, timed: str, counted: str) -> dict[str, str]:
    return {s: timed + s for s in cfg.timed_services} | {s: counted + s for s in cfg.counted_services}


def step_prefix(cfg: Settings) -> str:
    return f"{cfg.series.step_days}-Day_"


def first_kept(cfg: Settings, grid: G.Grid, training: bool) -> int:
    """First anchor kept after lagging: older ones only feed the look-back."""
    back = int(cfg.series.years_of_data * 365.25) if training else 0
    steps_back = back // cfg.series.step_days
    return max(0, grid.n - 1 - steps_back)


def _cut_text(grid: G.Grid) -> str:
    from datetime import datetime, timezone

    return datetime.fromtimestamp(grid.first, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")

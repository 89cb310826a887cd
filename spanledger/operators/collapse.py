"""One row per client, or per client and anchor; vocabularies; joins of the feature tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.functions.exprs import col, fill_null, secs
from spanledger.functions.ordered import range_rank
from spanledger.operators.grid import Grid


@dataclass(frozen=True)
class Collapse:
    """How the columns of a client's rows become one value."""

    largest: Sequence[str] = ()
    summed: Sequence[str] = ()
    # Newest non-null value by DateStart.
    newest: Sequence[str] = ()
    # Column -> observed values; gives 0/1 columns ``<column>_<value>``.
    present: dict[str, Sequence[str]] = field(default_factory=dict)

    def flags(self) -> list[tuple[str, str, str]]:
        return [(f, v, f"{f}_{v}") for f, vs in self.present.items() for v in vs]


def newest_value(column: str, order: Sequence[str]) -> Column:
    """Ordered carrier of the newest non-null value; combines map-side and has a full tie-break."""
    return F.max(F.when(F.col(column).isNotNull(), F.struct(*order, F.col(column).alias("v"))))


def collapse(df: DataFrame, keys: Sequence[str], spec: Collapse, order: Sequence[str] = ("DateStart", "DateEnd")) -> DataFrame:
    """One row per key. Only mergeable aggregates, so a hot client is combined before the shuffle."""
    aggs = [F.max(c).alias(c) for c in spec.largest]
    aggs += [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in spec.summed]
    aggs += [newest_value(c, order)["v"].alias(c) for c in spec.newest]
    aggs += [F.max(F.when(F.col(f) == v, 1).otherwise(0)).alias(n) for f, v, n in spec.flags()]
    return df.groupBy(*keys).agg(*aggs)


def collapse_asof(df: DataFrame, grid: Grid, spec: Collapse, client: str = "ClientID",
                  order: Sequence[str] = ("DateStart", "DateEnd")) -> DataFrame:
    """(client, k, ...): the collapse of the rows seen by each cut-off.

    Rows are combined per (client, first cut-off that sees them); the cut-offs after it inherit by a
    running aggregate over at most n rows per client. Gaps are filled by the caller's anchor rows.
    """
    w = W.partitionBy("client").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    until = F.coalesce(F.lead("k").over(W.partitionBy("client").orderBy("k")), F.lit(grid.n)) - 1
    rows = (grid.spread(df.withColumnRenamed(client, "client")).withColumn("k", grid.covering(secs("DateStart")))
            .where(F.col("k") < grid.n))
    aggs = [F.max(c).alias(c) for c in spec.largest]
    aggs += [F.sum(c).alias(c) for c in spec.summed]
    aggs += [newest_value(c, order).alias(c) for c in spec.newest]
    aggs += [F.max(F.when(F.col(f) == v, 1).otherwise(0)).alias(n) for f, v, n in spec.flags()]
    part = rows.groupBy("client", "k").agg(*aggs, F.count("*").alias("_rows"))
    run = [F.max(c).over(w).alias(c) for c in spec.largest]
    run += [F.coalesce(F.sum(c).over(w), F.lit(0.0)).alias(c) for c in spec.summed]
    run += [F.max(c).over(w)["v"].alias(c) for c in spec.newest]
    run += [F.max(col(n)).over(w).alias(n) for _, _, n in spec.flags()]
    return (part.select("client", F.col("k").alias("_k"), until.alias("_u"), *run)
            .withColumn("k", F.explode(F.sequence("_k", "_u"))).drop("_k", "_u"))


# --- vocabularies --------------------------------------------------------------------------------

def unpivot(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """Long (keep..., feature, value) of text columns."""
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])))


def classify_cats(df: DataFrame, columns: Sequence[str], key: str = "ClientID") -> DataFrame:
    """(feature, max_values, kind): ``multi`` when any client holds two different values.

    A client's values are compared by min and max, so nothing is collected per client.
    """
    per = df.groupBy(key).agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    flags = per.agg(*[F.max((F.col(f"lo_{c}") != F.col(f"hi_{c}")).cast("int")).alias(c) for c in columns])
    return (unpivot(flags, columns)
            .select("feature", F.when(F.col("value") == "1", "multi").otherwise("single").alias("kind")))


def split_kinds(df: DataFrame, columns: Sequence[str], key: str = "ClientID") -> tuple[list[str], list[str]]:
    """Single- and multi-valued column names; one row per column comes back to the driver."""
    kinds = {r["feature"]: r["kind"] for r in classify_cats(df, columns, key).collect()} if columns else {}
    return [c for c in columns if kinds[c] == "single"], [c for c in columns if kinds[c] == "multi"]


def distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value): distinct non-null values, combined map-side."""
    return unpivot(df, columns).where(F.col("value").isNotNull()).distinct()


def vocabulary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code): distinct values with codes 1.. in lexical order per feature; ranks are found by ranges, so
    no task sees all values of a feature."""
    return range_rank(distinct_values(df, columns), "feature", ["value"], "code").withColumn("code", F.col("code").cast("int"))


MAX_COLUMNS = 20_000


def vocabulary_lists(values: DataFrame, columns: Sequence[str]) -> dict[str, list[str]]:
    """Distinct values per feature in lexical order, as column names need them.

    A table with a column per value is what bounds the vocabulary; its size is checked, it is never cut. Beyond it
    rows are made by ``operators.sparse``, which has no such bound.
    """
    rows = values.where(F.col("feature").isin(list(columns))).limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} one-hot columns; use operators.sparse or drop a free-text feature")
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: (r["feature"], r["value"])):
        out[r["feature"]].append(r["value"])
    return out


# --- joins ---------------------------------------------------------------------------------------

def join_label(features: DataFrame, labels: DataFrame, on: Sequence[str]) -> DataFrame:
    return fill_null(features.join(labels, list(on), "left"), {"GroundTruth": 0})


def join_answers(features: DataFrame, answers: DataFrame, on: str, clients_only: bool, answers_only: bool = False) -> DataFrame:
    """Questionnaire columns beside the features: inner for clients with answers, else left."""
    out = features.join(answers, on, "inner" if clients_only else "left")
    return out.select(on, *[col(c) for c in answers.columns if c != on]) if clients_only and answers_only else out


def coalesce_update(df: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Cells of ``df`` overwritten by the matching non-null cells of ``new``."""
    shared = [c for c in new.columns if c in df.columns and c not in on]
    other = new.select(*on, *[col(c).alias(f"_new_{c}") for c in shared])
    out = df.join(other, list(on), "left")
    return out.select(*[F.coalesce(col(f"_new_{c}"), col(c)).alias(c) if c in shared else col(c) for c in df.columns])


def label_balance(df: DataFrame, label: str = "GroundTruth") -> DataFrame:
    pos, n = F.sum(label), F.count("*")
    return df.agg(pos.alias("num_pos"), (n - pos).alias("num_neg"), F.try_divide(100.0 * pos, n).alias("pct_pos"))

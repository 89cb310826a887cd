"""Encoders fitted as tables: vocabularies and moments. Small; joined back by whatever join their size allows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from spanledger.functions.exprs import col, total
from spanledger.functions.ordered import exact_quantiles, running_sums
from spanledger.operators.collapse import unpivot

# Fixed value: name of code 0, which no category uses.
DUMMY = "DUMMY_VAL"
UNKNOWN_CODE = -1
#: Classes of a label that bins are cut by at most.
MOST_CLASSES = 64


def onehot_multi(df: DataFrame, keys: Sequence[str], vocab: Mapping[str, Sequence[str]], null_as: str = "None") -> DataFrame:
    """One row per key with 0/1 columns ``<feature>_<value>``; values outside the vocabulary give zeros."""
    flags = [F.max(F.when(F.coalesce(F.col(f).cast("string"), F.lit(null_as)) == v, 1).otherwise(0)).alias(f"{f}_{v}")
             for f, vs in vocab.items() for v in vs]
    return df.groupBy(*keys).agg(*flags)


def _code(feature: str, values: Sequence[str]) -> Column:
    """Code of a value by its position in the vocabulary. A long one is in lexical order and is searched in two short scans."""
    value, known = col(feature).cast("string"), F.array(*[F.lit(v) for v in values]).cast("array<string>")
    if len(values) <= 64 or list(values) != sorted(values):
        pos = F.array_position(known, value)
        return F.when(pos > 0, pos.cast("int")).otherwise(UNKNOWN_CODE)
    steps = math.isqrt(len(values)) + 1
    heads = F.array(*[F.lit(v) for v in values[::steps]]).cast("array<string>")
    first = F.greatest(F.size(F.filter(heads, lambda x: x <= value)) - 1, F.lit(0)) * steps
    inside = lambda b: F.array_position(F.slice(known, b + 1, steps), value)
    at = F.transform(F.array(first), lambda b: F.when(inside(b) > 0, inside(b) + b))[0]
    return F.when(at > 0, at.cast("int")).otherwise(UNKNOWN_CODE)


def ordinal_encode(df: DataFrame, vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns replaced by codes 1.. (lexical order); unseen values and nulls are -1."""
    return df.withColumns({f: F.coalesce(_code(f, vs), F.lit(UNKNOWN_CODE)) for f, vs in vocab.items()})


def onehot_single(encoded: DataFrame, vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 columns from ordinal codes, in front of the remaining columns."""
    hot = [(col(f) == i + 1).cast("int").alias(f"{f}_{v}") for f, vs in vocab.items() for i, v in enumerate(vs)]
    return encoded.select(*hot, *[col(c) for c in encoded.columns if c not in vocab])


def decode_ordinal(df: DataFrame, vocab: Mapping[str, Sequence[str]]) -> DataFrame:
    """Codes back to values; code 0 is the dummy, unknown codes stay null."""
    def name(f, vs):
        values = F.array(F.lit(DUMMY), *[F.lit(v) for v in vs])
        return F.when(col(f) >= 0, F.get(values, col(f).cast("int")))
    return df.withColumns({f: name(f, vs) for f, vs in vocab.items()})


# --- scaling -------------------------------------------------------------------------------------

def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std): population std, 1 where it is zero. One pass, one row per column."""
    wide = df.agg(*[F.struct(F.avg(col(c)).alias("mean"), F.stddev_pop(col(c)).alias("std")).alias(f"m{i}") for i, c in enumerate(columns)])
    return (wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"m{i}.mean").alias("mean"),
                 F.when(F.col(f"m{i}.std") > 0, F.col(f"m{i}.std")).otherwise(1.0).alias("std"))
        for i, c in enumerate(columns)]))))


def fixed_moments(fitted: DataFrame) -> list[Row]:
    """The moments, read once; the scalers take them in place of the table."""
    return fitted.collect()


def _lookup(m: DataFrame | Sequence[Row]) -> dict[str, tuple[float, float]]:
    return {r["feature"]: (r["mean"], r["std"]) for r in (m.collect() if isinstance(m, DataFrame) else m)}


def standard_scale(df: DataFrame, fitted: DataFrame | Sequence[Row]) -> DataFrame:
    """Scaled columns first, as the scorer expects, the rest after. Moments are one row per column."""
    m = _lookup(fitted)
    return df.select(*[((col(c) - mu) / sd).alias(c) for c, (mu, sd) in m.items()],
                     *[col(c) for c in df.columns if c not in m])


def inverse_scale(df: DataFrame, fitted: DataFrame | Sequence[Row], round_all: bool = True) -> DataFrame:
    """Back to the original range; ``rint`` rounds halves to even."""
    m = _lookup(fitted)
    back = {c: col(c) * sd + mu for c, (mu, sd) in m.items() if c in df.columns}
    return df.withColumns({c: F.rint(x) if round_all else x for c, x in back.items()})


# --- training statistics -------------------------------------------------------------------------

def long_numbers(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    return df.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), col(c).cast("double").alias("value")) for c in columns])))


def feature_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, min, max, std) of the training table, population std."""
    return long_numbers(df, columns).groupBy("feature").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.stddev_pop("value").alias("std"))


def value_freqs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n, freq): how often each value occurs, and its share."""
    counts = unpivot(df, columns).groupBy("feature", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "feature").select("feature", "value", "n", (F.col("n") / F.col("_all")).alias("freq"))


def bin_edges(df: DataFrame, columns: Sequence[str], parts: int) -> DataFrame:
    """(feature, edges): exact quantile cut points (linear interpolation), duplicates removed.

    Counts of distinct values are combined map-side, then the rank of each value is found by running
    sums; no column is sorted in one task.
    """
    counts = (long_numbers(df, columns).where(F.col("value").isNotNull()).groupBy("feature", "value")
              .agg(F.count("*").alias("n")))
    q = exact_quantiles(counts, "feature", "value", "n", [i / parts for i in range(1, parts)])
    # At most ``parts`` points per feature.
    return q.groupBy("feature").agg(F.array_sort(F.collect_set("q")).alias("edges"))


def _entropy(counts: Sequence[Column]) -> Column:
    """Entropy in bits of class counts, 0 for none."""
    n = total(list(counts))
    return total([F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for c in counts])


def entropy_bins(df: DataFrame, columns: Sequence[str], label: str, depth: int = 3, mdl: bool = False) -> DataFrame:
    """(feature, edges): cut points that tell most about ``label``, found by halving bins ``depth`` times.

    In every round each bin of every feature is cut where the entropy of the label falls most (the
    smallest such point; halfway between two values), if it falls at all; with ``mdl``, if the fall pays for
    the description of the cut (Fayyad and Irani 1993). Distinct values and their class counts are
    made once; a round is one aggregate over their running sums, for all features together, so no
    column is ever in one task. Bins are few and are sent to all tasks. Null values and labels are left out.
    """
    rows = long_numbers(df, columns, F.col(label).alias("_label")).where(F.col("value").isNotNull() & F.col("_label").isNotNull())
    classes = [r["_label"] for r in df.select(F.col(label).alias("_label")).where(F.col("_label").isNotNull()).distinct().orderBy("_label").limit(MOST_CLASSES + 1).collect()]
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    names = [f"n{i}" for i in range(len(classes))]
    counts = rows.groupBy("feature", "value").agg(*[F.count_if(F.col("_label") == c).alias(n) for c, n in zip(classes, names)])
    sums = running_sums(counts, "value", names, within=["feature"]).persist() if classes else counts
    spark = df.sparkSession
    # A bin: (feature, no, values above lo up to hi, class counts below it and in it).
    everything = sums.groupBy("feature").agg(*[F.sum(n) for n in names]).collect()
    bins = [(r[0], 0, None, None, [0] * len(names), list(r[1:])) for r in everything]
    edges: dict[str, list[float]] = {f: [] for f in columns}
    schema = "feature string, no int, lo double, hi double, below array<long>, inside array<long>"
    for _ in range(depth):
        bins = [b for b in bins if sum(n > 0 for n in b[5]) > 1]
        if not bins:
            break
        own = sums.join(F.broadcast(spark.createDataFrame(bins, schema)), "feature").where(
            (F.col("lo").isNull() | (F.col("value") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("value") <= F.col("hi"))))
        left = [F.col(f"cum_{n}") - F.col("below")[i] for i, n in enumerate(names)]
        whole = [F.col("inside")[i] for i in range(len(names))]
        right = [w - c for w, c in zip(whole, left)]
        n, n_left = total(whole), total(left)
        e, e_left, e_right = _entropy(whole), _entropy(left), _entropy(right)
        gain = F.round(e - n_left / n * e_left - (n - n_left) / n * e_right, 12)
        least = F.lit(0.0)
        if mdl:
            kinds, k_left, k_right = (total([(c > 0).cast("int") for c in part]) for part in (whole, left, right))
            least = (F.log2(n - 1) + F.log2(F.pow(F.lit(3.0), kinds) - 2) - (kinds * e - k_left * e_left - k_right * e_right)) / n
        best = own.where(n_left < n).groupBy("feature", "no").agg(F.max(F.when(gain > least, F.struct(gain.alias("gain"), (-F.col("value")).alias("at"), F.array(*left).alias("left")))).alias("b"))
        found = {(r["feature"], r["no"]): (-r["b"]["at"], list(r["b"]["left"])) for r in best.where("b IS NOT NULL").collect()}
        if not found:
            break
        # Where the next value above each cut is.
        cuts = spark.createDataFrame([(f, no, v) for (f, no), (v, _) in found.items()], "feature string, no int, cut double")
        above = {(r[0], r[1]): r[2] for r in sums.join(F.broadcast(cuts), "feature").where("value > cut").groupBy("feature", "no").agg(F.min("value")).collect()}
        after = []
        for f, no, lo, hi, below, inside in bins:
            if (f, no) in found:
                v, own_left = found[f, no]
                edges[f].append((v + above[f, no]) / 2)
                after += [(f, 2 * no, lo, v, below, own_left), (f, 2 * no + 1, v, hi, [a + b for a, b in zip(below, own_left)], [a - b for a, b in zip(inside, own_left)])]
        bins = after
    sums.unpersist()
    return spark.createDataFrame([(f, sorted(edges[f])) for f in columns], "feature string, edges array<double>")


def bin_index(value: Column, edges: Column) -> Column:
    """Bin of a value: number of edges below it (bins are closed on the right)."""
    return F.size(F.filter(edges, lambda e: e < value))


def bin_rule(feature: Column, edges: Column, index: Column) -> Column:
    """Rule text of a bin, edges with two decimals: ``f <= a``, ``a < f <= b``, ``f > b``."""
    def lo():
        return F.format_string("%.2f", F.get(edges, index - 1))

    def hi():
        return F.format_string("%.2f", F.get(edges, index))
    return (F.when(F.size(edges) == 0, feature)
            .when(index == 0, F.concat(feature, F.lit(" <= "), hi()))
            .when(index == F.size(edges), F.concat(feature, F.lit(" > "), lo()))
            .otherwise(F.concat(lo(), F.lit(" < "), feature, F.lit(" <= "), hi())))


def value_rule(feature: Column, value: Column) -> Column:
    return F.concat(feature, F.lit("="), value.cast("string"))

"""Local explanations (Ribeiro 2016) as joins and aggregates.

A training table is summarised per feature: bin edges, frequency and moments per bin, frequency per
code. An example is perturbed by drawing each feature from its frequencies, all perturbations are
scored by the model as ordinary rows, and one weighted ridge fit per example gives its rules.

Draws come from alias tables: a feature with k slots has k columns of equal height, each with one slot
at the bottom and another on top. One number names a column and a height in it, so a draw is one look
at a constant array and one comparison, however many slots there are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from heapq import heapify, heappop, heappush, heapreplace

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.functions.exprs import int_div, mix, total
from spanledger.functions.ordered import prior_row, slice_count
from spanledger.operators.encode import bin_edges, bin_index, entropy_bins
from spanledger.operators.localfit import local_fit

# Fixed value: ``mix`` draws whole numbers below this.
DRAWS = 2_147_483_647
# Rows drawn by one task, and the samples of an example that stay together.
TASK_ROWS = 500_000
PART_SAMPLES = 5_000


@dataclass(frozen=True)
class Explainer:
    """Fitted summaries; as large as features x bins, so they live on the driver."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    edges: dict[str, list[float]]
    # feature -> list of (bin or code, count or share, mean, std, min, max)
    table: dict[str, list[tuple[int, float, float, float, float, float]]]
    names: Mapping[str, Sequence[str]]

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical


def fit(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str] = (), parts: int = 4,
        names: Mapping[str, Sequence[str]] | None = None, label: str | None = None,
        edges: Mapping[str, Sequence[float]] | None = None) -> Explainer:
    """Bin edges, then one aggregation for frequencies and moments of all features.

    Bins are quantiles (``parts``), or cut where they tell most about ``label`` if one is named, or
    given as ``edges``.
    """
    if edges is None:
        cuts = entropy_bins(df, numeric, label) if label else bin_edges(df, numeric, parts)
        edges = {r["feature"]: [float(e) for e in r["edges"]] for r in cuts.collect()} if numeric else {}
    edges = {f: list(edges.get(f, [])) for f in numeric}
    slots = [F.struct(F.lit(f).alias("feature"), _bin(f, edges).alias("slot"), F.col(f).cast("double").alias("v")) for f in numeric]
    slots += [F.struct(F.lit(f).alias("feature"), F.col(f).cast("int").alias("slot"), F.col(f).cast("double").alias("v")) for f in categorical]
    stats = (df.select(F.inline(F.array(*slots))).where(F.col("v").isNotNull()).groupBy("feature", "slot")
             .agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    table: dict = {f: [] for f in (*numeric, *categorical)}
    for r in sorted(stats.collect(), key=lambda r: (r["feature"], r["slot"])):
        table[r["feature"]].append((r["slot"], r["n"], r["mean"], r["std"], r["lo"], r["hi"]))
    return Explainer(tuple(numeric), tuple(categorical), edges, table, names or {})


def from_statistics(bins: Mapping[str, Sequence[float]], stats: Mapping[str, Sequence[tuple]], codes: Mapping[str, Mapping[int, float]] | None = None,
                    names: Mapping[str, Sequence[str]] | None = None) -> Explainer:
    """An explainer without a training table: edges, (share, mean, std, min, max) of every bin, and the share of every code."""
    table = {f: [(i, *s) for i, s in enumerate(stats[f])] for f in bins}
    for f, edges in bins.items():
        if len(stats[f]) != len(edges) + 1:
            raise ValueError(f"{f}: {len(edges)} edges make {len(edges) + 1} bins")
    table |= {f: [(c, n, float(c), 0.0, float(c), float(c)) for c, n in sorted(own.items())] for f, own in (codes or {}).items()}
    return Explainer(tuple(bins), tuple(codes or ()), {f: sorted(map(float, e)) for f, e in bins.items()}, table, names or {})


def _bin(f: str, edges: Mapping[str, list[float]]) -> Column:
    return bin_index(F.col(f), F.array(*[F.lit(e) for e in edges[f]]).cast("array<double>"))


def alias_table(weights: Sequence[float]) -> tuple[list[int], list[int]]:
    """For each column: the height, of ``DRAWS``, below which its own slot is drawn, and the slot drawn above.

    The poorest slot is filled up from the richest one until none is poor. Counts are handled as whole
    numbers, so any engine makes the same table.
    """
    if any(int(w) != w for w in weights):
        weights = [round(w * (1 << 40)) for w in weights]
    k, whole = len(weights), int(sum(weights))
    if not whole:
        return [DRAWS] * k, list(range(k))
    mass = [int(w) * k for w in weights]
    poor = [(m, i) for i, m in enumerate(mass) if m < whole]
    rich = [(-m, i) for i, m in enumerate(mass) if m >= whole]
    heapify(poor)
    heapify(rich)
    cut, other = [DRAWS] * k, list(range(k))
    while poor:
        m, i = heappop(poor)
        j = heappop(rich)[1]
        cut[i], other[i] = m * DRAWS // whole, j
        mass[j] -= whole - m
        heappush(*((poor, (mass[j], j)) if mass[j] < whole else (rich, (-mass[j], j))))
    return cut, other


def perturb(examples: DataFrame, ex: Explainer, key: str, samples: int, seed: int = 7) -> DataFrame:
    """(key, sample, <features>, same, differ): drawn neighbours of each example, sample 0 is the example itself.

    ``same`` holds 1 per feature that falls in the example's bin or has its code, ``differ`` counts the
    others. Categories that are 0 in the example stay 0, as their sparse entries are never drawn. Within
    a bin a value is drawn around the bin mean and kept inside the bin. Draws are ``mix`` of the row's
    number, so a lost task redraws the same values. Columns are made in steps, each used more than
    once by the next, so nothing is drawn twice.
    """
    first, number = F.col("sample") == 0, F.col(key) * samples + F.col("sample")
    own = {f"_own{i}": _bin(f, ex.edges) for i, f in enumerate(ex.features) if f in ex.numeric}
    rows = _spread(examples.select(key, *ex.features, *[c.alias(n) for n, c in own.items()]), key, samples)
    at, slot, values, same = {}, {}, [], []
    for i, f in enumerate(ex.features):
        k = len(ex.table[f])
        at[f"_at{i}"] = mix(number, seed * 1_000 + 3 * i) * k
        cut, other = alias_table([r[1] for r in ex.table[f]])
        column = int_div(F.col(f"_at{i}"), DRAWS)
        slot[f"_slot{i}"] = F.when(F.col(f"_at{i}") % DRAWS < _pick(cut, column), column.cast("int")).otherwise(_pick(other, column).cast("int"))
        drawn = F.col(f"_slot{i}")
        code = _pick([r[0] for r in ex.table[f]], drawn)
        if f in ex.numeric:
            u, v = (mix(number, seed * 1_000 + 3 * i + j) for j in (1, 2))
            slot[f"_z{i}"] = F.sqrt(-2 * F.log((u + 1) / F.lit(float(DRAWS)))) * F.cos(v * F.lit(2 * np.pi / DRAWS))
            mean, std, lo, hi = (_pick([float(r[j]) for r in ex.table[f]], drawn) for j in (2, 3, 4, 5))
            inside = F.greatest(lo, F.least(hi, mean + std * F.col(f"_z{i}")))
            values.append(F.when(first, F.col(f).cast("double")).otherwise(inside).alias(f))
            same.append(F.when(first | (code == F.col(f"_own{i}")), 1).otherwise(0))
        else:
            keep = first | (F.col(f) == 0)
            values.append(F.when(keep, F.col(f)).otherwise(code).cast("double").alias(f))
            same.append(F.when(keep | (code == F.col(f)), 1).otherwise(0))
    rows = rows.withColumns(at).withColumns(slot)
    flags = [s.alias(f"_same{i}") for i, s in enumerate(same)]
    # Two steps: a lambda reads an alias of its own select before the input column of that name.
    rows = rows.select(F.col(key), F.col("sample"), *values, *flags)
    parts = [F.col(f"_same{i}") for i in range(len(flags))]
    return rows.select(key, "sample", *ex.features, F.array(*parts).cast("array<int>").alias("same"), (F.lit(len(parts)) - total(parts)).alias("differ"))


def _spread(rows: DataFrame, key: str, samples: int) -> DataFrame:
    """Rows repeated with ``sample`` 0.., in tasks of about ``TASK_ROWS``: examples are few bytes and would be drawn from by as few
    tasks as read them. Parts of an example's samples are dealt, so one example with many samples is spread as well."""
    tasks, draws = min(-(-rows.count() * samples // TASK_ROWS), 100_000), F.sequence(F.lit(0), F.lit(samples - 1))
    if samples <= PART_SAMPLES:
        return (rows.repartition(tasks, key) if tasks > 1 else rows).select("*", F.explode(draws).alias("sample"))
    parts = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(PART_SAMPLES))).alias("_from"))
    until = F.least(F.col("_from") + (PART_SAMPLES - 1), F.lit(samples - 1))
    return (parts.repartition(tasks, key, "_from") if tasks > 1 else parts).select("*", F.explode(F.sequence("_from", until)).alias("sample")).drop("_from")


def _pick(values: Sequence, index: Column) -> Column:
    """An entry of a constant array."""
    return F.get(F.lit(np.array(values if len(values) else [0])), index)


def kernel_weight(distance: Column, width: float) -> Column:
    return F.sqrt(F.exp(-(distance * distance) / F.lit(float(width) ** 2)))


def default_width(features: int) -> float:
    return 0.75 * features ** 0.5


def neighbour_weights(perturbed: DataFrame, width: float) -> DataFrame:
    """Distance to the example in 0/1 space is the root of the number of features that differ."""
    return perturbed.withColumn("weight", kernel_weight(F.sqrt(F.col("differ").cast("double")), width))


def rules(examples: DataFrame, ex: Explainer, key: str) -> DataFrame:
    """(key, pos, rule): rule text of every feature of an example."""
    texts = []
    for i, f in enumerate(ex.features):
        if f in ex.numeric:
            e, b = ex.edges[f], _bin(f, ex.edges)
            names = [f] if not e else [f"{f} <= {e[0]:.2f}"] + [f"{a:.2f} < {f} <= {c:.2f}" for a, c in zip(e, e[1:])] + [f"{f} > {e[-1]:.2f}"]
            text = F.element_at(F.array(*[F.lit(n) for n in names]), b + 1)
        else:
            known = ex.names.get(f)
            code = F.col(f).cast("int")
            name = F.coalesce(F.get(F.array(*[F.lit(v) for v in known]), code), code.cast("string")) if known else code.cast("string")
            text = F.concat(F.lit(f + "="), name)
        texts.append(F.struct(F.lit(i).alias("pos"), text.alias("rule")))
    return examples.select(key, F.inline(F.array(*texts)))


def explain(examples: DataFrame, ex: Explainer, score, key: str, samples: int, num_features: int,
            width: float | None = None, seed: int = 7, method: str = "lasso_path") -> DataFrame:
    """(key, rank, rule, weight) for every example. ``score`` adds ``score`` to feature rows, in any order of rows."""
    width = width or default_width(len(ex.features))
    # Each example becomes ``samples`` rows, so the few input rows are spread out first.
    examples = examples.repartition(slice_count(examples), key)
    near = score(neighbour_weights(perturb(examples, ex, key, samples, seed), width))
    fits = local_fit(near, key, num_features, method)
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc(F.abs("weight")), "pos"))
    return fits.join(rules(examples, ex, key), [key, "pos"]).select(key, rank.alias("rank"), "rule", "weight")


def explain_one(examples: DataFrame, ex: Explainer, score, key: str, value, date=None, **kw) -> DataFrame:
    """Explanation of one client, or of one client at one date."""
    df = examples.where(F.col(key) == value)
    return explain(df.where(F.col("Date") == date) if date is not None else df, ex, score, key, **kw)


def explain_select(df: DataFrame, order: str, pred: str = "pred", label: str = "y", everything: bool = True,
                   chunk: int = 1_000_000) -> DataFrame:
    """Examples worth explaining: all, or every predicted or actual positive and the row that
    directly follows a predicted positive."""
    if everything:
        return df
    rows = prior_row(df.withColumn("_k", F.lit(0)), ["_k"], [order, pred], order, "_p", chunk)
    return rows.where((F.col(pred) == 1) | (F.col(label) == 1) | (F.col("_p")[pred] == 1)).drop("_k", "_p")


# --- summaries of explanations -------------------------------------------------------------------

def avg_rule_weight(exps: DataFrame) -> DataFrame:
    return exps.groupBy("rule").agg(F.avg("weight").alias("weight"))


def rule_importance(exps: DataFrame, key: str = "exp_id") -> DataFrame:
    """(rule, importance): root of the total absolute weight of a rule over explanations."""
    w = exps.groupBy(key, "rule").agg(F.sum("weight").alias("w"))
    return w.groupBy("rule").agg(F.sqrt(F.sum(F.abs("w"))).alias("importance"))


def greedy_pick(exps: DataFrame, picks: int, key: str = "exp_id", held: int = 2_048) -> DataFrame:
    """(step, exp_id, coverage): explanations that together cover the most important rules.

    Each step adds the explanation with the largest importance of rules not yet covered, the last
    one on ties. What an explanation adds can only fall as others are picked, so a gain once known bounds it
    from above (Minoux 1978): of a queue by bounds only the head is reckoned anew, until it keeps its place. The queue
    holds the ``held`` best; when its head falls below what was left outside, gains of all are made again in one scan.
    """
    spark = exps.sparkSession
    w = exps.groupBy(key, "rule").agg(F.sum("weight").alias("w"))
    per = (w.join(rule_importance(exps, key), "rule").groupBy(key)
           .agg(F.collect_list(F.when(F.col("w") != 0, F.struct("rule", "importance"))).alias("rules")).persist())
    chosen: list[tuple[int, int, float]] = []
    covered: set[str] = set()
    queue: list[tuple[float, int]] = []
    rules: dict[int, list[tuple[str, float]]] = {}
    outside, total_gain = None, 0.0

    def gain(e: int) -> float:
        return round(sum(sorted(v for r, v in rules[e] if r not in covered)), 9)

    while len(chosen) < picks:
        best = None
        while queue:
            bound, e = -queue[0][0], -queue[0][1]
            now = gain(e)
            if now < bound:
                heapreplace(queue, (-now, -e))
            else:
                best = (now, e)
                break
        if best is None or (outside is not None and best < outside):
            left = F.filter("rules", lambda r: ~r["rule"].isin(sorted(covered))) if covered else F.col("rules")
            sums = F.round(F.aggregate(F.array_sort(F.transform(left, lambda r: r["importance"])), F.lit(0.0), lambda s, v: s + v), 9)
            open_ = per.where(~F.col(key).isin([c[1] for c in chosen])) if chosen else per
            rows = open_.select(sums.alias("g"), key, "rules").orderBy(F.desc("g"), F.desc(key)).limit(held).collect()
            if not rows:
                break
            rules = {r[key]: [(x["rule"], x["importance"]) for x in r["rules"]] for r in rows}
            queue = [(-gain(r[key]), -r[key]) for r in rows]
            heapify(queue)
            outside = (rows[-1]["g"], rows[-1][key]) if len(rows) == held else None
            best = (-queue[0][0], -queue[0][1])
        heappop(queue)
        covered |= {r for r, _ in rules[best[1]]}
        total_gain += best[0]
        chosen.append((len(chosen) + 1, best[1], total_gain))
    per.unpersist()
    return spark.createDataFrame(chosen, f"step int, {key} long, coverage double")


def top_rules_by_sign(avg: DataFrame, shown: int) -> DataFrame:
    """The strongest rules of each sign, half of ``shown`` for the commoner sign and the other kept in
    proportion."""
    half = shown // 2
    pos = F.col("weight") >= 0
    n = avg.agg(F.struct(F.count_if(pos).alias("p"), F.count_if(~pos).alias("q"))).scalar()
    p, q = F.col("_n.p"), F.col("_n.q")
    ratio = p / F.when(q > 0, q)
    more = F.least(F.when(ratio >= 1, p).otherwise(q), F.lit(half))
    keep = (F.when(q == 0, F.when(pos, F.lit(half)).otherwise(0))
            .when(ratio >= 1, F.when(pos, more).otherwise(F.floor(more / ratio)))
            .otherwise(F.when(pos, F.floor(more * ratio)).otherwise(more)))
    # Rules are features x bins; rank within a sign.
    rank = F.row_number().over(W.partitionBy(pos).orderBy(F.desc(F.abs("weight")), "rule"))
    return (avg.withColumn("_n", n).withColumn("_r", rank).withColumn("_k", keep).where(F.col("_r") <= F.col("_k"))
            .select("rule", "weight"))


def short_text(rule: Column, width: int = 87, ends: int = 40) -> Column:
    return F.when(F.length(rule) >= width, F.concat(F.left(rule, F.lit(ends)), F.lit(" . . . "), F.right(rule, F.lit(ends)))).otherwise(rule)

"""Mixed-type clustering: k-prototypes (Huang 1998) and its silhouette.

Rows carry numerics as ``x`` (scaled, array of double) and categories as ``c`` (array of codes).
Centroids live on the driver: k of them, as wide as a row, independent of the number of rows. Each
iteration is one aggregation over the table for all restarts at once; no lineage builds up, since
an iteration only depends on the table and on literal centroids.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.functions.exprs import sq_distance, total as add_up
from spanledger.session import cut_lineage


@dataclass(frozen=True)
class Centroid:
    x: tuple[float, ...]
    c: tuple[int, ...] = ()


def _doubles(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(a)) for a in v]).cast("array<double>")


def _ints(v: Sequence[int]) -> Column:
    return F.array(*[F.lit(int(a)) for a in v]).cast("array<int>")


def mixed_distance(x: Column, c: Column, to: Centroid, gamma: float) -> Column:
    """Squared Euclidean distance plus ``gamma`` per differing category."""
    d = sq_distance(x, _doubles(to.x)) if to.x else F.lit(0.0)
    if to.c:
        d = d + gamma * F.aggregate(F.zip_with(c, _ints(to.c), lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, v: s + v)
    return d


def _nearest(df: DataFrame, runs: Sequence[Sequence[Centroid]], gamma: float) -> Column:
    """Array over runs of (run, cluster 1..k, cost); the lowest label wins ties."""
    def one(r, cents):
        ds = F.array(*[mixed_distance(F.col("x"), F.col("c"), c, gamma) for c in cents])
        return F.struct(F.lit(r).alias("run"), F.array_position(ds, F.array_min(ds)).cast("int").alias("cluster"),
                        F.array_min(ds).alias("cost"))
    return F.array(*[one(r, cents) for r, cents in enumerate(runs)])


def assign(df: DataFrame, centroids: Sequence[Centroid], gamma: float) -> DataFrame:
    """Adds ``cluster`` 1..k and ``cost``."""
    df = df if "c" in df.columns else df.withColumn("c", F.array().cast("array<int>"))
    a = _nearest(df, [centroids], gamma)[0]
    return df.withColumn("_a", a).withColumn("cluster", F.col("_a.cluster")).withColumn("cost", F.col("_a.cost")).drop("_a")


def update(assigned: DataFrame, width: int, cats: int, keys: Sequence[str] = ("cluster",)) -> DataFrame:
    """(keys, x, c, n, cost): mean of the numerics, most frequent category (lowest code on ties)."""
    means = assigned.groupBy(*keys).agg(
        F.array(*[F.avg(F.col("x")[i]) for i in range(width)]).cast("array<double>").alias("x"), F.count("*").alias("n"),
        F.sum("cost").alias("cost"))
    if not cats:
        return means.withColumn("c", F.array().cast("array<int>"))
    counts = (assigned.select(*keys, F.posexplode("c").alias("pos", "v")).groupBy(*keys, "pos", "v").agg(F.count("*").alias("m")))
    modes = (counts.groupBy(*keys, "pos").agg(F.max(F.struct("m", (-F.col("v")).alias("v")))["v"].alias("v"))
             .groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", (-F.col("v")).alias("v")))),
                                             lambda s: s["v"]).alias("c")))
    return means.join(modes, list(keys))


def numeric_spread(df: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population std per numeric."""
    r = df.agg(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(width)],
               *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(width)]).first()
    return np.array([r[f"m{i}"] for i in range(width)]), np.array([r[f"s{i}"] for i in range(width)])


def default_gamma(std: np.ndarray) -> float:
    """Weight of a category mismatch: half the mean spread of the numerics (Huang 1997)."""
    return 0.5 * float(std.mean()) if len(std) else 1.0


def cao_init(df: DataFrame, k: int) -> list[tuple[int, ...]]:
    """Categorical seeds by density and distance (Cao, Liang, Bai 2009).

    Works on the distinct category rows with their counts. One aggregation per seed.
    """
    rows = df.groupBy("c").agg(F.count("*").alias("w"))
    n = df.count()
    freq = rows.select(F.posexplode("c").alias("pos", "v"), "w").groupBy("pos", "v").agg(F.sum("w").alias("f"))
    dens = (rows.select("c", F.posexplode("c").alias("pos", "v")).join(freq, ["pos", "v"])
            .groupBy("c").agg((F.sum("f") / (F.lit(float(n)) * F.max(F.size("c")))).alias("dens"))).persist()
    seeds: list[tuple[int, ...]] = []
    for _ in range(k):
        score = F.col("dens")
        if seeds:
            far = [F.aggregate(F.zip_with("c", _ints(s), lambda a, b: (a != b).cast("int")), F.lit(0), lambda t, v: t + v)
                   for s in seeds]
            score = (F.least(*far) if len(far) > 1 else far[0]) * F.col("dens")
        seeds.append(tuple(dens.agg(F.max(F.struct(score.alias("s"), "c"))["c"]).first()[0]))
    dens.unpersist()
    return seeds


def _sweep(df: DataFrame, runs: Sequence[Sequence[Centroid]], gamma: float, width: int, cats: int) -> list:
    """One pass for all restarts: (run, cluster, n, s, cost, modes), at most runs * k rows.

    Tasks assign their Arrow batches by matrix products and send on sums per cluster; category counts
    are merged by Spark.
    """
    k = len(runs[0])
    cx = np.array([c.x for cents in runs for c in cents]).reshape(len(runs) * k, width)
    cc = np.array([c.c for cents in runs for c in cents], dtype=int).reshape(len(runs) * k, cats)

    def task(batches):
        n, s, cost = np.zeros(len(cx)), np.zeros((len(cx), width)), np.zeros(len(cx))
        seen: dict[tuple[int, int, int], int] = {}
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, width)
            c = b.column("c").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, cats).astype(int)
            d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ cx.T + (cx * cx).sum(1)[None, :], 0)
            for j in range(cats):
                d += gamma * (c[:, j, None] != cc[None, :, j])
            d = d.reshape(b.num_rows, len(runs), k)
            best = d.argmin(2)
            for r in range(len(runs)):
                slot = r * k + best[:, r]
                n += np.bincount(slot, minlength=len(cx))
                cost += np.bincount(slot, d[np.arange(b.num_rows), r, best[:, r]], minlength=len(cx))
                for i in np.unique(slot):
                    mine = slot == i
                    s[i] += x[mine].sum(0)
                    for j in range(cats):
                        for v, m in zip(*np.unique(c[mine, j], return_counts=True)):
                            seen[i, j, v] = seen.get((i, j, v), 0) + int(m)
        rows = [(int(i), -1, 0, int(n[i]), s[i].tolist(), float(cost[i])) for i in np.flatnonzero(n)]
        rows += [(int(i), int(j), int(v), m, [], 0.0) for (i, j, v), m in seen.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(("slot", "pos", "v", "n", "s", "cost"), r)) for r in rows], schema=_PARTIAL)

    parts = df.mapInArrow(task, "slot int, pos int, v int, n long, s array<double>, cost double")
    merged = parts.groupBy("slot", "pos", "v").agg(
        F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(i))) for i in range(width)]).cast("array<double>").alias("s"),
        F.sum("cost").alias("cost"))
    # Most frequent category per position, the lowest code on ties.
    top = (merged.groupBy("slot", "pos").agg(F.max(F.struct("n", (-F.col("v")).alias("v"), "s", "cost")).alias("m")).collect())
    out: dict[int, dict] = {}
    for r in sorted(top, key=lambda r: r["pos"]):
        if r["pos"] < 0:
            out[r["slot"]] = {"run": r["slot"] // k, "cluster": r["slot"] % k, "n": r["m"]["n"], "s": r["m"]["s"],
                              "cost": r["m"]["cost"], "modes": []}
        else:
            out[r["slot"]]["modes"].append(-r["m"]["v"])
    return list(out.values())


_PARTIAL = pa.schema([("slot", pa.int32()), ("pos", pa.int32()), ("v", pa.int32()), ("n", pa.int64()),
                      ("s", pa.list_(pa.float64())), ("cost", pa.float64())])


@dataclass(frozen=True)
class Clustering:
    centroids: list[Centroid]
    gamma: float
    cost: float
    iterations: int
    # False where the most iterations allowed were used up while centroids still moved.
    converged: bool = True


def kprototypes(df: DataFrame, k: int, n_runs: int = 15, max_iter: int = 100, seed: int = 7, gamma: float | None = None) -> Clustering:
    """Best of ``n_runs`` restarts, each iterated until no centroid moves.

    Numeric seeds are drawn around the column means, categorical seeds by density. All restarts that
    still move share one pass over the table.
    """
    df = df if "c" in df.columns else df.withColumn("c", F.array().cast("array<int>"))
    first = df.select(F.size("x"), F.size("c")).first()
    width, cats = int(first[0]), max(0, int(first[1]))
    mean, std = numeric_spread(df, width)
    gamma = default_gamma(std) if gamma is None else gamma
    seeds = cao_init(df, k) if cats else [()] * k
    rng = np.random.default_rng(seed)
    runs = {r: [Centroid(tuple(mean + rng.standard_normal(width) * std), c) for c in seeds] for r in range(n_runs)}
    done: dict[int, Clustering] = {}
    df = df.select("x", "c").persist()
    for it in range(1, max_iter + 1):
        order = list(runs)
        new: dict[int, dict[int, Centroid]] = {}
        cost: dict[int, float] = {}
        for row in _sweep(df, [runs[r] for r in order], gamma, width, cats):
            r = order[row["run"]]
            new.setdefault(r, {})[row["cluster"]] = Centroid(tuple(v / row["n"] for v in row["s"]), tuple(row["modes"]))
            cost[r] = cost.get(r, 0.0) + row["cost"]
        for r in order:
        # An empty cluster keeps its centroid.
            moved = [new[r].get(i, old) for i, old in enumerate(runs[r])]
            still = all(np.allclose(a.x, b.x, rtol=0, atol=1e-9) and a.c == b.c for a, b in zip(moved, runs[r]))
            runs[r] = moved
            if still or it == max_iter:
                done[r] = Clustering(moved, gamma, cost[r], it, still)
                del runs[r]
        if not runs:
            break
    df.unpersist()
    return min(done.values(), key=lambda c: c.cost)


# --- silhouette ----------------------------------------------------------------------------------

def silhouette_rows(df: DataFrame, gamma: float = 0.0) -> DataFrame:
    """Adds ``silhouette`` to rows with ``x``, ``c`` and ``cluster``, over the whole table.

    The distance is squared Euclidean plus mismatches, so the mean distance of a row to a cluster
    follows from the cluster's size, vector sum, squared norm and category counts. That makes it
    exact in two linear passes, without pairs and without sampling. A cluster of one scores 0. Only what
    is known of whole clusters comes to the driver.
    """
    df = df if "c" in df.columns else df.withColumn("c", F.array().cast("array<int>"))
    size = df.select(F.size("x"), F.size("c")).first()
    width, cats = int(size[0]), max(0, int(size[1]))
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)
    stats = df.withColumn("_n2", norm).groupBy("cluster").agg(
        F.count("*").alias("n"), F.sum("_n2").alias("q"), F.array(*[F.sum(F.col("x")[i]) for i in range(width)]).cast("array<double>").alias("s"))
    stats = sorted(stats.collect(), key=lambda r: r["cluster"])
    rows, ids = df.withColumn("_n2", norm), [r["cluster"] for r in stats]
    if cats:
        # How often each code stands at each position in every cluster; joined position by position, however many codes there are.
        seen = (df.select("cluster", F.posexplode("c").alias("pos", "v")).groupBy("pos", "v")
                .agg(F.array(*[F.count_if(F.col("cluster") == i) for i in ids]).alias("m")))
        seen = cut_lineage(seen)
        for p in range(cats):
            own = seen.where(F.col("pos") == p).select(F.col("v").alias(f"_v{p}"), F.col("m").alias(f"_m{p}"))
            rows = rows.join(own, F.col("c")[p] == F.col(f"_v{p}"), "left").drop(f"_v{p}")

    def mean_to(r, own: bool) -> Column:
        dot = F.aggregate(F.zip_with("x", _doubles(r["s"]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        total = F.col("_n2") * float(r["n"]) - 2.0 * dot + float(r["q"])
        if cats:
            hits = add_up([F.coalesce(F.col(f"_m{p}")[ids.index(r["cluster"])], F.lit(0)) for p in range(cats)])
            total = total + gamma * (float(r["n"]) * cats - hits)
        return total / float(r["n"] - 1 if own else r["n"])

    mine, others = F.lit(None).cast("double"), []
    for r in stats:
        here = F.col("cluster") == r["cluster"]
        if r["n"] > 1:
            mine = F.when(here, mean_to(r, True)).otherwise(mine)
        others.append(F.when(~here, mean_to(r, False)))
    b = F.least(*others) if len(others) > 1 else others[0]
    return (rows.withColumn("_a", mine).withColumn("_b", b)
            .withColumn("silhouette", F.when(F.col("_a").isNull() | F.col("_b").isNull(), 0.0)
                        .otherwise(F.when(F.greatest("_a", "_b") > 0, (F.col("_b") - F.col("_a")) / F.greatest("_a", "_b")).otherwise(0.0)))
            .drop("_n2", "_a", "_b", *[f"_m{p}" for p in range(cats)]))


def silhouette(df: DataFrame, gamma: float = 0.0) -> DataFrame:
    return silhouette_rows(df, gamma).agg(F.avg("silhouette").alias("silhouette"))


def silhouette_by_k(df: DataFrame, k_min: int = 2, k_max: int = 20, **kw) -> DataFrame:
    """(k, silhouette): one clustering per k."""
    scores = []
    for k in range(k_min, k_max + 1):
        model = kprototypes(df, k, **kw)
        scores.append((k, silhouette(assign(df, model.centroids, model.gamma), model.gamma).first()[0]))
    return df.sparkSession.createDataFrame(scores, "k int, silhouette double")


def best_k(scores: DataFrame) -> DataFrame:
    """The k with the highest silhouette, the smallest on ties."""
    return scores.agg(F.max(F.struct("silhouette", (-F.col("k")).alias("k"))).alias("m")).select(
        (-F.col("m.k")).alias("k"), F.col("m.silhouette").alias("silhouette"))


# --- report --------------------------------------------------------------------------------------

def cluster_share(assigned: DataFrame, cluster: str = "cluster") -> DataFrame:
    """(cluster, pct): share of the rows in percent; the window sees one row per cluster."""
    return (assigned.groupBy(cluster).agg(F.count("*").alias("n"))
            .select(cluster, (100.0 * F.col("n") / F.sum("n").over(W.partitionBy(F.lit(0)))).alias("pct")))


def centroid_table(df: DataFrame, model: Clustering, nums: Sequence[str], cats: Sequence[str]) -> DataFrame:
    """(cluster, columns...): the k centroids as rows, numerics still scaled."""
    rows = [(i + 1, *map(float, c.x), *map(int, c.c)) for i, c in enumerate(model.centroids)]
    schema = ["cluster int", *[f"`{n}` double" for n in nums], *[f"`{c}` int" for c in cats]]
    return df.sparkSession.createDataFrame(rows, ", ".join(schema))

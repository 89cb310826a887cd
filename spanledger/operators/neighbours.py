"""Exact k nearest neighbours and the over-sampling built on them.

The join follows the pivot method for kNN joins (Lu et al., VLDB 2012): rows belong to the cell of
their nearest pivot, and a cell is cut into rings by the distance to it, each a block of bounded size. A
first pass over the nearest ring of the own cell bounds each block's neighbour distance. By the triangle
inequality a ring can be too near to its pivot or too far from it to hold a neighbour; only the block
pairs that are left are compared. A task holds two blocks, whatever the size of a cell; a row sends on at
most k candidates per compared block. The driver knows pivots and cells, about the root of the table over
eight, and no block. Over-sampling follows SMOTE (Chawla 2002) and ADASYN (He 2008).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from spanledger.functions.exprs import int_div, mix
from spanledger.functions.ordered import range_rank, rank_cuts, up_to
from spanledger.session import cut_lineage

BLOCK_ROWS = 4096
# Block pairs that are sent to the rows; more of them are joined by moving the rows once more.
MOST_PAIRS = 500_000
# Distances are compared with this slack, so rounding cannot rule out a true neighbour.
SLACK = 1e-9


def _cells(df: DataFrame, pivots: np.ndarray, block_rows: int) -> DataFrame:
    """(id, x, cell, pd, chunk): nearest pivot, distance to it, and the ring of the cell, the innermost first."""
    def assign(batches):
        for b in batches:
            x = np.stack(b["x"].to_numpy()) if len(b) else np.zeros((0, pivots.shape[1]))
            d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :], 0)
            cell = d.argmin(1)
            yield b.assign(cell=cell.astype("int32"), pd=np.sqrt(((x - pivots[cell]) ** 2).sum(1)))

    rows = df.select("id", "x").mapInPandas(assign, "id long, x array<double>, cell int, pd double")
    return range_rank(rows, "cell", ["pd", "id"], "chunk").withColumn("chunk", int_div(F.col("chunk") - 1, block_rows).cast("int"))


def _rings(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell", "chunk").agg(F.min("pd").alias("near"), F.max("pd").alias("far"), F.count("*").alias("n"))


def _compare(left: DataFrame, right: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(id, nb, d2): the k nearest of each left row within each paired right block."""
    lkeys = ["lcell", "lchunk"]
    rkeys = ["rcell", "rchunk"]
    if pairs.count() <= MOST_PAIRS:
        pairs = F.broadcast(pairs)
    ls = left.select(F.col("cell").alias("lcell"), F.col("chunk").alias("lchunk"), "id", "x").join(pairs, lkeys)
    rs = right.select(F.col("cell").alias("rcell"), F.col("chunk").alias("rchunk"), "id", "x").join(pairs, rkeys)

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": [], "nb": [], "d2": []})
        x, y = np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())
        ids, nbs = a["id"].to_numpy(), b["id"].to_numpy()
        size, out = (y * y).sum(1), []
        for at in range(0, len(x), 512):
            own, who = x[at:at + 512], ids[at:at + 512]
            # By one product, with slack for its rounding; the few that may be nearest are measured again.
            about = size[None, :] - 2 * own @ y.T + (own * own).sum(1)[:, None]
            about[who[:, None] == nbs[None, :]] = np.inf
            most = np.partition(about, min(k, len(y)) - 1, axis=1)[:, min(k, len(y)) - 1]
            slack = 1e-9 * (size.max() + (own * own).sum(1))
            row, column = np.nonzero((about <= (most + slack)[:, None]) & np.isfinite(about))
            d2 = ((own[row] - y[column]) ** 2).sum(1)
            order = np.lexsort((nbs[column], d2, row))
            row, column, d2 = row[order], column[order], d2[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = place < k
            out.append(pd.DataFrame({"id": who[row[keep]], "nb": nbs[column[keep]], "d2": d2[keep]}))
        return pd.concat(out)

    keys = lkeys + rkeys
    return (ls.select(*keys, "id", "x").groupBy(*keys).cogroup(rs.select(*keys, "id", "x").groupBy(*keys))
            .applyInPandas(nearest, "id long, nb long, d2 double"))


def _best(cands: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("id").orderBy("d2", "nb"))
    return cands.withColumn("rank", rank).where(F.col("rank") <= k)


def _named(blocks: DataFrame, side: str, *columns: str) -> DataFrame:
    return blocks.select(*[F.col(c).alias(side + c) for c in columns])


def block_pairs(left: DataFrame, right: DataFrame, pivots: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    """(candidates of the first pass, further block pairs that may hold neighbours)."""
    lblocks, rblocks = cut_lineage(_rings(left)), cut_lineage(_rings(right))
    l, r = _named(lblocks, "l", "cell", "chunk", "near", "far"), _named(rblocks, "r", "cell", "chunk", "near", "far")
    apart = F.abs(F.col("lnear") + F.col("lfar") - F.col("rnear") - F.col("rfar"))
    own = (l.join(r, F.col("lcell") == F.col("rcell")).groupBy("lcell", "lchunk", "rcell").agg(F.min(F.struct(apart.alias("d"), F.col("rchunk").alias("c")))["c"].alias("rchunk")))
    own = cut_lineage(own)
    first = cut_lineage(_compare(left, right, own, k))
    reach = (left.join(first.groupBy("id").agg(F.count("*").alias("_n"), F.max("d2").alias("_d")), "id", "left").groupBy("cell", "chunk")
             .agg(F.min("pd").alias("near"), F.max("pd").alias("far"),
                  F.max(F.when(F.col("_n") >= k, F.sqrt("_d")).otherwise(F.lit(float("inf")))).alias("reach")))
    # One row per cell.
    cells = {r_["cell"]: (r_["near"], r_["far"]) for r_ in rblocks.groupBy("cell").agg(F.min("near").alias("near"), F.max("far").alias("far")).collect()}
    number = np.array(sorted(cells), np.int32)
    inner, outer = (np.array([cells[c][i] for c in number.tolist()]) for i in (0, 1))
    gaps = np.sqrt(((pivots[:, None, :] - pivots[None, :, :]) ** 2).sum(-1))

    def cells_of(batches):
        for b in batches:
            for c, h, lo, hi, r_ in zip(b["cell"], b["chunk"], b["near"], b["far"], b["reach"]):
                # Distance of the block's rows to another pivot: between these two.
                to, up = (np.where(number == c, lo, gaps[c, number] - hi), np.where(number == c, hi, gaps[c, number] + hi))
                keep = (to - outer <= r_ * (1 + SLACK) + SLACK) & (inner - up <= r_ * (1 + SLACK) + SLACK)
                yield pd.DataFrame({"lcell": np.full(keep.sum(), c), "lchunk": np.full(keep.sum(), h), "rcell": number[keep], "at_least": to[keep], "at_most": up[keep],
                                    "reach": np.full(keep.sum(), r_)})

    asked = reach.mapInPandas(cells_of, "lcell int, lchunk int, rcell int, at_least double, at_most double, reach double")
    bound = F.col("reach") * (1 + SLACK) + SLACK
    more = (asked.join(r, "rcell").where((F.col("at_least") - F.col("rfar") <= bound) & (F.col("rnear") - F.col("at_most") <= bound))
            .select("lcell", "lchunk", "rcell", "rchunk"))
    return first, cut_lineage(more.join(own, ["lcell", "lchunk", "rcell", "rchunk"], "left_anti"))


def knn(queries: DataFrame, base: DataFrame, k: int, seed: int = 7, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, nb, d2, rank): the k nearest base rows of each query row, itself left out; ties by id.

    Both sides have ``id`` and ``x``. Exact.
    """
    n = base.count()
    # Cells and their number both grow with the root of the table.
    n_pivots = min(max(1, n // block_rows), 1 + math.isqrt(n) // 8)
    chosen = base.withColumn("_h", mix(F.col("id"), seed)).orderBy("_h", "id").limit(n_pivots).collect()
    if not chosen:
        return queries.select("id", F.lit(0).cast("long").alias("nb"), F.lit(0.0).alias("d2"), F.lit(0).alias("rank")).where("false")
    pivots = np.array([r["x"] for r in chosen])
    left, right = _cells(queries, pivots, block_rows), _cells(base, pivots, block_rows)
    first, more = block_pairs(left, right, pivots, k)
    return _best(first.unionByName(_compare(left, right, more, k)), k)


# --- synthetic minority rows ---------------------------------------------------------------------

def _unit(seed: int) -> F.Column:
    """Reproducible draw in [0, 1) from row and copy, the same on any re-execution and in any engine."""
    return mix(F.col("id") * 65_536 + F.col("copy"), seed) / F.lit(2_147_483_647.0)


def _between(picks: DataFrame, rows: DataFrame, near: DataFrame, seed: int) -> DataFrame:
    """(id, copy, nb, x): points between a minority row and one of its minority neighbours."""
    degree = near.groupBy("id").agg(F.max("rank").alias("_deg"))
    chosen = picks.join(degree, "id").withColumn(
        "rank", (F.floor(_unit(seed) * F.col("_deg")) + 1).cast("int"))
    gap = _unit(seed + 1)
    far = rows.select(F.col("id").alias("nb"), F.col("x").alias("_y"))
    return (chosen.join(near.select("id", "nb", "rank"), ["id", "rank"]).join(rows, "id").join(far, "nb")
            .withColumn("_g", gap)
            .select("id", "copy", "nb", F.zip_with("x", "_y", lambda a, b: a + F.col("_g") * (b - a)).alias("x")))


def _sizes(df: DataFrame, label: str) -> tuple[int, int, int]:
    """(minority label, its size, rows missing to parity)."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    few = min(sorted(n), key=n.get)
    return few, n[few], max(n.values()) - n[few]


def minority_knn(df: DataFrame, label: str, k: int = 5, **kw) -> DataFrame:
    few, _, _ = _sizes(df, label)
    rows = df.where(F.col(label) == few)
    return knn(rows, rows, k, **kw)


def smote(df: DataFrame, label: str, k: int = 5, seed: int = 7, **kw) -> DataFrame:
    """Synthetic rows (id, copy, nb, x) that bring the minority to parity."""
    few, m, need = _sizes(df, label)
    rows = df.where(F.col(label) == few).select("id", "x")
    _, (last,) = rank_cuts(rows, "id", seed, [need % m])
    times = F.lit(need // m) + up_to("id", seed, last).cast("int")
    picks = rows.select("id", times.alias("_t")).where("_t > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("_t"))).alias("copy"))
    return _between(picks, rows, knn(rows, rows, k, **kw), seed)


def adasyn_weights(df: DataFrame, label: str, k: int = 5, **kw) -> DataFrame:
    """(id, ratio, n_new): share of other classes among the k neighbours, and synthetic rows due."""
    few, _, need = _sizes(df, label)
    near = knn(df.where(F.col(label) == few).select("id", "x"), df.select("id", "x"), k, **kw)
    other = df.select(F.col("id").alias("nb"), (F.col(label) != few).cast("int").alias("_o"))
    ratio = near.join(other, "nb").groupBy("id").agg((F.sum("_o") / F.lit(float(k))).alias("ratio"))
    ratio = cut_lineage(ratio)
    # Where no minority row has a neighbour of another class, none is due.
    share = F.try_divide(F.col("ratio"), ratio.agg(F.sum("ratio")).scalar())
    return ratio.withColumn("n_new", F.coalesce(F.rint(share * need).cast("long"), F.lit(0).cast("long")))


def adasyn(df: DataFrame, label: str, k: int = 5, seed: int = 7, **kw) -> DataFrame:
    """Synthetic rows, more of them where the minority is surrounded by other classes."""
    few, _, _ = _sizes(df, label)
    rows = df.where(F.col(label) == few).select("id", "x")
    picks = (adasyn_weights(df, label, k, **kw).where("n_new > 0")
             .select("id", F.explode(F.sequence(F.lit(1), F.col("n_new").cast("int"))).alias("copy")))
    return _between(picks, rows, knn(rows, rows, k, **kw), seed)

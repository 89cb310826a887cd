"""Hard negatives by anchor-clustered shared lists.

Anchors of near directions form clusters. For a cluster the candidates are sorted once by an upper bound of their inner product with any member: a member
lies within the cluster's angle of its centroid, so its angle to a candidate is at least the candidate's angle to the centroid less that. Every member walks
this one list, in steps of matrix products, until no later candidate can enter its answer; equal scores are walked to their end, so the answer is exact.
The list of a cluster is cut into blocks of rows, each sorted and walked where it lies: a (cluster, block) pair is one row of a join by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanledger.llm.common import cut_lineage
from spanledger.llm.curriculum import ranked

#: Numbers in the matrix of a block of candidates and of a cluster at most; small tables have smaller ones, for more tasks.
BLOCK_NUMBERS, CLUSTER_NUMBERS = 1 << 22, 1 << 16
#: Anchors that the centroids are learnt on at most (the first by hash), and centroids at most.
SAMPLE, CENTROIDS = 8_192, 64
#: Entries of the list that are multiplied at once.
STEP = 512
_LEAST = np.iinfo(np.int64).min
_PACKED = "block long, ids binary, nulls binary, hashes binary, labels binary, kind string, dims int, matrix binary"


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, shorter ones filled with zeros."""
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(column)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def pack(rows: DataFrame, windows: bool = False) -> DataFrame:
    """One row per ``block``: its rows as matrices, in the smallest type of number that holds them."""
    schema = _PACKED + ", lows binary, highs binary" * windows

    def work(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        one = lambda c: part.column(c).chunk(0)
        x = _matrix(one("vector"))
        most = np.abs(x).max(initial=0)
        kind = "i2" if most < 1 << 15 else "i4" if most < 1 << 31 else "f8"
        ids = one("id")
        out = {"block": one("block")[:1], "ids": ids.fill_null(0).to_numpy().tobytes(), "nulls": ids.is_null().to_numpy(zero_copy_only=False).tobytes(),
               "hashes": one("h").to_numpy().tobytes(), "labels": one("label").to_numpy().astype(np.int64).tobytes(), "kind": kind, "dims": x.shape[1],
               "matrix": x.astype(kind).tobytes()}
        if windows:
            out |= {c: one(c).flatten().to_numpy().tobytes() for c in ("lows", "highs")}
        return pa.table({k: v if k == "block" else pa.array([v], pa.int32() if k == "dims" else None) for k, v in out.items()})

    kept = rows.select("block", "id", "h", F.col("label").cast("long").alias("label"), "vector", *(["lows", "highs"] if windows else []))
    return kept.groupBy("block").applyInArrow(work, schema)


def learn_centroids(sample: np.ndarray, wanted: int, rounds: int = 10) -> np.ndarray:
    """Unit centroids by k-means on directions, from seeds spread over the sample."""
    norm = np.linalg.norm(sample, axis=1)
    own = sample[norm > 0] / norm[norm > 0, None]
    centre = own[:: max(1, len(own) // max(1, wanted))][:wanted].copy()
    for _ in range(rounds if len(centre) > 1 else 0):
        near = np.argmax(own @ centre.T, axis=1)
        for c in range(len(centre)):
            total = own[near == c].sum(0)
            if (size := np.linalg.norm(total)) > 0:
                centre[c] = total / size
    return centre


def with_cluster(anchors: DataFrame, centre: np.ndarray) -> DataFrame:
    """Adds the number of the nearest centroid by angle."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("vector")))
            d = min(x.shape[1], centre.shape[1]) if len(centre) else 0
            near = np.argmax(x[:, :d] @ centre[:, :d].T, axis=1) if len(centre) else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "cluster"])

    return anchors.mapInArrow(work, ", ".join(f"{c} {k}" for c, k in anchors.dtypes) + ", cluster int")


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, as 64-bit numbers. Scores that these can't hold are an error."""
    most = np.abs(a).max(initial=0) * np.abs(x).max(initial=0) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a @ x.T).astype(np.int64)
    if most < 1 << 63:
        return a.astype(np.int64) @ x.T.astype(np.int64)
    raise ValueError("scores beyond 64 bits")


def bounds(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """For every row of ``x``: what its inner product with a member of unit length can be at most, rounding included."""
    na, nx = np.linalg.norm(a, axis=1), np.linalg.norm(x, axis=1)
    unit = a[na > 0] / na[na > 0, None]
    centre = unit.sum(0)
    size = np.linalg.norm(centre)
    if size < 1e-9:
        return nx * (1 + 1e-9)
    centre /= size
    wide = np.arccos(np.clip(unit @ centre, -1, 1)).max()
    with np.errstate(invalid="ignore", divide="ignore"):
        angle = np.where(nx > 0, np.arccos(np.clip(x @ centre / nx, -1, 1)), 0)
    return nx * (np.cos(np.clip(angle - wide - 1e-7, 0, np.pi)) + 1e-9)


def walk(a: np.ndarray, x: np.ndarray, tie: np.ndarray, fits, lows: np.ndarray, highs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """For each member and each of its windows (lows to highs, members x windows) the ``k`` best candidates in it, by score and then ``tie``.

    ``fits(members, candidates)``: which pairs count. Returns members, windows, candidates and scores, and how many products were made."""
    na, bound = np.linalg.norm(a, axis=1), bounds(a, x)
    order = np.argsort(-bound, kind="stable")
    n_windows = lows.shape[1]
    need = np.where(lows > highs, np.iinfo(np.int64).max, lows)  # what a candidate must reach to enter
    empty = np.zeros(0, np.int64)
    slot, cand, score = empty, empty, empty  # slot: member * windows + window
    active, made = np.arange(len(a)), 0
    for at in range(0, len(order), STEP):
        best = bound[order[at]]
        active = active[na[active] * best * np.where(best > 0, 1 + 1e-9, 1 - 1e-9) + 1e-6 >= need[active].min(1)]
        if not len(active):
            break
        part = order[at:at + STEP]
        s = products(a[active], x[part])
        made += s.size
        s[~fits(active, part)] = _LEAST
        for w in range(n_windows):
            low = need[active, w]
            own = np.where(s <= highs[active, w, None], s, _LEAST)
            if own.shape[1] > k:
                low = np.maximum(low, np.partition(own, own.shape[1] - k, axis=1)[:, own.shape[1] - k])
            m, c = np.nonzero((own >= low[:, None]) & (own > _LEAST))
            slot = np.concatenate([slot, active[m] * n_windows + w])
            cand, score = np.concatenate([cand, part[c]]), np.concatenate([score, own[m, c]])
        by = np.lexsort((tie[cand], -score, slot))
        slot, cand, score = slot[by], cand[by], score[by]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = rank == k - 1
        need.reshape(-1)[slot[last]] = np.maximum(need.reshape(-1)[slot[last]], score[last])
        slot, cand, score = slot[rank < k], cand[rank < k], score[rank < k]
    return slot // n_windows, slot % n_windows, cand, score, made


def _walks(pairs: DataFrame, k: int, windows: int, same: bool) -> DataFrame:
    """member, window, score, id and h of candidates, from rows that hold a cluster (c_...) and a block of candidates (x_...)."""
    def read(batch: dict, side: str):
        get = lambda c, t: np.frombuffer(batch[f"{side}_{c}"], t)
        ids = get("ids", np.int64)
        x = get("matrix", batch[f"{side}_kind"]).astype(float).reshape(len(ids), batch[f"{side}_dims"])
        return ids, get("nulls", bool), get("hashes", np.int64), get("labels", np.int64), x

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                aid, anull, ahash, alabel, a = read(row, "c")
                xid, xnull, xhash, xlabel, x = read(row, "x")
                d = max(a.shape[1], x.shape[1], 1)
                a, x = np.pad(a, ((0, 0), (0, d - a.shape[1]))), np.pad(x, ((0, 0), (0, d - x.shape[1])))
                tie = np.empty(len(xid), np.int64)
                tie[np.lexsort((xhash, xid, xnull))] = np.arange(len(xid))
                if same:
                    lows, highs = np.full((len(a), 1), _LEAST + 1), np.full((len(a), 1), np.iinfo(np.int64).max)
                    fits = lambda m, c: (alabel[m, None] == xlabel[c]) & ~((ahash[m, None] == xhash[c]) & (aid[m, None] == xid[c]) & (anull[m, None] == xnull[c]))
                else:
                    lows, highs = (np.frombuffer(row[f"c_{c}"], np.int64).reshape(len(a), windows).copy() for c in ("lows", "highs"))
                    fits = lambda m, c: alabel[m, None] != xlabel[c]
                m, w, c, s, _ = walk(a, x, tie, fits, lows, highs, k)
                yield pa.RecordBatch.from_arrays([pa.array(aid[m]), pa.array(ahash[m]), pa.array(alabel[m]), pa.array(w.astype(np.int32)), pa.array(s),
                                                  pa.array(xid[c], mask=xnull[c]), pa.array(xhash[c])], ["anchor", "anchor_h", "anchor_label", "window", "score", "id", "h"])

    return pairs.mapInArrow(work, "anchor long, anchor_h long, anchor_label long, window int, score long, id long, h long")


def _with_blocks(clusters: DataFrame, blocks: DataFrame, spans: Column) -> DataFrame:
    """Every cluster beside each block that it has to walk; a block is one row, so the join holds one at a time."""
    own = clusters.select(F.explode(spans).alias("block"), *(F.col(c).alias(f"c_{c}") for c in clusters.columns if c not in ("block", "first", "last", "own_first", "own_last")))
    return own.join(blocks.select("block", *(F.col(c).alias(f"x_{c}") for c in blocks.columns if c != "block")), "block")


def hard_negatives(vectors: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "vector", label: str = "label", positives: int = 5, negatives: int = 5,
                   least_percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, over anchors for which ``is_anchor`` holds.

    Vectors hold whole numbers; a score is the inner product with the anchor, higher ones first, ties by smaller key (null keys last). An anchor's positives
    are its best other rows of its label; for each of these, negatives are the best rows of other labels whose score is at most the positive's and at least
    ``least_percent`` of it. Null labels, null vectors and vectors with null or non-finite components take no part. Shorter vectors are filled with
    zeros. Rows equal in key, label and vector are one row; rows of equal key that differ are rows of their own (and anchors of their own).
    A null key is no anchor. No anchors, no rows: an empty result."""
    sound = F.col(label).isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"),
                                                                F.coalesce(is_anchor & F.col(key).isNotNull(), F.lit(False)).alias("anchor"))
    rows = rows.withColumn("h", F.xxhash64("label", "vector")).dropDuplicates(["id", "label", "h", "vector"])
    rows = cut_lineage(ranked(rows, [F.col("label"), F.col("h"), F.col("id")]))
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if("anchor"), F.max(F.size("vector"))).first()
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchors:
        return vectors.sparkSession.createDataFrame([], schema)
    block = min(max(1, BLOCK_NUMBERS // max(1, dims)), max(1024, n // 64))
    members = min(max(1, CLUSTER_NUMBERS // max(1, dims)), max(64, n_anchors // 8))
    blocks = cut_lineage(pack(rows.withColumn("block", F.expr(f"place div {block}"))))
    last_block = (n - 1) // block
    # Anchors by label and cluster, cut into runs: a run is a cluster with a list of its own.
    sample = rows.where("anchor").orderBy(F.xxhash64("h", "id"), "h", "id").limit(SAMPLE).select("vector").collect()
    learnt = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        learnt[i, :len(r[0])] = r[0]
    n_labels = rows.where("anchor").agg(F.approx_count_distinct("label")).first()[0]
    centre = learn_centroids(learnt, min(CENTROIDS, max(1, n_anchors // (members * n_labels))))
    anchors = with_cluster(rows.where("anchor").select("id", "label", "vector", "h"), centre)
    anchors = ranked(anchors, [F.col("label"), F.col("cluster"), F.col("h"), F.col("id")]).withColumn("block", F.expr(f"place div {members}"))
    # Where each label's rows lie among the blocks.
    spans = rows.groupBy("label").agg(F.expr(f"min(place) div {block}").alias("first"), F.expr(f"max(place) div {block}").alias("last"), F.min("place").alias("p0"), F.max("place").alias("p1"))
    anchors = cut_lineage(anchors.join(spans, "label"))
    run = anchors.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("p0").alias("p0"), F.max("p1").alias("p1"), F.count_distinct("label").alias("n_labels"))
    # Blocks that hold nothing but the only label of a run have no negatives for it.
    run = run.select("block", "first", "last", F.when(F.col("n_labels") == 1, F.expr(f"(p0 + {block - 1}) div {block}")).alias("own_first"),
                     F.when(F.col("n_labels") == 1, F.when(F.col("p1") == n - 1, F.lit(last_block)).otherwise(F.expr(f"(p1 + 1) div {block} - 1"))).alias("own_last"))
    found = _walks(_with_blocks(pack(anchors).join(run, "block"), blocks, F.sequence("first", "last")), positives, 1, True)
    who = ["anchor", "anchor_h", "anchor_label"]
    best = [F.desc("score"), F.asc_nulls_last("id"), F.asc("h")]
    top = found.withColumn("rank", F.row_number().over(Window.partitionBy(*who).orderBy(*best))).where(F.col("rank") <= positives)
    lists = cut_lineage(top.groupBy(*who).agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("list")))  # at most ``positives`` entries
    fill = lambda f, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(f(F.get("list", i)["score"]), F.lit(none)))
    # The least whole number of at least so many percent, and the score itself; a window that is not there holds nothing.
    low = lambda s: F.ceil((s.cast("decimal(19,0)") * F.lit(least_percent)) / F.lit(100)).cast("long")
    asking = anchors.join(lists.select(F.col("anchor").alias("id"), F.col("anchor_h").alias("h"), F.col("anchor_label").cast(anchors.schema["label"].dataType).alias("label"), "list"), ["id", "h", "label"])
    asking = asking.withColumn("lows", fill(low, 1)).withColumn("highs", fill(lambda s: s, 0))
    elsewhere = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(last_block).cast("long")), lambda b: F.coalesce((b < F.col("own_first")) | (b > F.col("own_last")), F.lit(True)))
    found = _walks(_with_blocks(pack(asking, windows=True).join(run, "block"), blocks, elsewhere), negatives, positives, False)
    rank = F.row_number().over(Window.partitionBy(*who, "window").orderBy(*best))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    out = found.join(lists, who).withColumn("positive", F.get("list", F.col("window")))
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                      F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"))

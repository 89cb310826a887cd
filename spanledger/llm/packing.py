"""Best-fit packing of token sequences by hierarchical residual packing.

Every partition best-fits its own items. Bins that are nearly full leave; the underfull ones travel on as items of the next round,
in fewer partitions, where best fit joins them. Rounds go on until one partition is left or a round no longer helps.
A row stays one item throughout and carries its bin, the bin's fill and its own place, so a round moves only underfull bins.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.arrays import chunks, texts_of
from spanledger.llm.common import cut_lineage
from spanledger.llm.pretokens import library_encoder

CAPACITY = 2048
#: A bin with at least this share of the capacity is done.
NEARLY_FULL = 0.99
#: Underfull bins that one task of a later round takes at most, on average; it holds a few narrow numbers of each.
TASK_BINS = 500_000
#: Partitions of a round that meet in one of the next.
FAN_IN = 8
PIECES = "piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document: its ids and the end id, cut from the end into pieces of ``capacity``; the first may be shorter.

    Null text is empty and gives one piece with the end id alone. Added tokens of the file are one id each. A null or repeated key is kept as it is.
    ``keep_ids`` adds the ids themselves as an array."""
    kind = docs.select(key).dtypes[0][1]
    fields = f"{key} {kind}, {PIECES}" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path, lower=False, added=True)
        for rows, _, _ in chunks(batches):
            ids, at = encoder.ids(texts_of(rows.column("text")))
            out: list[list] = [[], [], [], [], []]
            kept = []
            for i in range(len(rows)):
                own = np.append(ids[at[i]:at[i + 1]], np.uint32(end_id)).astype("<u4")
                edges = [0, *range(len(own) % capacity or capacity, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    for column, v in zip(out, (i, k, a, b - a, zlib.crc32(own[a:b].tobytes())), strict=True):
                        column.append(v)
                    if keep_ids:
                        kept.append(own[a:b].astype(np.int32))
            cols = [rows.column(key).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int32()), *(pa.array(c, pa.int64()) for c in out[2:])]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols.append(pa.array(kept, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(key, "text").mapInArrow(run, fields)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best fit in decreasing order: for every item the bin (number of the item that opened it) and its place there."""
    order = np.lexsort((np.arange(len(sizes)), -sizes))
    bins, place = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                there &= ~(1 << room)
        else:
            room, b = capacity, i
        bins[i], place[i] = b, capacity - room
        if room > size:
            open_bins[room - size].append(b)
            there |= 1 << (room - size)
    return bins, place


def pack_round(items: DataFrame, capacity: int) -> DataFrame:
    """Joins the bins of every partition. Partitions hold whole bins, sorted by bin; one task holds its partition's narrow rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if whole is None or not whole.num_rows:
            return
        ids, fill = (whole.column(c).to_numpy() for c in ("sequence_id", "fill"))
        first = np.ones(len(ids), bool)
        first[1:] = ids[1:] != ids[:-1]
        group = np.cumsum(first) - 1
        own, sizes = ids[first], fill[first]
        bins, place = best_fit(sizes, capacity)
        total = np.bincount(bins, weights=sizes, minlength=len(own)).astype(np.int64)
        for name, values in (("sequence_id", own[bins][group]), ("fill", total[bins][group]), ("offset", whole.column("offset").to_numpy() + place[group])):
            whole = whole.set_column(whole.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        yield from whole.to_batches(max_chunksize=50_000)

    return items.mapInArrow(run, items.schema)


def best_fit_packing(items: DataFrame, length: str = "length", capacity: int = CAPACITY, nearly_full: float = NEARLY_FULL,
                     task_bins: int = TASK_BINS, fan_in: int = FAN_IN) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to every item: whole items in as few sequences of ``capacity`` as best fit finds.

    Items are kept whole, each once, also if rows repeat. Lengths outside 1..capacity raise an error; null lengths too. An empty table
    gives an empty one. Columns of the items called sequence_id, offset or fill are replaced."""
    df = items.drop("sequence_id", "offset", "fill")
    size = F.col(length).cast("long")
    bad = F.raise_error(F.concat(F.lit("length outside 1..capacity: "), F.coalesce(size.cast("string"), F.lit("null"))))
    size = F.when(size.between(1, capacity), size).otherwise(bad.cast("long"))
    # The number of an item must never change again, so it is written before it is used.
    now = cut_lineage(df.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("fill", size).withColumn("offset", F.lit(0).cast("long")))
    names = [*df.columns, "sequence_id", "offset"]
    done = [now.where(F.col("fill") == capacity)]
    left = now.where(F.col("fill") < capacity)
    parts, before = max(1, now.rdd.getNumPartitions()), None
    while True:
        # Neighbouring partitions meet without a shuffle: a bin's items stand in one partition already.
        now = cut_lineage(pack_round(left.coalesce(parts).sortWithinPartitions("sequence_id", "offset"), capacity))
        done.append(now.where(F.col("fill") >= nearly_full * capacity))
        left = now.where(F.col("fill") < nearly_full * capacity)
        n = left.where(F.col("offset") == 0).count()
        before, parts = parts, max(-(-parts // fan_in), -(-n // task_bins))
        if not n or parts >= before:
            break
    done.append(left)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*names)

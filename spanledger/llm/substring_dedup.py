"""Removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words; its minimiser is the smallest fingerprint among its runs of ``run`` words. Consecutive windows with the same
minimiser form a super-k-mer. Equal windows have equal minimisers, so only super-k-mers whose minimiser stands in two documents can hold
a repeated window. Those of equal content (equal minimiser and 64-bit fingerprint of all words) are one; where contents differ,
one packed string of each goes to the bucket of its minimiser, and sorting ranks of words, pairs, fours and so on finds equal windows exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from spanledger.llm.arrays import _BASE, _INVERSE, chunks, flat, mix, powers, span_hashes, texts_of, words
from spanledger.llm.common import cut_lineage

WINDOW = 50
RUN = 8
#: Words of one bucket, on average; its task holds some numbers of each.
BUCKET_WORDS = 1_500_000
#: A minimiser with more different contents, or with contents of more bytes, is dealt out by window instead of sorted in one bucket.
HOT_CONTENTS, HOT_BYTES = 20_000, 12 * BUCKET_WORDS
#: Windows that are handed on at once.
WINDOW_BATCH = 20_000
#: Documents whose keys may be broadcast to pick their texts before a shuffle (about 35 MB as a hash table); more are joined by key.
PICKED_DOCS = 500_000
SUPER = "start int, n int, minimiser long, content long"


def super_kmers(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """key, text_hash and SUPER of every super-k-mer: first word, number of windows, minimiser, fingerprint of the words. Null keys have none."""
    span = window - run + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            starts, ends, at = words(data, off)
            if len(starts) < window:
                continue
            own = span_hashes(data, starts, ends)
            n = len(own)
            grams = np.zeros(n - run + 1, np.uint64)
            for j in range(run):
                grams += own[j:n - run + 1 + j] * np.uint64(pow(_BASE, j + 3, 1 << 64))
            low, have = mix(grams), 1
            whole = low
            while have < span:
                step = min(have, span - have)
                low, have = np.minimum(low[:len(low) - step], low[step:]), have + step
            doc = np.repeat(np.arange(len(rows)), np.diff(at))[:len(low)]
            fits = np.flatnonzero(np.arange(len(low)) + window <= at[doc + 1])
            if not len(fits):
                continue
            low, doc = low[fits], doc[fits]
            new = np.ones(len(fits), bool)
            new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(fits)))
            begin, doc = fits[first], doc[first]
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(own * powers(_BASE, n), out=total[1:])
            stop = begin + count + window - 1
            content = mix((total[stop] - total[begin]) * powers(_INVERSE, n + 1)[begin] + count.astype(np.uint64))
            del whole
            take = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [rows.column(key).take(take), rows.column("text_hash").take(take), pa.array((begin - at[doc]).astype(np.int32)), pa.array(count.astype(np.int32)),
                 pa.array(low[first].view(np.int64)), pa.array(content.view(np.int64))], [key, "text_hash", "start", "n", "minimiser", "content"])

    kind = docs.select(key).dtypes[0][1]
    return _hashed(docs.select(key, "text").where(F.col(key).isNotNull())).mapInArrow(work, f"{key} {kind}, text_hash long, {SUPER}")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text_hash", F.xxhash64("text"))


def _picked(docs: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """Rows of ``docs`` whose keys occur; if they are few enough, before any shuffle of texts."""
    own = cut_lineage(keys.select(*names).distinct())
    return docs.join(F.broadcast(own), names, "left_semi") if own.count() <= PICKED_DOCS else docs


def packed_strings(docs: DataFrame, wanted: DataFrame, key: str, window: int) -> DataFrame:
    """minimiser, content, first (the key), packed: the words of each wanted super-k-mer, joined by one space."""
    names = [key, "text_hash"]
    lists = wanted.groupBy(*names).agg(F.collect_list(F.struct("start", "n", "minimiser", "content")).alias("wanted"))
    both = _picked(_hashed(docs.select(key, "text").where(F.col(key).isNotNull())), wanted, names).dropDuplicates(names).join(lists, names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            starts, ends, at = words(data, off)
            raw, out = data.tobytes(), ([], [], [], [])
            for i, (doc, wants) in enumerate(zip(rows.column(key).to_pylist(), rows.column("wanted").to_pylist(), strict=True)):
                for w in wants:
                    a = at[i] + w["start"]
                    for column, v in zip(out, (w["minimiser"], w["content"], doc, b" ".join(raw[starts[a]:ends[a + w["n"] + window - 2]].split())), strict=True):
                        column.append(v)
            kinds = (pa.int64(), pa.int64(), rows.schema.field(key).type, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["minimiser", "content", "first", "packed"])

    kind = docs.select(key).dtypes[0][1]
    return both.select(key, "text", "wanted").mapInArrow(work, f"minimiser long, content long, first {kind}, packed binary")


def window_ranks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int) -> np.ndarray:
    """Equal numbers for equal sequences of ``window`` words, by sorting ranks of ever longer runs; the last ``window`` - 1 places have no meaning."""
    edges = np.empty(2 * len(starts), np.int64)
    edges[0::2], edges[1::2] = starts, ends
    whole = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(data.tobytes())])
    rank = whole.take(pa.array(np.arange(0, len(edges) - 1, 2))).dictionary_encode().indices.to_numpy().astype(np.int64)
    have = 1
    while have < window:
        step = min(have, window - have)
        pair = rank[:-step] * (int(rank.max()) + 1) + rank[step:]
        rank, have = np.unique(pair, return_inverse=True)[1].astype(np.int64), have + step
    return rank


def _older(window: int, key: str):
    """For each content of a bucket: runs of its windows that stand in an older document than its own first one."""
    def work(bucket: pa.Table) -> pa.Table:
        bucket = bucket.combine_chunks()
        data, off = flat(texts_of(bucket.column("packed").combine_chunks()) if bucket.num_rows else texts_of(pa.array([], pa.binary())))
        first = bucket.column("first").to_numpy()
        starts, ends, at = words(data, off)
        rank = window_ranks(data, starts, ends, window)
        owner = np.repeat(np.arange(bucket.num_rows), np.diff(at))[:len(rank)]
        fits = np.flatnonzero(np.arange(len(rank)) + window <= at[owner + 1])
        rank, owner, place = rank[fits], owner[fits], fits - at[owner[fits]]
        order = np.argsort(rank, kind="stable")
        heads = np.flatnonzero(np.diff(rank[order], prepend=-1))
        low = np.empty(len(rank), first.dtype)
        low[order] = np.repeat(np.minimum.reduceat(first[owner[order]], heads), np.diff(np.append(heads, len(order))))
        hit = np.flatnonzero(low < first[owner])
        owner, place = owner[hit], place[hit]
        new = np.ones(len(hit), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1)
        begin = np.flatnonzero(new)
        take = pa.array(owner[begin])
        return pa.table({"minimiser": bucket.column("minimiser").take(take), "content": bucket.column("content").take(take),
                         "run_from": pa.array(place[begin].astype(np.int32)), "run_n": pa.array(np.diff(np.append(begin, len(hit))).astype(np.int32))})

    return work


def _older_by_window(hot: DataFrame, window: int) -> DataFrame:
    """The same for minimisers with very many contents: each window goes its own way, as a 128-bit digest of its words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        names = ["minimiser", "content", "first"]
        for batch in batches:
            column = [batch.column(batch.schema.get_field_index(c)) for c in names]
            packed = batch.column(batch.schema.get_field_index("packed"))
            for i in range(len(batch)):  # one content at a time, and of a long one some windows at a time
                own = packed[i].as_py().split()
                for a in range(0, len(own) - window + 1, WINDOW_BATCH):
                    places = range(a, min(a + WINDOW_BATCH, len(own) - window + 1))
                    digests = [blake2b(b" ".join(own[j:j + window]), digest_size=16).digest() for j in places]
                    take = pa.array(np.full(len(places), i))
                    yield pa.RecordBatch.from_arrays([*(c.take(take) for c in column), pa.array(places, pa.int32()), pa.array(digests, pa.binary())], [*names, "run_from", "digest"])

    kind = dict(hot.dtypes)["first"]
    each = hot.mapInArrow(work, f"minimiser long, content long, first {kind}, run_from int, digest binary")
    low = each.groupBy("digest").agg(F.min("first").alias("low"))
    return each.join(low, "digest").where("low < first").select("minimiser", "content", "run_from", F.lit(1).alias("run_n"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """key, text_hash, spans (word places from, to) of every document with a window that starts in a document with a smaller key."""
    pieces = super_kmers(docs, key, window, run).persist(StorageLevel.DISK_ONLY)
    shared = (pieces.groupBy("minimiser").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.min("content").alias("c"), F.max("content").alias("d"))
              .where("lo < hi").select("minimiser", (F.col("c") != F.col("d")).alias("mixed")))
    found = cut_lineage(pieces.join(shared, "minimiser"))
    pieces.unpersist()
    firsts = cut_lineage(found.groupBy("minimiser", "content", "mixed").agg(F.min(F.struct(key, "text_hash", "start", "n")).alias("rep"))
                         .select("minimiser", "content", "mixed", F.col(f"rep.{key}").alias(key), "rep.text_hash", "rep.start", "rep.n"))
    strings = cut_lineage(packed_strings(docs, firsts.where("mixed").drop("mixed"), key, window))
    total = strings.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    buckets = max(1, round(total / 6 / BUCKET_WORDS))
    weight = strings.groupBy("minimiser").agg(F.count("*").alias("n"), F.sum(F.octet_length("packed")).alias("bytes"))
    often = weight.where((F.col("n") > HOT_CONTENTS) | (F.col("bytes") > HOT_BYTES)).select("minimiser")
    older = (strings.join(often, "minimiser", "left_anti").withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(buckets)))
             .groupBy("bucket").applyInArrow(_older(window, key), "minimiser long, content long, run_from int, run_n int"))
    if often.count():
        older = older.unionByName(_older_by_window(strings.join(often, "minimiser", "left_semi"), window))
    # Cut here, so that the join below has plain exchanges on both sides, which Spark can split where one content is hot.
    older = cut_lineage(older.groupBy("minimiser", "content").agg(F.collect_list(F.struct("run_from", "run_n")).alias("runs")))
    judged = (found.join(firsts.select("minimiser", "content", F.col(key).alias("first")), ["minimiser", "content"])
              .join(older, ["minimiser", "content"], "left"))
    all_of_it = F.array(F.struct(F.lit(0).alias("run_from"), F.col("n").alias("run_n")))
    runs = F.when(F.col(key) > F.col("first"), all_of_it).otherwise(F.col("runs"))
    spans = F.transform(runs, lambda r: F.struct((F.col("start") + r["run_from"]).alias("a"), (F.col("start") + r["run_from"] + r["run_n"] + window - 1).alias("b")))
    return judged.select(key, "text_hash", spans.alias("spans")).where("spans is not null").groupBy(key, "text_hash").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _cut(docs: DataFrame, names: list[str]) -> DataFrame:
    """Adds n_words, n_removed and kept_text; ``spans`` and ``text_hash`` go."""
    fields = StructType([*(f for f in docs.schema.fields if f.name not in ("spans", "text_hash")), StructField("n_words", LongType()), StructField("n_removed", LongType()),
                         StructField("kept_text", StringType())])
    rest = [f.name for f in fields.fields[:-3]]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            n, gone, kept = [], [], []
            raw, where = data.tobytes(), off.tolist()
            spans = rows.column("spans").to_pylist() if "spans" in rows.schema.names else [None] * len(rows)
            for i, own in enumerate(spans):
                each = raw[where[i]:where[i + 1]].split()
                n.append(len(each))
                if own:
                    keep = np.ones(len(each), bool)
                    for s in own:
                        keep[s["a"]:s["b"]] = False
                    each = list(compress(each, keep.tolist()))
                gone.append(n[-1] - len(each))
                kept.append(b" ".join(each))
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in rest), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             [*rest, *names])

    return docs.mapInArrow(work, fields)


def drop_repeats(docs: DataFrame, key: str = "doc_id", window: int = WINDOW, run: int = RUN) -> DataFrame:
    """All columns of ``docs`` with n_words, n_removed and kept_text: the words left, joined by one space.

    A word goes if a window over it also starts in a document with a smaller key. Null text has no words; a null key removes nothing and loses
    nothing; rows of equal key do not remove from one another; identical rows have equal results. Columns called n_words, n_removed, kept_text,
    text_hash or spans are replaced."""
    own = docs.drop("n_words", "n_removed", "kept_text", "text_hash", "spans")
    names = [key, "text_hash"]
    spans = cut_lineage(repeated_spans(own, key, window, run))
    wide = _hashed(own)
    out = ["n_words", "n_removed", "kept_text"]
    if spans.count() > PICKED_DOCS:
        return _cut(wide.join(spans, names, "left"), out)
    # Texts without a repeat stay where they are.
    touched = F.broadcast(spans.select(*names))
    return _cut(wide.join(touched, names, "left_anti"), out).unionByName(_cut(wide.join(touched, names, "left_semi").join(spans, names), out).select(*own.columns, *out))

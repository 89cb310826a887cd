"""N-gram Jaccard join by grouped prefixes, and the classes of documents that its links connect.

A document is the set of its word shingles, as 64-bit fingerprints. Equal sets are one class. All sets are ordered by one order of shingles, rare ones
first (by a sketch of counters of fixed size), so that linked sets share a shingle of their prefixes. Classes with equal prefix and size
are one group.

First, in every list of groups that share a prefix shingle and a band of sizes, each group is paired with the most common-looking one, and each class with
the first of its group; the best pair of each class is verified. That joins copies without pairing them all.
Then every pair of classes that shares a prefix shingle and is not yet connected is filtered by size, place and a bitmap that can rule out but not miss, and
verified. Pairs within one component need no look, since they cannot change it; so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.arrays import chunks, lowered, mix, shingles, span_hashes, words
from spanledger.llm.common import cut_lineage
from spanledger.llm.components import components

#: Counters of the order of shingles, as a power of two: also the bound of what reaches the driver.
SKETCH_BITS = 18
#: Shingles that a task looks through at once for repeats.
REPEAT_WINDOW = 4_000_000
#: 64-bit words of the bitmap.
BITMAP = 8
#: Classes whose documents may be picked by a broadcast of their numbers before a shuffle (about 35 MB as a hash table).
PICKED = 500_000
_BITS = [f"b{i}" for i in range(BITMAP)]
#: Sets of more shingles have a second bitmap of so many 64-bit words, as the first one is too full to rule anything out.
LARGE, WIDE = 1_000, 128


def _sets(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    data = lowered(data)
    starts, ends, at = words(data, off)
    return shingles(span_hashes(data, starts, ends), at, n)


def _digests(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit digest of each row's set."""
    size = np.bincount(row, minlength=rows)
    total = np.zeros(len(token) + 1, np.uint64)
    np.cumsum(mix(token ^ np.uint64(0x5851F42D4C957F2D)), out=total[1:])
    at = np.concatenate([[0], np.cumsum(size)])
    return size, mix(total[at[1:]] - total[at[:-1]] + size.astype(np.uint64))


def shingle_counts(docs: DataFrame, n: int) -> np.ndarray:
    """Repeated shingles per counter over all documents; a shingle's counter is its upper bits.

    Each task counts the shingles that repeat among REPEAT_WINDOW at a time, so the many that stand once do not blur the counters. Any
    counts give one order of all shingles and so right results; good ones make the shared lists short."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        held: list[np.ndarray] = []

        def add() -> None:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            again = count > 1
            total[:] += np.bincount((token[again] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), weights=count[again], minlength=len(total)).astype(np.int64)
            held.clear()

        for rows, data, off in chunks(batches):
            held.append(_sets(rows, data, off, n)[1])
            if sum(map(len, held)) >= REPEAT_WINDOW:
                add()
        if held:
            add()
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["counter", "n"])

    got = docs.select("text").mapInArrow(work, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[got.column("counter").to_numpy()] = got.column("n").to_numpy()
    return out


def profiles(docs: DataFrame, key: str, n: int, percent: int) -> DataFrame:
    """key, size, cid (digest of the set), rank (rare-looking sets are high), prefix and bitmap of every document."""
    counts = np.minimum(shingle_counts(docs, n), (1 << 24) - 1).astype(np.uint32)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            row, token = _sets(rows, data, off, n)
            size, cid = _digests(row, token, len(rows))
            often = counts[(token >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
            order = np.lexsort((often << np.uint64(40) | token >> np.uint64(24), row))  # stable: ties stay in order of the whole fingerprint
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            taken = size - -(-size * percent // 100) + (size > 0)
            inside = place < np.repeat(taken, size)
            prefix, own = token[order][inside], row[inside]
            level = np.bincount(own, weights=np.log2(often[order][inside].astype(float) + 1), minlength=len(rows)) / np.maximum(taken, 1)
            odd = np.bincount(row * (64 * BITMAP) + (token & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP * len(rows)) & 1
            bits = np.packbits(odd.astype(np.uint8).reshape(len(rows), -1), axis=1).view(np.int64)
            large = np.flatnonzero(size > LARGE)
            slot = np.full(len(rows), -1)
            slot[large] = np.arange(len(large))
            of = slot[row]
            bit = (token[of >= 0] >> np.uint64(20) & np.uint64(64 * WIDE - 1)).astype(np.int64)
            odd = np.bincount(of[of >= 0] * (64 * WIDE) + bit, minlength=64 * WIDE * len(large)) & 1
            wide = np.packbits(odd.astype(np.uint8).reshape(len(large), -1), axis=1).view(np.int64).ravel() if len(large) else np.zeros(0, np.int64)
            wide = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > LARGE, WIDE, 0))]).astype(np.int32)), pa.array(wide))
            rank = (1023 - np.minimum(level * 32, 1023).astype(np.uint64)) << np.uint64(53) | cid >> np.uint64(11)
            edges = np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column(key), pa.array(size.astype(np.int32)), pa.array(cid.view(np.int64)), pa.array(rank.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(edges), pa.array(prefix.view(np.int64))), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(BITMAP)), wide],
                [key, "size", "cid", "rank", "prefix", *_BITS, "wide"])

    kind = docs.select(key).dtypes[0][1]
    return docs.select(key, "text").mapInArrow(work, f"{key} {kind}, size int, cid long, rank long, prefix array<long>, " + ", ".join(f"{b} long" for b in _BITS) + ", wide array<long>")


def _least(x: Column, y: Column, percent: int) -> Column:
    """Fewest common shingles of two linked sets of these sizes."""
    return F.floor(((x + y) * percent + 99 + percent) / (100 + percent))


def _sizes_fit(x: Column, y: Column, percent: int) -> Column:
    return 100 * F.least(x, y) >= percent * F.greatest(x, y)


def _apart(a: str, b: str) -> Column:
    return reduce(add, (F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _BITS))


def _bits_fit(a: str, b: str, percent: int) -> Column:
    """The bitmaps differ in no more bits than linked sets can differ in shingles."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return _apart(a, b) <= x + y - 2 * _least(x, y, percent)


def _not_apart(pairs: DataFrame, wide: DataFrame, percent: int) -> DataFrame:
    """Pairs x, y without those of two large sets whose second bitmaps differ in more bits than linked sets can differ in shingles."""
    pairs = cut_lineage(pairs)
    both = (F.col("size") > LARGE) & (F.col("other") > LARGE)
    far = pairs.where(both).join(wide.select(F.col("cid").alias("x"), F.col("wide").alias("a")), "x").join(wide.select(F.col("cid").alias("y"), F.col("wide").alias("b")), "y")
    apart = F.aggregate(F.zip_with("a", "b", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, v: n + v)
    near = far.where(apart <= F.col("size") + F.col("other") - 2 * _least(F.col("size"), F.col("other"), percent))
    return near.select("x", "y").unionByName(pairs.where(~both).select("x", "y"))


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: str, n: int, percent: int) -> DataFrame:
    """Those pairs x, y of classes whose sets are similar enough: their shingles are made again from one document of each class and compared."""
    pairs = cut_lineage(pairs)
    wanted = pairs.select(F.col("x").alias("cid")).union(pairs.select("y")).distinct()
    wanted = cut_lineage(classes.join(wanted, "cid", "left_semi").select("cid", key))
    own = docs.select(key, "text")
    ids = wanted.select(key).distinct()
    own = own.join(F.broadcast(ids) if wanted.count() <= PICKED else ids, key, "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            row, token = _sets(rows, data, off, n)
            size, cid = _digests(row, token, len(rows))
            edges = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(cid.view(np.int64)), pa.ListArray.from_arrays(pa.array(edges), pa.array(token.view(np.int64)))],
                                             [key, "cid", "tokens"])

    kind = docs.select(key).dtypes[0][1]
    sets = own.mapInArrow(work, f"{key} {kind}, cid long, tokens array<long>").join(wanted, [key, "cid"], "left_semi").dropDuplicates(["cid"])
    sets = sets.select("cid", "tokens").persist(StorageLevel.DISK_ONLY)
    both = pairs.join(sets.select(F.col("cid").alias("x"), F.col("tokens").alias("s")), "x").join(sets.select(F.col("cid").alias("y"), F.col("tokens").alias("t")), "y")
    common = F.size(F.array_intersect("s", "t"))
    out = cut_lineage(both.where(100 * common >= percent * (F.size("s") + F.size("t") - common)).select("x", "y"))
    sets.unpersist()
    return out


def near_duplicates(docs: DataFrame, key: str = "doc_id", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key that links lead to, itself included).

    Two documents link when 100 * common >= percent * union of their shingles of ``n`` words (A-Z in lower case). Null and empty texts and texts without words have
    no shingle and link with nothing; fewer than ``n`` words are one shingle. Rows of equal key are one node; a null key links with nothing and
    its component is null. Repeated rows give repeated results."""
    known = profiles(docs, key, n, percent).withColumn("gid", F.xxhash64("prefix", "size")).persist(StorageLevel.DISK_ONLY)
    rows = known.where((F.col("size") > 0) & F.col(key).isNotNull())
    plain = cut_lineage(known.select(key, "size", "cid"))
    # All of these are equal within a class.
    facts = cut_lineage(rows.groupBy("cid").agg(F.min(key).alias(key), *(F.min(c).alias(c) for c in ("size", "rank", "gid", *_BITS))))
    wide = cut_lineage(rows.where(F.col("size") > LARGE).select("cid", "wide").dropDuplicates(["cid"]))
    # Places of prefix shingles, of those that more than one group has; a group with several classes has a list of its own.
    tokens = rows.select("gid", F.posexplode("prefix").alias("pos", "token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    spots = tokens.join(often, "token", "left_semi").groupBy("token", "gid").agg(F.min("pos").alias("pos"))
    own = facts.groupBy("gid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gid").alias("token"), "gid", F.lit(0).alias("pos"))
    spots = cut_lineage(spots.unionByName(own))
    known.unpersist()
    classes = facts.select("cid", key)
    heads = facts.groupBy("gid").agg(F.min("rank").alias("head"), F.min("size").alias("size"))
    band = F.floor(F.log(F.col("size").cast("double")) / float(-np.log(percent / 100))).cast("int")
    placed = cut_lineage(spots.join(heads, "gid").select("token", band.alias("band"), "gid", "head"))
    best = placed.groupBy("token", "band").agg(F.min("head").alias("best"), F.max("head").alias("last")).where("best < last").drop("last")
    star = placed.join(best, ["token", "band"]).where("head <> best").select("gid", "best").distinct()
    # A class is tried with the head of its own group and the best group of its lists; of these, with the nearest bitmap.
    tries = star.unionByName(heads.select("gid", F.col("head").alias("best")))
    x, y = facts.alias("x"), facts.alias("y")
    near = (tries.join(x, "gid").join(y, F.col("best") == F.col("y.rank"))
            .where((F.col("x.cid") != F.col("y.cid")) & _sizes_fit(F.col("x.size"), F.col("y.size"), percent) & _bits_fit("x", "y", percent))
            .select(F.col("x.cid").alias("x"), F.col("x.size").alias("size"), F.struct(_apart("x", "y").alias("apart"), F.col("y.cid").alias("y"), F.col("y.size").alias("other")).alias("y"))
            .groupBy("x", "size").agg(F.min("y").alias("y")).select("x", "size", "y.y", "y.other"))
    links = verified(_not_apart(near, wide, percent), docs, classes, key, n, percent)
    found = components(links, "x", "y").withColumnRenamed("node", "cid")
    joined = facts.join(found, "cid", "left").withColumn("component", F.coalesce("component", "cid")).select("cid", "gid", "size", "component", *_BITS)
    joined = cut_lineage(joined)
    # All further pairs: lists of members that are not in one component yet.
    lists = spots.join(joined.select("gid", "cid", "component"), "gid")
    open_lists = lists.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    left = cut_lineage(lists.join(open_lists, "token", "left_semi").select("token", "pos", "cid").join(joined.drop("gid"), "cid"))
    x, y = left.alias("x"), left.alias("y")
    size, other = F.col("x.size"), F.col("y.size")
    room = 1 + F.least(size - F.col("x.pos") - 1, other - F.col("y.pos") - 1)
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.cid") < F.col("y.cid")) & (F.col("x.component") != F.col("y.component"))
                  & _sizes_fit(size, other, percent) & (room >= _least(size, other, percent)) & _bits_fit("x", "y", percent))
    rest = rest.select(F.col("x.cid").alias("x"), F.col("y.cid").alias("y"), size.alias("size"), other.alias("other")).distinct()
    more = verified(_not_apart(rest, wide, percent), docs, classes, key, n, percent)
    # Components of keys: every class stands for its smallest key.
    own = classes.select("cid", key)
    named = links.unionByName(more).join(own.select(F.col("cid").alias("x"), F.col(key).alias("a")), "x").join(own.select(F.col("cid").alias("y"), F.col(key).alias("b")), "y")
    rows = plain.where((F.col("size") > 0) & F.col(key).isNotNull())
    again = rows.select(key, "cid").join(own.select("cid", F.col(key).alias("first")), "cid").where(F.col(key) != F.col("first"))
    twice = rows.groupBy(key).agg(F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("lo < hi").select(key)
    if twice.limit(1).count():  # keys with several texts tie their classes together
        more_links = again.select(F.col(key).alias("a"), F.col("first").alias("b"))
        found = components(named.select("a", "b").unionByName(more_links.join(twice.withColumnRenamed(key, "a"), "a", "left_semi")))
    else:
        found = components(named.select("a", "b"))
    label = found.select(F.col("node").alias("first"), "component")
    result = (plain.select(key, F.col("size").cast("long").alias("n_shingles"), "cid").join(own.select("cid", F.col(key).alias("first")), "cid", "left")
              .withColumn("first", F.when((F.col("n_shingles") > 0) & F.col(key).isNotNull(), F.col("first"))).join(label, "first", "left"))
    return result.select(key, "n_shingles", F.coalesce("component", "first", key).alias("component_id"))

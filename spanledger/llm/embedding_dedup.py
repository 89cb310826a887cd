"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables, verified by cosine.

A rotation learnt on a bounded sample turns each vector into a balanced binary code. The code is cut into chunks, one table each; two vectors meet when
a chunk of theirs differs in one bit at most, which a key with that bit blanked finds by equality. A pair counts in the first table where
it meets, so no pair comes twice. Then the original vectors decide.

Codes tell vectors apart by their signs around the mean. Where all vectors lie in a narrow cone, near ones differ in many signs; so before the
tables are used, their recall is measured on the sample, with neighbours made at exactly the asked cosine. Below ``TRUST`` the pairs are found exactly
instead: vectors are cut into slabs along the direction of their largest spread, no wider than two linked vectors can be apart, and blocks of the same or
the next slab are compared by matrix products. A block pair gives link counts and a spanning set of links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.llm.common import cut_lineage
from spanledger.llm.components import components

#: Vectors that the rotation is learnt on at most, the first by a hash of their number.
SAMPLE = 8_192
#: Chunks of the code and bits of a chunk.
TABLES, CHUNK = 4, 16
#: Codes of a pair differ in at most so many of the 64 bits before vectors are compared; a pair at cosine 0.98 is expected to differ in about 4.
MOST_BITS = 18
#: Recall of the tables, measured on the sample, below which pairs are found exactly.
TRUST = 0.97
#: Numbers in the matrix of a block of the exact way.
BLOCK_NUMBERS = 1 << 17


def learn_rotation(sample: np.ndarray, bits: int = TABLES * CHUNK, rounds: int = 40, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection: principal directions, rotated so that signs lose least (alternating signs and orthogonal fit)."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    own = sample - mean
    dims = own.shape[1]
    axes = np.linalg.eigh(own.T @ own)[1][:, ::-1]
    parts = []
    for first in range(0, bits, dims):  # more bits than dimensions: another start each time
        width = min(dims, bits - first)
        low = own @ axes[:, :width]
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(low @ turn).T @ low)
            turn = (u @ v).T
        parts.append(axes[:, :width] @ turn)
    return mean, np.hstack(parts)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; other lengths are cut or filled with zeros."""
    out = np.zeros((len(column), dims))
    size = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    row = np.repeat(np.arange(len(column)), size)
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    out[row[place < dims], place[place < dims]] = values[place < dims]
    return out


def codes(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray) -> DataFrame:
    """cid, label, code, norm and vector."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("vector"))
            signs = (_matrix(own, len(mean)) - mean) @ turn > 0
            code = np.packbits(signs, axis=1, bitorder="little").view(np.int64)[:, 0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code)], [*batch.schema.names, "code"])

    kinds = ", ".join(f"{c} {k}" for c, k in vectors.dtypes)
    return vectors.mapInArrow(work, f"{kinds}, code long")


def linked(coded: DataFrame, least: float) -> DataFrame:
    """Pairs x < y of numbers whose vectors have equal labels and lengths and a cosine of ``least`` or more."""
    table = F.explode(F.expr(f"sequence(0, {TABLES - 1})")).alias("table")
    rows = coded.select("cid", "label", "code", table).withColumn("chunk", F.expr(f"shiftright(code, table * {CHUNK}) & {(1 << CHUNK) - 1}"))
    rows = rows.select("cid", "label", "code", "table", F.explode(F.expr(f"sequence(0, {CHUNK - 1})")).alias("bit"), "chunk")
    rows = rows.select("cid", "label", "code", "table", "bit", F.expr("chunk & ~shiftleft(1L, bit)").alias("blanked"))
    x, y = rows.alias("x"), rows.alias("y")
    apart = F.col("x.code").bitwiseXOR(F.col("y.code"))
    meet = (F.col("x.cid") < F.col("y.cid")) & (F.bit_count(apart) <= MOST_BITS)
    part = lambda t: F.bit_count(F.call_function("shiftright", apart, F.lit(t * CHUNK)).bitwiseAND((1 << CHUNK) - 1))
    for t in range(TABLES):
        here = F.col("x.table") == t
        meet = meet & (~here | (part(t) > 0) | (F.col("x.bit") == 0)) & (~(F.col("x.table") > t) | (part(t) > 1))
    keys = ["label", "table", "bit", "blanked"]
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"x.{k}") == F.col(f"y.{k}"))
    pairs = x.join(y, same & meet).select(F.col("x.cid").alias("x"), F.col("y.cid").alias("y"))
    own = coded.select("cid", "vector", "norm")
    both = (pairs.join(own.select(F.col("cid").alias("x"), F.col("vector").alias("a"), F.col("norm").alias("na")), "x")
            .join(own.select(F.col("cid").alias("y"), F.col("vector").alias("b"), F.col("norm").alias("nb")), "y").where(F.size("a") == F.size("b")))
    dot = F.aggregate(F.zip_with("a", "b", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return both.where(dot / (F.col("na") * F.col("nb")) >= least).select("x", "y")


def expected_recall(sample: np.ndarray, mean: np.ndarray, turn: np.ndarray, least: float, seed: int = 5) -> float:
    """Share of pairs at a cosine of ``least`` that the tables find: each sample vector (some thousands at most) with a neighbour in a random direction."""
    rng = np.random.default_rng(seed)
    own = sample[np.linalg.norm(sample, axis=1) > 0][:4_096]
    size = np.linalg.norm(own, axis=1, keepdims=True)
    unit = own / size
    aside = rng.standard_normal(own.shape)
    aside -= (aside * unit).sum(1, keepdims=True) * unit
    length = np.linalg.norm(aside, axis=1, keepdims=True)
    if own.shape[1] < 2 or not len(own):
        return 1.0
    near = (least * unit + (1 - least ** 2) ** 0.5 * aside / length) * size
    apart = ((own - mean) @ turn > 0) != ((near - mean) @ turn > 0)
    chunks = apart.reshape(len(own), TABLES, CHUNK).sum(2)
    return float(((chunks <= 1).any(1) & (apart.sum(1) <= MOST_BITS)).mean())


def exact_links(classes: DataFrame, least: float, sample: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(cid, others), (x, y): how many other vectors each is linked with, and links that hold the same components together."""
    dims = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    along = np.linalg.eigh(np.cov(unit.T) if len(unit) > 1 and dims > 1 else np.eye(dims))[1][:, -1]
    # Unit vectors at this cosine are no farther apart than this.
    wide = (2 - 2 * least) ** 0.5 * (1 + 1e-9)
    kind = dict(classes.dtypes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index("vector")), dims)
            norm = batch.column(batch.schema.get_field_index("norm")).to_numpy()
            slab = np.floor(x @ along / norm / wide).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slab)], [*batch.schema.names, "slab"])

    rows = classes.select("label", "cid", "copies", "vector", "norm", F.size("vector").alias("dims"))
    rows = cut_lineage(rows.mapInArrow(place, f"label {kind['label']}, cid long, copies long, vector {kind['vector']}, norm double, dims int, slab long"))
    most = max(1, BLOCK_NUMBERS // dims)
    pieces = rows.groupBy("label", "dims", "slab").agg(F.expr(f"(count(*) + {most - 1}) div {most}").cast("int").alias("pieces"))

    def packed(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        x = _matrix(part.column("vector").chunk(0), part.column("dims")[0].as_py())
        return pa.table({"label": part.column("label")[:1], "dims": part.column("dims")[:1], "slab": part.column("slab")[:1], "piece": part.column("piece")[:1], "cids": [part.column("cid").to_numpy().tobytes()],
                         "copies": [part.column("copies").to_numpy().tobytes()], "matrix": [(x / np.linalg.norm(x, axis=1, keepdims=True)).tobytes()]})

    name = ["label", "dims", "slab", "piece"]
    dealt = rows.join(pieces, name[:3]).withColumn("piece", F.pmod(F.xxhash64("cid"), F.col("pieces")).cast("int"))
    blocks = cut_lineage(dealt.groupBy(*name).applyInArrow(packed, f"label {kind['label']}, dims int, slab long, piece int, cids binary, copies binary, matrix binary"))
    # Each block beside itself, the later blocks of its slab, and all blocks of the next.
    after = pieces.select("label", "dims", (F.col("slab") - 1).alias("slab"), F.col("pieces").alias("after"))
    these = blocks.join(pieces, name[:3]).join(after, name[:3], "left")
    upto = lambda lo, n, slab: F.transform(F.filter(F.sequence(F.lit(0), F.coalesce(n, F.lit(0))), lambda i: (i >= lo) & (i < n)), lambda i: F.struct(slab.alias("slab"), i.alias("piece")))
    others = F.concat(upto(F.col("piece"), F.col("pieces"), F.col("slab")), upto(F.lit(0), F.col("after"), F.col("slab") + 1))
    mine = [F.col(c).alias(f"a_{c}") for c in ("slab", "piece", "cids", "copies", "matrix")]
    pairs = these.select("label", "dims", *mine, F.inline(others)).join(blocks, name)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (batch.slice(i, 1).to_pylist()[0] for i in range(len(batch))):
                a, b = (np.frombuffer(r[c], np.int64) for c in ("a_cids", "cids"))
                na, nb = (np.frombuffer(r[c], np.int64) for c in ("a_copies", "copies"))
                x, y = (np.frombuffer(r[c], float).reshape(len(ids), -1) for c, ids in (("a_matrix", a), ("matrix", b)))
                near = x @ y.T >= least
                if (r["a_slab"], r["a_piece"]) == (r["slab"], r["piece"]):
                    np.fill_diagonal(near, False)
                    found = [(a, near @ nb)]
                else:
                    found = [(a, near @ nb), (b, na @ near)]
                # Least numbers passed on until nothing changes.
                la, lb = a.copy(), b.copy()
                some_a, some_b = near.any(1), near.any(0)
                while True:
                    ua = np.minimum(la, np.where(near, lb[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
                    ub = np.minimum(lb, np.where(near, ua[:, None], np.iinfo(np.int64).max).min(0, initial=np.iinfo(np.int64).max))
                    if (ua == la).all() and (ub == lb).all():
                        break
                    la, lb = ua, ub
                cid = np.concatenate([i[n > 0] for i, n in found] + [a[some_a], b[some_b]])
                n_counts = sum(int((n > 0).sum()) for _, n in found)
                n = np.concatenate([c[c > 0] for _, c in found] + [np.zeros(len(cid) - n_counts, np.int64)])
                to = np.concatenate([np.full(n_counts, -1), la[some_a], lb[some_b]])
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(n.astype(np.int64)), pa.array(to)], ["cid", "others", "to"])

    found = cut_lineage(pairs.mapInArrow(compare, "cid long, others long, to long"))
    counts = found.where("others > 0").groupBy("cid").agg(F.sum("others").alias("others"))
    return counts, found.where("others = 0 AND cid <> to").select(F.col("cid").alias("x"), F.col("to").alias("y"))


def embedding_dedup(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98) -> DataFrame:
    """One row per row: key, n_links, component_id, kept (the component's smallest key).

    Null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing and are kept. Identical vectors of a label
    are compared once and counted each. Rows of equal key are vectors of their own, each with its own links and component. Vectors of different
    lengths do not link. An empty table gives no rows."""
    own = F.col(vector)
    sound = F.coalesce(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.size(own) > 0)
                       & F.forall(own, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    norm = F.sqrt(F.aggregate(own, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    rows = vectors.select(F.col(key).alias("id"), F.col(label).alias("label"), own.alias("vector"), F.when(sound, norm).alias("norm"))
    rows = rows.withColumn("ok", F.coalesce(F.col("norm") > 0, F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("label", "vector")).withColumn("h2", F.xxhash64("vector", F.lit(1), "label"))
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("vector").alias("vector"), F.first("norm").alias("norm"))
    # A number for each class: keys may repeat.
    classes = cut_lineage(classes.withColumn("cid", F.monotonically_increasing_id()))
    narrow = rows.select("id", "label", "ok", "h1", "h2")
    sample = classes.orderBy(F.xxhash64("h1", "h2"), "low").limit(SAMPLE).select("vector").collect()
    links, others = classes.select(F.col("cid").alias("x"), F.col("cid").alias("y")).limit(0), None
    if sample:
        dims = max(len(r[0]) for r in sample)
        learnt = np.zeros((len(sample), dims))
        for i, r in enumerate(sample):
            learnt[i, :len(r[0])] = r[0]
        mean, turn = learn_rotation(learnt)
        if expected_recall(learnt, mean, turn, least) >= TRUST:
            links = cut_lineage(linked(cut_lineage(codes(classes.select("cid", "label", "vector", "norm"), mean, turn)), least))
        else:
            others, links = exact_links(classes, least, learnt)
    found = components(links, "x", "y").withColumnRenamed("node", "cid")
    lows = found.join(classes.select("cid", "low"), "cid").groupBy("component").agg(F.min("low").alias("low"))
    found = found.join(lows, "component").select("cid", F.col("low").alias("component"))
    copies = classes.select(F.col("cid").alias("y"), "copies")
    ways = links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))
    if others is None:
        others = ways.join(copies, "y").groupBy(F.col("x").alias("cid")).agg(F.sum("copies").alias("others"))
    facts = classes.select("label", "h1", "h2", "cid", "low", "copies").join(others, "cid", "left").join(found, "cid", "left")
    facts = facts.select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "low").alias("component"), F.lit(True).alias("ok"))
    out = narrow.join(facts, ["label", "h1", "h2", "ok"], "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))

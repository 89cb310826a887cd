"""Quality by nearest-neighbour voting in a latent-semantic space.

A text is a weighted count of hashed marks: pairs of neighbouring bytes, shapes of words, and words that repeat one of the last few. The latent axes are
learnt on a bounded sample of labelled rows; up to ``EXEMPLARS`` labelled rows are projected on them and sent to all tasks. There every
whole text is compared with all exemplars as blocks of exact cosines, and its nearest ones vote, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanledger.llm.arrays import chunks, span_hashes, words

#: Bounds: labelled rows that the axes are learnt on, labelled rows that vote, marks, axes and neighbours.
LEARN, EXEMPLARS = 3_000, 8_192
MARKS, AXES, NEIGHBOURS = 2_048, 64, 25
THRESHOLD = 0.3
_SHAPES = 64


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def marks(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of marks of every row, damped by the square root and scaled to the length of the text."""
    n, out = len(off) - 1, np.zeros((len(off) - 1, MARKS), np.float32)
    if not len(data):
        return out
    bytes_at = np.repeat(np.arange(n), np.diff(off))
    pair = (data[:-1].astype(np.uint64) << np.uint64(8) | data[1:]) * np.uint64(0x9E3779B97F4A7C15)
    slot = (pair >> np.uint64(40)).astype(np.int64) % (MARKS - _SHAPES) + _SHAPES
    same = bytes_at[1:] == bytes_at[:-1]
    flat = np.bincount(bytes_at[:-1][same] * MARKS + slot[same], minlength=n * MARKS)
    starts, ends, at = words(data, off)
    if len(starts):
        row = np.repeat(np.arange(n), np.diff(at))
        kinds = np.zeros((4, len(data) + 1), np.int32)
        for k, hit in enumerate(((data >= 65) & (data <= 90), (data >= 97) & (data <= 122), (data >= 48) & (data <= 57), (data < 128))):
            np.cumsum(hit, out=kinds[k, 1:])
        upper, lower, digit, ascii_ = (kinds[:, ends] - kinds[:, starts])
        other = ascii_ - upper - lower - digit
        shape = (upper > 1) * 1 + (lower > 0) * 2 + (digit > 0) * 4 + np.minimum(other, 3) * 8
        own = span_hashes(data, starts, ends)
        flat += np.bincount(row * MARKS + shape % 32, minlength=n * MARKS)
        for back in range(1, 5):
            if len(own) > back:
                again = (own[back:] == own[:-back]) & (row[back:] == row[:-back])
                flat += np.bincount(row[back:][again] * MARKS + 32 + back, minlength=n * MARKS)
    out[:] = np.sqrt(flat.reshape(n, MARKS))
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.maximum(size, 1e-12)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def labelled(docs: DataFrame, labels: DataFrame, key: str, n: int) -> DataFrame:
    """Up to ``n`` labelled rows that are not held out, the first by a hash of their key: key, text, quality. A key labelled twice counts by its lowest label."""
    marks_ = labels.where(F.col("quality").isNotNull() & ~held_out(key)).groupBy(key).agg(F.min("quality").alias("quality"))
    chosen = marks_.orderBy(F.xxhash64(key), key).limit(n)
    return docs.select(key, "text").join(F.broadcast(chosen), key)


def _vectors(rows: DataFrame, project) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of labelled rows and their labels; the rows are bounded by the caller."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, data, off in chunks(batches):
            x = project(marks(data, off)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([own.column("quality").cast(pa.int32()), own.column("h"), pa.array([r.tobytes() for r in x], pa.binary())], ["quality", "h", "x"])

    got = rows.select("text", "quality", F.xxhash64("text").alias("h")).mapInArrow(work, "quality int, h long, x binary").toArrow()
    order = np.argsort(got.column("h").to_numpy(), kind="stable")
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), np.float32).reshape(got.num_rows, -1) if got.num_rows else np.zeros((0, AXES), np.float32)
    return x[order], got.column("quality").to_numpy()[order].astype(np.float32)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> dict:
    """Weights and axes from at most LEARN rows, and the latent vectors and labels of at most EXEMPLARS rows."""
    x, y = _vectors(labelled(docs, labels, key, LEARN), lambda m: m)
    if not len(x):
        return {"exemplars": np.zeros((0, AXES), np.float32), "quality": y, "prior": 0.5}
    rare = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 1
    x = x * rare.astype(np.float32)
    mean = x.mean(0)
    gram = (x - mean).T.astype(np.float64) @ (x - mean)
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, :AXES].astype(np.float32)
    project = lambda m: _unit((m * rare.astype(np.float32) - mean) @ axes)
    exemplars, quality = _vectors(labelled(docs, labels, key, EXEMPLARS), project)
    return {"exemplars": exemplars, "quality": quality, "prior": float(quality.mean()), "project": project}


def vote(latent: np.ndarray, model: dict) -> np.ndarray:
    """Share of quality among the nearest exemplars, each with its similarity (none below zero) as weight."""
    known, k = model["exemplars"], min(NEIGHBOURS, len(model["exemplars"]))
    out = np.empty(len(latent))
    for a in range(0, len(latent), 512):
        near = latent[a:a + 512] @ known.T
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, best, 1), 0).astype(float) ** 4
        total = weight.sum(1)
        out[a:a + 512] = np.where(total > 0, (weight * model["quality"][best]).sum(1) / np.maximum(total, 1e-300), model["prior"])
    return np.clip(out, 0, 1)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and score of every row: 0 to 1, higher where good quality is likelier. Only the text is looked at.

    A text without marks (null, empty) has the share of good rows among the exemplars; without any label all scores are 0.5. Null and repeated
    keys stay as they are."""
    model = learn(docs, labels, key)
    kind = docs.select(key).dtypes[0][1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, off in chunks(batches):
            m = marks(data, off)
            score = np.full(len(rows), model["prior"])
            if "project" in model:
                some = m.any(1)
                score[some] = vote(model["project"](m[some]), model)
            yield pa.RecordBatch.from_arrays([rows.column(key), pa.array(score)], [key, "score"])

    return docs.select(key, "text").mapInArrow(work, f"{key} {kind}, score double")

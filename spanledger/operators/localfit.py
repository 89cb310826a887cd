"""One small weighted linear model per example, from sums that can be merged.

A task adds up, for each example whose rows it meets, the weighted products of all pairs of columns: a Gram
matrix. Matrices of an example from any number of tasks and in any order are added, and everything
after that, selection of features included, looks at the matrix alone. So rows are never sorted or
shuffled, and what travels is one matrix per example and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from spanledger.functions.ordered import slice_count

# Ridge of the selecting and of the final fit; most features for which ``auto`` tries them one by one.
SELECT_ALPHA, FIT_ALPHA, AUTO_FORWARD = 0.01, 1.0, 6
#: Numbers of unfinished matrices that a task holds.
HELD_NUMBERS = 4_000_000
METHODS = ("highest_weights", "forward_selection", "lasso_path", "none", "auto")


class Gram:
    """Weighted sums over rows (1, x, y): the matrix of all products of two columns."""

    def __init__(self, sums: np.ndarray, rows: int):
        self.sums, self.rows = sums, rows

    @staticmethod
    def of(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Gram:
        own = np.column_stack([np.ones(len(x)), x, y])
        return Gram(own.T @ (own * w[:, None]), len(x))

    def __add__(self, other: Gram) -> Gram:
        return Gram(self.sums + other.sums, self.rows + other.rows)

    @property
    def weight(self) -> float:
        return self.sums[0, 0]

    @cached_property
    def centred(self) -> tuple[np.ndarray, np.ndarray, float]:
        """Weighted products around the means: of the features, of features and score, of the score."""
        s = self.sums - np.outer(self.sums[0], self.sums[0]) / self.weight
        return s[1:-1, 1:-1], s[1:-1, -1], s[-1, -1]

    def ridge(self, alpha: float, use: np.ndarray) -> np.ndarray:
        """Coefficients of ``use``; without a ridge and with dependent features, the shortest ones."""
        xx, xy, _ = self.centred
        own = xx[np.ix_(use, use)] + np.eye(len(use)) * alpha
        return np.linalg.solve(own, xy[use]) if alpha > 0 else np.linalg.lstsq(own, xy[use], rcond=1e-10)[0]

    def r2(self, use: np.ndarray, coef: np.ndarray) -> float:
        xx, xy, yy = self.centred
        return 1 - (yy - 2 * coef @ xy[use] + coef @ xx[np.ix_(use, use)] @ coef) / yy if yy > 0 else 1.0

    def intercept(self, use: np.ndarray, coef: np.ndarray) -> float:
        return (self.sums[0, -1] - coef @ self.sums[0, 1:-1][use]) / self.weight


def lasso_path(xx: np.ndarray, xy: np.ndarray) -> list[np.ndarray]:
    """Coefficients at every knot of the lasso path (Efron et al. 2004), from none to the least-squares fit.

    Between knots the coefficients of the active features move along a line on which their products with the
    residual stay equal; a knot is where another feature catches up or an active one becomes zero.
    """
    d = len(xy)
    b, c = np.zeros(d), xy.astype(float).copy()
    scale = np.abs(xy).max(initial=0)
    path, active, barred = [b.copy()], [], set()
    left_out = np.diag(xx) <= 1e-12 * max(1e-300, np.diag(xx).max(initial=0))
    for _ in range(8 * d + 8):
        most = max((abs(c[j]) for j in range(d) if not left_out[j]), default=0.0)
        if most <= 1e-10 * scale or scale == 0:
            break
        fresh = [j for j in range(d) if j not in active and j not in barred and not left_out[j] and abs(c[j]) >= most * (1 - 1e-9)]
        for j in fresh[:1]:
            trial = [*active, j]
            part = xx[np.ix_(trial, trial)]
            if np.linalg.matrix_rank(part, tol=1e-9 * np.abs(part).max()) < len(trial):
                left_out[j] = True  # it says nothing that the active ones do not say
            else:
                active = trial
        if fresh and left_out[fresh[0]]:
            continue
        if not active:
            break
        way = np.linalg.solve(xx[np.ix_(active, active)], np.sign(c[active]))
        slope = xx[:, active] @ way
        level = np.abs(c[active]).max()
        steps = [level]
        for j in range(d):
            if j not in active and not left_out[j]:
                for up in (1, -1):
                    rest = 1 - up * slope[j]
                    if rest > 1e-12 and (j not in barred or up * c[j] < level * (1 - 1e-9)):
                        g = (level - up * c[j]) / rest
                        if g > 1e-12 * scale:
                            steps.append(g)
        crossing = {j: -b[j] / s for j, s in zip(active, way) if s and -b[j] / s > 1e-12}
        gone = min(crossing, key=crossing.get, default=None)
        step = min(steps)
        barred = set()
        if gone is not None and crossing[gone] < step:
            step = crossing[gone]
            barred = {gone}
        b[active] += step * way
        c -= step * slope
        if barred:
            b[gone] = 0.0
            active = [j for j in active if j != gone]
        path.append(b.copy())
    return path


def select(g: Gram, num_features: int, method: str) -> np.ndarray:
    """Positions of the features of the final fit."""
    d = len(g.sums) - 2
    if method == "auto":
        method = "forward_selection" if num_features <= AUTO_FORWARD else "highest_weights"
    if method == "none":
        return np.arange(d)
    if method == "highest_weights":
        # The example itself has every feature present, so the coefficient is the feature's effect.
        return np.argsort(-np.abs(g.ridge(SELECT_ALPHA, np.arange(d))), kind="stable")[:num_features]
    if method == "forward_selection":
        used: list[int] = []
        for _ in range(min(num_features, d)):
            score = {j: g.r2(own := np.array([*used, j]), g.ridge(0.0, own)) for j in range(d) if j not in used}
            best = max(score.values())
            # The first of those that are equally good, but for rounding.
            used.append(next(j for j, v in score.items() if v >= best - 1e-12))
        return np.array(used, int)
    if method == "lasso_path":
        xx, xy, _ = g.centred
        if num_features >= d and np.linalg.cond(xx) < 1e8:  # the end of the path, where all features are
            return np.flatnonzero(np.linalg.solve(xx, xy))
        path = lasso_path(xx, xy)
        # The last knot with few enough features; if even the first has more, the first.
        for b in path[:0:-1]:
            if len(found := np.flatnonzero(b)) <= num_features:
                return found
        return np.flatnonzero(path[1]) if len(path) > 1 else np.arange(min(d, num_features))
    raise ValueError(f"no selection called {method}")


def _sums(key: str):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Gram] = {}

        def out(ids: list[int]) -> pa.RecordBatch:
            done = [held.pop(i) for i in ids]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([g.rows for g in done], pa.int64()), pa.array([g.sums.tobytes() for g in done], pa.binary())], ["key", "rows", "sums"])

        for b in batches:
            if not b.num_rows:
                continue
            ids, y, w = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in (key, "score", "weight"))
            x = b.column(b.schema.get_field_index("same")).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
            if (np.diff(ids) < 0).any():
                order = np.argsort(ids, kind="stable")
                ids, y, w, x = ids[order], y[order], w[order], x[order]
            cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for lo, hi in zip(cuts, cuts[1:]):
                g, k = Gram.of(x[lo:hi], y[lo:hi], w[lo:hi]), int(ids[lo])
                held[k] = held.pop(k) + g if k in held else g
            most = max(1, HELD_NUMBERS // (x.shape[1] + 2) ** 2)
            if len(held) > most:  # those not met for longest go
                yield out(list(held)[:len(held) - most // 2])
        if held:
            yield out(list(held))
    return task


def gram_sums(scored: DataFrame, key: str) -> DataFrame:
    """(key, rows, sums): partial matrices, some for each example and task. Nothing is shuffled."""
    rows = scored.select(F.col(key).cast("long").alias(key), F.col("score").cast("double").alias("score"), F.col("weight").cast("double").alias("weight"), "same")
    return rows.mapInArrow(_sums(key), "key long, rows long, sums binary")


def local_models(scored: DataFrame, key: str, num_features: int, method: str = "lasso_path", alpha: float = FIT_ALPHA) -> DataFrame:
    """(key, pos, weight, intercept, r2, local_score, rows): per example a ridge fit of ``score`` on ``same``.

    The features are chosen by ``method`` (one of ``METHODS``). ``local_score`` is the model's value at the
    example itself, where all features are present; ``rows`` counts the rows of the example. Rows may
    come in any order and lie in any number of tasks. Fewer features than asked for give fewer rows.
    """
    if method not in METHODS:
        raise ValueError(f"no selection called {method}")
    schema = pa.schema([(key, pa.int64()), ("pos", pa.int32()), ("weight", pa.float64()), ("intercept", pa.float64()), ("r2", pa.float64()), ("local_score", pa.float64()), ("rows", pa.int64())])

    def solve(example: int, g: Gram) -> list[tuple]:
        use = select(g, num_features, method)
        coef = g.ridge(alpha, use) if len(use) else np.zeros(0)
        base, r2 = float(g.intercept(use, coef)), float(g.r2(use, coef))
        return [(example, int(use[i]), float(coef[i]), base, r2, base + float(coef.sum()), g.rows) for i in np.argsort(-np.abs(coef), kind="stable")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, g, out = None, None, []
        for b in batches:
            for k, n, raw in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("key", "rows", "sums"))):
                sums = np.frombuffer(raw, float)
                own = Gram(sums.reshape(round(len(sums) ** 0.5), -1), n)
                if k == now:
                    g = g + own
                    continue
                if g is not None:
                    out += solve(now, g)
                now, g = k, own
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                    out = []
        if g is not None:
            out += solve(now, g)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    # A number of parts that stays: the matrices are small, their solutions are not.
    parts = gram_sums(scored, key).repartition(slice_count(scored), "key").sortWithinPartitions("key")
    return parts.mapInArrow(task, f"{key} long, pos int, weight double, intercept double, r2 double, local_score double, rows long")


def local_fit(scored: DataFrame, key: str, num_features: int, method: str = "lasso_path") -> DataFrame:
    """(key, pos, weight) of ``local_models``."""
    return local_models(scored, key, num_features, method).select(key, "pos", "weight")

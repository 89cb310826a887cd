"""Lagged time-step features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.functions.exprs import col


def lag_name(i: int, feature: str) -> str:
    return f"(-{i}){feature}"


def lag_assembly(df: DataFrame, features: Sequence[str], t_x: int, since=None, client: str = "ClientID",
                 date: str = "Date") -> DataFrame:
    """Past values beside the current one, by row position within the client, missing ones 0.

    Rows before ``since`` only serve as past values. Lag columns come last, oldest step first, with
    the unlagged features after them, which is the order sequence models expect. A client has one
    row per anchor, so the window is bounded by the grid.
    """
    w = W.partitionBy(client).orderBy(date)
    rest = [col(c) for c in df.columns if c not in features]
    lags = [F.coalesce(F.lag(col(f), i).over(w), F.lit(0)).alias(lag_name(i, f)) for i in range(t_x - 1, 0, -1) for f in features]
    out = df.select(*rest, *lags, *[col(f) for f in features])
    return out.where(F.col(date) >= since) if since is not None else out


def split_sequence(features: Column, t_x: int, step_features: int) -> tuple[Column, Column]:
    """An assembled feature array as its static part and its ``t_x`` steps, oldest first."""
    tail = t_x * step_features
    static = F.slice(features, F.lit(1), F.size(features) - tail)
    steps = F.transform(F.sequence(F.lit(0), F.lit(t_x - 1)), lambda i: F.slice(
        features, F.size(features) - tail + i * step_features + 1, F.lit(step_features)))
    return static, steps

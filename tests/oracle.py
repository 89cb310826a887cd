"""Compare a registered query with its SQL counterpart on the parquet tables."""

import glob
import os

import duckdb
import pandas as pd

ROOT = os.environ.get("SPANLEDGER_TESTDATA", "/root/testdata")


def connect(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{ROOT}/{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].map(lambda v: hasattr(v, "tolist") or isinstance(v, list)).any():
            df[c] = df[c].map(lambda v: str(list(v)) if v is not None else None)
        elif pd.api.types.is_float_dtype(df[c]):
            df[c] = df[c].round(6) + 0.0
    df = df.astype(object).where(df.notna(), None)
    return df.sort_values(list(df.columns), key=lambda s: s.map(str)).reset_index(drop=True)


def compare(query, spark, con, sf: str) -> str | None:
    got = tidy(query.run(spark, f"{ROOT}/{sf}").toPandas())
    want = tidy(con.sql(query.sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} != {list(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for c in got.columns:
        bad = [(a, b) for a, b in zip(got[c], want[c])
               if not (a == b or (isinstance(a, float) and isinstance(b, (float, int)) and abs(a - b) <= 1e-6 * max(1, abs(a)))
                       or (a is None and b is None))]
        kinds = {type(v).__name__ for v in got[c]} - {"NoneType"}, {type(v).__name__ for v in want[c]} - {"NoneType"}
        if bad:
            return f"{c}: {len(bad)} differ, e.g. {bad[:3]}"
        if kinds[0] != kinds[1] and kinds[0] and kinds[1]:
            return f"{c}: types {kinds}"
    return None

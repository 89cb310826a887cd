"""Small shared pieces: paths of vocabularies, tables, and reliable cuts."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.session import cut_lineage, pin_utc, shared_folder

__all__ = ["QUERIES", "LlmQuery", "cut_lineage", "fresh_names", "new_folder", "query", "see_package", "table", "vocabulary"]


@dataclass(frozen=True)
class LlmQuery:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, LlmQuery] = {}


def see_package(spark: SparkSession) -> SparkSession:
    """Lets Python workers of a local session import this package; on a cluster it is installed or sent with --py-files."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    now = sc.environment.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if sc.master.startswith("local") and root not in now.split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [now])])
    return spark


def query(name: str, sql: str | None = None):
    """Registers ``fn(spark, sf_dir)`` with the SQL of its result, where there is one."""
    def wrap(fn):
        QUERIES[name] = LlmQuery(lambda spark, sf_dir: fn(see_package(pin_utc(spark)), sf_dir), sql)
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, as installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the cluster shares."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case, whatever its columns are called."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"{n}_"
        taken.add(n.lower())
        out.append(n)
    return out


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))

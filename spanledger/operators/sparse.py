"""Wide rows without columns: dictionaries of any size as tables, rows as (size, indices, values).

A one-hot column per value ends where a table gets too wide. Here every (feature, value) has a place in one
dictionary, numbered by ranges of it with carried offsets, and a row lists the places it fills. Neither the
dictionary nor anything else that grows with the values is read to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, functions as F

from spanledger.functions.ordered import range_rank
from spanledger.operators.answers import is_numeric
from spanledger.operators.collapse import distinct_values, unpivot

# Terms of a column that are sent to all tasks.
FEW_TERMS = 100_000


def dictionary(terms: DataFrame) -> DataFrame:
    """(feature, value, at): distinct terms with places 0.. in the order of feature and value, nulls first.

    ``terms`` has a text ``feature``, not null, and a text ``value``; a null value stands for a numeric feature's one place.
    """
    known = terms.select("feature", "value").distinct().withColumn("_all", F.lit(0))
    return range_rank(known, "_all", ["feature", "value"], "at").select("feature", "value", (F.col("at") - 1).alias("at"))


def terms_of(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Terms of text columns; nulls are none."""
    return distinct_values(df, columns)


def _size(known: DataFrame) -> Column:
    return known.agg(F.count("*")).scalar()


def sparse_rows(cells: DataFrame, keys: Sequence[str], known: DataFrame) -> DataFrame:
    """(keys, size, indices, values): one row per key from cells (keys, feature, value, x).

    Cells of one place are combined to the largest ``x`` before the dictionary is joined, so a hot key and a hot value are small by
    then. Terms that the dictionary lacks, null features and ``x`` of 0 or null fill no place; a key with such cells only is a row
    without places. ``size`` is that of the dictionary. A row holds as many places as it has different terms.
    """
    once = cells.groupBy(*keys, "feature", "value").agg(F.max("x").alias("x"))
    k = known.select(F.col("feature").alias("_f"), F.col("value").alias("_v"), "at")
    placed = once.join(k, (F.col("feature") == F.col("_f")) & F.col("value").eqNullSafe(F.col("_v")), "left")
    filled = F.when(F.col("at").isNotNull() & (F.col("x") != 0), F.struct("at", "x"))
    rows = placed.groupBy(*keys).agg(F.array_sort(F.collect_list(filled)).alias("_c"))
    return rows.select(*keys, F.coalesce(_size(known), F.lit(0)).alias("size"), F.transform("_c", lambda c: c["at"]).alias("indices"),
                       F.transform("_c", lambda c: c["x"]).alias("values"))


def _counts(known: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Terms per column, one row each."""
    return {r["feature"]: r["count"] for r in known.where(F.col("feature").isin(list(columns))).groupBy("feature").count().collect()}


def _coded(df: DataFrame, feature: str, value: Column, known: DataFrame, code: str, out: str, terms: int) -> DataFrame:
    """Rows with the code of a value, null where it has none.

    Up to ``FEW_TERMS`` terms are sent out, so rows of a few hot values stay where they are; longer lists meet the rows in hash tables.
    """
    v = known.where(F.col("feature") == feature).select(F.col("value").alias("_v"), F.col(code).alias(out))
    v = F.broadcast(v) if terms <= FEW_TERMS else v.hint("shuffle_hash")
    return df.join(v, value == F.col("_v"), "left").drop("_v")


def onehot_sparse(df: DataFrame, keys: Sequence[str], columns: Sequence[str], known: DataFrame, null_as: str | None = None) -> DataFrame:
    """The one-hot form of text columns: 1 at each value that any row of the key holds; nulls as ``null_as``, or no place.

    Rows look up their places column by column, as they are; then the sets of places of a key are united, in each task first, so a
    hot key is small before it is moved. A table with a row per cell would be moved in place of the rows, and be as many times longer as there are columns.
    """
    columns = list(dict.fromkeys(columns))
    terms, rows = _counts(known, columns), df.select(*keys, *[F.col(c).cast("string").alias(f"_w{i}") for i, c in enumerate(columns)])
    for i, c in enumerate(columns):
        value = F.coalesce(f"_w{i}", F.lit(null_as)) if null_as is not None else F.col(f"_w{i}")
        rows = _coded(rows, c, value, known, "at", f"_at{i}", terms.get(c, 0)).drop(f"_w{i}")
    sets = rows.groupBy(*keys).agg(*[F.collect_set(f"_at{i}").alias(f"_s{i}") for i in range(len(columns))])
    places = F.array_sort(F.concat(*[F.col(f"_s{i}") for i in range(len(columns))]))
    return (sets.select(*keys, F.coalesce(_size(known), F.lit(0)).alias("size"), places.alias("indices"))
            .withColumn("values", F.transform("indices", lambda i: F.lit(1.0))))


def answer_cells(answers: DataFrame, kinds: DataFrame) -> DataFrame:
    """(ClientID, feature, value, x) of last answers: numeric questions one place with the number, others a place per answer.

    A categorical 0 is read as Unknown, as in the table with a column per question.
    """
    a = F.col("answer")
    rows = answers.join(kinds.withColumnRenamed("question", "_q"), F.col("question") == F.col("_q"))
    number = F.col("kind") == "numeric"
    return rows.select("ClientID", F.col("question").alias("feature"), F.when(~number, F.when(a == "0", "Unknown").otherwise(a)).alias("value"),
                       F.when(number, F.when(is_numeric(a), a.cast("double"))).otherwise(1.0).alias("x"))


def as_vectors(rows: DataFrame, out: str = "features") -> DataFrame:
    """Sparse rows with a vector column for MLlib, in place of size, indices and values."""
    make = F.udf(lambda n, at, x: SparseVector(int(n), at, x), VectorUDT())
    return rows.withColumn(out, make("size", "indices", "values")).drop("size", "indices", "values")


def ordinal_wide(df: DataFrame, columns: Sequence[str], vocab: DataFrame, unknown: int = -1) -> DataFrame:
    """Columns replaced by their codes in (feature, value, code); unseen values and nulls are ``unknown``. One join per column, columns keep their order."""
    out, terms = df, _counts(vocab, columns)
    for c in columns:
        out = _coded(out, c, F.col(c).cast("string"), vocab, "code", "_code", terms.get(c, 0)).withColumn(c, F.coalesce("_code", F.lit(unknown))).drop("_code")
    return out

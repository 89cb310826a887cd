"""The corpus pipeline: documents to packed sequences, stage by stage.

Every stage takes what its predecessor kept, as a table with the columns of ``documents``, and all but the last return such a table. A stage never
crashes on null or empty texts, ties, repeated rows, an empty table or further columns: the columns of ``documents`` are taken by name, others pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm.common import new_folder, see_package, table, vocabulary
from spanledger.llm.jaccard_join import near_duplicates
from spanledger.llm.line_dedup import drop_boilerplate
from spanledger.llm.packing import best_fit_packing, token_pieces
from spanledger.llm.quality_rules import quality_rules
from spanledger.llm.substring_dedup import drop_repeats
from spanledger.session import cut_lineage, pin_utc


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage uses, and all others in one struct, out of reach of the names that operators add."""
    rest = [F.col(c) for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*rest, F.lit(0).alias("_")).alias("_rest"))


def _back(docs: DataFrame, out: DataFrame, used: tuple[str, ...], text=None, changed=None) -> DataFrame:
    """The columns of ``docs`` again; with ``changed``, its rows have the new text, and n_chars, if there is one, counts it."""
    new = {c: F.col(c) if c in used else F.col("_rest")[c] for c in docs.columns}
    if changed is not None:
        new["text"] = text
        if "n_chars" in docs.columns:
            new["n_chars"] = F.when(changed, F.char_length(text).cast("long")).otherwise(new["n_chars"])
    return out.select(*(v.alias(c) for c, v in new.items()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that fail the base rules or a cutoff of their language go."""
    used = ("doc_id", "text", "lang")
    return _back(docs, quality_rules(_aside(docs, *used), table(spark, sf_dir, "labels")).where("kept"), used)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5, for sources of any size: boilerplate lines of a source go; a document whose lines are all boilerplate stays, with an empty text.

    Copies of a document count as one page of the source: which of them stays is for the next stage."""
    used = ("text", "source")
    return _back(docs, drop_boilerplate(_aside(docs, *used), F.col("source"), min_pages=1, copies=False), used, F.col("text"), F.col("n_removed") > 0)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4, five words and 0.8: of each component the document with the smallest number stays (rows of equal number and text: one).

    A document without shingles or number is no copy and stays, as do documents of one number that differ."""
    near = cut_lineage(near_duplicates(docs, n=5, percent=80))
    gone = near.where("doc_id <> component_id").select("doc_id").distinct()
    again = near.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    if again.limit(1).count():
        twice = left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        left = left.join(again, "doc_id", "left_anti").unionByName(twice)
    return left.select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: words of 50-word windows that an earlier document has go; other texts stay as they are."""
    used, changed = ("doc_id", "text"), F.col("n_removed") > 0
    return _back(docs, drop_repeats(_aside(docs, *used)), used, F.when(changed, F.col("kept_text")).otherwise(F.col("text")), changed)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: token pieces of all documents in sequences of 2048."""
    return best_fit_packing(token_pieces(docs, vocabulary("byte_bpe_50k.json"), end_id=0))


STAGES = [
    ("quality_rules", keep_quality),
    ("line_dedup", drop_site_lines),
    ("ngram_jaccard_join", keep_one_of_each),
    ("substring_dedup", drop_repeated_passages),
    ("best_fit_packing", pack),
]
#: Tokens and their packing are not SQL; the stages before have brute-force tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result is written as Parquet below the shared folder and read again as the documents of the next."""
    spark = see_package(pin_utc(spark))
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "corpus-pipeline")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs

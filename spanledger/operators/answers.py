"""Questionnaire answers: one row per client, one column per question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from spanledger.functions.exprs import int_div
from spanledger.operators.collapse import MAX_COLUMNS

# What a question text must match to be replaced by its description, and clean-up.
ANY_THREE = "..."
NOISE = "[%\r\n]"


def answers_asof(df: DataFrame, when: str, date: str = "SPDAT_Date") -> DataFrame:
    """Answers dated by ``when``; undated ones go."""
    d = F.col(date)
    d = F.try_to_timestamp(d) if df.schema[date].dataType.simpleString() == "string" else d
    return df.where(d <= F.lit(when).cast("timestamp"))


def question_subst(df: DataFrame, literal: bool = False) -> DataFrame:
    """Question text replaced by the description.

    The pattern is a regular expression by default, so any text of three characters matches;
    ``literal`` asks for the three dots themselves.
    """
    q = F.col("QuestionE")
    hit = q.contains(ANY_THREE) if literal else q.rlike(ANY_THREE)
    return df.withColumn("QuestionE", F.when(hit, F.col("DescriptionE")).otherwise(q))


def is_numeric(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))


def question_roots(df: DataFrame, chunk: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(answers with full questions, root questions to leave out).

    A row with a numeric component is a root; the parts after it get its text in front. A root
    directly followed by a part is only a heading. Intakes are read in chunks of positions, each
    handing on its last root and its first row, so a very long intake is spread over tasks.
    """
    keys = ["ClientID", "IntakeID"]
    rows = (df.withColumn("_num", is_numeric(F.col("Component"))).withColumn("_b", int_div(F.col("pos"), chunk)))
    over = W.partitionBy(*keys).orderBy("_b")
    ends = (rows.groupBy(*keys, "_b")
            .agg(F.max(F.when(F.col("_num"), F.struct("pos", "QuestionE"))).alias("_r"), F.min(F.struct("pos", "_num")).alias("_f"))
            .select(*keys, "_b", F.max("_r").over(over.rowsBetween(W.unboundedPreceding, -1))["QuestionE"].alias("_before"),
                    F.lead("_f").over(over)["_num"].alias("_after")))
    w = W.partitionBy(*keys, "_b").orderBy("pos")
    here = F.last(F.when(F.col("_num"), F.col("QuestionE")), ignorenulls=True).over(w)
    out = (rows.join(ends, [*keys, "_b"])
           .withColumn("_root", F.coalesce(here, "_before", F.lit("")))
           .withColumn("_next", F.coalesce(F.lead("_num").over(w), "_after")))
    roots = out.where(F.col("_num") & ~F.col("_next")).select("QuestionE").distinct()
    full = F.when(F.col("_num"), F.col("QuestionE")).otherwise(F.concat("_root", "QuestionE"))
    return out.withColumn("QuestionE", full).select(*df.columns), roots


def last_answers(df: DataFrame, roots: DataFrame) -> DataFrame:
    """(ClientID, question, answer): the last answer of each question that is no heading."""
    return (df.join(roots, "QuestionE", "left_anti")
            .groupBy("ClientID", F.col("QuestionE").alias("question"))
            .agg(F.max(F.struct("pos", F.col("ScoreValue").cast("string").alias("a")))["a"].alias("answer")))


def answer_types(answers: DataFrame) -> DataFrame:
    """(question, kind): numeric when every answer is digits, else categorical."""
    return (answers.groupBy("question").agg(F.min(is_numeric(F.col("answer")).cast("int")).alias("n"))
            .select("question", F.when(F.col("n") == 1, "numeric").otherwise("categorical").alias("kind")))


def clean_name(c: Column) -> Column:
    return F.regexp_replace(c, NOISE, "")


def answers_pivot(answers: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """Wide table: numeric questions as double, categorical ones as text with 0 read as Unknown.

    The question list is what bounds the width; it is read first so that the pivot needs no extra job.
    """
    rows = (kinds if kinds is not None else answer_types(answers)).limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} questions; use operators.sparse")
    wide = []
    for r in sorted(rows, key=lambda r: r["question"]):
        name = r["question"].replace("%", "").replace("\r", "").replace("\n", "")
        a = F.max(F.when(F.col("question") == r["question"], F.col("answer")))
        if r["kind"] == "numeric":
            wide.append(a.cast("double").alias(name))
        else:
            wide.append(F.when(a == "0", "Unknown").otherwise(a).alias(name))
    return answers.groupBy("ClientID").agg(*wide)


def questionnaire(df: DataFrame, when: str, literal: bool = False) -> DataFrame:
    """Raw answers to the wide table, as known at ``when``."""
    full, roots = question_roots(question_subst(answers_asof(df, when), literal))
    return answers_pivot(last_answers(full, roots))

"""One query per operator, with the parameters of production and the columns that are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanledger.llm.byte_bpe import encode_bytes, id_digest
from spanledger.llm.common import new_folder, query, table, vocabulary
from spanledger.llm.conversation_repair import damaged, repair_report
from spanledger.llm.curriculum import curriculum
from spanledger.llm.embedding_dedup import embedding_dedup
from spanledger.llm.hard_negatives import hard_negatives
from spanledger.llm.jaccard_join import near_duplicates
from spanledger.llm.line_dedup import drop_boilerplate, url_host
from spanledger.llm.native_sql import CONVERSATION_REPAIR, CURRICULUM, HARD_NEGATIVES, LINE_DEDUP, QUALITY_RULES, SCHEDULES
from spanledger.llm.packing import best_fit_packing, token_pieces
from spanledger.llm.quality_classifier import THRESHOLD, held_out as classifier_held_out, quality_scores
from spanledger.llm.quality_rules import quality_rules
from spanledger.llm.sharding import shard_records
from spanledger.llm.substring_dedup import drop_repeats
from spanledger.llm.token_files import read_token_files, write_token_files


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return best_fit_packing(token_pieces(docs, vocabulary("byte_bpe_50k.json"), end_id=0))


@query("op2_token_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    files = write_token_files(docs, new_folder(spark, "token-files"), vocabulary("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, files)


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    decoded = encode_bytes(table(spark, sf_dir, "documents"), path, decoded=True)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), id_digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_sharding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_records(spark, table(spark, sf_dir, "documents"), new_folder(spark, "slot-map"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
                        "virtual_slot", "map_version")


@query("op5_line_dedup", LINE_DEDUP)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every tag ends a line.
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    out = drop_boilerplate(pages, url_host())
    return out.select("page_id", F.coalesce(url_host(), F.lit("")).alias("host"), "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_quality_rules", QUALITY_RULES)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_substring_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.select("doc_id", classifier_held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


@query("op7_embedding_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


@query("op13_curriculum_mix", CURRICULUM)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum(table(spark, sf_dir, "documents"), SCHEDULES)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("position"), F.get("positions", F.lit(1)).alias("again"))


@query("op12_hard_negatives", HARD_NEGATIVES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("double")).otherwise(F.floor(256 * x.cast("double")).cast("double")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", moved.cast("int").alias("label"), whole.alias("vector"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0)


@query("op11_conversation_repair", CONVERSATION_REPAIR)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    report = repair_report(damaged(conversations), conversations)
    return report.select(F.col("conversation").cast("long").alias("conv_id"), *report.columns[1:])

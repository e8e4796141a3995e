"""The queries of this folder, under the names of the contract, and the SQL that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import chunks, collocations, conversations, fingerprints, language, licenses, metric_tree, mixing, packing, quality_qda, quality_rules, secrets, simhash, sql
from flowlens.llm.texts import read_documents, read_labels


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_qda.score_quality(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_rules(read_documents(spark, sf_dir), read_labels(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_likeness(read_documents(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(read_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeats(read_documents(spark, sf_dir)).select("doc_id", "start", "end", "n_chunks", "first_doc_id", "removable")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(read_documents(spark, sf_dir))
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        licenses.labels_of(F.col("base")).alias("base_labels"), licenses.labels_of(F.col("base"), F.col("detections")).alias("labels"), licenses.score_of(F.col("base"), F.col("detections")).alias("score"),
    )


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_documents(spark, sf_dir))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read_documents(spark, sf_dir))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secrets.spelled(F.col("base")), 256).alias("base_sha256"), secrets.spelled(F.col("spans")).alias("spans"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_tree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_documents(spark, sf_dir))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), here="here")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (op1_quality, op2_mixing, op3_quality_rules, op4_fingerprints, op5_packing, op6_simhash, op7_chunks, op8_licenses, op9_language, op10_secrets, op11_topk, op12_collocations, op13_conversations)
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mixing": sql.mixing_walk(), "op3_quality_rules": sql.quality_rules(), "op7_chunks": sql.repeated_chunks(),
        "op8_licenses": sql.license_scan(), "op9_language": sql.rank_profiles(), "op10_secrets": sql.secret_scan(), "op11_topk": sql.top_products(),
        "op12_collocations": sql.phrases(), "op13_conversations": sql.repaired_conversations(),
    }

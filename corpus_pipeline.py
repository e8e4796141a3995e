"""From raw documents to packed training sequences: five stages, each written and read again by the next.

All but the last return the columns of documents. Only what a stage decides leaves a document out: rules
reject it, a nearly equal document stands for it, or the mix does not take it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import mixing, packing, quality_rules, secrets, simhash
from flowlens.llm.texts import read_documents, read_labels
from flowlens.plans.shared import cut
from flowlens.plans.ship import ship


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the risk-controlled quality rules keep. Null, empty and short texts fail the base rule; repeated rows are judged
    alike; a language with too few labels, or an empty table of labels, leaves the base rule alone."""
    return quality_rules.keep_good(docs, read_labels(spark, sf_dir))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies: 256-bit SimHash of 5-word shingles, linked at
    a similarity of 0.8 or more. Rows without an id stay; of rows equal in id and text one stays, the same each time."""
    ship(spark)
    return simhash.drop_near_copies(docs, shingle=5, similarity=0.8, words=4)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark; null and empty texts as they are, very long ones whole."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null and empty texts count no words; a source without words is not taken; rows
    equal in id and text are dealt copies in turn."""
    return mixing.apply_mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens with their places in sequences. Null and empty texts are their end token alone; repeated
    rows are packed each; very long texts are cut into pieces; an empty table gives none."""
    ship(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", rules_stage),
    ("simhash near-dedup", dedup_stage),
    ("secret scans", secrets_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL has no XXH64, no BPE and no local search; tests hold the run against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage{k}")
    return docs

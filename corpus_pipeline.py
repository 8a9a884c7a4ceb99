"""The corpus pipeline: from ``documents`` to packed training sequences.

1. ``toxicity`` drops the documents that the classifier calls toxic.
2. ``near_duplicates`` keeps one document of each SimHash component (3-word shingles, 3 bits).
3. ``secret_scan`` replaces secrets in the texts by a mark and corrects ``n_chars``; no document goes.
4. ``packing`` cuts and packs the tokens of what is left into sequences of 2048.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept.  All but the
last return the columns of ``docs``, extra ones included.  Null texts count as empty and stay null,
null ids and repeated rows pass as any row (near duplicates keep one of repeated rows), and an empty
table passes through as an empty table of the stage's columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acctlens.llm import packing, secret_scan, simhash_bk, toxicity
from acctlens.llm.queries import held_out, vocabulary
from acctlens.session import cut_lineage, ship_code


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out(F.col("doc_id")))
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_bk.keep_one(docs, k=3, radius=3)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, chars_col="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), max_len=2048)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secret_scan", redact_secrets), ("packing", pack)]

# The classifier, the components and the tokenizer are beyond SQL; tests/llm hold the pipeline
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stage's rows written as Parquet and read again."""
    ship_code(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs

"""The corpus pipeline: five stages over ``documents``, each by one operator of
``roomflow.llm``. Every stage is written as Parquet and read again as the next
stage's input; all but the last return the columns of ``documents``.

1. quality rules: documents that a rule rejects go;
2. SimHash near-duplicates: one document of each component stays;
3. benchmark decontamination: documents with a benchmark passage go;
4. secret scans: secrets are masked in the text (``n_chars`` follows);
5. BPE: token ids per document (``doc_id, n_tokens, ids_sha256, ids``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roomflow.llm import bpe, decontaminate, quality_rules, secrets, simhash_dedup
from roomflow.llm.common import materialize
from roomflow.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length_col="n_chars")


def bpe_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs.select("doc_id", "text"), tokenizer_path()).select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secret_scan), ("bpe", bpe_ids)]

#: SQL has no XXH64 (stages 2 and 3) and no BPE (stage 5): tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last stage's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

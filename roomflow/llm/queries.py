"""Registered queries of the training-data operators: each applies its operator
with production parameters to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, chat_format, decontaminate, exact_dedup, licenses, packing, quality_rules, ranked_search,
               secrets, sharding, simhash_dedup, warc, whitening)
from .common import new_path
from .oracle import ORACLE  # noqa: F401  (read by the entry file)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(name: str):
    def put(f):
        QUERIES[name] = f
        return f
    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The public byte-level BPE vocabulary of the installed files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@_query("op1_warc")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(_table(spark, sf_dir, "pages"), "page_id", "html", "url")
    return back.select(
        F.col("key").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), F.col("refers_to").cast("bigint").alias("refers_to"))


@_query("op2_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ids = packing.token_ids(_table(spark, sf_dir, "documents"),
                            public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    packed = packing.write_packed(packing.pack(ids, eos=50256), new_path(spark, "packed"))
    return packed.select("part", "row", "n_tokens", F.sha2("input_ids", 256).alias("ids_sha256"), "cu_seqlens",
                         "position_resets", "doc_ids", "pieces", "first_tokens")


@_query("op3_chat_formatting")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).cast("bigint").alias("turn"), F.lit("user").alias("role")),
        F.struct(F.lit(1).cast("bigint").alias("turn"), F.lit("assistant").alias("role")))).alias("t")
    ).select(F.lit(-7).cast("bigint").alias("conv_id"), "t.turn", "t.role", F.lit(said).alias("text"))
    return chat_format.digests(chat_format.format_conversations(rows.union(own)))


@_query("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measures(_table(spark, sf_dir, "documents"))


@_query("op7_sharding")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


@_query("op4_secrets")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.BASE_RULES))

    def count(k: int) -> Column:
        hits = F.filter("spans", lambda s: s["kind"] == k)
        return F.size(hits).cast("bigint").alias(f"n_{secrets.RULES[k].name}")

    return found.select(
        "doc_id", *map(count, range(len(secrets.BASE_RULES))),
        F.sha2(secrets.span_text(base, secrets.RULES).cast("binary"), 256).alias("base_sha256"),
        secrets.span_text(F.col("spans"), secrets.RULES).alias("spans"))


@_query("op5_bpe")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path()
    ids = bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    ids = ids.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
                     F.sha2("ids", 256).alias("ids_sha256"), "ids")
    return bpe.decode(ids, path).select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


@_query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_dedup.components_of(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_query("op9_decontamination")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "distance", "similarity")


@_query("op10_licenses")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


@_query("op11_exact_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(_table(spark, sf_dir, "documents"))


@_query("op12_whitening")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.by_component(whitening.whiten(_table(spark, sf_dir, "embeddings")))
    return rows.withColumnRenamed("id", "vec_id").withColumn("deviation", F.col("deviation").cast("bigint"))


@_query("op13_ranked_search")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))

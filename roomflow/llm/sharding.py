"""Contiguous, byte-balanced shards from global prefix sums.

Rows are put in one global order (id, then checksum, size and an arbitrary
fixed tie) by range partitioning; each partition's totals give the bytes and
rows before it; a window inside the partition gives the bytes and rows before
each row. The total is cut at equal targets, a row going to the shard its
middle byte falls in: shards are contiguous and differ from the target by less
than their largest row.

Only small rows (id, size, checksum) are moved unless ``carry`` asks for more
columns. A repeated or hot id is split among range partitions by the tie.

Defined results: null text has no bytes (size = overhead) and checksum 0; null
ids sort first; repeated rows take a place each and are interchangeable; an
empty table gives an empty table; other columns are ignored or carried in a
struct, where their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

N_SHARDS = 40
OVERHEAD = 16  # bytes counted per row beside its text


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, overhead: int = OVERHEAD,
                  id_col: str = "doc_id", text_col: str = "text",
                  carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` (and ``row``, a struct of the
    ``carry`` columns) for every row. Sums stay below 2**63 for up to 10**17
    bytes at 40 shards."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []
    keep = ["row"] if carry else []
    order = ["doc_id", "text_crc32", "size", "tie"]
    light = materialize(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text_or_empty(text_col)) + F.lit(overhead)).cast("bigint").alias("size"),
        F.crc32(text_or_empty(text_col).cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"), *rest), "shard-rows")
    # Written once: the range bounds are sampled, so the partition of a row must be fixed before
    # it is used twice.
    ranged = materialize(light.repartitionByRange(parts, *order).withColumn(
        "pid", F.spark_partition_id()), "shard-ranges")
    before = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    zero = F.lit(0).cast("bigint")
    offsets = (ranged.groupBy("pid").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n"))
               .select("pid", F.coalesce(F.sum("b").over(before), zero).alias("bytes_before"),
                       F.coalesce(F.sum("n").over(before), zero).alias("rows_before"),
                       F.sum("b").over(Window.partitionBy(F.lit(1))).alias("total")))
    inside = Window.partitionBy("pid").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (ranged.join(F.broadcast(offsets), "pid")
              .withColumn("begin", F.col("bytes_before") + F.sum("size").over(upto) - F.col("size"))
              .withColumn("place", F.col("rows_before") + F.row_number().over(inside) - 1)
              .withColumn("shard", F.expr(
                  f"cast(least({n_shards - 1}, ((2 * begin + size) * {n_shards}) div (2 * total)) as int)"))
              .select("doc_id", "size", "text_crc32", "shard", "place", *keep))
    placed = materialize(placed, "shard-places")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"), *keep)


def write_shards(docs: DataFrame, path: str, n_shards: int = N_SHARDS, overhead: int = OVERHEAD,
                 id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row of ``docs``, all columns in the struct ``row``, with its
    ``slot``, as Parquet under ``path/shard=k``."""
    out = assign_shards(docs, n_shards, overhead, id_col, text_col, carry=docs.columns)
    out.select("shard", "slot", "row").write.partitionBy("shard").parquet(path)

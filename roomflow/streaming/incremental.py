"""Keeping the monthly tables current as new booking / sale files land.

The aggregating operators of this library are plain ``groupBy().agg()``
plans, so they run unchanged on a streaming DataFrame: Structured Streaming
keeps one state row per group (months x rooms x properties). Each
micro-batch's complete result is written with ``foreachBatch`` into a folder of
its own epoch, so a reader never meets a half-written table and a replayed
batch (after a failure) is harmless.

Top-N and sorted outputs are not incremental; compute them from the written
table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.monthly import monthly_bookings_and_revenue, monthly_revenue_summary
from ..operators.utilization import utilization_metrics
from ..session import ensure_checkpoint_dir

INCREMENTAL = {
    "monthly_revenue": monthly_revenue_summary,
    "monthly_bookings": monthly_bookings_and_revenue,
    "utilization": utilization_metrics,
}


def read_stream(spark: SparkSession, source_dir: str, schema: StructType,
                fmt: str = "parquet", max_files_per_trigger: int | None = None) -> DataFrame:
    """Stream the files of ``source_dir`` (schema required, as for any file stream)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return reader.load(source_dir)


def read_latest(spark: SparkSession, output_path: str) -> DataFrame:
    """The table as of the last epoch written under ``output_path``."""
    epochs = spark.read.parquet(output_path)
    last = epochs.agg(F.max("epoch")).first()[0]
    return epochs.where(F.col("epoch") == F.lit(last)).drop("epoch")


def start_incremental(spark: SparkSession, source_dir: str, schema: StructType, output_path: str,
                      operator: str | Callable[[DataFrame], DataFrame] = "monthly_revenue",
                      checkpoint_location: str | None = None, available_now: bool = True,
                      processing_time: str | None = None, fmt: str = "parquet") -> StreamingQuery:
    """Start a stream that writes ``operator``'s whole table for every epoch
    under ``output_path`` (see :func:`read_latest`; old epochs may be deleted).
    State and output have a row per group: months x rooms x properties.

    ``checkpoint_location`` defaults to a folder under the session's reliable
    checkpoint directory. ``available_now`` processes what is there and
    stops; give ``processing_time`` (e.g. '1 minute') for a long-running job.
    """
    op = INCREMENTAL[operator] if isinstance(operator, str) else operator
    table = op(read_stream(spark, source_dir, schema, fmt))
    if checkpoint_location is None:
        name = operator if isinstance(operator, str) else getattr(operator, "__name__", "table")
        checkpoint_location = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"

    def write_batch(batch: DataFrame, epoch: int) -> None:
        # a folder of its own per epoch: readers keep the last whole one, a re-run epoch rewrites its own
        batch.write.mode("overwrite").parquet(f"{output_path.rstrip('/')}/epoch={epoch}")

    writer = (table.writeStream.outputMode("complete").foreachBatch(write_batch)
              .option("checkpointLocation", checkpoint_location))
    if processing_time:
        writer = writer.trigger(processingTime=processing_time)
    elif available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()

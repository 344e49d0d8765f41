"""Running totals over a global order without funnelling rows into one task.

An unpartitioned window (``Window.orderBy(x)``) moves every row to a single
task. Here the rows are range-partitioned on the order, each range partition
takes its own running totals with a window, and the totals of the partitions
before it are added from a table of groups x partitions rows. The ranged rows
are checkpointed before they are used twice: the bounds of a range partitioning
are sampled, so a second evaluation may place a row elsewhere.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable


def ranged_rows(df: DataFrame, order_by: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``order_by`` and checkpointed, with the range in ``_pid``."""
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reliable(df.repartitionByRange(parts, *order_by).withColumn("_pid", F.spark_partition_id()))


def running_totals(df: DataFrame, order_by: Sequence[str], sums: Mapping[str, Column],
                   group_by: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Add inclusive running totals ``sums`` (name -> expression) in the order
    of ``order_by`` (which should be unique within a group), restarting per
    ``group_by`` group. Rows from :func:`ranged_rows` (ranged on the groups, then
    the order) are taken as they are."""
    groups = list(group_by)
    ranged = df if "_pid" in df.columns else ranged_rows(df, [*groups, *order_by], partitions)
    local = Window.partitionBy("_pid", *groups).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ranged = ranged.withColumns({f"_loc_{k}": F.sum(e).over(local) for k, e in sums.items()})
    totals = ranged.groupBy(*groups, "_pid").agg(*[F.sum(e).alias(f"_tot_{k}") for k, e in sums.items()])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*groups, "_pid", *[
        F.coalesce(F.sum(f"_tot_{k}").over(before), F.lit(0).cast(totals.schema[f"_tot_{k}"].dataType))
        .alias(f"_off_{k}") for k in sums])
    out = ranged.join(offsets, [*groups, "_pid"])
    out = out.withColumns({k: F.col(f"_off_{k}") + F.col(f"_loc_{k}") for k in sums})
    return out.drop("_pid", *[f"_loc_{k}" for k in sums], *[f"_off_{k}" for k in sums])

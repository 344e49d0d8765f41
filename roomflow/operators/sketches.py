"""Mergeable column profiles: sketches stored per part, merged on demand.

A profile of a huge table need not be taken anew when a month of data arrives. A
part (a month, a day, a load) keeps one row per column: count, minimum, maximum, a
KLL quantile sketch and an HLL distinct-count sketch. Parts merge by group-by; the
merged sketches answer as if the table had been read whole, within stated bounds:

* quantiles: the rank of an answer is off by at most :func:`rank_error` of the
  rows (twice the published error at 99 % confidence, so all but certain);
* distinct counts: the relative standard error is :func:`distinct_error`.

NaN counts as null, as in ``operators.profile``.

The most frequent value needs no bound: :func:`exact_top` counts hashed buckets
first (a mergeable sketch whose counts never lie too low), then counts exactly
those values that the buckets leave possible.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..functions import columns as C
from ..functions.totals import known
from ..session import reliable, stored

KLL_K = 1000
HLL_LOG2 = 12
BUCKETS = 1 << 14
TRIED = 64  # buckets whose values are counted first


def rank_error(k: int = KLL_K) -> float:
    """Twice the published single-sided rank error of KLL at 99 % confidence."""
    return 2 * 2.296 / k ** 0.9021


def distinct_error(log2_buckets: int = HLL_LOG2) -> float:
    return 1.04 / 2 ** (log2_buckets / 2)


def _typed(df: DataFrame, kind) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kind)]


def _stacked(df: DataFrame, part: Sequence[str], names: Sequence[str], value) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(n).alias("column"), value(n).alias("value")) for n in names])
    return df.select(*[C.col(p) for p in part], F.inline(entries))


def column_sketches(df: DataFrame, part: Sequence[str] = (), columns: Sequence[str] | None = None,
                    k: int = KLL_K, log2_buckets: int = HLL_LOG2) -> DataFrame:
    """A row per part (the columns ``part``) and numeric column: ``column, count,
    min, max, quantiles, distinct``; to be stored and merged by
    :func:`merge_sketches`. One aggregate over one scan."""
    names = list(columns) if columns else [c for c in _typed(df, NumericType) if c not in part]
    rows = _stacked(df, part, names, lambda n: known(C.col(n)).cast("double"))
    v = F.col("value")
    return rows.groupBy(*part, "column").agg(
        F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
        F.kll_sketch_agg_double(v, F.lit(k)).alias("quantiles"),
        F.hll_sketch_agg((v + F.lit(0.0)).cast("string"), F.lit(log2_buckets)).alias("distinct"))  # -0.0 is 0.0


def merge_sketches(sketches: DataFrame, part: Sequence[str] = (), k: int = KLL_K) -> DataFrame:
    """Sketch rows merged per ``part`` (none: the whole table) and column."""
    return sketches.groupBy(*part, "column").agg(
        F.sum("count").alias("count"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("quantiles", F.lit(k)).alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"))


def sketched_quantiles(sketches: DataFrame, probs: Sequence[float], part: Sequence[str] = ()) -> DataFrame:
    """``column, p, count, q`` per merged column with values; ``q`` is a value of it."""
    answers = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double(
        "quantiles", F.lit(float(p))).alias("q")) for p in probs])  # the rank must be a constant
    return sketches.where(F.col("count") > 0).select(*part, "column", "count", F.explode(answers).alias("a")).select(
        *part, "column", "a.p", "count", "a.q")


def sketched_distinct(sketches: DataFrame, part: Sequence[str] = ()) -> DataFrame:
    """``column, count, unique`` (estimate) per merged column."""
    return sketches.select(*part, "column", "count", F.hll_sketch_estimate("distinct").alias("unique"))


def check_quantiles(df: DataFrame, quantiles: DataFrame, k: int = KLL_K) -> DataFrame:
    """``column, p, count, within``: whether the exact rank of each answer in ``df``
    is within the stated error of ``p`` (one more scan; answers are few rows)."""
    names = [r["column"] for r in quantiles.select("column").distinct().collect()]  # columns of a table
    rows = _stacked(df, (), names, lambda n: known(C.col(n)).cast("double")).where(F.col("value").isNotNull())
    q = quantiles.select("column", "p", "q")
    ranks = rows.join(F.broadcast(q), "column").groupBy("column", "p").agg(  # a row per column and quantile
        F.count(F.lit(1)).alias("count"), F.count_if(F.col("value") < F.col("q")).alias("below"),
        F.count_if(F.col("value") <= F.col("q")).alias("upto"))
    e = F.lit(rank_error(k))
    low, high = F.col("below") / F.col("count"), F.col("upto") / F.col("count")
    return ranks.select("column", "p", "count", ((low <= F.col("p") + e) & (high >= F.col("p") - e)).alias("within"))


# --- the most frequent value ------------------------------------------------------

def bucket_counts(df: DataFrame, columns: Sequence[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``column, row, bucket, c``: values counted in hashed buckets, twice with
    different hashes. Counts of parts add up; none is below that of a value in it."""
    names = list(columns) if columns else _typed(df, StringType)
    rows = _stacked(df, (), names, lambda n: C.col(n)).where(F.col("value").isNotNull())
    return rows.select("column", F.posexplode(_buckets(F.col("value"), buckets)).alias("row", "bucket")).groupBy(
        "column", "row", "bucket").agg(F.count(F.lit(1)).alias("c"))


def _buckets(value: Column, buckets: int) -> Column:
    n = F.lit(buckets).cast("bigint")
    return F.array(F.pmod(F.xxhash64(value), n), F.pmod(F.xxhash64(F.lit("again"), value), n))


def exact_top(df: DataFrame, columns: Sequence[str] | None = None, buckets: int = BUCKETS,
              tried: int = TRIED) -> DataFrame:
    """``column, count, top, freq, recounted`` per string column: the most frequent
    value (ties to the smallest) and its exact count; ``recounted`` rows were counted
    by value in the last pass.

    1. Bucket counts. 2. The values of the fullest ``tried`` buckets are counted; the
    best of them has a count ``c``. 3. A value can only beat or tie it when both its
    buckets hold ``c`` rows or more: those values, and no others, are counted. On
    skewed columns few rows are left; on flat ones step 3 counts nearly all values,
    as a plain group-by would. The answer is exact either way.

    ``df`` is read once: its columns are written and the steps read them. Buckets are
    bounded, so their tables are broadcast and rows stay where they are until they
    are counted."""
    names = list(columns) if columns else _typed(df, StringType)
    places = [f"c{i}" for i in range(len(names))]  # a file takes these whatever the names
    df = stored(df.select(*[C.col(n).alias(p) for n, p in zip(names, places)]), "values").toDF(*names)
    sketch = reliable(bucket_counts(df, names, buckets))  # at most columns x 2 x buckets rows
    rows = _stacked(df, (), names, lambda n: C.col(n)).where(F.col("value").isNotNull())
    rows = rows.withColumn("at", _buckets(F.col("value"), buckets)).select(
        "column", "value", F.get("at", F.lit(0)).alias("b0"), F.get("at", F.lit(1)).alias("b1"))

    def held(buckets_of: DataFrame, row: int) -> DataFrame:
        return F.broadcast(buckets_of.where(F.col("row") == row).select("column", F.col("bucket").alias(f"b{row}")))

    # per column the fullest buckets: an array of a bounded size
    fullest = sketch.where("row = 0").groupBy("column").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("c", "bucket")), False), 1, tried).alias("most")).select(
        "column", F.explode(F.transform("most", lambda x: x["bucket"])).alias("b0"))
    first = rows.join(F.broadcast(fullest), ["column", "b0"]).groupBy("column", "value").agg(F.count(F.lit(1)).alias("c"))
    least = first.groupBy("column").agg(F.max("c").alias("least"))
    open_ = reliable(sketch.join(least, "column").where(F.col("c") >= F.col("least")).select("column", "row", "bucket"))
    last = rows.join(held(open_, 0), ["column", "b0"]).join(held(open_, 1), ["column", "b1"]).groupBy(
        "column", "value").agg(F.count(F.lit(1)).alias("c"))
    best = last.groupBy("column").agg(
        F.min_by("value", F.struct((-F.col("c")).alias("k"), F.col("value").alias("v"))).alias("top"),
        F.max("c").alias("freq"), F.sum("c").alias("recounted"))
    counts = sketch.where("row = 0").groupBy("column").agg(F.sum("c").alias("count"))
    return counts.join(best, "column").select("column", "count", "top", "freq", "recounted")

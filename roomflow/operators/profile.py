"""Table profiling (the EDA notebook) and input diagnosis.

All statistics are computed in a few distributed passes over a *long*
form of the table (one row per column and value), so profiling many columns
costs one shuffle rather than one per column:

* shape, null counts, min / max / distinct: one global aggregate each
  (map-side partials, one row per task to the final merge);
* duplicates: 16-byte row fingerprints, whole rows only where one repeats;
* numeric and datetime summaries: values are counted per (column, value) in the
  only scan of the table, written once in range partitions; moments are weighted
  aggregates of the counts, and exact quartiles with linear interpolation (pandas
  ``describe``) come from running counts over the value order, inside the ranges
  that hold a wanted rank. What is joined on the column name is broadcast. No
  column or value group ever funnels through one task. The approximate
  form is one aggregate without writing;
* categorical top value: counts per (column, value), then the most frequent
  value per column with ties to the smallest value.

A column whose values are all null keeps its row (count 0); without columns of
the wanted kind the result is empty. NaN counts as null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DateType,
    FloatType,
    DoubleType,
    NumericType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from ..functions import columns as C
from ..functions.running import ranged_rows
from ..functions.timecols import epoch_micros
from ..functions.totals import known
from ..session import reliable

QUARTILES = (0.25, 0.5, 0.75)
EPOCH_NTZ = "1970-01-01 00:00:00"


def _typed(df: DataFrame, kinds) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def _null_test(df: DataFrame, name: str) -> Column:
    dtype = {f.name: f.dataType for f in df.schema.fields}[name]
    c = C.col(name)
    if isinstance(dtype, (FloatType, DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def _long(df: DataFrame, names: Sequence[str], value: callable) -> DataFrame:
    """Stack ``names`` into (column, value) rows."""
    entries = F.array(*[F.struct(F.lit(n).alias("column"), value(n).alias("value")) for n in names])
    return df.select(F.inline(entries))


def _empty(df: DataFrame, ddl: str) -> DataFrame:
    return df.sparkSession.createDataFrame([], ddl)


def profile_shape(df: DataFrame) -> DataFrame:
    """rows, columns, elements (rows x columns)."""
    ncols = len(df.columns)
    return df.agg(F.count(F.lit(1)).alias("rows")).select(
        "rows", F.lit(ncols).cast("bigint").alias("columns"),
        (F.col("rows") * F.lit(ncols)).alias("elements"))


def profile_columns(df: DataFrame) -> DataFrame:
    """One row per column: position, column, dtype, null_count (NaN counts as null)."""
    counts = df.agg(*[F.count_if(_null_test(df, n)).alias(f"_n{i}") for i, n in enumerate(df.columns)])
    entries = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("position"), F.lit(n).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("dtype"), F.col(f"_n{i}").alias("null_count"))
        for i, (n, f) in enumerate(zip(df.columns, df.schema.fields))])
    return counts.select(F.inline(entries))


def _value_counts(long_df: DataFrame, partitions: int | None = None) -> DataFrame:
    """``column, value, c`` per distinct value (0 for null), ranged and written once."""
    counts = long_df.groupBy("column", "value").agg(F.count("value").alias("c"))
    return ranged_rows(counts, ["column", "value"], partitions)


def exact_quantiles(long_df: DataFrame, probs: Sequence[float] = QUARTILES,
                    partitions: int | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per ``column`` (linear interpolation).

    ``long_df``: (column string, value double); nulls are left out.
    Returns (column, p, q).
    """
    return _quantiles(_value_counts(long_df, partitions), probs)


def _quantiles(counts: DataFrame, probs: Sequence[float]) -> DataFrame:
    """From ranged counts. Ranks are found in two steps: a range's first rank comes
    from the totals of the ranges before it, so only ranges that hold a wanted rank
    are put in order. Wanted ranks are few (``probs`` x columns) and are broadcast: a
    join that moves rows by column would bring a column together in one task."""
    hit_lo = (F.col("before") <= F.col("lo")) & (F.col("lo") < F.col("after"))
    hit_hi = (F.col("before") <= F.col("hi")) & (F.col("hi") < F.col("after"))
    so_far = Window.partitionBy("column").orderBy("_pid")  # columns x ranges rows
    ranges = reliable(counts.groupBy("column", "_pid").agg(F.sum("c").alias("c")).withColumn("after", F.sum("c").over(so_far))
                      .select("column", "_pid", (F.col("after") - F.col("c")).alias("before"), "after"))
    n = ranges.groupBy("column").agg(F.max("after").alias("n")).where("n > 0")
    targets = n.select("column", F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("p"), "n")
    h = (F.col("n") - 1).cast("double") * F.col("p")
    targets = targets.select("column", "p", h.alias("h"),
                             F.floor(h).alias("lo"), F.ceil(h).alias("hi"))
    wanted = ranges.join(targets, "column").where(hit_lo | hit_hi)
    held = wanted.select("column", "_pid", F.col("before").alias("start")).distinct()
    in_order = Window.partitionBy("column", "_pid").orderBy("value")
    cum = (counts.join(F.broadcast(held), ["column", "_pid"])
           .withColumn("after", F.col("start") + F.sum("c").over(in_order))
           .select("column", "_pid", "value", (F.col("after") - F.col("c")).alias("before"), "after"))
    picked = (cum.join(F.broadcast(wanted.select("column", "_pid", "p", "h", "lo", "hi")), ["column", "_pid"])
              .where(hit_lo | hit_hi)
              .groupBy("column", "p", "h", "lo", "hi")
              .agg(F.max(F.when(hit_lo, F.col("value"))).alias("v_lo"),
                   F.max(F.when(hit_hi, F.col("value"))).alias("v_hi")))
    q = F.when(F.col("lo") == F.col("hi"), F.col("v_lo")).otherwise(
        F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * (F.col("h") - F.col("lo").cast("double")))
    return picked.select("column", "p", q.alias("q"))


def _with_quartiles(stats: DataFrame, counts: DataFrame) -> DataFrame:
    wide = _quantiles(counts, QUARTILES).groupBy("column").agg(*[
        F.max(F.when(F.col("p") == F.lit(p), F.col("q"))).alias(f"p{int(p * 100)}") for p in QUARTILES])
    return stats.join(wide, "column", "left")  # one row per column on each side


def _sketched(value: Column, accuracy: int) -> list[Column]:
    # mergeable quantile sketch per column: bounded memory
    q = F.percentile_approx(value, [float(p) for p in QUARTILES], accuracy)
    return [F.get(q, F.lit(i)).alias(f"p{int(p * 100)}") for i, p in enumerate(QUARTILES)]


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                    accuracy: int = 10000) -> DataFrame:
    """count, mean, std (sample), min, p25, p50, p75, max per numeric column.

    Quartiles are exact (linear interpolation) by default; ``approx=True``
    uses ``percentile_approx`` (rank error about 1/``accuracy``, no
    interpolation) for very large tables.
    """
    names = list(columns) if columns else _typed(df, NumericType)
    if not names:
        return _empty(df, "column string, count bigint, mean double, std double, min double, p25 double, "
                          "p50 double, p75 double, max double")
    long_df = _long(df, names, lambda n: known(C.col(n)).cast("double"))
    v, c = F.col("value"), F.col("c")
    ends = [F.min(v).alias("min"), F.max(v).alias("max")]
    if approx:
        out = long_df.groupBy("column").agg(
            F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), *ends,
            *_sketched(v, accuracy))
    else:
        counts = _value_counts(long_df)
        n = F.sum("c")
        means = counts.groupBy("column").agg(
            n.alias("count"), F.when(n > 0, F.sum(v * c) / n).alias("mean"), *ends)
        # squares about the mean, so that nothing cancels; means has one row per column
        squares = counts.join(F.broadcast(means.select("column", "count", "mean")), "column").groupBy("column").agg(
            F.when(F.first("count") > 1, F.sqrt(F.sum(c * (v - F.col("mean")) * (v - F.col("mean")))
                                                / (F.first("count") - 1))).alias("std"))
        out = _with_quartiles(means.join(squares, "column"), counts)
    return out.select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def _micros(c: Column) -> Column:
    return epoch_micros(c.cast("timestamp_ntz"))


def _from_micros(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", c.cast("bigint"), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def profile_datetime(df: DataFrame, columns: Sequence[str] | None = None, approx: bool = False,
                     accuracy: int = 10000) -> DataFrame:
    """count, mean, min, p25, p50, p75, max per timestamp/date column
    (computed on microseconds, returned as timestamp_ntz); ``approx`` as in
    ``profile_numeric``."""
    names = list(columns) if columns else _typed(df, (TimestampType, TimestampNTZType, DateType))
    if not names:
        return _empty(df, "column string, count bigint, " + ", ".join(
            f"{c} timestamp_ntz" for c in ("mean", "min", "p25", "p50", "p75", "max")))
    long_df = _long(df, names, lambda n: _micros(C.col(n)).cast("double"))
    v = F.col("value")
    ends = [F.min(v).alias("min"), F.max(v).alias("max")]
    micros = v.cast("decimal(19,0)")
    if approx:
        out = long_df.groupBy("column").agg(F.count(v).alias("count"), F.sum(micros.cast("decimal(28,0)")).alias("_s"),
                                            *ends, *_sketched(v, accuracy))
    else:
        counts = _value_counts(long_df)
        out = _with_quartiles(counts.groupBy("column").agg(
            F.sum("c").alias("count"), F.sum(micros * F.col("c").cast("decimal(18,0)")).alias("_s"), *ends), counts)
    # the nearest whole microsecond, in exact integers
    out = out.withColumn("mean", F.expr(
        "CASE WHEN count > 0 THEN (2 * _s + count) div (2 * count) END").cast("double")).drop("_s")
    as_ts = lambda c: _from_micros(F.floor(F.col(c) + F.lit(0.5))).alias(c)
    return out.select("column", "count", as_ts("mean"), as_ts("min"), as_ts("p25"), as_ts("p50"),
                      as_ts("p75"), as_ts("max"))


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """count, unique, top (most frequent; ties to the smallest), freq per string column."""
    names = list(columns) if columns else _typed(df, StringType)
    if not names:
        return _empty(df, "column string, count bigint, unique bigint, top string, freq bigint")
    long_df = _long(df, names, lambda n: C.col(n))
    counts = long_df.groupBy("column", "value").agg(F.count("value").alias("c"))  # 0 for the null value
    known_c = F.when(F.col("value").isNotNull(), F.col("c"))
    return counts.groupBy("column").agg(
        F.sum("c").alias("count"), F.count("value").alias("unique"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(
            (-F.col("c")).alias("k"), F.col("value").alias("v")))).alias("top"),
        F.max(known_c).alias("freq"))


def profile_min_max_unique(df: DataFrame, approx: bool = False) -> DataFrame:
    """min, max (as strings) and distinct non-null count per column.

    ``approx=True`` uses HyperLogLog++ (``approx_count_distinct``) instead of
    exact distinct counting for very wide or very large tables.
    """
    if not df.columns:
        return _empty(df, "column string, min string, max string, unique bigint")
    floats = set(_typed(df, (FloatType, DoubleType)))
    aggs = []
    for i, n in enumerate(df.columns):
        c = known(C.col(n)) if n in floats else C.col(n)
        aggs += [F.min(c).cast("string").alias(f"_mn{i}"), F.max(c).cast("string").alias(f"_mx{i}")]
        aggs += [F.approx_count_distinct(c).alias(f"_u{i}")] if approx else []
    row = df.agg(*aggs)
    unique = (lambda i: F.col(f"_u{i}")) if approx else (lambda i: F.lit(0).cast("bigint"))
    entries = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"_mn{i}").alias("min"),
                                 F.col(f"_mx{i}").alias("max"), unique(i).alias("unique"))
                        for i, n in enumerate(df.columns)])
    ends = row.select(F.inline(entries))
    if approx:
        return ends
    # Distinct values of all columns in one shuffle of (column, value) rows.
    values = _long(df, df.columns, lambda n: (
        known(C.col(n)) + F.lit(0.0) if n in floats else C.col(n)).cast("string"))  # -0.0 equals 0.0
    counts = (values.where(F.col("value").isNotNull()).distinct()
              .groupBy("column").agg(F.count(F.lit(1)).alias("_u")))
    return ends.join(counts, "column", "left").select(
        "column", "min", "max", F.coalesce("_u", "unique").alias("unique"))


def row_fingerprint(df: DataFrame) -> Column:
    """128 bits of a whole row; equal rows have equal ones (nulls too)."""
    cols = [C.col(n) for n in df.columns]
    where = [c.isNull() for c in cols]  # a null leaves a hash as it was
    return F.struct(F.xxhash64(*cols, *where).alias("a"), F.xxhash64(F.lit("b"), *where, *cols).alias("b"))


def profile_duplicates(df: DataFrame) -> DataFrame:
    """rows, distinct_rows, duplicate_rows (rows beyond the first of each
    identical group; nulls compare equal).

    Rows are grouped by a fingerprint of 16 bytes. Only where a fingerprint repeats
    are whole rows compared, so two different rows never count as one."""
    zero = F.lit(0).cast("bigint")
    if not df.columns:
        return df.agg(F.count(F.lit(1)).alias("rows")).select(
            "rows", F.least("rows", F.lit(1).cast("bigint")).alias("distinct_rows"),
            F.greatest(F.col("rows") - 1, zero).alias("duplicate_rows"))
    counts = reliable(df.select(row_fingerprint(df).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("c"))
                      .groupBy(F.when(F.col("c") > 1, F.col("f")).alias("f")).agg(
                          F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")))
    again = counts.where(F.col("f").isNotNull()).select("f")
    own = df.select(row_fingerprint(df).alias("f"), F.struct(*[C.col(n) for n in df.columns]).alias("r"))
    groups = own.join(again, "f", "left_semi").groupBy("r").agg(F.count(F.lit(1)).alias("c"))
    repeated = groups.agg(F.count(F.lit(1)).alias("d"))
    single = counts.where(F.col("f").isNull()).agg(F.coalesce(F.sum("n"), zero).alias("s"))
    total_rows = counts.agg(F.coalesce(F.sum("c"), zero).alias("rows"))
    one = total_rows.unionByName(single, True).unionByName(repeated, True).agg(
        F.max("rows").alias("rows"), (F.max("s") + F.max("d")).alias("distinct_rows"))
    return one.select("rows", "distinct_rows", (F.col("rows") - F.col("distinct_rows")).alias("duplicate_rows"))


def _order(df: DataFrame, order_by: Sequence[str] | None, descending: bool) -> list[Column]:
    names = list(order_by) if order_by else df.columns
    if descending:
        return [C.col(n).desc_nulls_last() for n in names]
    return [C.col(n).asc_nulls_last() for n in names]


def preview_head(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """First ``n`` rows in an explicit order (all columns by default): a
    distributed top-n, not a collect."""
    return df.orderBy(*_order(df, order_by, False)).limit(n)


def preview_tail(df: DataFrame, n: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    """Last ``n`` rows of the same order (returned last-first)."""
    return df.orderBy(*_order(df, order_by, True)).limit(n)


# ---------------------------------------------------------------------------
# Input diagnosis: which column each role resolves to, and how usable it is.
# ---------------------------------------------------------------------------
BOOKING_ROLES = [("start", C.BOOKING_START, "timestamp_ntz"), ("end", C.BOOKING_END, "timestamp_ntz"),
                 ("price", C.BOOKING_PRICE, "double"), ("tenant", [C.TENANT], "string"),
                 ("room", C.ROOM_KEYS, "string"), ("product", C.PRODUCT_KEYS, "string")]
REVENUE_ROLES = [("date", C.REVENUE_DATE, "timestamp_ntz"), ("price", C.REVENUE_PRICE, "double"),
                 ("product", C.ROI_PRODUCT, "string"), ("duration", C.ROI_DURATION, "double")]


def _role_metrics(df: DataFrame, roles) -> tuple[list[Column], list[tuple]]:
    aggs, meta = [F.count(F.lit(1)).alias("_rows")], []
    for i, (role, cands, target) in enumerate(roles):
        name = C.resolve(df, cands)
        meta.append((role, ", ".join(cands), name))
        if name is not None:
            c = C.col(name)
            aggs += [F.count_if(c.isNull()).alias(f"_nul{i}"),
                     F.count_if(c.isNotNull() & c.try_cast(target).isNull()).alias(f"_bad{i}")]
        else:
            aggs += [F.lit(None).cast("bigint").alias(f"_nul{i}"),
                     F.lit(None).cast("bigint").alias(f"_bad{i}")]
    return aggs, meta


def diagnose_columns(df: DataFrame, roles=BOOKING_ROLES) -> DataFrame:
    """Per role: candidates, resolved column (NULL when none), rows, nulls,
    and non-null values that do not convert to the role's type."""
    aggs, meta = _role_metrics(df, roles)
    row = df.agg(*aggs)
    entries = F.array(*[
        F.struct(F.lit(role).alias("role"), F.lit(cands).alias("candidates"),
                 F.lit(name).cast("string").alias("resolved"), F.col("_rows").alias("rows"),
                 F.col(f"_nul{i}").alias("nulls"), F.col(f"_bad{i}").alias("bad_values"))
        for i, (role, cands, name) in enumerate(meta)])
    return row.select(F.inline(entries))


class LoadDiagnosis:
    """The diagnosis of a table, collected by whatever reads it.

    ``table`` is the table to use in place of ``df``; its first action (a write, a
    count) fills the metrics as rows pass by, and :meth:`rows` then gives the rows of
    :func:`diagnose_columns` without another scan."""

    def __init__(self, df: DataFrame, roles=BOOKING_ROLES):
        aggs, self._meta = _role_metrics(df, roles)
        self._spark = df.sparkSession
        self._seen = Observation()
        self.table = df.observe(self._seen, *aggs)

    def rows(self) -> DataFrame:
        """Waits for the first action on ``table``."""
        m = self._seen.get
        return self._spark.createDataFrame(
            [(role, cands, name, m["_rows"], m[f"_nul{i}"], m[f"_bad{i}"])
             for i, (role, cands, name) in enumerate(self._meta)],
            "role string, candidates string, resolved string, rows bigint, nulls bigint, bad_values bigint")

"""Frequent itemsets by prefix classes with diffsets.

Tenants are dealt into chunks of about ``CHUNK``; in a chunk an item is a bit per
tenant, so all items of a chunk are a few megabytes. Items are numbered
from the rarest on. A class holds the itemsets with one smallest item: a task takes
the bits of that item and of the more frequent ones and walks its itemsets depth
first. Below the first level an itemset keeps its diffset only, the tenants that
its prefix has and it has not (``d(PXY) = d(PY) - d(PX)``,
``support(PXY) = support(PX) - |d(PXY)|``): diffsets shrink on dense baskets, and a
branch ends as soon as its support does. A diffset is taken in blocks of words and
left where its prefix can no longer stay frequent, which most that fail show early.

With more than one chunk every itemset that is frequent as a whole is frequent in
some chunk. Chunks where a found itemset stayed under the local limit are counted
for it in a second pass, unless its bound already rules it out, so supports are
exact. Frequent items are few by nature (at most mean basket size / support);
memory of a task depends on the chunk, not on the table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import reliable, ship_package

CHUNK = 1 << 18  # tenants
BLOCKS = (4, 2, 1)  # a diffset is tested at these parts of its words
TOGETHER = 50_000  # itemsets in an output batch
COUNTED = 100_000  # itemsets counted by a task of the second pass
_FOUND = "chunk int, items array<int>, freq bigint, least bigint"


def support_limit(min_support: float, n: int) -> int:
    """The least count whose share of ``n`` is at least ``min_support``."""
    least = max(0, math.floor(min_support * n) - 1)
    while least / n < min_support:
        least += 1
    return least


def class_itemsets(bits: np.ndarray, least: int, max_size: int | None = None) -> Iterator[tuple]:
    """``(prefix, extensions, supports)``: frequent itemsets that hold row 0 of
    ``bits`` (a row per item, ``uint64`` words): the prefix with each extension.
    Row 0 alone comes as the empty prefix with extension 0."""
    whole = int(np.bitwise_count(bits[0]).sum())
    if whole < least:
        return
    yield (), np.array([0]), np.array([whole])
    if max_size is not None and max_size < 2:
        return

    width = bits.shape[1]
    ends = sorted({-(-width // b) for b in BLOCKS})

    def frame(prefix: tuple, of: int, items: np.ndarray, has: np.ndarray, but: np.ndarray) -> tuple | None:
        """Items whose diffset ``has & ~but`` leaves enough of ``of`` (either may be one row)."""
        if not len(items):
            return None
        alive, support, done, start = None, of, [], 0
        for end in ends:
            a, b = has[..., start:end], but[..., start:end]
            if alive is not None:
                a, b = (a if a.ndim == 1 else a[alive]), (b if b.ndim == 1 else b[alive])
            diffs = a & ~b
            support = support - np.bitwise_count(diffs).sum(axis=1, dtype=np.int64)
            keep = np.flatnonzero(support >= least)
            if not len(keep):
                return None
            done.append(diffs)
            if len(keep) < len(support):
                support, done = support[keep], [d[keep] for d in done]
                alive = keep if alive is None else alive[keep]
            start = end
        return (prefix, items if alive is None else items[alive],
                done[0] if len(done) == 1 else np.concatenate(done, axis=1), support)

    top = frame((0,), whole, np.arange(1, len(bits)), bits[0], bits[1:])
    stack = [[*top, 0]] if top else []
    if top:
        yield top[0], top[1], top[3]
    while stack:
        prefix, items, diffs, support, at = stack[-1]
        if at >= len(items) - 1 or (max_size is not None and len(prefix) + 2 > max_size):
            stack.pop()
            continue
        stack[-1][4] += 1
        below = frame((*prefix, int(items[at])), int(support[at]), items[at + 1:], diffs[at + 1:], diffs[at])
        if below:
            yield below[0], below[1], below[3]
            if len(below[1]) > 1:
                stack.append([*below, 0])


def _matrix(items: pa.StructArray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Item numbers, ascending, and their rows of bits, from ``item, words`` of a row."""
    number, lists = items.flatten()
    number = number.to_numpy(zero_copy_only=False).astype(np.int32)
    order = np.argsort(number)
    row = np.empty(len(number), np.int64)
    row[order] = np.arange(len(number))
    word, value = lists.flatten().flatten()
    bits = np.zeros((len(number), words), dtype=np.uint64)
    at = np.repeat(row, lists.value_lengths().to_numpy(zero_copy_only=False))
    bits[at, word.to_numpy(zero_copy_only=False)] = value.to_numpy(zero_copy_only=False).view(np.uint64)
    return number[order], bits


def _mined(classes: DataFrame, min_support: float, max_size: int | None) -> DataFrame:
    """``chunk, items, freq, least`` of the itemsets frequent in each chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, flat, ends, freq, limit = [], [], [0], [], []

        def batch() -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            done = pa.RecordBatch.from_arrays([pa.array(chunk, pa.int32()), lists, pa.array(freq, pa.int64()),
                                               pa.array(limit, pa.int64())], names=["chunk", "items", "freq", "least"])
            chunk.clear(), flat.clear(), freq.clear(), limit.clear()
            ends[:] = [0]
            return done

        for b in batches:
            for of_chunk, n, items in zip(b.column("chunk").to_pylist(), b.column("n").to_pylist(), b.column("items")):
                # a local limit is a little low rather than high: what counts is the sum
                least = max(1, math.ceil(min_support * n * (1 - 1e-12)))
                names, bits = _matrix(items.values, -(-n // 64))
                for prefix, more, support in class_itemsets(bits, least, max_size):
                    head = names[list(prefix)].tolist() if prefix else []
                    for x, s in zip(names[more].tolist(), support.tolist()):
                        flat += [*head, x]
                        ends.append(len(flat))
                        freq.append(s)
                    chunk += [of_chunk] * len(more)
                    limit += [least] * len(more)
                    if len(freq) >= TOGETHER:
                        yield batch()
        yield batch()

    return classes.mapInArrow(run, _FOUND)


def _counted(missing: DataFrame, chunks: DataFrame, groups: int) -> DataFrame:
    """``chunk, items, freq`` of given itemsets in given chunks."""
    def count(want: pa.Table, have: pa.Table) -> pa.Table:
        lists = want.column("items").to_pylist()
        freq = [0] * len(lists)
        for n, held in zip(have.column("n").to_pylist(), have.column("items")):
            names, bits = _matrix(held.values, -(-n // 64))
            row = {int(x): k for k, x in enumerate(names)}
            for k, items in enumerate(lists):
                if all(x in row for x in items):
                    freq[k] = int(np.bitwise_count(np.bitwise_and.reduce(bits[[row[x] for x in items]])).sum())
        return pa.table({"chunk": want.column("chunk"), "items": want.column("items"),
                         "freq": pa.array(freq, pa.int64())})

    g = F.pmod(F.xxhash64("items"), F.lit(groups))
    left = missing.withColumn("g", g).groupBy("chunk", "g")
    right = chunks.withColumn("g", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.lit(groups - 1).cast("bigint")))).groupBy("chunk", "g")
    return left.cogroup(right).applyInArrow(count, "chunk int, items array<int>, freq bigint")


def frequent_itemsets_diffsets(bookings: DataFrame, min_support: float, max_size: int | None = None,
                               chunk_tenants: int = CHUNK) -> tuple[DataFrame, int]:
    """``((items sorted, freq), number of tenants)`` of the products that tenants
    book together. Tenants without a product count in the number."""
    spark = bookings.sparkSession
    ship_package(spark)
    rows = bookings.select(C.col(C.TENANT).alias("tenant"), C.col("product_name").alias("item")) \
        .where(F.col("tenant").isNotNull())
    pairs = reliable(rows.distinct())
    tenants = pairs.select("tenant").distinct()
    n = tenants.count()
    none = spark.createDataFrame([], "items array<string>, freq bigint")
    if n == 0:
        return none, 0
    n_chunks = -(-n // chunk_tenants)
    chunk = F.pmod(F.xxhash64("tenant"), F.lit(n_chunks)).cast("int")
    # a chunk's tenants are few: a window over each numbers them
    placed = tenants.select("tenant", chunk.alias("chunk")).withColumn(
        "at", F.row_number().over(Window.partitionBy("chunk").orderBy("tenant")) - 1)
    sizes = placed.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    known = pairs.where(F.col("item").isNotNull())
    least = support_limit(min_support, n)
    items = known.groupBy("item").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= max(1, least))
    names = [r["item"] for r in items.orderBy("freq", "item").collect()]  # at most basket size / support
    if not names:
        return none, n
    number = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(F.lit, range(len(names)))))
    words = (known.join(placed, "tenant")
             .select("chunk", F.element_at(number, F.col("item")).alias("item"), "at").where(F.col("item").isNotNull())
             .groupBy("chunk", "item", F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.expr("shiftleft(CAST(1 AS BIGINT), CAST(at % 64 AS INT))")).alias("bits")))
    # at most items x chunk / 64 words meet in a row
    per_item = words.groupBy("chunk", "item").agg(F.collect_list(F.struct("word", "bits")).alias("words"))
    chunks = reliable(per_item.groupBy("chunk").agg(F.collect_list(F.struct("item", "words")).alias("items"))
                      .join(sizes, "chunk"))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    classes = chunks.select("chunk", "n", "items", F.explode(F.transform("items", lambda x: x["item"])).alias("class"))
    classes = classes.select("chunk", "n", "class", F.filter("items", lambda x: x["item"] >= F.col("class")).alias(
        "items")).repartition(tasks, "chunk", "class").select("chunk", "n", "items")
    found = reliable(_mined(classes, min_support, max_size))
    if n_chunks > 1:
        found = _completed(found, chunks, n, least, min_support)
    sets = found.where(F.col("freq") >= least)
    label = F.array(*map(F.lit, names))
    return sets.select(F.array_sort(F.transform("items", lambda i: F.get(label, i))).alias("items"), "freq"), n


def _completed(found: DataFrame, chunks: DataFrame, n: int, least: int, min_support: float) -> DataFrame:
    """``items, freq`` over all chunks from what each chunk found."""
    limits = chunks.select("chunk", F.greatest(F.lit(1), F.ceil(F.lit(min_support * (1 - 1e-12)) * F.col("n"))).cast(
        "bigint").alias("most"))
    per_set = found.groupBy("items").agg(F.sum("freq").alias("got"), F.sum(F.col("least") - 1).alias("seen"))
    total = limits.agg(F.sum(F.col("most") - 1)).first()[0]
    # where it was not found an itemset has less than the local limit
    open_ = reliable(per_set.where(F.col("got") + F.lit(total) - F.col("seen") >= least).select("items"))
    missing = reliable(open_.select("items", F.explode(F.lit([r["chunk"] for r in chunks.select("chunk").collect()]).cast(
        "array<int>")).alias("chunk")).join(found, ["chunk", "items"], "left_anti").select("chunk", "items"))
    groups = max(1, -(-missing.count() // (COUNTED * max(1, chunks.count()))))
    counted = _counted(missing, chunks, groups)
    whole = found.join(open_, "items", "left_semi").select("items", "freq").unionByName(counted.select("items", "freq"))
    return reliable(whole.groupBy("items").agg(F.sum("freq").alias("freq")))

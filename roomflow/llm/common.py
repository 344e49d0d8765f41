"""Helpers shared by the training-data operators.

* :func:`materialize` cuts lineage with a Parquet table in the shared folder.
* :func:`map_arrow` is ``mapInArrow`` whose workers can import this package.
* :class:`KeyFilter` splits rows by whether a written table may hold their key, where
  the rows are: what it does not hold needs no shuffle.
* :func:`let`, :func:`words_of`, :func:`running` are native column idioms.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

SPACE = r"\x20\x09-\x0D"  # what separates words: space and the ASCII controls 9 to 13


_LOCAL: dict[str, str] = {}  # scratch folder per local application


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is
    unset, a local master gets a scratch folder (kept for the session) and any
    other master an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="roomflow-llm-")
        path = _LOCAL[app]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts lineage (a lost executor costs a re-read, not a recomputation), fixes
    anything that depends on partitioning or task order, and lets the optimizer
    see the real size. Files stay until the shared folder is cleaned.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow(f, schema)``; workers get the package first."""
    ship_package(df.sparkSession, shared_dir(df.sparkSession))
    return df.mapInArrow(f, schema)


PAGE_BITS = 15  # of a bitmap that Spark's bitmap functions build
BITS_A_KEY = 32


#: Columns of a content key: 96 bits of hashes of id and text, and the length.
KEY = ["k1", "k2", "k3"]


def content_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(doc_id, text).alias("k1"), F.hash(text).alias("k2"), F.octet_length(text).alias("k3")]


class KeyFilter:
    """Bitmaps of the hashed ``columns`` of ``keys``, at least :data:`BITS_A_KEY` bits a key,
    broadcast: a table of at most ``2 ** most_bits / 8`` bytes whatever the input. Up to
    ``2 ** most_bits / BITS_A_KEY`` keys at most one in 32 of the other rows counts as held;
    with more keys the share rises. It only decides what moves: a join decides the result.
    """

    def __init__(self, keys: DataFrame, columns: list[str], most_bits: int = 30):
        n, self.columns, self.bits = keys.count(), columns, PAGE_BITS
        while self.bits < most_bits and (1 << self.bits) < BITS_A_KEY * n:
            self.bits += 1
        place = keys.select(self._place().alias("place"))
        self.pages = materialize(
            place.groupBy(F.shiftright("place", PAGE_BITS).alias("page_no")).agg(
                F.bitmap_construct_agg(F.col("place").bitwiseAND((1 << PAGE_BITS) - 1)).alias("page")), "key-bitmaps")

    def _place(self) -> Column:
        return F.xxhash64(*self.columns).bitwiseAND((1 << self.bits) - 1)

    def _split(self, rows: DataFrame, how: str) -> DataFrame:
        at = self._place().bitwiseAND((1 << PAGE_BITS) - 1)
        byte = F.conv(F.hex(F.substring("page", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        bit = F.getbit(byte, at.bitwiseAND(7).cast("int"))
        held = (F.shiftright(self._place(), PAGE_BITS) == F.col("page_no")) & (bit == 1)
        return rows.join(F.broadcast(self.pages), held, how)

    def held(self, rows: DataFrame) -> DataFrame:
        """Rows whose key may be among the keys (all that are, and few others)."""
        return self._split(rows, "left_semi")

    def absent(self, rows: DataFrame) -> DataFrame:
        """The other rows; none of their keys is among the keys."""
        return self._split(rows, "left_anti")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A column expression used several times inside higher-order functions can be
    inlined by the optimizer and evaluated per element; a lambda variable
    cannot.
    """
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str) -> Column:
    """A text column with null as the empty string (internal names never clash:
    callers select into their own columns first)."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters outside :data:`SPACE`, in order."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


def indices(n: Column, first: int = 1) -> Column:
    """``first .. first + n - 1``; empty when ``n`` is below one."""
    return F.when(n > 0, F.sequence(F.lit(first), n + F.lit(first - 1))).otherwise(
        F.array().cast("array<int>"))


def running(values: Column, combine: Callable[[Column, Column], Column], block: int = 512) -> Column:
    """Inclusive running ``combine`` (associative) of an ``array<bigint>``, by two
    levels of blocks: ``aggregate`` copies its result at each step, so one level
    over a long array would be quadratic."""

    def scan(a: Column) -> Column:
        start = F.array().cast("array<bigint>")
        return F.aggregate(a, start, lambda acc, x: F.concat(acc, F.array(
            F.when(F.size(acc) > 0, combine(F.get(acc, F.size(acc) - 1), x)).otherwise(x))))

    def blocks(a: Column) -> Column:
        starts = F.filter(indices(F.size(a)), lambda i: (i - 1) % block == 0)
        return F.transform(starts, lambda i: scan(F.slice(a, i, block)))

    def joined(parts: Column) -> Column:
        ends = scan(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)))
        return let(ends, lambda e: F.flatten(F.transform(parts, lambda p, k: F.transform(
            p, lambda x: F.when(k > 0, combine(F.get(e, k - 1), x)).otherwise(x)))))

    return let(values, lambda a: let(blocks(a), joined))


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an ``array<bigint>``."""
    return running(values, lambda a, x: a + x)

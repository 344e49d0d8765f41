"""Exact duplicates by deterministic block naming (native column functions only).

A text is cut into blocks of a fixed number of bytes. Equal blocks get one
integer name, different blocks different names; then adjacent names are paired
and the pairs named in the same way, level by level, until each document has a
single name. Two documents have the same name exactly when their texts are
equal: names stand for compared contents, never for a digest alone.

Naming without moving the corpus twice:

* Level 0. ``groupBy(digest)`` with the set of the blocks that have it. Equal
  blocks meet in the map-side partial, so a block that a third of all rows hold
  leaves each task once; each distinct block is shuffled once. A digest is only
  a place to compare: where two different blocks share one (about a thousand at
  100 TB) both are kept apart by their content. The distinct blocks, sorted by
  digest and content, are numbered in that order. Occurrences carry digests, 8
  bytes for each block, and take names by an equi-join that adaptive execution
  can split; the few blocks with a shared digest take theirs by content.
* Level k. Pairs ``(a, b)`` of a document's names (the last may lack ``b``) are
  grouped, sorted and numbered; pairs take their names by an equi-join. Only
  documents with more than one name left take part, so the work halves.

Names of different levels never clash (the level is in the low six bits), so one
integer is the identity. Every numbering is written once before it is used.

Defined results: null counts as the empty text, which is one empty block; white
space runs (space, 9 to 13) count as one space, also at the ends; of equal texts
the smallest id stays (null ids last), of rows with the same id exactly one;
repeated rows count each; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, indices, let, materialize, text_or_empty

BLOCK = 1024  # bytes
LEVEL_BITS = 6  # of a name: up to 63 levels


def normal_text(text: Column) -> Column:
    """White space runs as one space, as UTF-8 bytes."""
    return F.regexp_replace(text, f"[{SPACE}]+", " ").cast("binary")


def blocks_of(data: Column, size: int = BLOCK) -> Column:
    """``data`` (binary) in blocks of ``size`` bytes; one empty block if empty."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(data) / F.lit(size)).cast("int"))
    return F.transform(indices(n, 0), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def digest_of(block: Column, bits: int = 64) -> Column:
    """Where equal blocks meet; fewer ``bits`` make different blocks meet too."""
    h = F.xxhash64(block)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def numbered(sorted_by: DataFrame, keys: list[str], level: int, name: str) -> DataFrame:
    """``sorted_by`` (distinct in ``keys``) with integer names that rise in the
    order of ``keys``; written, since range bounds are sampled."""
    parts = int(sorted_by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = sorted_by.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return materialize(ranged.withColumn("name", F.shiftleft(
        F.monotonically_increasing_id(), LEVEL_BITS).bitwiseOR(F.lit(level).cast("bigint"))), name)


def name_blocks(docs: DataFrame, size: int = BLOCK, digest_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """``(rows, names)`` of ``docs`` (``id``, ``text``): ``row, id, sha, n`` per
    document and ``row, n, pos, name`` per block (``n`` in its row)."""
    data = docs.select(F.col("id"), normal_text(F.col("text")).alias("data"))
    cut = let(F.col("data"), lambda d: blocks_of(d, size))
    digest = digest_of(F.col("block"), digest_bits)

    contents = data.select(F.explode(cut).alias("block")).select(digest.alias("digest"), "block")
    # A digest has one block, save for a chance meeting: the set is as good as always a single block.
    met = contents.groupBy("digest").agg(F.collect_set("block").alias("blocks"))
    alone = F.size("blocks") == 1
    met = met.select("digest", F.explode(F.when(alone, F.array(F.lit(None).cast("binary")))
                                         .otherwise(F.col("blocks"))).alias("block"))
    known = numbered(met, ["digest", "block"], 0, "block-names")
    shared = materialize(known.filter("block is not null"), "block-shared")

    own = data.withColumn("row", F.monotonically_increasing_id()).withColumn("sha", F.sha2("data", 256))
    at = own.select("row", "id", "sha", cut.alias("cut")).select(
        "row", "id", "sha", F.size("cut").alias("n"), F.posexplode("cut").alias("pos", "block")).select(
        "row", "n", "pos", digest.alias("digest"), "block",
        F.when(F.col("pos") == 0, F.struct("id", "sha")).alias("head"))
    placed = materialize(at.join(shared.withColumnRenamed("name", "own_name"), ["digest", "block"], "left").select(
        "row", "n", "pos", "digest", "own_name", "head"), "block-places")
    rows = placed.filter("pos = 0").select("row", "head.id", "head.sha")
    by_digest = known.filter("block is null").select("digest", "name")
    names = placed.select("row", "n", "pos", "digest", "own_name").join(by_digest, "digest", "left").select(
        "row", "n", "pos", F.coalesce("own_name", "name").alias("name"))
    return rows, names


def name_pairs(names: DataFrame, level: int) -> DataFrame:
    """The names ``row, n, pos, name`` of the next level (``n`` names a row)."""
    first, second = F.col("pos") % 2 == 0, F.col("pos") % 2 == 1
    pairs = materialize(names.groupBy("row", "n", F.shiftright("pos", 1).alias("pos")).agg(
        F.max(F.when(first, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(second, F.col("name"))), F.lit(-1).cast("bigint")).alias("b")), "pair-places")
    known = numbered(pairs.select("a", "b").distinct(), ["a", "b"], level, "pair-names")
    return pairs.join(known, ["a", "b"]).select("row", F.shiftright(F.col("n") + 1, 1).alias("n"), "pos", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               size: int = BLOCK, digest_bits: int = 64) -> DataFrame:
    """``row, id, sha, identity`` per row of ``docs``: equal ``identity`` exactly
    for texts that are equal after white space is folded."""
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows, names = name_blocks(own, size, digest_bits)
    done, level = None, 0
    while True:
        named = materialize(names, f"names-{level}")
        ended = named.filter("n = 1").select("row", F.col("name").alias("identity"))
        done = ended if done is None else done.union(ended)
        more = named.filter("n > 1")
        if more.isEmpty():
            break
        level += 1
        names = name_pairs(more, level)
    return rows.join(done, "row")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               size: int = BLOCK, digest_bits: int = 64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` per row of ``docs``."""
    rows = materialize(identities(docs, id_col, text_col, size, digest_bits), "exact-rows")
    rank = F.struct(F.col("id").isNull().alias("null_id"), F.col("id"), F.col("row"))
    # Written, so that the join below shuffles both sides for itself and a large group can be split.
    groups = materialize(rows.groupBy("identity").agg(
        F.min(rank).alias("keep"), F.count(F.lit(1)).alias("group_size")), "exact-groups")
    return rows.join(groups, "identity").select(
        F.col("id").alias("doc_id"), F.col("keep.id").alias("keep_id"), "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns kept."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_of"),
                         F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"),
                         F.monotonically_increasing_id().alias("at"))
    packed = materialize(packed, "exact-docs")  # so that a row keeps its number
    ranked = packed.select(F.struct(F.col("id").isNull().alias("null_id"), "id", "at").alias("rank"), "text")
    gone = duplicates(ranked, "rank", "text").filter("not kept").select(F.col("doc_id.at").alias("gone_at"))
    return packed.join(gone, packed["at"] == gone["gone_at"], "left_anti").select("row_of.*")

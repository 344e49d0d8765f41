"""SimHash near-duplicates with pivot distance tables.

1. A 64-bit fingerprint per row, computed where the row is (no shuffle).
2. Equal fingerprints meet first (``groupBy`` with map-side partials), so a
   group of exact copies is one node however large.
3. Pivot table: the Hamming distance of every distinct fingerprint to many
   reference fingerprints — zero, one mask per block of two bits, and sixteen
   mixed patterns. From the distances to zero and to a block's mask the
   number of set bits in that block follows: ``(d(x,0) - d(x,mask) + 2) / 2``.
   Two fingerprints at distance <= r change at most r blocks, so of ``GROUPS``
   groups of blocks at least ``GROUPS - r`` have equal coordinates: candidates
   are joined on those coordinates, one key per choice of groups (complete, no
   cross join, no bucket cap).
4. A candidate pair whose coordinates to the mixed pivots differ by more than r
   anywhere is discarded (triangle inequality): a random pair at 20 bits has a
   chance of about 0.4 at each pivot to stay. Survivors are verified by the exact
   distance.
5. Components by alternating large-star and small-star rounds, each written to
   the shared folder; a node's links meet in joins that adaptive execution can
   split, never in one row.

Defined results: null and empty texts (no words) have fingerprint zero and link
like any other; fewer words than a shingle form one shingle; repeated rows and
ties share a fingerprint; a null id never names a component unless all ids of
the component are null; an empty table gives an empty table; other columns are
ignored (:func:`components_of`) or passed through (:func:`keep_one`).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KeyFilter, map_arrow, materialize

SHINGLE = 3
MAX_DISTANCE = 2
SEED = 42
BLOCKS = 32  # of two bits
GROUPS = 6  # of blocks; one candidate key per choice of GROUPS - distance groups
#: Reference fingerprints: alternating runs of 1, 2, 4, 8, 16 and 32 bits, then mixed ones by a rule. Any serve.
PIVOTS = (0x5555555555555555, 0x3333333333333333, 0x0F0F0F0F0F0F0F0F, 0x00FF00FF00FF00FF, 0x0000FFFF0000FFFF,
          0x00000000FFFFFFFF, *((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64) for k in range(10)))
PIECE = 1 << 16  # shingles whose bits are counted at a time


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a UTF-8 text: A-Z lower-cased, words split at
    ASCII white space, a bit set when set in over half of the shingle hashes."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = data.lower().split()  # bytes: only A-Z change; space and 9 to 13 separate
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    hashed = partial(xxh64_intdigest, seed=SEED)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, PIECE):
        part = words[at:at + PIECE + shingle - 1]
        grams = [b" ".join(part)] if len(part) <= shingle else list(
            map(b" ".join, zip(*(part[k:] for k in range(shingle)))))
        h = np.fromiter(map(hashed, grams), dtype="<u8", count=len(grams))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def add_fingerprints(docs: DataFrame, name: str, text_col: str = "text",
                     shingle: int = SHINGLE, drop_text: bool = False) -> DataFrame:
    """``docs`` with the bigint column ``name``; columns pass through by position."""
    fields = [f for f in docs.schema.fields]
    at = docs.columns.index(text_col)
    kept = [k for k in range(len(fields)) if not (drop_text and k == at)]
    schema = T.StructType([fields[k] for k in kept] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*(fields[k].name for k in kept), name]
        for b in batches:
            texts = b.column(at).cast(pa.binary()).to_pylist()
            fps = [fingerprint(t, shingle) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in kept), pa.array(fps, pa.int64())], names=names)

    return map_arrow(docs, run, schema)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def coordinates(fp: Column) -> Column:
    """Distances to all pivots, eight to a number (a byte each)."""
    d = [_distance(fp, F.lit(_signed(p)).cast("bigint")).cast("bigint") for p in PIVOTS]
    words = [d[k:k + 8] for k in range(0, len(d), 8)]
    return F.struct(*[reduce(lambda a, x: a.bitwiseOR(x), [F.shiftleft(x, 8 * k) for k, x in enumerate(w)]).alias(f"w{i}")
                      for i, w in enumerate(words)])


def coordinate_difference(x: str, y: str) -> Column:
    """The largest difference of two rows' coordinates (column names)."""
    out = []
    for k in range(len(PIVOTS)):
        a, b = (F.shiftrightunsigned(F.col(f"{c}.w{k // 8}"), 8 * (k % 8)).bitwiseAND(255) for c in (x, y))
        out.append(F.abs(a - b))
    return F.greatest(*out)


def pivot_table(nodes: DataFrame, max_distance: int = MAX_DISTANCE, groups: int = GROUPS) -> DataFrame:
    """``table, key, fp, at``: a row per fingerprint and choice of groups, with its
    coordinates ``at``."""
    fp = F.col("fp")
    to_zero = _distance(fp, F.lit(0).cast("bigint"))
    per = [list(range(BLOCKS))[g::groups] for g in range(groups)]

    def code(blocks: list[int]) -> Column:
        out = F.lit(0).cast("bigint")
        for b in blocks:
            mask = F.lit(_signed(3 << (2 * b))).cast("bigint")
            set_bits = ((to_zero - _distance(fp, mask) + 2) / 2).cast("bigint")
            out = out * 3 + set_bits
        return out

    coded = nodes.select("fp", F.array(*[code(b) for b in per]).alias("codes"), coordinates(fp).alias("at"))
    choices = list(combinations(range(groups), groups - max_distance))
    keys = F.array(*[F.struct(
        F.lit(t).cast("smallint").alias("table"),
        F.xxhash64(*[F.get("codes", F.lit(g)) for g in c]).alias("key")) for t, c in enumerate(choices)])
    return coded.select("fp", "at", F.explode(keys).alias("k")).select("k.table", "k.key", "fp", "at")


def candidate_pairs(nodes: DataFrame, max_distance: int = MAX_DISTANCE, groups: int = GROUPS) -> DataFrame:
    """``a, b, differ``: fingerprints with an equal key, a < b, and their largest
    difference of coordinates (a pair may come from several tables)."""
    if not 0 <= max_distance < groups <= BLOCKS:
        raise ValueError(f"max_distance must be below the number of groups ({groups}), and that at most {BLOCKS}")
    t = pivot_table(nodes, max_distance, groups)
    x, y = t.alias("x"), t.alias("y")
    return x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.table") == F.col("y.table"))
                  & (F.col("x.fp") < F.col("y.fp"))).select(
        F.col("x.fp").alias("a"), F.col("y.fp").alias("b"), coordinate_difference("x.at", "y.at").alias("differ"))


def near_pairs(nodes: DataFrame, max_distance: int = MAX_DISTANCE, groups: int | None = None) -> DataFrame:
    """``(a, b)``, a < b: distinct fingerprints at most ``max_distance`` bits apart.
    Pairs whose coordinates differ by more go first, the others are verified.
    ``groups`` of blocks: as many as a larger distance needs, unless given."""
    groups = groups or max(GROUPS, max_distance + 2)
    survivors = candidate_pairs(nodes, max_distance, groups).filter(F.col("differ") <= max_distance)
    return survivors.filter(_distance(F.col("a"), F.col("b")) <= max_distance).select("a", "b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; root is the
    smallest node of its component. Large-star and small-star rounds until a
    round changes nothing (compared by count and two checksums)."""

    def mark(e: DataFrame) -> tuple:
        h = F.xxhash64("u", "v")
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).head())

    def star(e: DataFrame, by: str) -> DataFrame:
        least = materialize(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"cc-{by}")
        return e.join(least, "u")

    links = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .filter("u > v").distinct(), "cc-links")
    seen = mark(links)
    while seen[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = materialize(star(both, "large").filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-links")
        small = star(large, "small").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").filter("u > v").distinct()
        links = materialize(small, "cc-links")
        now = mark(links)
        if now == seen:
            break
        seen = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def link_fingerprints(rows: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``fp, component`` per distinct fingerprint of the written table ``rows``
    (``fp``, ``rank``): component is the smallest rank reachable."""
    nodes = materialize(rows.groupBy("fp").agg(F.min("rank").alias("rank")), "simhash-nodes")
    roots = connected_components(near_pairs(nodes, max_distance))
    roots = materialize(roots, "simhash-roots")
    linked = nodes.join(roots, nodes["fp"] == roots["node"])  # only linked fingerprints
    best = linked.groupBy("root").agg(F.min("rank").alias("component"))
    named = materialize(roots.join(best, "root").select("node", "component"), "simhash-named")
    return materialize(nodes.join(named, nodes["fp"] == named["node"], "left").select(
        "fp", F.coalesce("component", "rank").alias("component")), "simhash-classes")


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = materialize(add_fingerprints(d, "fp", "text", shingle, drop_text=True), "simhash-rows")
    classes = link_fingerprints(rows.select("fp", F.col("doc_id").alias("rank")), max_distance)
    return rows.join(classes, "fp").select("doc_id", "fp", F.col("component").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = SHINGLE, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` with one row of each component: the smallest id, then any one of
    its rows (fixed by a written row number, so a re-run task agrees)."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"),
                      F.monotonically_increasing_id().alias("tie"))
    rows = materialize(add_fingerprints(own, "fp", "text", shingle, drop_text=True), "simhash-docs")
    rank = F.struct(F.col("id").isNull().alias("null_id"), F.col("id"), F.col("tie"))
    classes = link_fingerprints(rows.select("fp", rank.alias("rank")), max_distance)
    keep = classes.select(F.col("component.tie").alias("keep_tie")).distinct()
    gone = materialize(rows.select("tie").join(keep, F.col("tie") == F.col("keep_tie"), "left_anti"), "simhash-gone")
    # Rows that surely stay are told apart where they are: only what may go moves with its text.
    known = KeyFilter(gone, ["tie"])
    stay = known.held(rows).join(gone.withColumnRenamed("tie", "gone_tie"), F.col("tie") == F.col("gone_tie"), "left_anti")
    return known.absent(rows).select("row.*").union(stay.select("row.*"))

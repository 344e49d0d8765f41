"""Benchmark decontamination by SimHash of item-sized windows.

A document is contaminated by an item when a window of as many words as the item
(the whole document, when it is shorter) has

* a SimHash at most ``radius`` bits from the item's, and
* an exact weighted-shingle similarity (Jaccard on multisets of ``shingle``-word
  shingles) of at least ``similarity``.

Method: items are the stated query set; they are taken in blocks of bounded
size against all documents. Every shingle of a document is looked up among a
block's shingles (a broadcast bounded by the block, shingles of all lengths in one
pass), which gives hit rows (document, item, position). A similarity of ``s`` needs ``2s/(1+s)`` of the
window's shingles to be hits, and moving a window right to its next hit, or to
the end of the document, never loses one; so only windows that begin at a hit
(or end with the document) and hold enough hits are fingerprinted. Fingerprints
meet those of the items that the hits belong to in multi-index Hamming blocks:
``radius + 1`` blocks of the 64 bits, at least one of which is equal within the
radius, so every pair within the radius becomes a candidate, once; the distance and
the exact similarity then decide. Work grows with the hits.

Words are runs outside space and ASCII 9-13, lower-cased. An item or window
of fewer words than ``shingle`` is one shingle. All rows are handled by content
key (hashes of id and text): a hot id is split by its texts, and equal rows are
scanned as rows but verified once.

Defined results: null and empty texts and items have no words and never match;
of repeated or tied windows the most similar, then the first, is reported; equal
items are reported each; repeated rows of a document give one report per item;
null ids are reported as null; empty tables give an empty table; other columns
are ignored (:func:`find_leaks`) or passed through (:func:`drop_leaks`).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, content_key, indices, let, materialize, running, text_or_empty, words_of

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a bit differs with probability 0.15 (mean 9.7 of 64, deviation 2.9): five
#: deviations above the mean.
RADIUS = 24
ITEM_WORDS = 1 << 18  # words of the items broadcast at a time


def _words(text: Column) -> Column:
    return words_of(F.lower(text))


def _n_shingles(n_words: Column, size: Column) -> Column:
    return F.greatest(n_words - size + 1, F.least(n_words, F.lit(1)))


def _shingles(h: Column, size: int) -> Column:
    """Hashes of the ``size``-word shingles of the word hashes ``h``, in order."""
    return F.transform(indices(_n_shingles(F.size(h), F.lit(size)), 0),
                       lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _hashes(words: Column, size: Column, sizes: Sequence[int]) -> Column:
    """Shingle hashes for the length in the column ``size``, one of ``sizes``."""
    return let(_word_hashes(words), lambda h: reduce(
        lambda rest, n: F.when(size == n, _shingles(h, n)).otherwise(rest), sizes, F.array().cast("array<bigint>")))


def _counted_shingles(words: Column, size: Column) -> Column:
    """The shingles themselves, each with its occurrence number: the size of the
    intersection of two such sets is that of the multisets."""
    sorted_shingles = F.array_sort(F.transform(
        indices(_n_shingles(F.size(words), size)), lambda i: F.array_join(F.slice(words, i, size), " ")))

    def count(s: Column) -> Column:
        first = F.transform(s, lambda x, j: F.when(
            (j > 0) & (F.get(s, j - 1) == x), F.lit(0)).otherwise(j).cast("bigint"))
        return let(running(first, lambda a, x: F.greatest(a, x)), lambda f: F.transform(
            s, lambda x, j: F.concat_ws(" ", x, (j - F.get(f, j)).cast("string"))))

    return let(sorted_shingles, count)


def _simhash(hashes: Column) -> Column:
    """SimHash of a multiset of shingle hashes: a bit is set when set in over half."""
    one = F.lit(1).cast("bigint")

    def bit(k: Column) -> Column:
        votes = F.aggregate(hashes, F.lit(0), lambda a, h: a + F.getbit(h, k).cast("int"))
        return F.when(2 * votes > F.size(hashes), F.call_function("shiftleft", one, k)).otherwise(
            F.lit(0).cast("bigint"))

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("bigint"),
                       lambda a, x: a.bitwiseOR(x))


def _hamming_blocks(fp: Column, radius: int) -> Column:
    """``radius + 1`` structs (block, bits): fingerprints within the radius share one."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return F.array(*[F.struct(
        F.lit(k).alias("block"),
        F.shiftrightunsigned(fp, cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1).alias("bits"))
        for k in range(n)])


def _first_equal_block(differ: Column, radius: int) -> Column:
    """The first of the ``radius + 1`` blocks in which two fingerprints are equal."""
    n = radius + 1
    cuts = [64 * k // n for k in range(n + 1)]
    out = F.lit(None).cast("int")
    for k in reversed(range(n)):
        part = F.shiftrightunsigned(differ, cuts[k]).bitwiseAND((1 << (cuts[k + 1] - cuts[k])) - 1)
        out = F.when(part == 0, F.lit(k)).otherwise(out)
    return out


def _item_blocks(items: DataFrame, block_words: int) -> Iterator[DataFrame]:
    """The items in hash ranges of about half of ``block_words`` words each."""
    total = items.agg(F.sum("n_words")).head()[0] or 0
    blocks = -(-2 * total // block_words)
    for k in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = SHINGLE,
               similarity: float = SIMILARITY, radius: int = RADIUS,
               block_words: int = ITEM_WORDS) -> DataFrame:
    """``k1, k2, k3, doc_id, item_id, start, n_words, distance, similarity``: per
    contaminated document (content key) and item, the best window (its first
    word and its number of words)."""
    text = F.col("text")
    keyed = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).select(
        *content_key(F.col("doc_id"), text), "doc_id", _words(text).alias("words"))
    items = benchmark.select(F.col(item_id_col).alias("item_id"), text_or_empty(item_text_col).alias("text"))
    items = materialize(items.select("item_id", "text", _words(text).alias("words")).select(
        "*", F.size("words").alias("n_words")).filter("n_words > 0"), "bench-items")
    items = items.withColumn("size", F.least("n_words", F.lit(shingle)))
    found = []
    for block in _item_blocks(items, block_words):
        sizes = sorted(r["size"] for r in block.select("size").distinct().collect())  # at most ``shingle`` rows
        if sizes:
            found.append(_scan(keyed, block, sizes, similarity, radius))
    if not found:
        return keyed.filter("false").select(
            *KEY, "doc_id", F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"),
            F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0).alias("distance"),
            F.lit(0.0).alias("similarity"))
    return reduce(DataFrame.union, found)


def _scan(keyed: DataFrame, items: DataFrame, sizes: Sequence[int], similarity: float, radius: int) -> DataFrame:
    """The leaks of one block of items, whose shingles have the lengths ``sizes``:
    one pass over the documents' words, another over the texts with enough hits."""
    words, size = F.col("words"), F.col("size")
    items = materialize(items.select(
        F.monotonically_increasing_id().alias("item"), "item_id", "words", "n_words", "size",
        _n_shingles(F.col("n_words"), size).alias("item_size"),
        _hashes(words, size, sizes).alias("hashes")).withColumn("item_fp", _simhash(F.col("hashes"))), "bench-block")

    # 1. All documents' shingles against the block's (at most block_words rows are broadcast).
    in_items = items.select("item", "n_words", "item_size", "size", F.explode(F.array_distinct("hashes")).alias(
        "h")).withColumnRenamed("n_words", "item_words")
    placed = let(_word_hashes(words), lambda h: F.concat(*[F.transform(
        _shingles(h, n), lambda x, i: F.struct(F.lit(n).alias("size"), x.alias("h"), i.alias("pos"))) for n in sizes]))
    shingled = keyed.filter(F.size("words") > 0).select(
        *KEY, F.size("words").alias("doc_words"), F.explode(placed).alias("p")).select(
        *KEY, "doc_words", "p.size", "p.h", "p.pos")
    hits = materialize(shingled.join(F.broadcast(in_items), ["h", "size"]).select(
        *KEY, "item", "item_words", "item_size", "size", "doc_words", "pos").dropDuplicates([*KEY, "item", "pos"]),
        "bench-hits")

    # 2. Windows with enough hits. ``last`` is the start of a window that ends with the document.
    window = F.least("item_size", _n_shingles(F.col("doc_words"), size))
    need = F.ceil(F.lit(similarity) * (F.col("window") + F.col("item_size")) / F.lit(1 + similarity) - F.lit(1e-9))
    grouped = hits.groupBy(*KEY, "item", "item_words", "item_size", "size", "doc_words").agg(
        F.count(F.lit(1)).alias("n"), F.collect_list("pos").alias("at")).withColumn("window", window).withColumn(
        "need", need.cast("int")).withColumn("last", _n_shingles(F.col("doc_words"), size) - F.col("window"))
    grouped = grouped.filter("n >= need").withColumn("at", F.array_sort("at"))
    here = F.filter("at", lambda p, i: (p <= F.col("last")) & F.coalesce(
        F.get("at", i + F.col("need") - 1) < p + F.col("window"), F.lit(False)))
    at_end = F.when(F.size(F.filter("at", lambda p: p >= F.col("last"))) >= F.col("need"),
                    F.array("last")).otherwise(F.array().cast("array<int>"))
    windows = materialize(grouped.select(
        *KEY, "item", "size", F.least("item_words", "doc_words").alias("window_words"), "window",
        F.explode(F.array_union(here, at_end)).alias("start")), "bench-windows")

    # 3. Fingerprints of the windows meet those of the items that their hits belong to (a similarity of
    # ``similarity`` needs hits of that very item) in multi-index blocks. A pair may share several blocks:
    # it is taken at the first, so there are at most as many rows as windows of hits.
    wanted = windows.select(*KEY).distinct()
    texts = materialize(keyed.join(wanted, KEY).dropDuplicates(KEY), "bench-texts")
    cut = windows.join(texts, KEY).select(
        *KEY, "doc_id", "item", "size", "window", "start",
        F.slice("words", F.col("start") + 1, F.col("window_words")).alias("cut"))
    printed = materialize(cut.withColumn("fp", let(_hashes(F.col("cut"), size, sizes), _simhash)), "bench-prints")
    left = printed.select(*KEY, "item", "start", "fp", F.explode(_hamming_blocks(F.col("fp"), radius)).alias("b"))
    right = items.select("item", "item_fp", F.explode(_hamming_blocks(F.col("item_fp"), radius)).alias("b"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = left.join(F.broadcast(right), ["item", "b"]).filter(
        (F.col("b.block") == _first_equal_block(differ, radius)) & (F.bit_count(differ) <= radius)).select(
        *KEY, "start", "item", F.bit_count(differ).alias("distance"))

    # 4. Exact similarity of the multisets of shingles.
    pairs = near.join(printed.select(*KEY, "doc_id", "item", "start", "window", "cut"), [*KEY, "item", "start"]).join(
        F.broadcast(items.select("item", "item_id", "item_size", "size", F.col("words").alias("item_words"))), "item")
    shared = F.size(F.array_intersect(_counted_shingles(F.col("cut"), size),
                                      _counted_shingles(F.col("item_words"), size)))
    scored = pairs.select(*KEY, "doc_id", "item_id", "item", "start", F.size("cut").alias("n_words"), "distance",
                          "window", "item_size", shared.alias("shared"))
    scored = scored.withColumn("similarity", F.col("shared") / (
        F.col("window") + F.col("item_size") - F.col("shared"))).filter(F.col("similarity") >= similarity)
    best = scored.groupBy(*KEY, "item").agg(F.max_by(
        F.struct("doc_id", "item_id", "start", "n_words", "distance", "similarity"),
        F.struct("similarity", -F.col("start"))).alias("best"))
    return best.select(*KEY, "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               **settings) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, with their columns."""
    leaked = materialize(find_leaks(docs, benchmark, id_col, text_col, **settings).select(*KEY).distinct(),
                         "bench-leaked")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       *content_key(F.col(id_col), text_or_empty(text_col)))
    return rows.join(leaked, KEY, "left_anti").select("row.*")

"""Ranked lexical search, term at a time with limited accumulators.

1. One pass over the whole texts turns each row into the terms it shares with
   the queries (term number and occurrences) and its length. Rows are written,
   texts are not kept. Corpus counts (documents with a term, all terms, documents
   of each query term) come from this table.
2. Rows are searched where they lie, a bounded number of postings at a time. For
   each query its terms are taken rarest first. A document gets an accumulator at
   its first term. After each term the k-th highest partial score is compared with
   the sum of the remaining terms' bounds (weight times the highest impact in
   these postings): once a document without an accumulator could not reach it, no
   more are created; documents that have one are still updated, exactly. The k-th
   score of earlier postings of the task is a lower limit for the next ones.
3. The k best of each task meet by query: tasks x k small rows, whatever the corpus.

Nothing is lost: a document left without an accumulator has a score strictly
below k documents of its own task. Equal scores go by ascending id (null last).

Queries are taken in blocks of at most ``VOCABULARY`` distinct terms, each with
its own pass, so that what every task holds of the queries has a bound. A very
long text is split into terms piece by piece.

Defined results: null and empty texts have no terms and are never found; a query
without terms has no rows; repeated rows rank each on their own; an empty table
gives an empty table; other columns are ignored, whatever their names. With fewer
than ``k`` documents of score above 0 all of them are returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow, materialize

TOP = 10
VOCABULARY = 200_000  # distinct terms of a block of queries
POSTINGS = 4_000_000  # searched at a time
PIECE = 1 << 20  # bytes of a text split at a time

#: Letters, digits and every byte of a character beyond ASCII; A-Z in lower case.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                    for b in range(256))


def count_terms(data: bytes) -> Counter:
    """Occurrences of each term of a UTF-8 text."""
    if len(data) <= PIECE:
        return Counter(data.translate(_TERM_BYTES).split())
    counts: Counter = Counter()
    rest = b""
    for at in range(0, len(data), PIECE):
        part = rest + data[at:at + PIECE].translate(_TERM_BYTES)
        cut = part.rfind(b" ") + 1
        counts.update(part[:cut].split())
        rest = part[cut:]
    if rest:
        counts[rest] += 1
    return counts


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def query_blocks(items: DataFrame, item_col: str, text_col: str,
                 vocabulary: int = VOCABULARY) -> Iterator[list[tuple]]:
    """Blocks of ``(item, terms)`` of at most ``vocabulary`` distinct terms (an item
    may exceed it alone), one at a time."""
    rows = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    block, seen = [], set()
    for r in rows.toLocalIterator():
        terms = sorted(count_terms((r["text"] or "").encode()))
        if block and len(seen) + len(terms) > vocabulary:
            yield block
            block, seen = [], set()
        block.append((r["item"], terms))
        seen.update(terms)
    yield block


def shared_terms(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """``id, n, terms, tf`` per row of ``docs``: its length and its query terms."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["id"], T.StructField("n", T.LongType()),
                           T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("tf", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths, ends, terms, tfs = [], [0], [], []
            for data in b.column(1).cast(pa.binary()):
                counts = count_terms(data.as_py() or b"")
                lengths.append(counts.total())
                for t in counts.keys() & vocabulary.keys():
                    terms.append(vocabulary[t])
                    tfs.append(counts[t])
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int64()))], names=["id", "n", "terms", "tf"])

    return map_arrow(own, run, schema)


def impacts(tf: np.ndarray, n: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """What an occurrence count is worth in a document of ``n`` terms."""
    m = 10 + 90 * n * n_docs // all_terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def search(query: list[tuple[int, int]], postings: dict[int, tuple[np.ndarray, np.ndarray]],
           n_rows: int, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
    """``(rows, scores, created)``: documents with an accumulator and their exact
    scores. ``query`` holds ``(term, weight)``, rarest first; ``floor`` is a score
    that k documents elsewhere are known to have (0: none)."""
    scores = np.zeros(n_rows, dtype=np.int64)
    held = np.zeros(n_rows, dtype=bool)
    parts = [(w, *postings[t]) for t, w in query if t in postings and w > 0]
    bounds = [w * int(worth.max()) for w, _, worth in parts]
    remaining = sum(bounds)
    created, open_ = 0, True
    for (w, rows, worth), bound in zip(parts, bounds):
        if open_ and remaining < floor:
            open_ = False
        if open_:
            fresh = int((~held[rows]).sum())
            held[rows] = True
            created += fresh
            scores[rows] += w * worth
        else:
            on = held[rows]
            scores[rows[on]] += w * worth[on]
        remaining -= bound
        if open_ and created >= k and remaining:
            partial = scores[held]
            floor = max(floor, int(np.partition(partial, len(partial) - k)[-k]))
    rows = np.flatnonzero(held)
    return rows, scores[rows], created


def best_of_task(found: DataFrame, queries: list[list[tuple[int, int]]], n_docs: int, all_terms: int,
                 k: int = TOP, at_once: int = POSTINGS) -> DataFrame:
    """``query, id, score``: for every query the best ``k`` rows of each task."""
    used = {t for q in queries for t, _ in q}
    schema = T.StructType([T.StructField("query", T.IntegerType()), found.schema["id"],
                           T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries]

        def take(part: list[pa.RecordBatch]) -> None:
            ids = [x for b in part for x in b.column(0).to_pylist()]
            n = np.concatenate([b.column(1).to_numpy(zero_copy_only=False) for b in part])
            size = np.concatenate([np.diff(b.column(2).offsets.to_numpy()) for b in part])
            term = np.concatenate([b.column(2).flatten().to_numpy(zero_copy_only=False) for b in part])
            tf = np.concatenate([b.column(3).flatten().to_numpy(zero_copy_only=False) for b in part])
            row = np.repeat(np.arange(len(n)), size)
            worth = impacts(tf, n[row], n_docs, all_terms)
            order = np.argsort(term, kind="stable")
            term, row, worth = term[order], row[order], worth[order]
            starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(term)].astype(int)
            postings = {int(term[s]): (row[s:e], worth[s:e]) for s, e in zip(starts, ends) if int(term[s]) in used}
            for q, query in enumerate(queries):
                floor = best[q][-1][0] if len(best[q]) == k else 0
                rows, scores, _ = search(query, postings, len(n), k, floor)
                if len(rows) > k:  # ties at the limit stay for the ids to settle
                    keep = scores >= np.partition(scores, len(scores) - k)[-k]
                    rows, scores = rows[keep], scores[keep]
                own = [(int(s), ids[r]) for r, s in zip(rows, scores) if s > 0 and s >= floor]
                best[q] = sorted(best[q] + own, key=lambda x: (-x[0], x[1] is None, x[1]))[:k]

        part, held = [], 0
        for b in batches:
            part.append(b)
            held += len(b.column(2).flatten())
            if held >= at_once:
                take(part)
                part, held = [], 0
        if part:
            take(part)
        flat = [(q, i, s) for q, rows in enumerate(best) for s, i in rows]
        yield pa.RecordBatch.from_pylist([{"query": q, "id": i, "score": s} for q, i, s in flat], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(schema)
    return map_arrow(found, run, schema)


def _search_block(docs: DataFrame, block: list[tuple], id_col: str, text_col: str, k: int) -> DataFrame | None:
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    if not vocabulary:
        return None
    found = materialize(shared_terms(docs, vocabulary, id_col, text_col), "search-terms")
    tot = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).head()
    if not tot["docs"]:
        return None
    df = {r["t"]: r["df"] for r in found.select(F.explode("terms").alias("t")).groupBy("t").agg(
        F.count(F.lit(1)).alias("df")).collect()}  # a number for each term of the block
    queries = []
    for _, terms in block:
        known = sorted((df[i], i) for i in (vocabulary[t] for t in terms) if i in df)
        queries.append([(i, weight(tot["docs"], n)) for n, i in known])
    hits = best_of_task(found.filter(F.size("terms") > 0), queries, tot["docs"], tot["terms"], k)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    hits = hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return hits, [item for item, _ in block]


def ranked_search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", k: int = TOP,
                  vocabulary: int = VOCABULARY) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` best rows of ``docs`` for every
    row of ``items``. Building it runs the passes over the texts."""
    spark = docs.sparkSession
    parts = []
    for block in query_blocks(items, item_col, item_text_col, vocabulary):
        done = _search_block(docs, block, id_col, text_col, k)
        if done:
            hits, names = done
            numbered = spark.createDataFrame(
                list(enumerate(names)),
                T.StructType([T.StructField("query", T.IntegerType()),
                              T.StructField("item_id", items.schema[item_col].dataType)]))
            parts.append(hits.join(numbered, "query").select(
                "item_id", "rank", F.col("id").alias("doc_id"), "score"))
    if not parts:
        return spark.createDataFrame([], T.StructType([
            T.StructField("item_id", items.schema[item_col].dataType), T.StructField("rank", T.IntegerType()),
            T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.LongType())]))
    return reduce(DataFrame.union, parts)

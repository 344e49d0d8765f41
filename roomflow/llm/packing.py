"""Best-fit-decreasing packing of token ids into fixed-length rows.

Documents are split without loss into pieces of at most ``seq_len`` tokens. In
every task pieces are gathered until a window of ``window_tokens`` is full;
within the window the longest piece goes first, each into the open row with the
least room that still holds it. A segment tree over capacities (a leaf per free
length, each node the number of open rows below) finds that row in a logarithmic
number of steps. Windows bound the memory of a task at any input size; no row is
shuffled, and a hot document or source needs no special care since only lengths
matter. A re-run task sees the same rows and packs them alike.

A packed row holds the padded id matrix row (little-endian unsigned integers of
``id_bytes``), cumulative segment lengths (``cu_seqlens``, from 0), the offsets
at which positions restart, and per segment the document id, piece number and
first token of the piece.

Defined results: null text and null ids are empty; with ``eos`` every document
ends with that id, so empty ones keep a segment (without it they have none and
are left out); equal lengths are taken in row order; repeated rows and null ids
are segments of their own; an empty table gives an empty table; other columns
are ignored. An id that does not fit ``id_bytes`` is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import map_arrow

SEQ_LEN = 2048
WINDOW_TOKENS = 1 << 22
PADDING = 0


class CapacityTree:
    """Open rows by free length; ``best(n)`` is the least free length >= n."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def put(self, free: int, row: int) -> None:
        self.rows.setdefault(free, []).append(row)
        self._add(free, 1)

    def take(self, free: int) -> int:
        self._add(free, -1)
        return self.rows[free].pop()

    def _add(self, free: int, n: int) -> None:
        k = self.width + free
        while k:
            self.count[k] += n
            k >>= 1

    def best(self, n: int) -> int | None:
        k = self.width + n
        if self.count[k]:
            return n
        while k > 1:
            if not k & 1 and self.count[k + 1]:  # a subtree to the right holds a row
                k += 1
                while k < self.width:
                    k = 2 * k if self.count[2 * k] else 2 * k + 1
                return k - self.width
            k >>= 1
        return None


def best_fit_decreasing(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Rows of indices into ``lengths`` (each at most ``capacity``, above 0)."""
    tree, rows = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        free = tree.best(lengths[i])
        if free is None:
            free, row = capacity, len(rows)
            rows.append([])
        else:
            row = tree.take(free)
        rows[row].append(i)
        if free > lengths[i]:
            tree.put(free - lengths[i], row)
    return rows


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: whole texts as little-endian unsigned 32-bit ids, by the
    ranks file ``vocabulary`` and its split ``pattern``."""
    d = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([d.schema["doc_id"], T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(vocabulary, pattern)
        for b in batches:
            ids = [coder.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() if t else b""
                   for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return map_arrow(d, run, schema)


def pack(ids: DataFrame, seq_len: int = SEQ_LEN, eos: int | None = None, id_bytes: int = 2,
         window_tokens: int = WINDOW_TOKENS) -> DataFrame:
    """Packed rows of ``doc_id, ids`` (see the module's text)."""
    kind = ids.schema["doc_id"].dataType
    of = T.ArrayType
    schema = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("row", T.LongType()),
        T.StructField("input_ids", T.BinaryType()), T.StructField("n_tokens", T.IntegerType()),
        T.StructField("cu_seqlens", of(T.IntegerType())), T.StructField("position_resets", of(T.IntegerType())),
        T.StructField("doc_ids", of(kind)), T.StructField("pieces", of(T.IntegerType())),
        T.StructField("first_tokens", of(T.LongType()))])
    arrow = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        dtype = f"<u{id_bytes}"
        end = np.array([] if eos is None else [eos], dtype="<u4")

        def emit(window: list[tuple]) -> Iterator[pa.RecordBatch]:
            nonlocal done
            rows = best_fit_decreasing([len(w[3]) for w in window], seq_len)
            for at in range(0, len(rows), 256):
                out = []
                for row in rows[at:at + 256]:
                    parts = [window[i] for i in row]
                    flat = np.full(seq_len, PADDING, dtype=dtype)
                    cuts = np.cumsum([0, *(len(p[3]) for p in parts)])
                    flat[:cuts[-1]] = np.concatenate([p[3] for p in parts])
                    out.append((part, done, flat.tobytes(), int(cuts[-1]), cuts.tolist(), cuts[:-1].tolist(),
                                [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
                    done += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

        window, held = [], 0
        for b in batches:
            for doc, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                tokens = np.concatenate([np.frombuffer(raw or b"", dtype="<u4"), end])
                if len(tokens) and tokens.max() >= 1 << (8 * id_bytes):
                    raise ValueError(f"an id of {tokens.max()} takes more than {id_bytes} bytes")
                for piece, first in enumerate(range(0, len(tokens), seq_len)):
                    window.append((doc, piece, first, tokens[first:first + seq_len]))
                    held += len(window[-1][3])
                    if held >= window_tokens:
                        yield from emit(window)
                        window, held = [], 0
        yield from emit(window)

    return map_arrow(ids.select("doc_id", "ids"), run, schema)


def write_packed(packed: DataFrame, path: str) -> DataFrame:
    """Write packed rows as Parquet and return the written table."""
    packed.write.parquet(path)
    spark: SparkSession = packed.sparkSession
    return spark.read.schema(packed.schema).parquet(path)

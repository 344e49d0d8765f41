"""Byte-level BPE encoding and decoding with a segment tree of pair ranks.

Per distinct pre-token a segment tree stands over the ranks of adjacent pairs:
its root yields the leftmost pair of lowest rank; a merge changes three leaves,
each updated in a logarithmic number of steps, until the root holds no mergeable
pair. Short pre-tokens of a batch run side by side in numpy (one tree per row),
long ones one at a time. Encoded pre-tokens are kept in a bounded table per
worker. Rows are encoded where they are: no shuffle, nothing on the driver.

The vocabulary (a ``tokenizers`` JSON file of a byte-level BPE) is named by
path and read once per worker. Token ids are returned as a binary of
little-endian unsigned 32-bit integers.

Defined results: null text is the empty text, with no ids; a text of any length
is encoded whole; repeated rows give equal rows; an empty table gives an empty
table; other columns pass through in their order, but for one that has the name
of the new column, which it replaces. Decoding
replaces bytes that are not UTF-8 by U+FFFD; a null binary decodes to the empty
text; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_arrow

#: Fixed value: the split pattern of this family of byte-level tokenizers.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KNOWN_WORDS = 400_000  # pre-tokens a worker keeps before it starts anew
KNOWN_BYTES = 48 << 20  # of pre-tokens with their ids, likewise
ENTRY_BYTES = 240  # of an entry beside its own bytes
TOGETHER = 1 << 20  # characters split at a time
NARROW = 64  # pre-tokens up to so many bytes are merged side by side, and kept
TREES = 1 << 16  # tree leaves held at a time
NONE = 1 << 40  # larger than any rank times a width


def byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in the vocabulary file: printable
    Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def check_settings(spec: dict) -> None:
    """Raise ``ValueError`` for a vocabulary file with settings that are not those
    of this encoder: plain byte-level BPE, tokens in brackets taken as they stand."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback",
                       "ignore_merges") if model.get(k)]
    odd += ["normalizer"] if spec.get("normalizer") else []
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        odd.append("pre_tokenizer")
    odd += [f"added token {t['content']!r}" for t in spec.get("added_tokens", [])
            if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if odd or model.get("type", "BPE") != "BPE":
        raise ValueError(f"settings of the vocabulary file that this encoder does not have: {odd or model['type']}")


class ByteBPE:
    """Vocabulary, pair ranks and the two segment-tree merges."""

    def __init__(self, path: str):
        import numpy as np
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        check_settings(spec)
        chars = byte_chars()
        vocab: dict[str, int] = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.split = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(
            self.special, key=len, reverse=True))) + ")") if self.special else None
        self.of_byte = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int64)
        self.pairs = {(vocab[a], vocab[b]): k for k, (a, b) in enumerate(merges)}
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        keys = np.array([a << 32 | b for a, b in self.pairs], dtype=np.int64)
        ranks = np.array(list(self.pairs.values()), dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], ranks[order]
        byte_of = {c: b for b, c in chars.items()}
        self.token_bytes: dict[int, bytes] = {
            i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.token_bytes |= {i: t.encode() for t, i in self.special.items()}
        self.known: dict[str, bytes] = {}
        self.known_bytes = 0

    def _ranks(self, left, right, pos, width):
        """Leaf values ``rank * width + position`` of pairs, NONE where unmergeable."""
        import numpy as np

        key = left << 32 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where((self.pair_keys[at] == key) & (right >= 0) & (left >= 0),
                        self.pair_ranks[at] * width + pos, NONE)

    def merge_rows(self, words: Sequence[bytes], width: int) -> list[bytes]:
        """Ids of ``words`` of at most ``width`` (a power of two) bytes, a tree per row."""
        import numpy as np

        n = len(words)
        size = np.array([len(w) for w in words])
        ids = np.full((n, width + 2), -1, dtype=np.int64)  # slot 0 and the last one are ends
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        inside = np.arange(width) < size[:, None]
        ids[:, 1:-1] = np.where(inside, self.of_byte[raw], -1)
        after = np.broadcast_to(np.arange(1, width + 3), (n, width + 2)).copy()
        before = np.broadcast_to(np.arange(-1, width + 1), (n, width + 2)).copy()
        before[:, 0] = 0
        tree = np.full((n, 2 * width), NONE, dtype=np.int64)
        tree[:, width:] = self._ranks(ids[:, 1:-1], ids[:, 2:], np.arange(width), width)
        for level in range(width.bit_length() - 2, -1, -1):
            lo, hi = 1 << level, 2 << level
            tree[:, lo:hi] = np.minimum(tree[:, 2 * lo:2 * hi:2], tree[:, 2 * lo + 1:2 * hi:2])
        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            root = tree[rows, 1]
            here = root % width + 1
            gone = after[rows, here]
            then = after[rows, gone]
            prev = before[rows, here]
            ids[rows, here] = self.merged[root // width]
            ids[rows, gone] = -1
            after[rows, here] = then
            before[rows, then] = here
            slots = np.stack([prev, here, gone])
            values = np.stack([
                self._ranks(ids[rows, prev], ids[rows, here], prev - 1, width),
                self._ranks(ids[rows, here], ids[rows, then], here - 1, width),
                np.full(len(rows), NONE)])
            at = np.maximum(slots - 1, 0) + width  # the left end has no leaf
            tree[rows, at[2]] = values[2]
            tree[rows, at[1]] = values[1]
            has = prev > 0
            tree[rows[has], at[0][has]] = values[0][has]
            while width > 1 and at[0, 0] > 1:
                at >>= 1
                tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])
            rows = rows[tree[rows, 1] < NONE]
        return [r[r >= 0].astype("<u4").tobytes() for r in ids]

    def merge_one(self, word: bytes) -> bytes:
        """Ids of one pre-token of any length, by one tree in plain lists."""
        n = len(word)
        width = 1 << max(0, n - 1).bit_length()
        ids = self.of_byte[list(word)].tolist() if n else []
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs, merged = self.pairs, self.merged
        tree = [NONE] * (2 * width)
        for k in range(n - 1):
            rank = pairs.get((ids[k], ids[k + 1]))
            if rank is not None:
                tree[width + k] = rank * width + k
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = width + leaf
            tree[k] = value
            while k > 1:
                k >>= 1
                best = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == best:
                    return
                tree[k] = best

        while n and tree[1] < NONE:
            rank, here = divmod(tree[1], width)
            gone = after[here]
            then = after[gone]
            ids[here], ids[gone] = int(merged[rank]), -1
            after[here] = then
            put(gone, NONE)
            right = pairs.get((ids[here], ids[then])) if then < n else None
            put(here, NONE if right is None else right * width + here)
            if then < n:
                before[then] = here
            prev = before[here]
            if prev >= 0:
                left = pairs.get((ids[prev], ids[here]))
                put(prev, NONE if left is None else left * width + prev)
        out = [i for i in ids if i >= 0]
        return struct.pack(f"<{len(out)}I", *out)

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Encode pre-tokens that are not known yet, those of one width together.
        Narrow ones are kept; the others are returned."""
        widths: dict[int, list[str]] = {}
        for w in words:
            n = len(w.encode())
            widths.setdefault(1 << max(1, (n - 1).bit_length()), []).append(w)
        wide: dict[str, bytes] = {}
        for width, group in widths.items():
            if width > NARROW:
                wide.update((w, self.merge_one(w.encode())) for w in group)
                continue
            step = max(1, TREES // width)
            for k in range(0, len(group), step):
                part = group[k:k + step]
                self.known.update(zip(part, self.merge_rows([w.encode() for w in part], width)))
            self.known_bytes += len(group) * (ENTRY_BYTES + 5 * width)
        return wide

    def encode_texts(self, texts: Sequence[str | None]) -> Iterator[bytes]:
        """Ids of whole texts; strings of special tokens become their ids. Texts
        are taken some at a time, so that many new pre-tokens are merged together."""
        group, chars = [], 0
        for t in texts:
            group.append(t or "")
            chars += len(group[-1])
            if chars >= TOGETHER:
                yield from self._encode_group(group)
                group, chars = [], 0
        yield from self._encode_group(group)

    def _encode_group(self, texts: Sequence[str]) -> Iterator[bytes]:
        if len(self.known) > KNOWN_WORDS or self.known_bytes > KNOWN_BYTES:
            self.known.clear()
            self.known_bytes = 0
        known = self.known
        split = [[self.split.findall(p) if k % 2 == 0 else p for k, p in enumerate(
            self.specials.split(t) if self.specials else [t])] for t in texts]
        wide = self.learn({w for parts in split for words in parts[::2] for w in words if w not in known})
        ids = (lambda w: wide[w] if w in wide else known[w]) if wide else known.__getitem__
        for parts in split:
            yield b"".join([b"".join(map(ids, x)) if k % 2 == 0 else
                            struct.pack("<I", self.special[x]) for k, x in enumerate(parts)])

    def decode_ids(self, ids: bytes | None) -> str:
        import numpy as np

        tokens = np.frombuffer(ids or b"", dtype="<u4").tolist()
        return b"".join(map(self.token_bytes.__getitem__, tokens)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """The vocabulary at ``path``, once per process."""
    return ByteBPE(path)


def _mapped(df: DataFrame, column: str, name: str, kind: T.DataType, arrow: pa.DataType, make) -> DataFrame:
    """``df`` with ``column`` replaced by ``name``: ``make(values)`` batch by batch."""
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c == column or c != name])
    at = df.columns.index(column)
    schema = T.StructType([T.StructField(name, kind) if k == at else f
                           for k, f in enumerate(df.schema.fields)])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = pa.array(make(b.column(at).to_pylist()), arrow)
            yield pa.RecordBatch.from_arrays(
                [done if k == at else b.column(k) for k in range(len(names))], names=names)

    return map_arrow(df, run, schema)


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``df`` with the text column replaced by its token ids (binary)."""
    return _mapped(df, text_col, ids_col, T.BinaryType(), pa.binary(),
                   lambda texts: list(load(path).encode_texts(texts)))


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``df`` with the ids column replaced by the decoded text."""
    return _mapped(df, ids_col, text_col, T.StringType(), pa.string(),
                   lambda ids: [load(path).decode_ids(x) for x in ids])

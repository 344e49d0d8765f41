"""BPE, packing, WARC and sharding: exact round trips and brute force."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from roomflow.llm import bpe, packing, sharding, warc
from roomflow.llm.common import new_path
from roomflow.llm.queries import tokenizer_path

from .helpers import sha

ODD = ["", "a", "<|endoftext|>", "x<|endoftext|>y<|endoftext|>", "  \n\n\t x's they'll", "\u0085 \x1c", "ab" * 3000,
       " " * 500, "naïve café 😀 日本語", "word " * 300, "\U0010ffff�"]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_bpe_equals_the_library(spark, sf_small, reference):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(ODD)] + [(None, None, "x"), (-1, "", None)], docs.schema)
    docs = docs.union(odd).withColumnRenamed("lang", "ids_sha256")
    coded = bpe.encode(docs.withColumn("said", F.col("text")), tokenizer_path())
    back = bpe.decode(coded.withColumn("raw", F.col("ids")), tokenizer_path()).collect()
    assert len(back) == docs.count()
    for r in back:
        want = reference.encode(r.said or "", add_special_tokens=False).ids
        assert r.raw == struct.pack(f"<{len(want)}I", *want)
        assert r.text == reference.decode(want, skip_special_tokens=False) == (r.said or "")
    assert bpe.encode(docs.limit(0), tokenizer_path()).count() == 0
    clash = bpe.encode(docs.withColumn("ids", F.lit("own")).limit(3), tokenizer_path())
    assert clash.columns == ["doc_id", "ids", "ids_sha256"] and clash.select("ids").count() == 3


def test_both_segment_trees_equal_the_library(reference):
    coder, rng = bpe.ByteBPE(tokenizer_path()), random.Random(4)
    words = ["".join(rng.choices("abcdefgthenou'é1", k=rng.randint(1, 40))) for _ in range(600)]
    model = reference.model
    chars = bpe.byte_chars()
    for w in words:
        raw = w.encode()
        want = [t.id for t in model.tokenize("".join(chars[b] for b in raw))]
        assert coder.merge_one(raw) == struct.pack(f"<{len(want)}I", *want)
        width = 1 << max(1, (len(raw) - 1).bit_length())
        assert coder.merge_rows([raw, raw], width)[1] == struct.pack(f"<{len(want)}I", *want)


def test_bpe_starts_anew_when_its_table_is_full(monkeypatch, reference):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 5)
    monkeypatch.setattr(bpe, "TOGETHER", 10)
    coder = bpe.ByteBPE(tokenizer_path())
    said = [f"these are word{k} and more" for k in range(20)]
    for t, got in zip(said, coder.encode_texts(said), strict=True):
        want = reference.encode(t, add_special_tokens=False).ids
        assert got == struct.pack(f"<{len(want)}I", *want)


def best_fit_brute(lengths, capacity):
    rows, free = [], []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [f for f in free if f >= lengths[i]]
        if fits:
            least = min(fits)
            row = max(k for k, f in enumerate(free) if f == least)
        else:
            row, least = len(rows), capacity
            rows.append([])
            free.append(capacity)
        rows[row].append(i)
        free[row] = least - lengths[i]
    return [sum(lengths[i] for i in r) for r in rows]


def test_best_fit_decreasing_equals_brute_force():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randint(1, 40)
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        rows = packing.best_fit_decreasing(lengths, capacity)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(sum(lengths[i] for i in r) for r in rows) == sorted(best_fit_brute(lengths, capacity))


@pytest.mark.parametrize("eos", [None, 7])
def test_packing_loses_nothing(spark, eos):
    rng = random.Random(7)
    rows = [(k, [rng.randint(1, 60000) for _ in range(rng.choice([0, 1, 3, 15, 16, 17, 50, 400]))]) for k in range(120)]
    raw = [(k, struct.pack(f"<{len(x)}I", *x)) for k, x in rows] + [(None, None)]
    df = spark.createDataFrame(raw, "doc_id long, ids binary").withColumn("row", F.lit(1)).withColumn("part", F.lit("x"))
    out = packing.write_packed(packing.pack(df, seq_len=16, eos=eos, window_tokens=200), new_path(spark, "packed")).collect()
    got = {}
    for r in out:
        flat = struct.unpack("<16H", r.input_ids)
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= 16 and r.position_resets == r.cu_seqlens[:-1]
        assert not any(flat[r.n_tokens:])
        for k, doc in enumerate(r.doc_ids):
            got.setdefault(doc, []).append((r.pieces[k], r.first_tokens[k], flat[r.cu_seqlens[k]:r.cu_seqlens[k + 1]]))
    tail = [] if eos is None else [eos]
    want = {k: x + tail for k, x in [*rows, (None, [])] if x + tail}
    assert set(got) == set(want)
    for doc, pieces in got.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(len(pieces))) and [p[1] for p in pieces] == [16 * p[0] for p in pieces]
        assert [i for p in pieces for i in p[2]] == want[doc]
    assert len({(r.part, r.row) for r in out}) == len(out)
    assert packing.pack(df.limit(0)).count() == 0


def test_packing_takes_whole_texts_and_refuses_wide_ids(spark, reference):
    import public_tokenizers

    df = spark.createDataFrame([(1, "hello there <|endoftext|>"), (2, None), (3, "")], "doc_id long, text string")
    ids = packing.token_ids(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).collect()
    reference.encode_special_tokens = True
    want = reference.encode("hello there <|endoftext|>", add_special_tokens=False).ids
    reference.encode_special_tokens = False
    assert [bytes(r.ids) for r in ids] == [struct.pack(f"<{len(want)}I", *want), b"", b""]
    wide = spark.createDataFrame([(1, struct.pack("<I", 70000))], "doc_id long, ids binary")
    with pytest.raises(Exception, match="70000"):
        packing.pack(wide).collect()


def payloads():
    rng = random.Random(8)
    out = [None, b"", b"x", b"y" * 99, b"y" * 100, b"\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" * 9, b"\n" * 500, b"\r\n\r\n" * 77,
           bytes(range(256)) * 40, rng.randbytes(5000), "é😀".encode() * 400, b"HTTP/1.1 200 OK\r\n\r\n" + b"z" * 300]
    return out + [out[8], out[8], out[4], out[2], None, out[9] + b"\n"]


def test_warc_round_trip(spark):
    rows = [(100 - k, f"http://h/{k}\r\nX: y", p) for k, p in enumerate(payloads())] + [(None, None, b"q" * 200), (100, None, b"q" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html binary").withColumn("record", F.lit(1)).withColumn("key", F.lit(1))
    got = warc.round_trip(df.repartition(3), "page_id", "html", "url", chunk_bytes=64).collect()
    assert len(got) == len(rows)
    first = {}
    for key, _, p in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if p is not None and len(p) >= 100:
            first.setdefault(p, key)
    want = []
    for key, _, p in rows:
        p = p or b""
        revisit = len(p) >= 100 and first[p] != key
        want.append((str(key), len(p), sha(p), "revisit" if revisit else "response", str(first[p]) if revisit and first[p] is not None else None))
    assert sorted((str(r.key), r.payload_bytes, r.payload_digest, r.warc_type, r.refers_to) for r in got) == sorted(
        want, key=lambda r: tuple(map(str, r)))or sorted(map(str, want)) == sorted(str((
            str(r.key), r.payload_bytes, r.payload_digest, r.warc_type, r.refers_to)) for r in got)
    assert all(r.payload_digest == r.declared_sha256 for r in got)
    assert warc.round_trip(df.limit(0), "page_id", "html").count() == 0


def test_warc_repeated_rows_have_one_response(spark):
    df = spark.createDataFrame([(1, b"a" * 150)] * 3, "page_id long, html binary")
    got = warc.round_trip(df, "page_id", "html").collect()
    assert sorted(r.warc_type for r in got) == ["response", "revisit", "revisit"]
    assert {r.refers_to for r in got if r.warc_type == "revisit"} == {"1"}


def test_warc_chunks_carry_running_digests(spark):
    data = random.Random(9).randbytes(1000)
    rows = warc.chunk_table(spark.createDataFrame([(1, data)], "k long, p binary"), "k", "p", chunk_bytes=128).orderBy("chunk_no").collect()
    assert b"".join(r.data for r in rows) == data and max(len(r.data) for r in rows) == 128
    assert [r.sha256 for r in rows] == [sha(data[:r.upto]) for r in rows] and rows[-1].upto == 1000


def test_warc_reads_other_archives(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/plain\r\n\r\nhello\r\n\r\nWARC/1.0\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 4\r\n\r\na\r\nb\r\n\r\n"
    rec = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n"
    raw = info + rec % (len(body), body)
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(rec % (len(body), body)))  # a member per record
    (tmp_path / "b.warc").write_bytes(raw)
    got = warc.read_records(spark, str(tmp_path)).collect()
    assert [(r.payload_bytes, r.payload_digest) for r in got] == [(19, sha(b"hello\r\n\r\nWARC/1.0\r\n"))] * 2
    (tmp_path / "c.warc").write_bytes(raw[:-30])
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_records(spark, str(tmp_path / "c.warc")).collect()


def test_shards(spark):
    rng = random.Random(10)
    rows = [(rng.randint(0, 500) if rng.random() < .7 else 7, rng.choice([None, "", "é" * 9, "x" * rng.randint(1, 400)])) for _ in range(700)]
    rows += [(None, "n"), (None, None)] + [(3, "same")] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit("x")).withColumn("pid", F.lit(1))
    got = sharding.assign_shards(df, n_shards=9, carry=["shard", "text"]).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").encode()) + 16
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted(
        (str(i), size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
        assert r.row.shard == "x" and size(r.row.text) == r.size
    assert set(by) == set(range(9))
    target = sum(r.size for r in got) / 9
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - target) <= max(r.size for r in got)
    order = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)  # contiguous in the global order
    assert sharding.assign_shards(df.limit(0)).count() == 0


def test_written_shards_hold_every_row(spark):
    df = spark.createDataFrame([(k % 50, f"t{k}", k) for k in range(200)], "doc_id long, text string, slot int")
    path = new_path(spark, "shards")
    sharding.write_shards(df, path, n_shards=4)
    back = spark.read.parquet(path)
    assert sorted(tuple(r.row) for r in back.collect()) == sorted(tuple(r) for r in df.collect())
    assert back.select("shard").distinct().count() == 4


def test_bpe_keeps_a_bounded_number_of_bytes(reference, monkeypatch):
    """Long distinct pre-tokens are encoded but not kept; the rest has a bound."""
    monkeypatch.setattr(bpe, "KNOWN_BYTES", 100_000)
    tool = bpe.ByteBPE(tokenizer_path())
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=rng.choice([5, 30, 5000]))) for _ in range(40))
             for _ in range(30)]
    for t in texts:
        assert next(iter(tool.encode_texts([t]))) == struct.pack(
            f"<{len(ids := reference.encode(t, add_special_tokens=False).ids)}I", *ids)
        assert all(len(w.encode()) <= bpe.NARROW for w in tool.known)
        held = sum(len(w.encode()) + len(x) + bpe.ENTRY_BYTES for w, x in tool.known.items())
        assert held <= tool.known_bytes <= 100_000 + 200_000


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}},
    {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": {"ignore_merges": True}},
    {"added_tokens": [{"id": 1, "content": "<x>", "lstrip": True}]}])
def test_bpe_refuses_vocabularies_with_other_settings(change):
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.check_settings(spec)
    for k, v in change.items():
        spec[k] = {**spec[k], **v} if k == "model" else v
    with pytest.raises(ValueError):
        bpe.check_settings(spec)


def test_shard_and_slot_of_every_row(spark):
    """Row by row: the shard that the middle of a row falls in, rows in order of id,
    checksum and size, gapless slots."""
    rng = random.Random(8)
    rows = [(i, "x" * rng.randint(0, 300) if rng.random() < 0.9 else None) for i in range(400)] + [
        (1000, "long " * 40_000), (7, "again"), (7, "other")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), n_shards=9).collect()
    light = sorted((i, zlib.crc32((t or "").encode()), len(t or "") + sharding.OVERHEAD) for i, t in rows)
    total, at, want, slots = sum(s for _, _, s in light), 0, [], {}
    for i, c, s in light:
        shard = min(8, (2 * at + s) * 9 // (2 * total))
        want.append((i, s, c, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        at += s
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(want)

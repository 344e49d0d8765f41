"""SimHash near-duplicates, decontamination and the pipeline against brute force."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from roomflow.llm import decontaminate, simhash_dedup
from roomflow.llm.common import materialize
from roomflow.llm.queries import ORACLE, QUERIES, tokenizer_path
from tools.oracle_check import TABLES

from .helpers import WORD, components, grams, quality, secret_spans, sha, simhash, similarity


def near_texts(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = [None, "", " \n", "One", "one", "one two", "One  TWO"]
    for _ in range(25):
        base = rng.choices(words, k=rng.choice([3, 10, 60, 300]))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    return out + out[10:15]


def test_simhash_components_equal_brute_force(spark):
    said = near_texts(11)
    ids = list(range(len(said)))
    df = spark.createDataFrame(list(zip(ids, said)), "doc_id long, text string").withColumn("fp", F.lit("x"))
    got = {r.doc_id: r for r in simhash_dedup.components_of(df).collect()}
    prints = [simhash(t) for t in said]
    assert [got[i].fp & (2**64 - 1) for i in ids] == prints
    assert [got[i].component_id for i in ids] == components(ids, prints, 2)
    assert len(set(components(ids, prints, 2))) < len(set(prints))  # some links join different fingerprints
    kept = simhash_dedup.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(components(ids, prints, 2)))


def test_near_pairs_are_complete_and_chains_meet(spark):
    rng = random.Random(12)
    prints = [0, 1, 3, 7, -1, 1 << 62]
    for _ in range(40):
        x = rng.getrandbits(64) - (1 << 63)
        prints.append(x)
        for _ in range(8):  # a chain, each at most two bits from the last
            x ^= (1 << rng.randrange(63)) | (1 << rng.randrange(63))
            prints.append(x)
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(p, k) for k, p in enumerate(prints)], "fp long, rank long")
    pairs = {(r.a, r.b) for r in simhash_dedup.near_pairs(nodes).collect()}
    mask = (1 << 64) - 1
    want = {(a, b) for a in prints for b in prints if a < b and ((a ^ b) & mask).bit_count() <= 2}
    assert pairs == want
    got = {r.fp: r.component for r in simhash_dedup.link_fingerprints(materialize(nodes, "t")).collect()}
    assert [got[p] for p in prints] == components(list(range(len(prints))), [p & mask for p in prints], 2)


def test_simhash_edges(spark):
    rows = [(None, "a b c d"), (5, "a b c d"), (3, "A B C D"), (3, "A B C D"), (None, "z"), (9, "q " * 70_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(2)).withColumn("tie", F.lit(3))
    got = sorted(((str(r.doc_id), r.component_id) for r in simhash_dedup.components_of(df).collect()), key=str)
    assert got == [("3", 3), ("3", 3), ("5", 3), ("9", 9), ("None", 3), ("None", None)]
    kept = simhash_dedup.keep_one(df).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["3", "9", "None"] and all(r.row == 2 and r.tie == 3 for r in kept)
    assert simhash_dedup.components_of(df.limit(0)).count() == 0 and simhash_dedup.keep_one(df.limit(0)).count() == 0


def leaks_brute(docs, items, size=5, least=0.8):
    """Best similarity per (doc, item) over every window of the item's length."""
    out = {}
    for d, text in docs:
        words = WORD.findall((text or "").lower())
        for i, said in items:
            item = WORD.findall((said or "").lower())
            if not words or not item:
                continue
            n, w = min(size, len(item)), min(len(item), len(words))
            shingles = grams(item, n)
            if not set(shingles) & set(grams(words, n)):
                continue  # no window shares a shingle
            best = max(similarity(grams(words[s:s + w], n), shingles) for s in range(len(words) - w + 1))
            if best >= least - 1e-12:
                out[d, i] = best
    return out


def leak_case(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(200)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([2, 4, 5, 12, 30, 55])))) for k in range(25)]
    items += [(25, None), (26, ""), (27, items[3][1]), (None, " ".join(rng.choices(words, k=20)))]
    docs = [(0, None), (1, ""), (2, "w1"), (3, items[4][1])]
    for k in range(4, 90):
        body = rng.choices(words, k=rng.choice([0, 4, 40, 120]))
        if rng.random() < .7:
            said = (rng.choice(items)[1] or "x").split()
            for _ in range(rng.choice([0, 0, 1, 2])):
                said[rng.randrange(len(said))] = "changed"
            if rng.random() < .2:
                said = said[: max(1, int(len(said) * .9))]
            at = rng.randint(0, len(body))
            body = body[:at] + said * rng.choice([1, 1, 2]) + body[at:]
        docs.append((k, " ".join(body).upper() if k % 9 == 0 else " ".join(body)))
    return docs + docs[10:14] + [(None, docs[3][1])], items


def test_leaks_equal_brute_force(spark):
    docs, items = leak_case(13)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("k1", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(1))
    want = leaks_brute(docs, items)
    # The radius holds nearly every pair at this similarity; a wider one holds all.
    got = decontaminate.find_leaks(d, b, radius=40).collect()
    assert {(r.doc_id, r.item_id): pytest.approx(r.similarity) for r in got} == want
    assert len(want) > 20
    near = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()}
    long_items = {i for i, t in items if t and len(t.split()) >= 12}
    assert {k for k in want if k[1] in long_items} <= near <= set(want)
    for r in got:
        words = WORD.findall(dict((str(i), t) for i, t in docs)[str(r.doc_id)].lower())
        assert r.n_words == len(words[r.start:r.start + r.n_words])
    in_blocks = decontaminate.find_leaks(d, b, radius=40, block_words=700).collect()
    assert {(r.doc_id, r.item_id) for r in in_blocks} == set(want)
    kept = decontaminate.drop_leaks(d, b, radius=40)
    assert kept.columns == d.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in docs if i not in {k[0] for k in want})


def test_leaks_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.find_leaks(d, b).count() == 1
    assert decontaminate.find_leaks(d.limit(0), b).count() == 0
    assert decontaminate.find_leaks(d, b.limit(0)).count() == 0
    assert decontaminate.drop_leaks(d, b.limit(0)).count() == 1


@pytest.fixture(scope="module")
def con(sf_small):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return c


def plain(rows):
    return sorted((tuple(None if v is None or v != v else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_its_sql(spark, con, sf_small, name):
    got = QUERIES[name](spark, sf_small)
    want = con.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(map(tuple, got.select(*columns).collect())) == plain(want.fetchall())


def test_every_query_is_registered(spark):
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in QUERIES}
    assert set(QUERIES) <= set(entry.queries()) and entry.queries()["pipeline"] is corpus_pipeline.run


def test_queries_without_sql(spark, sf_small):
    import zlib

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_small}/documents.parquet").collect()]
    by = dict(docs)
    for r in QUERIES["op7_sharding"](spark, sf_small).collect():
        assert (r.size, r.text_crc32) == (len(by[r.doc_id].encode()) + 16, zlib.crc32(by[r.doc_id].encode()))
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 40
    for r in QUERIES["op5_bpe"](spark, sf_small).collect():
        assert r.decoded_sha256 == sha(by[r.doc_id])
    got = {r.doc_id: r for r in QUERIES["op8_simhash"](spark, sf_small).collect()}
    ids = [i for i, _ in docs]
    prints = [simhash(t) for _, t in docs]
    assert [got[i].fingerprint for i in ids] == [f"{p:016x}" for p in prints]
    assert [got[i].component_id for i in ids] == components(ids, prints, 2)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    found = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, sf_small).collect()}
    assert found == {(d, i) for d, t in docs for i, x in items if " ".join(x.lower().split()) in " ".join(t.lower().split())} | found
    assert found <= set(leaks_brute([d for d in docs if len(d[1]) < 9000 or (d[0] in {f[0] for f in found})], items))
    packed = QUERIES["op2_packing"](spark, sf_small).collect()
    assert {d for r in packed for d in r.doc_ids} == set(ids) and all(r.n_tokens <= 2048 for r in packed)


def test_pipeline_stages_equal_brute_force(spark, sf_small):
    import struct

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "bpe"]
    good = materialize(stages["quality"](spark, docs, sf_small), "t")
    assert {r.doc_id for r in good.collect()} == {r.doc_id for r in docs.collect() if quality(r.text)[-1]}
    one = materialize(stages["near_duplicates"](spark, good, sf_small), "t")
    rows = good.collect()
    assert {r.doc_id for r in one.collect()} == set(components([r.doc_id for r in rows], [simhash(r.text) for r in rows], 2))
    clean = materialize(stages["decontamination"](spark, one, sf_small), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    leaked = {d for d, _ in leaks_brute([(r.doc_id, r.text) for r in one.collect()], items)}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - leaked
    masked = materialize(stages["secrets"](spark, clean, sf_small), "t")
    assert masked.columns == docs.columns and dict(masked.dtypes) == dict(docs.dtypes)
    before = {r.doc_id: r for r in clean.collect()}
    after = {r.doc_id: r for r in masked.collect()}
    for i, r in before.items():
        spans, out, at = secret_spans(r.text), "", 0
        for s, _, e in spans:
            if s >= at:
                out += r.text[at:s] + "[SECRET]"
            at = max(at, e)
        assert after[i].text == out + r.text[at:] and after[i].n_chars == (len(after[i].text) if spans else r.n_chars)
    reference = Tokenizer.from_file(tokenizer_path())
    last = stages["bpe"](spark, masked, sf_small).collect()
    for r in last:
        want = reference.encode(after[r.doc_id].text, add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids == struct.pack(f"<{len(want)}I", *want) and r.ids_sha256 == sha(bytes(r.ids))
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf_small).collect()) == sorted(tuple(r) for r in last)


def test_pipeline_stages_take_nulls_repeats_and_empty_tables(spark, sf_small):
    long = " ".join(f"word{k}" for k in range(30_000))
    rows = [(1, long, "en", None, None), (1, long, "en", None, None), (None, None, None, None, None), (2, "", "en", "s", 0),
            (None, " ".join(f"other{k}" for k in range(40)) + " token=abcdefabcdef0123", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_small)
        assert name == "bpe" or out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_small).count() == 0
        assert out.count() == {"quality": 3, "near_duplicates": 3, "decontamination": 5, "secrets": 5, "bpe": 5}[name]


def _farthest_windows(rng, n, times):
    """Bits between SimHashes of ``n`` shingles and of a window that shares just
    enough of them for the similarity."""
    shared = -(-16 * n // 18) if n > 1 else 1  # x / (2 n - x) >= 0.8
    while shared / (2 * n - shared) < decontaminate.SIMILARITY:
        shared += 1
    bits = rng.integers(0, 2, size=(times, 2 * n - shared, 64), dtype=np.int8)
    a = 2 * bits[:, :n].sum(axis=1, dtype=np.int32) > n
    b = 2 * bits[:, n - shared:].sum(axis=1, dtype=np.int32) > n
    return (a != b).sum(axis=1)


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8, 9, 10, 13, 18, 26, 36, 46, 56])
def test_default_radius_loses_next_to_nothing(n):
    """Windows at the least similarity, by shingles of the item (README has the table)."""
    far = _farthest_windows(np.random.default_rng(n), n, 20_000)
    assert (far > decontaminate.RADIUS).sum() <= 2


def test_leaks_at_the_default_radius_for_every_item_length(spark):
    rng = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    items, docs = [], []
    for n in range(1, 61):
        said = rng.choices(words, k=n)
        items.append((n, " ".join(said)))
        for copy in range(3):
            cut = list(said)
            if copy and n >= 25:  # a changed end word costs one shingle, one inside costs five
                cut[-1 if copy == 1 else n // 2] = "other"
            body = rng.choices(words, k=30)
            docs.append((10 * n + copy, " ".join(body[:9] + cut + body[9:])))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = leaks_brute(docs, items)
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(d, b).collect()}
    assert len(want) >= 120 and got == {k: pytest.approx(v) for k, v in want.items()}


def test_candidates_are_at_most_the_windows_of_the_hits(spark, monkeypatch):
    """A window meets an item once, and only an item that its hits belong to."""
    docs, items = leak_case(4)
    made = {}
    written = decontaminate.materialize

    def keep(df, name):
        made[name] = written(df, name)
        return made[name]

    monkeypatch.setattr(decontaminate, "materialize", keep)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    decontaminate.find_leaks(d, b).collect()
    windows = made["bench-windows"].select(*decontaminate.KEY, "item", "start")
    assert windows.distinct().count() == windows.count()
    prints, block = made["bench-prints"], made["bench-block"]
    for radius in (3, 24, 40):
        fp, item_fp = F.col("fp"), F.col("item_fp")
        differ = fp.bitwiseXOR(item_fp)
        pairs = prints.join(block.select("item", "item_fp"), "item").select(
            F.bit_count(differ).alias("n"), decontaminate._first_equal_block(differ, radius).alias("block"))
        assert all(r.block is not None for r in pairs.filter(F.col("n") <= radius).collect())


def test_leaks_in_one_very_long_text(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(3000)]
    item = rng.choices(words, k=40)
    body = rng.choices(words, k=120_000)
    d = spark.createDataFrame([(1, " ".join(body[:90_000] + item + body[90_000:])), (2, " ".join(body))],
                              "doc_id long, text string")
    b = spark.createDataFrame([(5, " ".join(item))], "item_id long, text string")
    (found,) = decontaminate.find_leaks(d, b).collect()
    assert (found.doc_id, found.item_id, found.start, found.similarity) == (1, 5, 90_000, 1.0)


def test_pivots_discard_before_the_exact_check(spark):
    """Of the pairs with an equal key most that are too far go by coordinates; none
    that is near does."""
    rng = random.Random(17)
    base = [rng.getrandbits(64) for _ in range(300)]
    fps = set(base)
    for x in base:
        for flips in (1, 2, 3, 6, 10):
            y = x
            for bit in rng.sample(range(16), flips):  # changes in few blocks: keys often stay equal
                y ^= 1 << bit
            fps.add(y)
    signed = [simhash_dedup._signed(x) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    met = simhash_dedup.candidate_pairs(nodes).distinct().collect()
    exact = {(r.a, r.b): ((r.a ^ r.b) & (1 << 64) - 1).bit_count() for r in met}
    far = [r for r in met if exact[r.a, r.b] > 2]
    stay = [r for r in far if r.differ <= 2]
    assert len(far) > 100 and len(stay) < len(far) / 2
    assert all(r.differ <= exact[r.a, r.b] for r in met)
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i]
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2}
    assert {(r.a, r.b) for r in simhash_dedup.near_pairs(nodes).collect()} == want


@pytest.mark.parametrize("distance", [0, 5, 6, 7, 9])
def test_other_distances(spark, distance):
    rng = random.Random(distance)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        y = x
        for bit in rng.sample(range(64), rng.randint(1, 12)):
            y ^= 1 << bit
        fps.add(y)
    signed = [simhash_dedup._signed(x) for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = {(min(a, b), max(a, b)) for i, a in enumerate(signed) for b in signed[:i]
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
    assert {(r.a, r.b) for r in simhash_dedup.near_pairs(nodes, distance).collect()} == want
    with pytest.raises(ValueError):
        simhash_dedup.near_pairs(nodes, 6, groups=6)


def test_key_filter_keeps_every_key_and_few_others(spark):
    from roomflow.llm.common import BITS_A_KEY, KeyFilter

    rows = spark.range(200_000).withColumn("other", F.col("id") % 7)
    for n, bits in ((0, 30), (1, 30), (5_000, 30), (5_000, 15), (200_000, 15)):
        keys = rows.filter(F.col("id") < n)
        known = KeyFilter(keys, ["id", "other"], most_bits=bits)
        held, absent = known.held(rows), known.absent(rows)
        assert held.filter(F.col("id") < n).count() == n
        assert absent.filter(F.col("id") < n).count() == 0
        chance = held.filter(F.col("id") >= n).count()
        assert held.count() + absent.count() == 200_000  # also where the bitmaps are full
        if bits == 30:
            assert chance <= 1.2 * (200_000 - n) / BITS_A_KEY
    nulls = spark.createDataFrame([(None,), (1,)], "k long")
    known = KeyFilter(nulls.filter("k is null"), ["k"])
    assert known.held(nulls).filter("k is null").count() == 1

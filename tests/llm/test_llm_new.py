"""Exact duplicates, whitening and ranked search against brute force."""

import math
import random
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomflow.llm import exact_dedup, ranked_search, whitening
from roomflow.llm.queries import QUERIES

from .helpers import ascii_lower, sha

DOC = "doc_id bigint, text string"


# --- exact duplicates ---------------------------------------------------------------------------

def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[normal(t)]
        known = [x for x in ids if x is not None]
        out.append((i, min(known) if known else None, len(ids), sha(normal(t))))
    return out


def texts(rng):
    words = ["aa", "b", "cde", "ñú", "漢字", "\t", "\n\n", "x" * 40]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(12)]
    out = []
    for _ in range(80):
        t = rng.choice(base)
        if rng.random() < 0.3:
            t = t.replace(" ", rng.choice(["  ", "\n", "\x0b "]))
        if rng.random() < 0.2 and t:
            k = rng.randrange(len(t))
            t = t[:k] + "z" + t[k + 1:]
        out.append(t)
    return out + [None, "", None, " ", "\n", "a", "a ", " a"]


@pytest.mark.parametrize("size, bits", [(1024, 64), (16, 64), (7, 64), (16, 3), (1, 6)])
def test_exact_duplicates_equal_brute_force(spark, size, bits):
    """Few digest bits make different blocks share a digest: content decides."""
    rng = random.Random(size * 100 + bits)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    got = exact_dedup.duplicates(spark.createDataFrame(rows, DOC), size=size, digest_bits=bits).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == sorted(brute_exact(rows))
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_exact_names_are_one_per_text_at_every_level(spark):
    """Texts that differ in one byte anywhere, or in length only, are apart."""
    base = "".join(random.Random(5).choices("abc", k=200))
    rows = [base[:k] + "#" + base[k + 1:] for k in range(0, 200, 7)] + [base[:k] for k in range(0, 200, 9)] + [base]
    rows = list(enumerate(rows + rows))
    got = exact_dedup.identities(spark.createDataFrame(rows, DOC), size=8, digest_bits=5).collect()
    by_name = {}
    for r in got:
        by_name.setdefault(r.identity, set()).add(rows[r.id][1])
    assert all(len(x) == 1 for x in by_name.values())
    assert len(by_name) == len({t for _, t in rows})


def test_exact_duplicates_edge_cases(spark):
    long = "word " * 60_000
    rows = [(None, "a"), (3, "a"), (3, "a"), (None, "b"), (None, "b"), (7, long), (8, long + "x"), (9, long)]
    docs = spark.createDataFrame([(*r, "n", 1) for r in rows],
                                 "doc_id bigint, text string, name string, identity int")
    got = exact_dedup.duplicates(docs).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == sorted(
        (str(a), str(b), n) for a, b, n in [(None, 3, 3), (3, 3, 3), (3, 3, 3), (None, None, 2), (None, None, 2),
                                            (7, 7, 2), (8, 8, 1), (9, 7, 2)])
    assert Counter((r.group_size, r.kept) for r in got)[(3, True)] == 1
    assert Counter((r.group_size, r.kept) for r in got)[(2, True)] == 2
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 4
    assert exact_dedup.duplicates(docs.limit(0)).collect() == []
    assert exact_dedup.keep_one(docs.limit(0)).collect() == []


def test_exact_dedup_has_no_python(spark, sf_small):
    plan = QUERIES["op11_exact_dedup"](spark, sf_small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- whitening ----------------------------------------------------------------------------------

VEC = "vec_id bigint, embedding array<float>"


def brute_whiten(vectors, k=16):
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    a = (fit * n - total) / n
    _, s, vt = np.linalg.svd(a, full_matrices=False)
    keep = s > 1e-9 * s[0]
    e = (s[keep] ** 2 / n)[:k]
    return n, ((x * n - total) ** 2).sum(axis=1), ((x * n - total) / n) @ vt[keep][:k].T / np.sqrt(e), e / (
        (a ** 2).sum() / n)


def check_whitening(spark, vectors, **more):
    data = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(vectors)], VEC)
    got = whitening.whiten(data, **more).orderBy("id").collect()
    n, deviation, white, explained = brute_whiten(vectors, **{"k": more.get("components", 16)})
    assert [r.id for r in got] == list(range(len(vectors)))
    assert {r.n for r in got} == {n} and [int(r.deviation) for r in got] == deviation.tolist()
    mine = np.array([r.whitened for r in got])
    assert mine.shape == white.shape
    sign = np.sign((mine * white).sum(axis=0))
    assert np.abs(mine * sign - white).max() < 1e-6
    assert np.allclose(got[0].explained, explained, rtol=1e-6)
    assert got[0].identity_error < 1e-9


def test_whitening_equals_svd(spark):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(300, 24)) @ rng.normal(size=(24, 24))
    check_whitening(spark, np.concatenate([a, a[:100]]))


def test_whitening_of_dependent_and_constant_dimensions(spark):
    rng = np.random.default_rng(1)
    a = np.round(rng.normal(size=(80, 7)) * 64) / 64
    a[:, 2], a[:, 5] = 1.5, a[:, 0]
    check_whitening(spark, a)
    check_whitening(spark, rng.normal(size=(5, 12)), components=3)


def test_whitening_of_very_unequal_scales(spark):
    rng = np.random.default_rng(2)
    check_whitening(spark, rng.normal(size=(200, 6)) * [1e4, 1, 100, 0.5, 1e3, 10])


def test_first_factor_is_shifted_and_passes_make_rows_orthonormal():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(400, 8)) @ np.diag(10.0 ** -np.arange(8))
    g = a.T @ a
    r = whitening._cholesky(g, len(a), shifted=True)
    assert np.trace(r.T @ r) > np.trace(g)
    q = whitening.solved(a, r)
    assert np.allclose(q @ r, a) and np.allclose(r, np.triu(r))
    for _ in range(2):
        q = whitening.solved(q, whitening._cholesky(q.T @ q, len(a), shifted=False))
    assert np.abs(q.T @ q - np.eye(8)).max() < 1e-13


def test_deviations_beyond_64_bits_are_exact():
    x = np.array([[10 ** 9, -10 ** 9], [5, 7]])
    n, total = 10 ** 7, [123, -456789]
    assert whitening.deviations(x, n, total) == [
        sum((n * int(v) - s) ** 2 for v, s in zip(row, total)) for row in x]


def test_whitening_edge_cases(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]),
            (None, [3.0, 5.0]), (6, [1.0, 2.0]), (7, [0.5, 9.0])]
    wide = spark.createDataFrame([(*r, 1, "x") for r in rows], VEC + ", n int, whitened string")
    got = whitening.by_component(whitening.whiten(wide)).collect()
    assert Counter(r.id for r in got) == {1: 2, 6: 2, 7: 2, None: 2}
    assert {r.n for r in got} == {3} and {r.component for r in got} == {1, 2}
    assert whitening.whiten(wide.limit(0)).collect() == []
    one = whitening.whiten(wide.filter("vec_id in (1, 6)")).collect()
    assert [(r.n, r.whitened) for r in one] == [(1, []), (1, [])]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VEC))


def test_whitening_query_on_its_table(spark, sf_small):
    got = QUERIES["op12_whitening"](spark, sf_small)
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet").collect()
    rows = {r.vec_id: r.embedding for r in e if r.embedding is not None
            and all(c is not None and math.isfinite(c) for c in r.embedding)}
    ids = sorted(rows)
    n, deviation, white, explained = brute_whiten([rows[i] for i in ids])
    found = got.orderBy("vec_id", "component").collect()
    assert [(r.vec_id, r.component) for r in found] == [(i, k + 1) for i in ids for k in range(white.shape[1])]
    mine = np.array([r.whitened for r in found]).reshape(white.shape)
    assert np.abs(np.abs(mine) - np.abs(white)).max() < 1e-6
    assert [r.deviation for r in found[::white.shape[1]]] == deviation.tolist()
    assert np.allclose([r.explained for r in found[:white.shape[1]]], explained, rtol=1e-6)
    assert found[0].identity_error < 1e-6 and found[0].n == n


# --- ranked search ------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    terms = [TERM.findall(ascii_lower(t or "")) for _, t in docs]
    n_docs, total = sum(1 for t in terms if t), sum(map(len, terms))
    counts = [Counter(t) for t in terms]
    out = []
    for item, text in items:
        found = []
        words = set(TERM.findall(ascii_lower(text or "")))
        df = {w: sum(w in c for c in counts) for w in words}
        for (i, _), t, c in zip(docs, terms, counts):
            s = 0
            for w in words & c.keys():
                m = 100 - 90 + (90 * len(t) * n_docs) // total
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (
                    (1000000000 * c[w]) // (1000 * c[w] + 8 * m))
            if s > 0:
                found.append((s, i))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
        out += [(item, rank + 1, i, s) for rank, (s, i) in enumerate(found[:k])]
    return out


def corpus(rng, n, top=40):
    return [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % top}" for _ in range(rng.randint(0, 30))))
            for i in range(n)]


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 10), (3, 1)])
def test_search_equals_brute_force(spark, seed, k):
    rng = random.Random(seed)
    docs = corpus(rng, 300)
    items = [(j, t) for j, (_, t) in enumerate(rng.sample(docs, 12))] + [(50, "W1 w2, w1"), (51, ""), (52, None)]
    d = spark.createDataFrame(docs, DOC).repartition(3)
    i = spark.createDataFrame(items, "item_id bigint, text string")
    want = sorted(brute_search(docs, items, k))
    assert sorted(map(tuple, ranked_search.ranked_search(d, i, k=k).collect())) == want
    # several blocks of queries
    assert sorted(map(tuple, ranked_search.ranked_search(d, i, k=k, vocabulary=20).collect())) == want


def test_accumulators_are_limited_and_scores_stay_exact():
    """Once the remaining bounds cannot reach the k-th score no document gets an
    accumulator, and those that have one get all their terms."""
    rng = np.random.default_rng(4)
    n, k = 2000, 5
    query = [(t, 6000 - 700 * t) for t in range(8)]
    postings = {}
    for t in range(8):
        rows = np.sort(rng.choice(n, size=5 * 2 ** t, replace=False))
        postings[t] = (rows, rng.integers(400, 900, size=len(rows)))
    every = np.zeros(n, dtype=np.int64)
    for t, w in query:
        every[postings[t][0]] += w * postings[t][1]
    rows, scores, created = ranked_search.search(query, postings, n, k, 0)
    assert created == len(rows) < np.count_nonzero(every)
    assert (scores == every[rows]).all()
    assert sorted(scores)[-k:] == sorted(every)[-k:]
    # a known score of other rows closes the table earlier
    floor = int(np.sort(every)[-k])
    few = ranked_search.search(query, postings, n, k, floor)
    assert few[2] <= created and sorted(few[1])[-k:] == sorted(every)[-k:]
    assert ranked_search.search(query, postings, n, k, int(every.max()) * 100)[2] == 0


def test_search_in_small_pieces_and_many_postings_batches(spark, monkeypatch):
    rng = random.Random(9)
    docs = corpus(rng, 200)
    text = docs[0][1] + " " + "long w1 " * 500
    monkeypatch.setattr(ranked_search, "PIECE", 7)
    assert ranked_search.count_terms(text.encode()) == Counter(x.encode() for x in TERM.findall(text))
    assert ranked_search.count_terms("AÑ-b_C d\x1ce".encode()) == Counter(
        x.encode() for x in TERM.findall(ascii_lower("AÑ-b_C d\x1ce")))
    found = ranked_search.shared_terms(spark.createDataFrame(docs, DOC), {b"w1": 0, b"w2": 1}, "doc_id", "text")
    found = found.coalesce(1)
    queries = [[(1, 500), (0, 300)]]
    small = ranked_search.best_of_task(found, queries, 200, 3000, 5, at_once=1).collect()
    assert sorted(map(tuple, small)) == sorted(map(tuple, ranked_search.best_of_task(
        found, queries, 200, 3000, 5).collect()))


def test_search_edge_cases(spark):
    docs = [(None, "a b"), (5, "a b"), (4, "a b"), (4, "a b"), (6, None), (7, ""), (8, "--"), (9, "a " * 100_000)]
    items = [(1, "A"), (None, "b"), (1, "zzz"), (3, None)]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], DOC + ", score int, query string")
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id bigint, text string, rank int")
    key = lambda rows: sorted(rows, key=str)
    assert key(map(tuple, ranked_search.ranked_search(d, i).collect())) == key(brute_search(docs, items, 10))
    assert ranked_search.ranked_search(d.limit(0), i).collect() == []
    assert ranked_search.ranked_search(d, i.limit(0)).collect() == []
    assert ranked_search.ranked_search(d.filter("doc_id in (6, 7, 8)"), i).collect() == []
    assert ranked_search.ranked_search(d, i).columns == ["item_id", "rank", "doc_id", "score"]


# --- workers --------------------------------------------------------------------------------------

STARTED_ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from roomflow.session import get_session
spark = get_session("local[4]", shuffle_partitions=4)
for name in ("op1_warc", "op2_packing", "op5_bpe", "op8_simhash", "op12_whitening", "op13_ranked_search"):
    print(name, entry.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_when_started_in_another_folder(scratch):
    import os

    import roomflow

    top = os.path.dirname(os.path.dirname(os.path.abspath(roomflow.__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", STARTED_ELSEWHERE, top], cwd=scratch, env=env,
                          capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 12

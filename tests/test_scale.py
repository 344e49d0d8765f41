"""Work that must not grow faster than the input: tables read once, rows moved few times."""

import contextlib
import io
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomflow.functions import grouped as G
from roomflow.operators import itemsets as I
from roomflow.operators import profile as P
from roomflow.operators import sketches as S
from roomflow.plans import profile_plans


def _counted(df, counter):
    """``df`` that adds its rows to ``counter`` each time it is read."""
    def run(batches):
        for b in batches:
            counter.add(b.num_rows)
            yield b
    return df.mapInArrow(run, df.schema)


def _plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_quartiles_bring_no_column_together(spark):
    """Value counts are joined by broadcast whatever the sizes look like (F1)."""
    df = spark.createDataFrame([(float(i % 97), i) for i in range(1000)] + [(None, None)], "x double, y int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = P.profile_numeric(df)
        assert _plan(out).count("BroadcastHashJoin") >= 3  # ranges, ranks, means
        got = {r.column: r for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    for name, values in (("x", [float(i % 97) for i in range(1000)]), ("y", list(range(1000)))):
        r = got[name]
        assert [r.p25, r.p50, r.p75] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))
        assert (r["count"], r.min, r.max) == (1000, min(values), max(values))
        assert r.std == pytest.approx(np.std(values, ddof=1))


def test_top_values_read_the_table_once(spark):
    """F2"""
    rows = [(f"v{i % 50}", "same" if i % 3 else None) for i in range(600)]
    seen = spark.sparkContext.accumulator(0)
    got = {r.column: (r["count"], r.top, r.freq) for r in S.exact_top(_counted(
        spark.createDataFrame(rows, "`a, b` string, c string"), seen), buckets=16, tried=2).collect()}
    assert got == {"a, b": (600, "v0", 12), "c": (400, "same", 400)}
    assert seen.value == 600


@pytest.mark.parametrize("query", ["profile_distinct_sketches", "profile_quantile_sketches"])
def test_sketch_checks_read_the_bookings_once(spark, sf_small, monkeypatch, query):
    """F3, F7"""
    whole = profile_plans.bookings(spark, sf_small)
    n, seen = whole.count(), spark.sparkContext.accumulator(0)
    monkeypatch.setattr(profile_plans, "bookings", lambda *_: _counted(whole, seen))
    rows = getattr(profile_plans, query)(spark, sf_small).collect()
    assert rows and all(r.within for r in rows) and seen.value == n


def test_only_the_finest_sets_are_grouped_from_the_rows(spark, monkeypatch):
    """F4, F6, F8: coarser sets are sums of what was written, equal to their own group-by."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "a", "b"]), rng.choice([None, "t", "u"]),
             rng.choice([None, 1, 5, 7])) for _ in range(300)]
    df = spark.createDataFrame(rows, "m int, r string, t string, x int")
    written = []
    monkeypatch.setattr(G, "reliable", lambda d: written.append(d.cache()) or written[-1])
    sets = {"fine": ["m", "r"], "coarse": ["m"], "other": ["t"]}
    got = G.grouped_once(df, sets, {"n": F.count(F.lit(1)), "x": F.sum("x")}, {"n": F.col("n"), "x2": F.col("x") * 2})
    groups = {k: len({tuple(dict(zip("mrtx", r))[c] for c in s) for r in rows}) for k, s in sets.items()}
    assert written[0].count() == groups["fine"] + groups["other"]
    for name, s in sets.items():
        want = df.dropna(subset=s).groupBy(*s).agg(F.count(F.lit(1)).alias("n"), (F.sum("x") * 2).alias("x2"))
        assert sorted(map(tuple, got[name].collect()), key=str) == sorted(map(tuple, want.collect()), key=str), name


def test_itemsets_that_fail_are_left_early(monkeypatch):
    """equal to brute force; a failing diffset is not taken to its end."""
    rng = np.random.default_rng(5)
    held = rng.random((9, 64 * 40)) < np.linspace(0.3, 0.9, 9)[:, None]
    bits = np.packbits(held, axis=1, bitorder="little").view(np.uint64)
    least = 500
    got = {}
    for first in range(9):
        for prefix, more, support in I.class_itemsets(bits[first:], least):
            got.update({tuple(first + i for i in (*prefix, x)): s for x, s in zip(more.tolist(), support.tolist())})
    want = {c: n for k in range(1, 10) for c in itertools.combinations(range(9), k)
            if (n := int(held[list(c)].all(axis=0).sum())) >= least}
    assert got == want
    apart = np.zeros((40, 4000), np.uint64)  # no two of these 40 items meet
    for i in range(40):
        apart[i, i::40] = ~np.uint64(0)
    words = []
    count = np.bitwise_count
    monkeypatch.setattr(I.np, "bitwise_count", lambda x: words.append(x.size) or count(x))
    assert [tuple(p) for p, *_ in I.class_itemsets(apart, 6000)] == [()]
    assert sum(words) < 0.4 * apart.size

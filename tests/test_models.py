"""Forecasts, clusters and upsell rules against brute-force restatements."""

from datetime import date, datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomflow.operators.forecast import (
    arrays_to_rows,
    bookings_forecast,
    forecast_as_arrays,
    forecast_series,
    interval_z,
)
from roomflow.operators.recommend import ml_product_upsell, ml_underutilized_rooms


def _series(spark, key, ys, start_year=2020):
    rows = [(key, datetime(start_year + i // 12, i % 12 + 1, 1), float(y)) for i, y in enumerate(ys)]
    return rows


def test_forecast_matches_numpy_least_squares(spark):
    rng = np.random.default_rng(3)
    ys = {1: 50 + 2 * np.arange(30) + rng.normal(0, 3, 30), 2: [5.0, 7.0], 3: [9.0]}
    rows = [r for k, v in ys.items() for r in _series(spark, k, v)]
    df = spark.createDataFrame(rows, "k long, ds timestamp_ntz, y double")
    out = forecast_series(df, ["k"], periods=3, seasonality=False).orderBy("k", "ds").collect()
    assert {r.k for r in out} == {1, 2}                   # one-month series skipped
    got = [r for r in out if r.k == 1]
    assert len(got) == 33
    x = np.array([(date(2020 + i // 12, i % 12 + 1, 1) - date(2000, 1, 1)).days for i in range(30)], float)
    b, a = np.polyfit(x, ys[1], 1)
    resid = ys[1] - (a + b * x)
    sigma = np.sqrt(np.mean(resid ** 2))
    sxx = np.sum((x - x.mean()) ** 2)
    z = interval_z(0.8)
    for r in got:
        xi = (r.ds.date() - date(2000, 1, 1)).days
        assert r.yhat == pytest.approx(a + b * xi, rel=1e-6)
        half = z * sigma * np.sqrt(1 + 1 / 30 + (xi - x.mean()) ** 2 / sxx)
        assert r.yhat_upper - r.yhat == pytest.approx(half, rel=1e-6)
    future = [r.ds for r in got[-3:]]
    # last observed month is 2022-06-01: month ends starting with that month
    assert future == [datetime(2022, 6, 30), datetime(2022, 7, 31), datetime(2022, 8, 31)]


def test_forecast_season_applies_after_two_years(spark):
    pattern = [10, 12, 15, 20, 30, 40, 45, 40, 30, 20, 15, 12]
    ys = pattern * 3
    df = spark.createDataFrame(_series(spark, 1, ys), "k long, ds timestamp_ntz, y double")
    out = forecast_series(df, ["k"], periods=2).orderBy("ds").collect()
    hist = out[:36]
    err = max(abs(r.yhat - y) for r, y in zip(hist, ys))
    assert err < 1.0                                       # season captured
    assert all(r.yhat_lower <= r.yhat <= r.yhat_upper for r in out)


def test_bookings_forecast_overall_and_arrays(spark):
    rows = [(k, datetime(2023, m, 3, 10)) for k in (1, 2) for m in range(1, 7) for _ in range(k * m)]
    b = spark.createDataFrame(rows, "room_id long, start_time timestamp_ntz")
    fc = bookings_forecast(b, months=3)
    assert fc.columns == ["room_id", "ds", "yhat", "yhat_lower", "yhat_upper"]
    assert fc.count() == 2 * (6 + 3)
    overall = bookings_forecast(b.drop("room_id"), months=3)
    assert overall.columns == ["ds", "yhat", "yhat_lower", "yhat_upper"] and overall.count() == 9
    arrays = forecast_as_arrays(fc, ["room_id"])
    assert arrays.count() == 2 and len(arrays.first().ds) == 9
    back = arrays_to_rows(arrays)
    assert back.count() == fc.count()


def test_kmeans_low_cluster(spark):
    rows = [(i, datetime(2024, 1, 1), v) for i, v in
            enumerate([1.0, 2.0, 3.0, 2.5, 40.0, 45.0, 50.0, None])]
    util = spark.createDataFrame(rows, "room_id long, month timestamp_ntz, utilization_pct double")
    out = ml_underutilized_rooms(util).orderBy("room_id").collect()
    assert [r.room_id for r in out] == [0, 1, 2, 3, 7]    # null average clusters as 0
    assert {r.cluster for r in out} == {0} and all(r.ml_underutilized for r in out)
    unchanged = util.drop("room_id")
    assert ml_underutilized_rooms(unchanged) is unchanged


def test_two_means_cut_is_optimal(spark):
    from roomflow.operators.recommend import two_means_cut

    rng = np.random.default_rng(5)
    for trial in range(3):
        vals = np.round(np.concatenate([rng.gamma(2, 5, 40), rng.normal(40, 8, 25)]), 3)
        df = spark.createDataFrame([(float(v),) for v in vals], "_x double")
        cut = two_means_cut(df)
        u = np.unique(vals)
        sse = [((vals[vals <= c] - vals[vals <= c].mean()) ** 2).sum()
               + ((vals[vals > c] - vals[vals > c].mean()) ** 2).sum() for c in u[:-1]]
        assert cut == pytest.approx(u[int(np.argmin(sse))])


def _sse(vals, cuts):
    parts = np.split(np.sort(vals), np.searchsorted(np.sort(vals), cuts, side="right"))
    return sum(((p - p.mean()) ** 2).sum() for p in parts)


@pytest.mark.parametrize("k, piece", [(3, 1 << 16), (3, 4), (4, 3), (5, 5), (6, 7), (6, 1)])
def test_cuts_into_more_clusters_are_optimal(spark, k, piece):
    """Equal to exhaustive search; small pieces run pivots and pieces."""
    from roomflow.operators.cuts import k_means_cuts

    rng = np.random.default_rng(11 * k + piece)
    vals = np.round(np.concatenate([rng.gamma(2, 5, 12), rng.normal(40, 8, 8), rng.normal(90, 2, 5)]), 0)
    cuts = k_means_cuts(spark.createDataFrame([(float(v),) for v in vals], "_x double"), k, piece=piece)
    assert len(cuts) == k - 1 and cuts == sorted(cuts)
    u = np.unique(vals)
    assert _sse(vals, cuts) == pytest.approx(min(_sse(vals, list(c)) for c in combinations(u[:-1], k - 1)), abs=1e-9)


def test_one_layer_in_pieces_equals_the_plain_recurrence(spark):
    """Every value of a layer, with many pivots and pieces, on skewed counts."""
    from roomflow.operators.cuts import next_layer

    rng = np.random.default_rng(2)
    x, c = np.sort(rng.gamma(0.5, 10, 400)), rng.integers(1, 1000, 400)
    x = x - (x * c).sum() / c.sum()
    n, s = np.cumsum(c).astype(float), np.cumsum(x * c)
    f = s * s / n
    layer = spark.createDataFrame([(i + 1, float(n[i]), float(s[i]), float(f[i])) for i in range(400)],
                                  "i bigint, n double, s double, f double").repartition(5)
    for j in (2, 3):
        want = [max(f[m] + (s[i] - s[m]) ** 2 / (n[i] - n[m]) for m in range(j - 2, i)) for i in range(j - 1, 400)]
        layer = next_layer(layer, j, 400, piece=32)
        got = layer.orderBy("i").collect()
        assert [r.i for r in got] == list(range(j, 401))
        assert np.allclose([r.f for r in got], want, rtol=1e-12)
        f = np.array([0.0] * (j - 1) + want)


def test_cuts_of_few_values(spark):
    from roomflow.operators.cuts import k_means_cuts

    def cuts(values, k):
        return k_means_cuts(spark.createDataFrame([(v,) for v in values], "_x double"), k)

    assert cuts([], 3) == [] and cuts([5.0, 5.0], 3) == [] and cuts([1.0, 2.0], 1) == []
    assert cuts([1.0, 2.0, 2.0], 4) == [1.0] and cuts([1.0, 2.0, 9.0, 9.0], 3) == [1.0, 2.0]
    assert cuts([0.0, 1.0, 2.0], 2) == [0.0]  # a tie goes to the smallest value


def test_three_clusters(spark):
    rows = [(i, datetime(2024, 1, 1), v) for i, v in
            enumerate([1.0, 2.0, 1.5, 20.0, 22.0, 21.0, 60.0, 62.0, 61.0])]
    util = spark.createDataFrame(rows, "room_id long, month timestamp_ntz, utilization_pct double")
    for method in ("auto", "kmeans"):
        out = ml_underutilized_rooms(util, n_clusters=3, method=method).orderBy("room_id").collect()
        assert [r.room_id for r in out] == [0, 1, 2] and {r.cluster for r in out} == {0}
    with pytest.raises(ValueError):
        ml_underutilized_rooms(util, n_clusters=3, method="exact")


def _brute_rules(baskets, min_support, min_conf):
    n = len(baskets)
    items = sorted(set().union(*baskets))
    supp = {}
    for size in range(1, len(items) + 1):
        found = False
        for combo in combinations(items, size):
            c = sum(1 for b in baskets if set(combo) <= b)
            if c / n >= min_support:
                supp[frozenset(combo)] = c / n
                found = True
        if not found:
            break
    rules = set()
    for s, sup in supp.items():
        if len(s) < 2:
            continue
        for a in s:
            rest = s - {a}
            conf = sup / supp[frozenset([a])]
            if conf >= min_conf:
                rules.add((a, tuple(sorted(rest)), round(sup, 9), round(conf, 9),
                           round(conf / supp[rest], 9)))
    return rules


def test_upsell_rules_three_baskets(spark):
    rows = [("t1", "a"), ("t1", "b"), ("t2", "a"), ("t2", "b"), ("t2", "c"), ("t3", "c"),
            ("t4", None), (None, "a")]
    b = spark.createDataFrame(rows, "enterprise_name string, product_name string")
    got = {(r.antecedent, tuple(r.consequents), round(r.support, 9), round(r.confidence, 9),
            round(r.lift, 9)) for r in ml_product_upsell(b, min_support=0.05, min_confidence=0.3).collect()}
    baskets = [{"a", "b"}, {"a", "b", "c"}, {"c"}, set()]   # t4 counts, with an empty basket
    assert got == _brute_rules(baskets, 0.05, 0.3)
    assert ("a", ("b", "c")) in {(g[0], g[1]) for g in got}  # multi-item consequent kept
    assert ml_product_upsell(b.drop("product_name")).count() == 0


def test_diffset_and_fpgrowth_miners_agree(spark, sf_small):
    from roomflow.sources.fixtures import bookings_view

    b = bookings_view(spark, sf_small)
    cols = ["antecedent", "consequents", "support", "confidence", "lift"]
    vert = ml_product_upsell(b, 0.3, 0.5).select(*cols).collect()
    fpg = ml_product_upsell(b, 0.3, 0.5, method="fpgrowth").select(*cols).collect()
    assert len(vert) > 0
    assert sorted(map(tuple, vert)) == sorted(map(tuple, fpg))


def _py_rules(baskets, min_support, min_conf):
    """Level-wise restatement with Python sets (any itemset size)."""
    from collections import defaultdict

    n = len(baskets)
    tids = defaultdict(set)
    for t, items in baskets.items():
        for i in items:
            tids[i].add(t)
    singles = sorted(i for i, s in tids.items() if len(s) / n >= min_support)
    level = {(i,): tids[i] for i in singles}
    freq = {k: len(v) for k, v in level.items()}
    while level:
        nxt = {}
        for key, ts in level.items():
            for i in singles:
                if i > key[-1]:
                    both = ts & tids[i]
                    if len(both) / n >= min_support:
                        nxt[key + (i,)] = both
        freq.update({k: len(v) for k, v in nxt.items()})
        level = nxt
    rules = set()
    for key, f in freq.items():
        if len(key) < 2:
            continue
        for a in key:
            rest = tuple(x for x in key if x != a)
            conf = f / freq[(a,)]
            if conf >= min_conf:
                rules.add((a, rest, f / n, conf, conf / (freq[rest] / n)))
    return rules


def test_upsell_rules_all_sizes_small_fixture(spark, sf_small):
    from collections import defaultdict

    from roomflow.plans.recommend_plans import UPSELL_CONFIDENCE
    RULE_SUPPORT = 0.15  # at the default nearly every set of the small tables is frequent
    from roomflow.sources.fixtures import bookings_view

    b = bookings_view(spark, sf_small)
    baskets = defaultdict(set)
    for r in b.select("enterprise_name", "product_name").collect():
        if r.enterprise_name is not None:
            baskets[r.enterprise_name]
            if r.product_name is not None:
                baskets[r.enterprise_name].add(r.product_name)
    want = _py_rules(baskets, RULE_SUPPORT, UPSELL_CONFIDENCE)
    got = {(r.antecedent, tuple(r.consequents), r.support, r.confidence, r.lift)
           for r in ml_product_upsell(b, RULE_SUPPORT, UPSELL_CONFIDENCE).collect()}
    assert max(len(c) for _, c, *_ in want) >= 4          # deeper than the SQL oracle reaches
    assert got == want


def test_forecast_ignores_months_without_a_value(spark):
    from datetime import datetime

    def series(values):
        return spark.createDataFrame([(datetime(2024, k + 1, 1), v) for k, v in enumerate(values)],
                                     "ds timestamp_ntz, y double")

    rows = {r.ds: r for r in forecast_series(series([10.0, 20.0, None, 40.0, float("nan")]), periods=1).collect()}
    assert rows[datetime(2024, 4, 1)].yhat == pytest.approx(39.95, abs=0.01)
    assert datetime(2024, 3, 1) in rows and datetime(2024, 5, 1) in rows and datetime(2024, 5, 31) in rows
    assert forecast_series(series([5.0, None, None])).collect() == []  # one month with a value
    keyed = series([1.0, 2.0, 3.0]).withColumn("k", F.lit("a")).union(series([4.0, 4.0]).withColumn("k", F.lit("b")))
    assert forecast_series(keyed, ["k"], periods=2).groupBy("k").count().collect() != []


def test_equally_used_rooms_are_one_cluster(spark):
    from roomflow.operators.recommend import ml_underutilized_rooms

    util = spark.createDataFrame([(k, 50.0) for k in range(5)], "room_id long, utilization_pct double")
    for k in (2, 3):
        rows = ml_underutilized_rooms(util, n_clusters=k).collect()
        assert sorted(r.room_id for r in rows) == list(range(5)) and {r.cluster for r in rows} == {0}
    assert ml_underutilized_rooms(util.limit(0)).collect() == []


def _brute_itemsets(baskets, support):
    n, out = len(baskets), {}
    items = sorted({i for b in baskets for i in b})
    def grow(head, rest):
        for k, x in enumerate(rest):
            have = sum(set(head) | {x} <= b for b in baskets)
            if have and have / n >= support:
                out[(*head, x)] = have
                grow((*head, x), rest[k + 1:])
    grow((), items)
    return out


@pytest.mark.parametrize("seed, support, chunk", [(1, 0.05, 1 << 16), (2, 0.1, 16), (3, 0.3, 7), (4, 0.2, 30)])
def test_itemsets_equal_enumeration(spark, seed, support, chunk):
    """Also with tenants in small chunks, where an itemset is not frequent in each."""
    from roomflow.operators.itemsets import frequent_itemsets_diffsets

    rng = np.random.default_rng(seed)
    baskets = [{f"p{i}" for i in range(9) if rng.random() < (0.15 + 0.08 * i if t % 3 else 0.2)} for t in range(90)]
    rows = [(f"t{t}", i) for t, b in enumerate(baskets) for i in b] * 2
    rows += [("t0", None), ("none", None), (None, "p1")]
    df = spark.createDataFrame(rows, "enterprise_name string, product_name string")
    tenants = [b for b in baskets if b] + [set()]  # one tenant has no product
    tenants += [set()] if not baskets[0] else []
    sets, n = frequent_itemsets_diffsets(df, support, chunk_tenants=chunk)
    assert n == len(tenants)
    got = {tuple(r["items"]): r.freq for r in sets.collect()}
    assert got == _brute_itemsets(tenants, support)
    some, _ = frequent_itemsets_diffsets(df, support, max_size=2, chunk_tenants=chunk)
    assert {tuple(r["items"]): r.freq for r in some.collect()} == {k: v for k, v in got.items() if len(k) <= 2}


def test_itemsets_of_nothing(spark):
    from roomflow.operators.itemsets import frequent_itemsets_diffsets, support_limit

    empty = spark.createDataFrame([], "enterprise_name string, product_name string")
    assert frequent_itemsets_diffsets(empty, 0.1)[1] == 0
    alone = spark.createDataFrame([("a", None)], "enterprise_name string, product_name string")
    sets, n = frequent_itemsets_diffsets(alone, 0.1)
    assert n == 1 and sets.collect() == []
    for n in range(1, 60):
        for s in (0.05, 0.1, 0.15, 0.3, 1 / 3, 0.7, 1.0):
            assert support_limit(s, n) == min(c for c in range(n + 2) if c / n >= s)

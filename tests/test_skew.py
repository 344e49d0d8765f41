"""A third of all rows on one room and one tenant: results stay whole and exact."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest

from roomflow.operators.ranking import top_tenants
from roomflow.operators.recommend import ml_product_upsell
from roomflow.operators.utilization import utilization_metrics


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(6000):
        hot = i % 3 == 0
        room = 1 if hot else rnd.randrange(2, 60)
        tenant = "hot" if hot else f"t{rnd.randrange(0, 200)}"
        start = datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(0, 24 * 120))
        end = start + timedelta(minutes=15 * rnd.randrange(0, 40))
        product = f"p{rnd.randrange(0, 12)}"
        rows.append((room, tenant, product, start, end, float(rnd.randrange(100, 10000)) / 100))
    df = spark.createDataFrame(rows, "room_id long, enterprise_name string, product_name string, "
                                     "booking_start_time timestamp_ntz, booking_end_time timestamp_ntz, "
                                     "calculated_price double").repartition(7)
    return df, rows


def test_utilization_hot_room(skewed):
    df, rows = skewed
    want = defaultdict(float)
    for room, _, _, s, e, _ in rows:
        so = s.replace(hour=9, minute=0, second=0)
        ec = e.replace(hour=18, minute=0, second=0)
        want[(s.year, s.month, room)] += max((min(e, ec) - max(s, so)).total_seconds() / 60, 0.0)
    got = {(r.month.year, r.month.month, r.room_id): r.booked_minutes
           for r in utilization_metrics(df).collect()}
    assert got == pytest.approx(dict(want))


def test_top_tenants_hot_tenant(skewed):
    df, rows = skewed
    counts = Counter(t for _, t, *_ in rows)
    top = top_tenants(df, 3).collect()
    assert top[0].enterprise_name == "hot" and top[0].booking_count == counts["hot"] == 2000
    assert top[0].total_revenue == pytest.approx(sum(p for _, t, *_, p in rows if t == "hot"))


def test_upsell_hot_tenant_counts_once(skewed):
    df, rows = skewed
    baskets = defaultdict(set)
    for _, t, p, *_ in rows:
        baskets[t].add(p)
    n = len(baskets)
    got = {(r.antecedent, tuple(r.consequents)): r.support
           for r in ml_product_upsell(df, min_support=0.2, min_confidence=0.1,
                                      max_consequents=1).collect()}
    for (a, (c,)), sup in got.items():
        assert sup == pytest.approx(sum(1 for b in baskets.values() if {a, c} <= b) / n)
    assert len(got) > 0

"""Mergeable profiles and the exact top value."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roomflow.operators import profile as P
from roomflow.operators import sketches as S


def _table(spark, seed, n=4000):
    rng = np.random.default_rng(seed)
    rows = [(int(i % 7), float(x) if rng.random() < 0.9 else rng.choice([None, float("nan")]), int(z))
            for i, (x, z) in enumerate(zip(rng.lognormal(0, 3, n), rng.zipf(1.3, n) % 500))]
    return spark.createDataFrame(rows, "part int, x double, z long")


def test_merged_sketches_answer_for_the_whole_table(spark, scratch):
    df = _table(spark, 1)
    S.column_sketches(df, ["part"]).write.parquet(f"{scratch}/parts")
    merged = S.merge_sketches(spark.read.parquet(f"{scratch}/parts")).cache()
    exact = {r.column: r for r in P.profile_numeric(df, ["x", "z"]).collect()}
    for r in merged.collect():
        assert (r["count"], r.min, r.max) == (exact[r.column]["count"], exact[r.column].min, exact[r.column].max)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    q = S.sketched_quantiles(merged, probs)
    checked = S.check_quantiles(df, q).collect()
    assert len(checked) == 2 * len(probs) and all(r.within for r in checked)
    x = [r.x for r in df.collect() if r.x is not None and r.x == r.x]
    for r in q.where("column = 'x'").collect():
        rank = sum(v <= r.q for v in x) / len(x)
        assert r.q in x and abs(rank - r.p) <= S.rank_error() + 1 / len(x)
    distinct = {r.column: r.unique for r in S.sketched_distinct(merged).collect()}
    for c in ("x", "z"):
        true = len({r[c] for r in df.collect() if r[c] is not None and r[c] == r[c]})
        assert abs(distinct[c] - true) <= 4 * S.distinct_error() * true


def test_wrong_answers_are_not_within(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1000)], "x double")
    q = spark.createDataFrame([("x", 0.5, 900.0), ("x", 0.25, 250.0)], "column string, p double, q double")
    assert {r.p: r.within for r in S.check_quantiles(df, q).collect()} == {0.5: False, 0.25: True}


def test_sketches_of_null_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1), (float("nan"), 1)], "x double, part int")
    merged = S.merge_sketches(S.column_sketches(df, ["part"]))
    assert merged.first()["count"] == 0 and S.sketched_quantiles(merged, [0.5]).collect() == []
    assert S.sketched_distinct(merged).first().unique == 0
    assert S.merge_sketches(S.column_sketches(df.limit(0), ["part"])).collect() == []


def _brute_top(values):
    counts = Counter(v for v in values if v is not None)
    best = max(counts.values())
    return sum(counts.values()), min(v for v, c in counts.items() if c == best), best


@pytest.mark.parametrize("shape, buckets, tried", [("skewed", 1 << 14, 64), ("skewed", 8, 1), ("flat", 64, 2),
                                                   ("ties", 4, 1), ("ties", 1 << 14, 1)])
def test_exact_top_equals_counting(spark, shape, buckets, tried):
    rng = random.Random(7)
    if shape == "skewed":
        values = [f"v{int(rng.paretovariate(0.8)) % 900}" for _ in range(3000)] + [None] * 5000
    elif shape == "flat":
        values = [f"v{i % 1000}" for i in range(3000)]
    else:
        values = ["b", "a", "c"] * 50 + [f"x{i}" for i in range(400)] + ["", ""]
    df = spark.createDataFrame([(v, "one", None) for v in values], "s string, value string, gone string")
    got = {r.column: r for r in S.exact_top(df, buckets=buckets, tried=tried).collect()}
    assert (got["s"]["count"], got["s"].top, got["s"].freq) == _brute_top(values)
    assert (got["value"].top, got["value"].freq) == ("one", len(values)) and "gone" not in got
    assert got["s"].freq <= got["s"].recounted <= got["s"]["count"]
    if shape == "skewed" and buckets > 1000:
        assert got["s"].recounted < got["s"]["count"] / 2  # the tail is never counted by value


def test_bucket_counts_add_up_over_parts(spark):
    df = spark.createDataFrame([(f"v{i % 37}", i % 3) for i in range(500)], "s string, part int")
    parts = [S.bucket_counts(df.where(F.col("part") == k).select("s"), buckets=16) for k in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("column", "row", "bucket").agg(
        F.sum("c").alias("c"))
    whole = S.bucket_counts(df.select("s"), buckets=16)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.parametrize("same", [False, True])
def test_duplicates_by_fingerprint(spark, monkeypatch, same):
    """Equal to grouping whole rows, also when all rows share a fingerprint."""
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, "", "a"]), rng.choice([0.0, -0.0, float("nan"), None]))
            for _ in range(200)] + [(7, "x", 1.0)]
    df = spark.createDataFrame(rows, "r int, f string, c double")
    if same:
        monkeypatch.setattr(P, "row_fingerprint", lambda df: F.struct(F.lit(1).cast("bigint").alias("a")))
    key = lambda r: (r[0], r[1], "nan" if r[2] != r[2] else r[2])  # noqa: E731  (-0.0 equals 0.0)
    n = len(set(map(key, rows)))
    assert tuple(P.profile_duplicates(df).first()) == (201, n, 201 - n)
    assert tuple(P.profile_duplicates(df.limit(0)).first()) == (0, 0, 0)

"""Optimal clusters of one-dimensional values.

Values are ordered once with distributed running totals of count ``n`` and
centred sum ``s``; a cluster from position a (excluded) to b takes
``(s_b - s_a)^2 / (n_b - n_a)`` off the squared error, so the best k clusters
maximise a sum of k such terms. With ``f_j(i)`` the best sum for the first i
distinct values in j clusters, ``f_j(i) = max over m < i of f_{j-1}(m) + term(m, i)``,
and the best m never moves left as i grows. One layer is computed from the one
before by divide and conquer on that monotone split:

1. some positions (pivots) find their best m among all rows, each task by itself,
   then by one aggregate;
2. positions between two pivots look only between the pivots' splits: bounded
   pieces of positions and splits are solved by the same rule inside a task and
   the pieces' best values meet by position.

Work is one pass of the rows a layer for the pivots and one for the pieces; a task
holds at most ``PIECE`` positions and splits. The cuts are read off from the last
layer to the first. Nothing but pivots (at most ``PIVOTS``) and cuts reaches the
driver. The result is the global optimum for every k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import running_totals
from ..session import reliable, ship_package

PIECE = 1 << 16  # positions, and splits, of a piece
PIVOTS = 1000
_LAYER = "i bigint, n double, s double, f double"


def _term(n0, s0, n1, s1):
    """What a cluster between two positions takes off the squared error."""
    return (s1 - s0) ** 2 / (n1 - n0)


def _columns(batch: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch)
            else batch.column(c).to_numpy() for c in ("i", "n", "s", "f")]


def best_splits(targets: tuple, splits: tuple) -> np.ndarray:
    """``f`` of every target (``i, n, s`` ascending): the best over the splits
    (``i, n, s, f`` ascending) before it; -inf without one. Divide and conquer on
    the monotone best split."""
    ti, tn, ts = targets
    si, sn, ss, sf = splits
    out = np.full(len(ti), -np.inf)
    stack = [(0, len(ti), 0, len(si))]
    while stack:
        a, b, lo, hi = stack.pop()
        if a >= b or lo >= hi:
            continue
        mid = (a + b) // 2
        end = min(hi, int(np.searchsorted(si, ti[mid])))  # splits before the target
        if end <= lo:
            stack.append((mid + 1, b, lo, hi))
            continue
        value = sf[lo:end] + _term(sn[lo:end], ss[lo:end], tn[mid], ts[mid])
        at = int(np.argmax(value))
        out[mid] = value[at]
        stack.append((a, mid, lo, lo + at + 1))
        stack.append((mid + 1, b, lo + at, hi))
    return out


def _pivot_splits(layer: DataFrame, pivots: list[tuple]) -> list[int]:
    """The best split of each pivot ``(i, n, s)`` over all rows of ``layer``."""
    pi, pn, ps = (np.array(c, dtype=t) for c, t in zip(zip(*pivots), (np.int64, float, float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, where = np.full(len(pi), -np.inf), np.zeros(len(pi), np.int64)
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                i, n, s, f = _columns(b.slice(k, 1000))
                with np.errstate(divide="ignore", invalid="ignore"):
                    value = f[:, None] + _term(n[:, None], s[:, None], pn, ps)
                value = np.where(i[:, None] < pi, value, -np.inf)
                at = value.argmax(axis=0)
                top = value[at, np.arange(len(pi))]
                better = (top > best) | ((top == best) & (i[at] < where))
                best, where = np.where(better, top, best), np.where(better, i[at], where)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pi)), pa.int32()), pa.array(best),
                                          pa.array(where)], names=["p", "value", "i"])

    found = layer.mapInArrow(run, "p int, value double, i bigint").groupBy("p").agg(
        F.max(F.struct("value", (-F.col("i")).alias("left"))).alias("b"))
    return [-r["b"]["left"] for r in found.orderBy("p").collect()]  # one row a pivot


def next_layer(layer: DataFrame, clusters: int, last: int, piece: int = PIECE) -> DataFrame:
    """``i, n, s, f`` for one cluster more than ``layer`` (``clusters`` then), for
    every position from ``clusters`` to ``last``."""
    step = max(piece, -(-last // PIVOTS))
    at = [r for r in layer.where((F.col("i") % step == 0) & (F.col("i") >= clusters) & (F.col("i") < last))
          .select("i", "n", "s").orderBy("i").collect()]  # at most PIVOTS rows
    bounds = [clusters - 1, *(_pivot_splits(layer, [tuple(r) for r in at]) if at else []), last - 1]
    begins = np.array([clusters, *(r["i"] for r in at)])  # a stretch of positions begins here
    lows, highs = np.array(bounds[:-1]), np.array(bounds[1:])
    pieces = (highs - lows) // piece + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _columns(b)
            i = rows[0]
            p = np.searchsorted(begins, i, side="right") - 1
            inside = p >= 0
            times = np.where(inside, pieces[np.maximum(p, 0)], 0)
            which = np.repeat(np.arange(len(i)), times)  # a position goes to every piece of its stretch
            q = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
            first = np.searchsorted(highs, i, side="left")  # stretches whose splits include i
            after = np.searchsorted(lows, i, side="right")
            width = np.maximum(after - first, 0)
            split = np.repeat(np.arange(len(i)), width)
            sp = np.arange(len(split)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(first, width)
            sq = (i[split] - lows[sp]) // piece
            pick = np.concatenate([which, split])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([p[which], sp]), pa.int32()), pa.array(np.concatenate([q, sq]), pa.int64()),
                 pa.array(np.concatenate([np.zeros(len(which), bool), np.ones(len(split), bool)])),
                 *(pa.array(c[pick]) for c in rows)], names=["p", "q", "split", "i", "n", "s", "f"])

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        split = table.column("split").to_numpy()
        i, n, s, f = _columns(table)
        best = best_splits((i[~split], n[~split], s[~split]), (i[split], n[split], s[split], f[split]))
        return pa.table({"i": i[~split], "n": n[~split], "s": s[~split], "f": best})

    dealt = layer.mapInArrow(deal, "p int, q bigint, split boolean, " + _LAYER)
    solved = dealt.groupBy("p", "q").applyInArrow(solve, _LAYER)
    best = solved.groupBy("i").agg(F.first("n").alias("n"), F.first("s").alias("s"), F.max("f").alias("f"))
    return reliable(best.where(F.col("f") > F.lit(float("-inf"))))


def k_means_cuts(values: DataFrame, k: int, x: str = "_x", piece: int = PIECE) -> list[float]:
    """Ascending cuts of column ``x`` into at most ``k`` clusters of least squared
    error: the largest value of each cluster but the last (ties stay together).
    Fewer distinct values than clusters give a cut after each value but the last;
    of equally good places the smallest value counts. The result depends on the
    values only."""
    v = F.col(x)
    per_value = values.groupBy(x).agg(F.count(F.lit(1)).alias("c"))
    tot = values.agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("mean")).first()
    if not tot["n"] or k < 2:
        return []
    run = running_totals(per_value, [x], {"i": F.lit(1).cast("bigint"), "n": F.col("c"),
                                          "s": (v - F.lit(tot["mean"])) * F.col("c")})
    run = run.select("i", v.alias("v"), F.col("n").cast("double").alias("n"), "s")
    first = run.withColumn("f", F.col("s") * F.col("s") / F.col("n"))
    if k > 2:
        ship_package(values.sparkSession)
        first = reliable(first)
        last = first.agg(F.max("i")).first()[0]
        if last <= k:
            return [r["v"] for r in first.where(F.col("i") < last).orderBy("i").collect()]  # under k rows
        layers = [first.drop("v")]
        for j in range(2, k):
            layers.append(next_layer(layers[-1], j, last, piece))
    else:
        layers = [first.drop("v")]
    n, s, before = tot["n"], 0.0, None  # the sum of all centred values is zero
    cuts = []
    for layer in reversed(layers):
        open_ = layer.where((F.col("n") < F.lit(n)) & (F.lit(True) if before is None else F.col("i") < F.lit(before)))
        gain = F.col("f") + (F.lit(s) - F.col("s")) * (F.lit(s) - F.col("s")) / (F.lit(n) - F.col("n"))
        best = open_.agg(F.max(F.struct(gain.alias("gain"), (-F.col("i")).alias("left"), "n", "s")).alias("b")).first()["b"]
        if best is None:
            return []
        before, n, s = -best["left"], best["n"], best["s"]
        cuts.append(before)
    found = first.where(F.col("i").isin(cuts)).orderBy("i").collect()  # k - 1 rows
    return [r["v"] for r in found]

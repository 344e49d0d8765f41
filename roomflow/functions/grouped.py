"""Several group-bys of one table in a single pass.

``GROUPING SETS`` expands a row once per grouping inside the scan's stage, map-side
partials collapse it there, and one exchange moves the groups. Only the finest sets
are grouped from the rows: a set whose keys another one has too is added up from that
one's groups. The result, a row per group of the finest sets, is written once; each
grouping is a filter of it, or a sum over one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable
from . import columns as C


def grouped_once(df: DataFrame, sets: Mapping[str, Sequence[str]],
                 sums: Mapping[str, Column], results: Mapping[str, Column]) -> dict[str, DataFrame]:
    """Per name of ``sets`` (its key columns) the groups with the columns ``results``,
    expressions of ``sums``, which are aggregates that add up over parts (sums, counts);
    groups with a null key are left out. ``df`` is read once, at this call."""
    keys = list(dict.fromkeys(k for s in sets.values() for k in s))
    distinct = list(dict.fromkeys(tuple(k for k in keys if k in s) for s in sets.values()))
    finest = [s for s in distinct if not any(set(s) < set(t) for t in distinct)]
    rows = df.groupingSets([[F.col(k) for k in s] for s in finest], *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("_set"), *[e.alias(n) for n, e in sums.items()])
    rows = reliable(rows)
    out = {}
    for name, s in sets.items():
        base = next(t for t in finest if set(s) <= set(t))
        number = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in base)  # a bit per absent key
        groups = C.drop_null_keys(rows.where(F.col("_set") == number), list(s))
        if set(s) < set(base):
            groups = groups.groupBy(*s).agg(*[F.sum(n).alias(n) for n in sums])
        out[name] = groups.select(*s, *[e.alias(n) for n, e in results.items()])
    return out

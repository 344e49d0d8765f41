"""Summarise the physical plan of every registered query into PLANS.md.

    python tools/plan_summary.py [--sf /root/testdata/sf0.1] [--out PLANS.md]

Counts operators in the formatted plan (before adaptive re-planning): hash
and range exchanges, single-partition exchanges, broadcasts, join
strategies, sorts, windows, partial aggregates, generators. Building a plan
for the model-based queries runs their training jobs (checkpoints).
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

COUNTS = [
    ("hash exch", r"^Arguments: hashpartitioning"),
    ("range exch", r"^Arguments: rangepartitioning"),
    ("single exch", r"^Arguments: SinglePartition"),
    ("broadcast", r"^\(\d+\) BroadcastExchange"),
    ("BHJ", r"^\(\d+\) BroadcastHashJoin"),
    ("SMJ", r"^\(\d+\) SortMergeJoin"),
    ("sort", r"^\(\d+\) Sort\b"),
    ("window", r"^\(\d+\) Window"),
    ("partial agg", r"Functions \[\d+\]: \[partial_"),
    ("generate", r"^\(\d+\) Generate"),
    ("top-n", r"^\(\d+\) TakeOrderedAndProject"),
]


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--out", default=os.path.join(os.path.dirname(os.path.dirname(
        os.path.abspath(__file__))), "PLANS.md"))
    a = ap.parse_args()

    from roomflow.plans import QUERIES
    from roomflow.session import get_session

    spark = get_session("local[8]", shuffle_partitions=16,
                        extra_conf={"spark.driver.memory": "12g"})
    rows = []
    for name in sorted(QUERIES):
        buf = io.StringIO()
        try:
            with contextlib.redirect_stdout(buf):
                QUERIES[name](spark, a.sf).explain("formatted")
        except Exception as e:  # noqa: BLE001
            rows.append(f"| {name} | planning failed: {type(e).__name__} |")
            continue
        plan = buf.getvalue()
        counts = [len(re.findall(p, plan, flags=re.M)) for _, p in COUNTS]
        pushed = len(re.findall(r"^PushedFilters: \[.+\]", plan, flags=re.M))
        rows.append(f"| {name} | " + " | ".join(str(c) for c in counts) + f" | {pushed} |")
    spark.stop()
    head = "| query | " + " | ".join(n for n, _ in COUNTS) + " | scans w/ pushed filters |"
    sep = "|" + "---|" * (len(COUNTS) + 2)
    text = f"""# Physical plans (generated by tools/plan_summary.py at {a.sf})

Counts of operators in each registered query's formatted physical plan, as
planned before adaptive execution (AQE may still turn a shuffle join into a
broadcast join or coalesce partitions at runtime). "single exch" marks an
exchange to one partition; it appears only after a map-side partial step of
a global aggregate (one row per task) or for inputs bounded by configuration
(offsets of running totals), never for data rows. Model-based queries, exact
quartiles and loading start from checkpointed or written tables: their jobs run
while the query is built, so the plans here show only what comes after.

{head}
{sep}
""" + "\n".join(rows) + "\n"
    with open(a.out, "w") as f:
        f.write(text)
    print(f"wrote {a.out} ({len(rows)} queries)")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

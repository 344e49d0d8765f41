"""Plan shape of every registered query: no pair explosion, no Python rows,
pruned scans, partial aggregation before shuffles."""

import contextlib
import io

import pytest

from roomflow.plans import QUERIES

NAMES = sorted(QUERIES)
FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF", "FlatMapGroupsInArrow", "MapInArrow"]


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


USER_CODE = {"forecast_user_model"}  # runs a user's function by its purpose


@pytest.mark.parametrize("name", sorted(set(NAMES) - USER_CODE))
def test_plan_shape(spark, sf_small, name):
    sf = sf_small if name != "upsell_rules" else "/root/testdata/sf0.01"  # see test_oracle
    plan = _plan(QUERIES[name](spark, sf))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad} in plan"
    for line in plan.splitlines():
        if line.startswith("ReadSchema:") and "l_orderkey" in line and name != "profile_duplicates":
            assert "l_returnflag" not in line and "l_linestatus" not in line
    if "Exchange hashpartitioning" in plan and "HashAggregate" in plan:
        assert "partial_" in plan, f"{name}: aggregate without a map-side partial step"

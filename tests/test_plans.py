"""Plan guards over the registered queries: no cartesian / nested-loop joins and no
row-at-a-time Python evaluation anywhere (file-writing and streaming keys excluded:
they run actions while building and are covered by their own tests)."""

import pytest

import __spark_entry__ as E
from conftest import SF001

SIDE_EFFECT_PREFIXES = ("scan_", "sink_", "compact_", "union_runs", "resolve_run", "gate_", "load_report", "stream_")
KEYS = sorted(k for k in E.queries() if not k.startswith(SIDE_EFFECT_PREFIXES))


@pytest.mark.parametrize("key", KEYS)
def test_no_cartesian_and_no_row_python(spark, key):
    df = E.queries()[key](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan, key
    assert "BroadcastNestedLoopJoin" not in plan, key
    assert "BatchEvalPython" not in plan, key

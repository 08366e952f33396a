"""Physical-plan properties of the registered queries (read from explain)."""
import re

import pytest

import __spark_entry__ as entry

from conftest import SF_SMALL

SKIP = {"m14_train_validate_forest", "m9_model_comparison", "m10_m11_cross_validation",
        "st1_stream_session_ingest"}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SKIP))
def test_no_cartesian_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_SMALL))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, (name, bad)


def test_flagship_pushdown_and_one_shuffle(spark):
    plan = plan_of(entry.queries()["sc2_next_load_rule"](spark, SF_SMALL))
    assert "PushedFilters: [In(event_type" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double," \
           "props:string>" in plan
    ex = exchanges(plan)
    assert len(ex) == 1 and ex[0].startswith("user_id") and "compound" in ex[0]
    assert "partial_max_by" in plan  # reduced map-side before the shuffle


def test_periodization_single_exchange(spark):
    plan = plan_of(entry.queries()["m2_periodization"](spark, SF_SMALL))
    ex = exchanges(plan)
    assert len(ex) == 1 and ex[0].startswith("user_id") and "compound" in ex[0]


@pytest.mark.parametrize("name", ["w17_recent_sessions", "a10_quality_gate", "a13_affine_calibration"])
def test_newest_n_uses_window_group_limit(spark, name):
    assert "WindowGroupLimit" in plan_of(entry.queries()[name](spark, SF_SMALL))


def test_fixed_dimension_is_broadcast(spark):
    plan = plan_of(entry.queries()["j1_j2_parent_and_scale"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan

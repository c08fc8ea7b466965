"""Plan-shape tests: the physical properties the design relies on stay true."""

import re

import pytest

from tests.conftest import SF_SMALL

MODEL_QUERIES = {"train_gbt", "train_linear", "train_network", "feature_importance", "batch_score"}


def _plan(spark, name):
    import __spark_entry__ as E

    return E.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()


def test_ordered_features_share_one_shuffle(spark):
    plan = _plan(spark, "lag_features")
    assert len(re.findall(r"\bWindow \[", plan)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(city", plan)) == 1
    # forward fill runs once (cached for the median job and the feature plan); the lag/mean window reads the
    # cached frame, whose (city) partitioning it reuses: Window <- Sort <- InMemoryTableScan, no exchange
    plan = _plan(spark, "feature_build")
    lines = [ln.strip(" :+-*()0123456789") for ln in plan.splitlines()]
    i = next(k for k, ln in enumerate(lines) if ln.startswith("Window [lag("))
    j = next(k for k in range(i, len(lines)) if lines[k].startswith("InMemoryTableScan"))
    assert j - i <= 4 and not any(ln.startswith("Exchange") for ln in lines[i:j])


def test_trailing_window_reaches_the_scan(spark):
    plan = _plan(spark, "psi_report")
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts," in plan
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 1


def test_log_scan_prunes_partitions_and_columns(spark):
    plan = _plan(spark, "prediction_log_window")
    assert re.search(r"PartitionFilters: \[[^\]]*created_date", plan)
    assert re.search(r"ReadSchema: struct<id:bigint,created_at:timestamp_ntz,model_version:string,predicted_aqi:double>",
                     plan)


@pytest.mark.parametrize("name", ["recent_runs", "latest_run_per_family", "scoring_rows"])
def test_top_n_per_group_is_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in _plan(spark, name)


def test_no_cartesian_products_anywhere(spark):
    import __spark_entry__ as E

    for name in sorted(set(E.queries()) - MODEL_QUERIES):
        plan = _plan(spark, name)
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name

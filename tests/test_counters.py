"""Rates of scraped counters against a plain fold, and their edge cases."""

import datetime as dt
import math

from hypothesis import HealthCheck, given, settings, strategies as st

from driftwise.operators.counters import counter_rate

EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "job string, at timestamp_ntz, total double"


def _plain(samples, range_s, step_s):
    """{window end: (samples, increase)} of one series of (second, value)."""
    out = {}
    samples = sorted(set(samples))
    for end in range(0, int(max((s for s, _ in samples), default=0)) + range_s + step_s, step_s):
        inside = [(s, v) for s, v in samples if end - range_s < s <= end]
        if len(inside) < 2:
            continue
        grown, before = 0.0, inside[0][1]
        for _, v in inside[1:]:
            grown, before = grown + (v if v < before else v - before), v
        sampled = inside[-1][0] - inside[0][0]
        mean = sampled / (len(inside) - 1)
        left, right = inside[0][0] - (end - range_s), end - inside[-1][0]
        left = mean / 2 if left >= mean * 1.1 else left
        right = mean / 2 if right >= mean * 1.1 else right
        if grown > 0 and inside[0][1] >= 0:
            left = min(left, sampled * inside[0][1] / grown)
        out[end] = (len(inside), grown * (sampled + left + right) / sampled)
    return out


def _rates(spark, rows, range_s=60, step_s=20):
    df = spark.createDataFrame([(j, EPOCH + dt.timedelta(seconds=s) if s is not None else None, v) for j, s, v in rows], SCHEMA)
    got = counter_rate(df, "at", "total", ["job"], range_s, step_s).collect()
    return {(r["job"], int((r["window_end"] - EPOCH).total_seconds())): (r["n_samples"], r["increase"]) for r in got}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.integers(1, 300), st.integers(0, 9), max_size=30))
def test_equals_the_plain_fold(spark, points):
    rows = [("a", s, float(v)) for s, v in points.items()]
    want = {("a", e): x for e, x in _plain([(s, float(v)) for s, v in points.items()], 60, 20).items()}
    got = _rates(spark, rows)
    assert set(got) == set(want)
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-9, abs_tol=1e-9) for k in want)


def test_nulls_copies_resets_and_lone_samples(spark):
    rows = [("a", 10, 5.0), ("a", 10, 5.0), ("a", 30, 9.0), ("a", 50, 2.0), ("a", None, 1.0), ("a", 40, None), ("b", 15, 1.0), (None, 10, 0.0), (None, 50, 4.0)]
    got = _rates(spark, rows, 60, 60)
    assert set(got) == {("a", 60), (None, 60)}
    assert got["a", 60] == (3, 6.0 * (40 + 10 + 10) / 40)          # 4 up, then from 0 to 2
    assert got[None, 60] == (2, 4.0 * (40 + 0 + 10) / 40)          # it was 0 at its first sample
    assert _rates(spark, []) == {}

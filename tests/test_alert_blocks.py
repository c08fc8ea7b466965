"""Alert grids and islands in blocks: borders, stray timestamps, plan shape."""

import datetime as dt

from driftwise.operators import alerts as A

EPOCH = dt.datetime(1970, 1, 1)
RULE = A.Rule("r", "warning", 0.5, 300, 90, 30)
EDGE = A.BLOCK_POINTS * RULE.step_s


def _buckets(spark, rows):
    return spark.createDataFrame(rows, "_t long, n long")


def test_islands_merge_over_block_borders(spark):
    runs = [(EDGE - 300, EDGE + 300), (2 * EDGE, 5 * EDGE - 30), (5 * EDGE + 30, 5 * EDGE + 150), (7 * EDGE - 120, 7 * EDGE - 30)]
    points = [(t, 1.0) for a, b in runs for t in range(a, b + 1, 30)] + [(t, 0.0) for t in range(8 * EDGE, 8 * EDGE + 300, 30)]
    got = A.sustained(spark.createDataFrame(points, "_t long, value double"), RULE).collect()
    want = {(EPOCH + dt.timedelta(seconds=a), EPOCH + dt.timedelta(seconds=b), (b - a) // 30 + 1) for a, b in runs}
    assert {(r["pending_since"], r["last_breach"], r["n_points"]) for r in got} == want and len(got) == len(want)


def test_trailing_sums_equal_python_over_borders(spark):
    rows = [(t, 1 + t // 30 % 7) for t in [0, 30, EDGE - 300, EDGE - 30, EDGE, EDGE + 270, 3 * EDGE - 30, 9 * EDGE]]
    b = _buckets(spark, rows)
    g = A.occupied_grid(b, RULE.range_s, RULE.step_s).join(b, "_t", "left").na.fill(0, ["n"])
    got = {r["_t"]: r["n"] for r in A.trailing_sums(g, ["n"], RULE.range_s, RULE.step_s).collect()}
    for t in range(0, 9 * EDGE + 1, 30):
        assert got.get(t, 0) == sum(n for at, n in rows if t - RULE.range_s < at <= t), t
    assert max(got) == 9 * EDGE


def test_stray_timestamp_adds_two_blocks(spark):
    day, year_2100 = 1_700_000_010, 4_102_444_800
    near, far = (A.occupied_grid(_buckets(spark, rows), 300, 30).count() for rows in ([(day, 1)], [(day, 1), (year_2100, 1)]))
    assert near < A.BLOCK_POINTS and far <= 4 * A.BLOCK_POINTS
    assert A.occupied_grid(_buckets(spark, []), 300, 30).count() == 0


def test_no_rule_is_ordered_in_one_task(spark):
    from driftwise.plans.queries import QUERIES
    from tests.conftest import SF_SMALL

    plan = QUERIES["sustained_alerts"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert not any(x in lines[i - 1] for x in ("Sort [", "Window")), plan


def test_sliding_windows_of_panes_equal_python(spark):
    from driftwise.streaming.streams import sliding_from_panes

    panes = [(600 * i, float(i % 5), 1 + i % 3) for i in [0, 1, 5, 143, 144, 145, 1023, 1024, 1100, 2500]]
    got = {(r["window_start"], r["n"], r["sse"]) for r in sliding_from_panes(spark.createDataFrame(panes, "_p long, sse double, n long")).collect()}
    want = set()
    for s in range(-86400, 600 * 2501, 600):
        inside = [(e, n) for p, e, n in panes if s <= p < s + 86400]
        if inside:
            want.add((EPOCH + dt.timedelta(seconds=s), sum(n for _, n in inside), sum(e for e, _ in inside)))
    assert got == want

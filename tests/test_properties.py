"""Property tests for the skew machinery: on random data with many duplicate timestamps and nulls, the
split plans must equal the plain window plans."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from driftwise.operators import features
from driftwise.operators.ordering import global_ordinal
from driftwise.params import FeatureParams, SkewParams

T0 = dt.datetime(2024, 1, 1)
ROW = st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(0, 40), st.one_of(st.none(), st.integers(0, 9)))
SETTINGS = dict(max_examples=6, deadline=None, derandomize=True,
                suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def _frame(spark, rows):
    data = [(k, T0 + dt.timedelta(minutes=m), i, None if v is None else float(v)) for i, (k, m, v) in enumerate(rows)]
    return spark.createDataFrame(data, "k string, t timestamp_ntz, rid long, v double")


@settings(**SETTINGS)
@given(rows=st.lists(ROW, min_size=1, max_size=60), seg=st.integers(2, 12), width=st.sampled_from([60, 600, 3600]))
def test_global_ordinal_equals_row_number(spark, rows, seg, width):
    df = _frame(spark, rows)
    a = global_ordinal(df, "t", "rid", "o", bucket_seconds=width, segment_rows=seg)
    b = df.withColumn("o", F.row_number().over(Window.orderBy("t", "rid")))
    assert a.select("rid", "o").exceptAll(b.select("rid", "o")).count() == 0


@settings(**SETTINGS)
@given(rows=st.lists(ROW, min_size=1, max_size=60), hot=st.integers(3, 15), seg=st.integers(2, 6))
def test_hot_key_split_equals_plain_features(spark, rows, hot, seg):
    df = _frame(spark, rows)
    kw = dict(key="k", ts="t", tiebreak="rid", pollutants=("v",), target="none", lags=(1, 3), rolls=(2, 4))
    a = features.build_features(df, FeatureParams(**kw))
    b = features.build_features(df, FeatureParams(**kw, skew=SkewParams(hot_key_rows=hot, segment_rows=seg)))
    cols = sorted(a.columns)
    assert a.count() == b.count()
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0


@settings(**SETTINGS)
@given(values=st.lists(st.integers(-50, 50), min_size=1, max_size=300),
       qs=st.lists(st.sampled_from([0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]), min_size=1, max_size=4,
                   unique=True))
def test_bracketing_quantiles_equal_numpy(spark, values, qs):
    import numpy as np

    from driftwise.operators.quantiles import grouped_quantiles

    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = grouped_quantiles(df, "g", "v", qs, exact_limit=1, accuracy=50, max_collect=7)["g"]
    assert np.allclose(got, np.quantile(np.array(values, dtype=float), qs), rtol=0, atol=1e-9)


@settings(**SETTINGS)
@given(ref=st.lists(st.integers(0, 30), min_size=2, max_size=80), cur=st.lists(st.integers(-5, 35), max_size=80))
def test_psi_equals_numpy(spark, ref, cur):
    import numpy as np

    from driftwise.operators import drift

    edges = np.unique(np.quantile(np.array(ref, dtype=float), np.linspace(0, 1, 6)))
    if len(edges) < 2:
        return
    rc, _ = np.histogram(ref, bins=edges)
    r = rc / rc.sum()
    base = spark.createDataFrame([("x", [float(e) for e in edges], [float(x) for x in r])],
                                 "feature string, bin_edges array<double>, reference_distribution array<double>")
    current = spark.createDataFrame([("x", float(v)) for v in cur] or [("x", None)], "feature string, value double")
    rows = drift.psi(current, base).collect()
    got = rows[0]["psi"] if rows else 0.0
    cc, _ = np.histogram(cur, bins=edges)
    if cc.sum() == 0:
        want = 0.0
    else:
        c = cc / cc.sum()
        rr, cs = np.where(r == 0, 1e-4, r), np.where(c == 0, 1e-4, c)
        want = float(np.sum((cs - rr) * np.log(cs / rr)))
    assert abs(got - want) < 1e-9


def _prometheus_quantile(q, les, cum):
    """Prometheus bucketQuantile for finite bounds ``les`` and cumulative counts (last one +Inf)."""
    total = cum[-1]
    if total == 0:
        return None
    rank = q * total
    b = next((i for i in range(len(les)) if cum[i] >= rank), len(les))
    if b == len(les):
        return les[-1]
    if b == 0 and les[0] <= 0:
        return les[0]
    start = 0.0 if b == 0 else les[b - 1]
    prev = 0 if b == 0 else cum[b - 1]
    return start + (les[b] - start) * ((rank - prev) / (cum[b] - prev))


@settings(**SETTINGS)
@given(obs=st.lists(st.floats(0, 6, allow_nan=False), max_size=50), q=st.sampled_from([0.5, 0.9, 0.95, 0.99]))
def test_histogram_quantile_equals_prometheus(spark, obs, q):
    from driftwise.operators import monitor
    from driftwise.params import LATENCY_BUCKETS_S as LES

    df = spark.createDataFrame([(v,) for v in obs] or [(None,)], "v double")
    got = monitor.histogram_quantile(monitor.cumulative_histogram(df, "v", LES), q).first()["value"]
    cum = [sum(1 for v in obs if v <= le) for le in LES] + [len(obs)]
    want = _prometheus_quantile(q, list(LES), cum)
    assert (got is None and want is None) or abs(got - want) < 1e-9


@settings(**SETTINGS)
@given(rows=st.lists(ROW, min_size=1, max_size=50))
def test_lags_means_ffill_equal_pandas(spark, rows):
    """Against pandas' own per-group primitives (shift, shift(1).rolling(k, min_periods=1).mean(), ffill);
    the rolling frame is per group (SURVEY T1)."""
    import pandas as pd

    df = _frame(spark, rows)
    p = FeatureParams(key="k", ts="t", tiebreak="rid", pollutants=("v",), target="none", lags=(1, 3), rolls=(2, 5))
    got = features.add_lags_and_rolls(df, p).toPandas().set_index("rid").sort_index()
    ff = features.forward_fill(df, p).toPandas().set_index("rid").sort_index()
    pdf = pd.DataFrame(
        [(k, m, i, None if v is None else float(v)) for i, (k, m, v) in enumerate(rows)],
        columns=["k", "m", "rid", "v"]).sort_values(["k", "m", "rid"])
    g = pdf.groupby("k", sort=False)["v"]
    pdf["v_lag1"], pdf["v_lag3"] = g.shift(1), g.shift(3)
    for w in (2, 5):
        pdf[f"v_roll{w}"] = g.transform(lambda s, w=w: s.shift(1).rolling(w, min_periods=1).mean())
    pdf["v_ff"] = g.transform(lambda s: s.ffill())
    pdf = pdf.set_index("rid").sort_index()
    for c in ("v_lag1", "v_lag3", "v_roll2", "v_roll5"):
        a, b = got[c].astype(float), pdf[c].astype(float)
        assert ((a - b).abs().fillna(0) < 1e-9).all() and (a.isna() == b.isna()).all(), c
    a, b = ff["v"].astype(float), pdf["v_ff"].astype(float)
    assert ((a - b).abs().fillna(0) < 1e-9).all() and (a.isna() == b.isna()).all()


@settings(**SETTINGS)
@given(rows=st.lists(ROW, min_size=1, max_size=60), v=st.sampled_from([0.1, 0.15, 0.2, 0.33]),
       t=st.sampled_from([0.1, 0.15, 0.2, 0.25]))
def test_split_sizes_and_order_follow_the_slicing_rule(spark, rows, v, t):
    from driftwise.operators import split
    from driftwise.params import SplitParams

    df = _frame(spark, rows)
    n = len(rows)
    s = split.chronological_split(df, "t", "rid", SplitParams(val_size=v, test_size=t)).toPandas()
    counts = s["split"].value_counts().to_dict()
    n_test, n_val = int(n * t), int(n * v)
    assert counts.get("test", 0) == n_test and counts.get("val", 0) == n_val
    assert counts.get("train", 0) == n - n_val - n_test
    s = s.sort_values(["t", "rid"])
    order = {"train": 0, "val": 1, "test": 2}
    assert list(s["split"].map(order)) == sorted(s["split"].map(order))


@settings(**SETTINGS)
@given(subs=st.lists(st.tuples(st.integers(0, 8), st.integers(0, 30), st.integers(0, 99)), max_size=60))
def test_latest_feedback_equals_python(spark, subs):
    from driftwise.operators.feedback import latest_feedback

    data = [(pid, float(val), T0 + dt.timedelta(minutes=m)) for pid, m, val in subs]
    gt = spark.createDataFrame(data or [(0, 0.0, T0)], "prediction_id long, actual_aqi double, feedback_at timestamp_ntz")
    if not data:
        gt = gt.limit(0)
    got = {r["prediction_id"]: (r["actual_aqi"], r["feedback_at"], r["n_submissions"])
           for r in latest_feedback(gt).collect()}
    want = {}
    for pid, val, ts in data:
        best = want.get(pid)
        cnt = (best[2] if best else 0) + 1
        if best is None or (ts, val) > (best[1], best[0]):
            want[pid] = (val, ts, cnt)
        else:
            want[pid] = (best[0], best[1], cnt)
    assert got == want


@settings(**SETTINGS)
@given(vals=st.lists(st.one_of(st.none(), st.floats(0, 1, allow_nan=False)), min_size=1, max_size=80),
       holes=st.sets(st.integers(0, 79), max_size=10))
def test_sustained_islands_equal_python(spark, vals, holes):
    from driftwise.operators.alerts import Rule, sustained

    rule = Rule("r", "warning", 0.5, 300, 90, 30)
    pts = [(i * 30, v) for i, v in enumerate(vals) if i not in holes]      # missing points break islands
    series = spark.createDataFrame(pts or [(0, None)], "_t long, value double")
    got = sorted((r["pending_since"], r["n_points"]) for r in sustained(series, rule).collect())
    epoch = dt.datetime(1970, 1, 1)
    want, run = [], []

    def close(r):
        if r and r[-1] - r[0] >= rule.for_s:
            want.append((epoch + dt.timedelta(seconds=r[0]), len(r)))

    for t, v in pts:
        breach = v is not None and v > rule.threshold
        if breach and run and t == run[-1] + rule.step_s:
            run.append(t)
        else:
            close(run)
            run = [t] if breach else []
    close(run)
    assert got == sorted(want)


@settings(**SETTINGS)
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.text(alphabet="abcé-Zz09", min_size=0, max_size=9)),
                     min_size=1, max_size=60, unique_by=lambda r: r[1]),
       seg=st.integers(2, 8))
def test_global_ordinal_with_string_tiebreaks_on_copies(spark, rows, seg):
    data = [(T0 + dt.timedelta(hours=h), key) for h, key in rows]       # few distinct timestamps
    df = spark.createDataFrame(data, "t timestamp_ntz, rid string")
    a = global_ordinal(df, "t", "rid", "o", segment_rows=seg)
    b = df.withColumn("o", F.row_number().over(Window.orderBy("t", "rid")))
    assert a.select("rid", "o").exceptAll(b.select("rid", "o")).count() == 0

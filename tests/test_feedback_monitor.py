"""Feedback attach/merge, monitoring gates, histogram quantile edges, registry."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwise.operators import feedback, monitor, registry
from driftwise.params import DriftParams

T0 = dt.datetime(2024, 1, 1)


def _preds(spark):
    rows = [(1, T0, "v1", "xgboost", '{"city": "A", "date": "2024-01-01", "PM2.5": 1.0}', 100.0, 10.0),
            (2, T0, "v1", "xgboost", '{"city": "B", "date": "2024-01-01"}', 50.0, 20.0)]
    return spark.createDataFrame(rows, "id long, created_at timestamp_ntz, model_version string, model_family string, "
                                       "input_features string, predicted_aqi double, latency_ms double")


def _gt(spark):
    rows = [(1, 120.0, T0 + dt.timedelta(hours=1)), (1, 238.0, T0 + dt.timedelta(hours=2)),
            (99, 5.0, T0 + dt.timedelta(hours=1))]
    return spark.createDataFrame(rows, "prediction_id long, actual_aqi double, feedback_at timestamp_ntz")


def test_latest_feedback_wins_and_unknown_ids(spark):
    a = {r["id"]: r for r in feedback.attach_ground_truth(_preds(spark), _gt(spark)).collect()}
    assert a[1]["actual_aqi"] == 238.0 and a[2]["actual_aqi"] is None
    u = feedback.unknown_feedback(_gt(spark), _preds(spark)).collect()
    assert [r["prediction_id"] for r in u] == [99]


def test_feedback_view_and_raw_rows(spark):
    att = feedback.attach_ground_truth(_preds(spark), _gt(spark))
    v = feedback.recent_feedback(att, 10).collect()
    assert len(v) == 1 and v[0]["error"] == 138.0 and v[0]["city"] == "A" and v[0]["created_at"] == "2024-01-01T00:00:00"
    raw = feedback.feedback_as_raw_rows(att, ["PM2.5", "PM10"]).collect()
    assert raw[0]["City"] == "A" and raw[0]["AQI"] == 238.0 and raw[0]["PM2.5"] == 1.0 and raw[0]["PM10"] is None


def test_merge_collapses_only_with_feedback(spark):
    base = spark.createDataFrame([("A", 1, 10.0), ("A", 1, 11.0), ("B", 1, 5.0)], "City string, Date int, AQI double")
    fb = spark.createDataFrame([("B", 1, 7.0, T0)], "City string, Date int, AQI double, feedback_at timestamp_ntz")
    empty = fb.limit(0)
    assert feedback.rebuild_rows(base, empty, ["City", "Date"], ["feedback_at"]).count() == 3
    merged = {(r["City"]): r["AQI"] for r in feedback.rebuild_rows(base, fb, ["City", "Date"], ["feedback_at", "AQI"]).collect()}
    assert merged["B"] == 7.0 and len(merged) == 2


def test_rolling_error_and_gates(spark):
    att = feedback.attach_ground_truth(_preds(spark), _gt(spark))
    r = monitor.rolling_error(att, T0 + dt.timedelta(hours=3), 24)
    row = r.first()
    assert row["feedback_count"] == 1 and row["rolling_rmse"] == pytest.approx(138.0)
    dec = monitor.decay_decision(r, spark.createDataFrame([(0.3,)], "max_psi double"),
                                 DriftParams(feedback_count_threshold=1)).first()
    assert dec["count_gate_met"] and dec["rmse_gate_met"] and dec["psi_breach"] and dec["should_retrain"]
    empty = monitor.rolling_error(att, T0 + dt.timedelta(days=5), 24)
    st = monitor.retrain_status(empty, DriftParams()).first()
    assert st["rolling_rmse_24h"] is None and st["rmse_gate_met"] is False and st["feedback_count_window"] == 0


def _hist(spark, values, buckets):
    df = spark.createDataFrame([(float(v),) for v in values], "v double") if values else \
        spark.createDataFrame([], "v double")
    return monitor.cumulative_histogram(df, "v", buckets)


def test_histogram_quantile_edges(spark):
    b = (0.1, 0.5, 1.0)
    assert monitor.histogram_quantile(_hist(spark, [], b), 0.5).first()["value"] is None
    # all in the first bucket: interpolate from 0
    assert monitor.histogram_quantile(_hist(spark, [0.05] * 4, b), 0.5).first()["value"] == pytest.approx(0.05)
    # everything above the last finite bound: answer the highest finite bound
    assert monitor.histogram_quantile(_hist(spark, [3.0, 4.0], b), 0.5).first()["value"] == 1.0
    # lowest bucket bound at 0: answer the bound
    assert monitor.histogram_quantile(_hist(spark, [0.0, 0.0, 60.0], (0.0, 50.0, 100.0)), 0.3).first()["value"] == 0.0
    # interpolation inside a middle bucket
    v = monitor.histogram_quantile(_hist(spark, [0.05, 0.3, 0.3, 0.7], b), 0.5).first()["value"]
    assert v == pytest.approx(0.1 + 0.4 * (2 - 1) / 2)


def test_latency_summary_small_n(spark):
    df = spark.createDataFrame([(1, 12.0)], "id long, latency_ms double")
    r = monitor.latency_summary(df).first()
    assert r["p95"] == 12.0 and r["p50"] == 12.0 and r["throughput_rps"] == pytest.approx(1000 / 12)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([5, 1, 3, 2, 4])], "id long, latency_ms double")
    assert monitor.latency_summary(df).first()["p95"] == 4.0   # sorted[int(4.75) - 1] = sorted[3]


def test_champion_and_promotion(spark):
    runs = spark.createDataFrame([
        ("r1", "xgboost", "FINISHED", T0, 10.0), ("r2", "xgboost", "FINISHED", T0 + dt.timedelta(1), 20.0),
        ("r3", "pytorch_nn", "FINISHED", T0, 20.0), ("r4", "pytorch_nn", "RUNNING", T0 + dt.timedelta(2), 1.0),
    ], "run_id string, model_family string, status string, start_time timestamp_ntz, val_rmse double")
    ch = registry.champion(runs).first()
    assert ch["winning_family"] == "xgboost" and ch["run_id"] == "r2"   # tie on 20.0 -> first candidate
    mv = spark.createDataFrame([("m", 1, "r1", "Production")], "name string, version int, run_id string, stage string")
    out = {r["version"]: r["stage"] for r in registry.promote(mv, registry.champion(runs), "m").collect()}
    assert out == {1: "Archived", 2: "Production"}
    none = registry.champion(runs.where(F.col("status") == "nope"))
    assert none.count() == 0


def test_missing_metric_is_infinite(spark):
    runs = spark.createDataFrame([
        ("r1", "xgboost", "FINISHED", T0, None), ("r3", "pytorch_nn", "FINISHED", T0, 50.0),
    ], "run_id string, model_family string, status string, start_time timestamp_ntz, val_rmse double")
    assert registry.champion(runs).first()["winning_family"] == "pytorch_nn"


def test_keyset_page_composite_cursor(spark):
    from driftwise.operators.paging import keyset_page

    rows = [(T0, i) for i in range(5)] + [(T0 + dt.timedelta(days=1), 10 + i) for i in range(5)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, id long")
    page = [r["id"] for r in keyset_page(df, "d", "id", T0, 2, 4).collect()]
    assert page == [3, 4, 10, 11]          # rows sharing the cursor's timestamp are not skipped
    nxt = [r["id"] for r in keyset_page(df, "d", "id", T0 + dt.timedelta(days=1), 11, 4).collect()]
    assert nxt == [12, 13, 14]


def test_scoring_rows_history_and_optional_encoding(spark):
    from driftwise.operators import features, scoring

    rows = [("A", T0 + dt.timedelta(days=i), i, float(10 * i)) for i in range(20)] + [("B", T0, 100, 5.0)]
    df = spark.createDataFrame(rows, "city string, ts timestamp_ntz, rid long, p1 double")
    req = scoring.request_batches(df, "city", "ts", "rid", ["p1"])
    cols = ["p1", "p1_lag1", "p1_lag7", "p1_roll3", "city_target_enc"]
    out = {r["city"]: r for r in scoring.feature_rows(req, cols, ["p1"], key="city").collect()}
    assert out["A"]["p1"] == 190.0 and out["A"]["p1_lag1"] == 180.0 and out["A"]["p1_lag7"] == 120.0
    assert out["A"]["p1_roll3"] == 0.0 and out["A"]["city_target_enc"] == 0.0       # serving zero-fill
    assert out["B"]["p1_lag1"] == 0.0                                                 # no history
    enc = features.fit_encoding(df.withColumn("AQI", F.col("p1")), "city", "AQI")
    out = {r["city"]: r for r in scoring.feature_rows(req, cols, ["p1"], key="city", encoding=enc,
                                                      global_mean=F.lit(1.0)).collect()}
    assert out["A"]["city_target_enc"] == 95.0 and out["B"]["city_target_enc"] == 5.0


def test_promote_needs_a_candidate_and_keeps_other_names(spark):
    import pytest

    from driftwise.operators import registry

    versions = spark.createDataFrame([("aqi_regressor", 3, "r1", "Production"), ("other", 9, "r2", "Production")],
                                     "name string, version int, run_id string, stage string")
    champ = spark.createDataFrame([("xgboost", "r7", 1.0)], "winning_family string, run_id string, val_rmse double")
    got = {tuple(r) for r in registry.promote(versions, champ).select("name", "version", "run_id", "stage").collect()}
    assert got == {("aqi_regressor", 3, "r1", "Archived"), ("other", 9, "r2", "Production"), ("aqi_regressor", 4, "r7", "Production")}
    with pytest.raises(ValueError):
        registry.promote(versions, champ.where("1 = 0"))


def test_window_before_latest_wins_changes_nothing(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from driftwise.operators import feedback, monitor

    now = dt.datetime(2024, 1, 10)
    pred = spark.createDataFrame([(i, float(i)) for i in range(6)], "id long, predicted_aqi double")
    gt = spark.createDataFrame([(1, 2.0, now - dt.timedelta(hours=30)), (1, 5.0, now - dt.timedelta(hours=3)), (2, 4.0, now - dt.timedelta(hours=40)),
                                (3, 1.0, now - dt.timedelta(hours=1)), (99, 1.0, now - dt.timedelta(hours=1))],
                               "prediction_id long, actual_aqi double, feedback_at timestamp_ntz")
    a = F.lit(now).cast("timestamp_ntz")
    want = monitor.rolling_error(feedback.attach_ground_truth(pred, gt), a, 24).collect()
    assert monitor.rolling_error(monitor.recent_attached(pred, gt, a, 24), a, 24).collect() == want

"""Every main operator accepts empty inputs (an empty day, no feedback yet) without failing."""

from pyspark.sql import functions as F

from driftwise.operators import alerts, baseline, drift, feedback, features, monitor, quality, split
from driftwise.operators.ordering import global_ordinal
from driftwise.params import DriftParams, FeatureParams, ValidateParams
from driftwise.sources import views
from tests.conftest import SF_SMALL


def test_empty_inputs(spark):
    r = views.readings(spark, SF_SMALL).limit(0)
    assert features.build_features(r, FeatureParams()).count() == 0
    assert features.impute(r, FeatureParams()).count() == 0
    assert baseline.baseline_stats(r, ["p1", "p2"]).count() == 0
    assert global_ordinal(r, "ts", "event_id").count() == 0
    assert split.chronological_split(r, "ts", "event_id").count() == 0
    assert quality.validate(r, ValidateParams(min_rows=1)).first()["passed"] is False
    preds = views.predictions(spark, SF_SMALL).limit(0)
    gt = views.ground_truth(spark, SF_SMALL).limit(0)
    att = feedback.attach_ground_truth(preds, gt)
    roll = monitor.rolling_error(att, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 24)
    assert roll.first()["feedback_count"] == 0
    base = baseline.baseline_stats(views.readings(spark, SF_SMALL).select(F.col("p1").alias("PM2.5")), ["PM2.5"])
    rep = drift.drift_report(preds, base, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    assert rep.count() == 0 and drift.max_psi(rep).first()["max_psi"] == 0.0
    dec = monitor.decay_decision(roll, drift.max_psi(rep), DriftParams()).first()
    assert dec["should_retrain"] is False
    assert monitor.latency_summary(preds).first()["n"] == 0
    assert alerts.evaluate_alerts(views.requests(spark, SF_SMALL).limit(0), att, preds, base).count() == 0

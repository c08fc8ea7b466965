"""End-to-end jobs on a raw CSV landed from the test tables."""

import os

from pyspark.sql import functions as F

from driftwise.params import POLLUTANTS, DriftParams, FeatureParams, ValidateParams
from driftwise.plans import jobs
from driftwise.sources import io, views
from tests.conftest import SF_SMALL


def _land_csv(spark, path):
    raw = views.raw_readings(spark, SF_SMALL)
    cols = [F.col("City"), F.col("Date")] + [
        (F.col(f"`{p}`") if p in ("PM2.5", "PM10") else F.lit(None).cast("double")).alias(p) for p in POLLUTANTS
    ] + [F.col("AQI"), F.lit(None).cast("string").alias("AQI_Bucket")]
    raw.select(*cols).coalesce(1).write.option("header", True).option("nullValue", "").csv(path)


def test_feature_monitor_and_retrain_jobs(spark, tmp_path):
    raw_path = str(tmp_path / "raw")
    _land_csv(spark, raw_path)
    out = str(tmp_path / "out")
    vp = ValidateParams(min_rows=100)
    fp = FeatureParams(key="City", ts="Date", tiebreak="_row", pollutants=("PM2.5", "PM10"), target="AQI",
                       lags=(1, 2), rolls=(3,))
    res = jobs.feature_job(spark, raw_path, out, vp, fp, n_bins=5)
    feats = spark.read.parquet(res["features"])
    assert feats.count() > 0 and "PM2.5_lag1" in feats.columns and "city_target_enc" in feats.columns
    assert res["n_baseline_features"] == 3
    assert io.load_baseline(spark, res["baseline"]).count() == 3
    rep = spark.read.json(os.path.join(out, "validation_report")).first()
    assert rep["passed"] is True

    # prediction log + ground truth from the test tables, then one monitor pass and a retrain
    log, gt = str(tmp_path / "log"), str(tmp_path / "gt")
    io.append_predictions(views.predictions(spark, SF_SMALL), log)
    io.write_table(views.ground_truth(spark, SF_SMALL), gt)
    now = views.events(spark, SF_SMALL).agg(F.max("ts")).first()[0]
    dec = jobs.monitor_job(spark, log, gt, res["baseline"], str(tmp_path / "mon"), now, DriftParams()).first()
    assert dec["window_hours"] == 24 and dec["feedback_count"] >= 0
    jobs.monitor_job(spark, log, gt, res["baseline"], str(tmp_path / "mon"), now, DriftParams())      # a retry of the same pass
    once = io.read_batches(spark, str(tmp_path / "mon" / "metrics_history"))
    assert once.count() == spark.read.parquet(str(tmp_path / "mon" / "metrics")).count() > 0
    runs = spark.createDataFrame([], "run_id string, model_family string, status string, val_rmse double, "
                                     "start_time timestamp_ntz")
    versions = spark.createDataFrame([], "name string, version int, run_id string, stage string")
    rr = jobs.retrain_job(spark, raw_path, log, gt, str(tmp_path / "retrain"), runs, versions, fp, gbt_iters=3, nn_rounds=5)
    assert rr["champion"] is not None and rr["features"] > 0
    mv = spark.read.parquet(str(tmp_path / "retrain" / "model_versions")).collect()
    assert [r["stage"] for r in mv] == ["Production"]
    assert io.load_baseline(spark, str(tmp_path / "retrain" / "baseline")).count() == 3

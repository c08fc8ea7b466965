"""End-to-end jobs matching the reference's stages (feature build, monitor pass, retrain). Each job reads
tables, runs the operators as Spark plans and writes its outputs; nothing but small summaries returns to
the driver."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.functions.exprs import as_ntz, parse_ts
from driftwise.operators import baseline, drift, feedback, features, monitor, network, registry, split, train
from driftwise.params import POLLUTANTS, DriftParams, FeatureParams, SplitParams, ValidateParams
from driftwise.sources import io

# Sensor-table defaults: City x Date rows, the twelve pollutants, AQI target.
SENSOR_FEATURES = FeatureParams(key="City", ts="Date", tiebreak="_row", pollutants=POLLUTANTS, target="AQI")


def landed_readings(spark: SparkSession, raw_path: str) -> DataFrame:
    """S1 + F1: the raw CSV with Date parsed (coerced) and a load-order tiebreak for equal (City, Date)."""
    raw = io.read_raw_csv(spark, raw_path)
    return raw.withColumn("Date", parse_ts(F.col("Date")).cast("timestamp_ntz")) \
              .withColumn("_row", F.monotonically_increasing_id())


def feature_job(spark: SparkSession, raw_path: str, out_dir: str, vparams: ValidateParams = ValidateParams(),
                fparams: FeatureParams = SENSOR_FEATURES, n_bins: int = 10) -> dict:
    """Validate (S6 report; errors stop the job), build features (C1 -> S3), write the encoding map (S7) and
    the baseline of the pollutants + target (A3 -> S5)."""
    raw = io.read_raw_csv(spark, raw_path)
    report = quality_report = _validate(raw, vparams)
    io.write_table(quality_report, os.path.join(out_dir, "validation_report"), "json")
    r = report.first()
    if not r["passed"]:
        raise ValueError(f"validation failed: {list(r['errors'])}")
    readings = landed_readings(spark, raw_path)
    held: list = []
    feats = train.materialize(features.build_features(readings, fparams, cache=held).drop("_row"))
    for h in held:
        h.unpersist()
    io.write_table(feats, os.path.join(out_dir, "features"))
    dated = readings.where(F.col(fparams.ts).isNotNull())
    io.write_table(features.fit_encoding(dated, fparams.key, fparams.target), os.path.join(out_dir, "encoding"))
    cols = list(fparams.pollutants) + ([fparams.target] if fparams.target in feats.columns else [])
    base = baseline.baseline_stats(feats, cols, n_bins)
    io.write_baseline(base, os.path.join(out_dir, "baseline"))
    return {"rows": r["n_rows"], "features": os.path.join(out_dir, "features"),
            "baseline": os.path.join(out_dir, "baseline"), "n_baseline_features": base.count()}


def _validate(raw: DataFrame, vparams: ValidateParams) -> DataFrame:
    from driftwise.operators.quality import validate

    return validate(raw, vparams)


def monitor_job(spark: SparkSession, log_path: str, feedback_path: str, baseline_path: str, out_dir: str,
                as_of, params: DriftParams = DriftParams(), runs_path: str | None = None) -> DataFrame:
    """One monitor pass: trailing-window scans of the day-partitioned prediction log (S9), latest-wins ground
    truth (J2), rolling RMSE + count (A9, A10), PSI report (A7) -> metric rows (S11), decision (C10), and,
    given a runs table, the cooldown branch (C12, C13). Writes psi/metrics/decision, adds the
    metrics of this time to metrics_history; returns the decision."""
    log = spark.read.parquet(log_path)
    gt = spark.read.parquet(feedback_path)
    base = io.load_baseline(spark, baseline_path)
    a = as_ntz(as_of)
    attached = monitor.recent_attached(log.select("id", "predicted_aqi"), gt, a, params.window_hours)
    rolling = monitor.rolling_error(attached, a, params.window_hours)
    recent = io.scan_predictions(spark, log_path, as_of, params.window_hours, ["created_at", "input_features"])
    inputs = drift.json_inputs_long(recent).where(F.col("feature").isin(list(POLLUTANTS)))
    report = drift.psi(inputs, base, params.epsilon)
    io.write_table(report, os.path.join(out_dir, "psi"))
    report = spark.read.schema(report.schema).parquet(os.path.join(out_dir, "psi"))    # made once, read below
    io.write_table(io.psi_metrics(report), os.path.join(out_dir, "metrics"))
    io.record_metrics(report, os.path.join(out_dir, "metrics_history"), as_of)
    decision = monitor.decay_decision(rolling, drift.max_psi(report), params)
    if runs_path:
        cool = monitor.cooldown_active(spark.read.parquet(runs_path), a, params.cooldown_hours)
        decision = decision.join(monitor.retrain_branch(decision, cool).drop("should_retrain"))
    io.write_table(decision, os.path.join(out_dir, "decision"), "json")
    return spark.read.schema(decision.schema).json(os.path.join(out_dir, "decision"))


def retrain_job(spark: SparkSession, raw_path: str, log_path: str, feedback_path: str, out_dir: str,
                runs: DataFrame, model_versions: DataFrame, fparams: FeatureParams = SENSOR_FEATURES,
                sparams: SplitParams = SplitParams(), gbt_iters: int = 300, nn_rounds: int = 150) -> dict:
    """Rebuild with feedback (C2: S1 + P16 + U1 + W6 + C1, rewriting the feature table and the baseline),
    prepare splits (C3), train both families (C6 boosted trees, C7 network), evaluate (A11), log runs (C9) and promote the
    champion (K5, C8)."""
    base = landed_readings(spark, raw_path)
    att = feedback.attach_ground_truth(spark.read.parquet(log_path), spark.read.parquet(feedback_path))
    fb = feedback.feedback_as_raw_rows(att, list(fparams.pollutants), fparams.target)
    fb = fb.withColumn("Date", parse_ts(F.col("Date")).cast("timestamp_ntz")).withColumn("_row", F.lit(-1).cast("long"))
    merged = feedback.rebuild_rows(base, fb, [fparams.key, fparams.ts], ["feedback_at", "_row"]).drop("feedback_at")
    held: list = []
    feats = train.materialize(features.build_features(merged, fparams, cache=held).drop("_row"))
    for h in held:
        h.unpersist()
    io.write_table(feats, os.path.join(out_dir, "features"))
    base_cols = list(fparams.pollutants) + [fparams.target]
    io.write_baseline(baseline.baseline_stats(feats, base_cols), os.path.join(out_dir, "baseline"))
    # the merge left one row per (key, time), so the key breaks ties of a date the same way in every run
    tbl, cols = split.prepare_splits(feats, fparams.target, [fparams.key], fparams.ts, fparams.key, sparams)
    tbl = train.materialize(tbl)
    models = {"xgboost": train.train_gbt(tbl, cols, fparams.target, max_iter=gbt_iters),
              "pytorch_nn": network.train_network(tbl, cols, fparams.target, max_rounds=nn_rounds)}
    metrics = {fam: {r["split"]: r.asDict() for r in train.evaluate(m, tbl, fparams.target).collect()}
               for fam, m in models.items()}
    stamp = F.current_timestamp().cast("timestamp_ntz")
    new_runs = spark.createDataFrame(
        [(f"{fam}-{os.path.basename(out_dir)}", fam, "FINISHED", metrics[fam].get("val", {}).get("rmse"))
         for fam in models], "run_id string, model_family string, status string, val_rmse double",
    ).withColumn("start_time", stamp)
    all_runs = runs.unionByName(new_runs, allowMissingColumns=True)
    champ = registry.champion(all_runs)
    versions = registry.promote(model_versions, champ)
    io.write_table(all_runs, os.path.join(out_dir, "runs"))
    io.write_table(versions, os.path.join(out_dir, "model_versions"))
    winner = champ.first()
    if winner is not None:
        best, path = models[winner["winning_family"]], os.path.join(out_dir, "model")
        if isinstance(best, network.Network):
            io.write_table(best.rows(tbl), path)
        else:
            best.write().overwrite().save(path)
    return {"features": feats.count(), "metrics": metrics,
            "champion": winner.asDict() if winner is not None else None}

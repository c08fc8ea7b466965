"""Registered queries: one callable (spark, sf_dir) -> DataFrame per operator group of the inventory.

Every query reads whole driver tables (or views Spark derives from them); nothing is sampled or capped
except where a limit is the feature itself (top-k, keyset page). Doubles are rounded to 6 digits and
integers widened to bigint at the very end so results compare value-for-value with the SQL oracles.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.exprs import aqi_band, aqi_color, col as qcol, is_uuid
from driftwise.operators import (
    alerts, baseline, counters, drift, feedback, features, incremental, monitor, quality, registry, scoring, serving, split,
)
from driftwise.params import (
    LATENCY_BUCKETS_S, PREDICTION_VALUE_BUCKETS, VALUE_RANGES, DriftParams, FeatureParams, SplitParams, ValidateParams,
)
from driftwise.sources import views as V

P = FeatureParams()
D = DriftParams()
S = SplitParams()
BASELINE_FEATURES = {"p1": "PM2.5", "p2": "PM10", "target": "AQI"}
PAGE_SIZE = 100
COUNTER_RANGE_S, COUNTER_STEP_S = 3600, 900


def finish(df: DataFrame) -> DataFrame:
    """Round floating columns to 6 digits; widen integral columns to bigint (comparison normal form)."""
    out = []
    for f in df.schema.fields:
        c = qcol(f.name)
        if isinstance(f.dataType, T.DoubleType | T.FloatType):
            # two-stage rounding (9 digits absorbs float noise, then half-up to 6) so engines that sum in a
            # different order agree even when the exact value sits on a 6-digit tie
            out.append(F.round(c.cast("double").try_cast("decimal(38,9)"), 6).cast("double").alias(f.name))
        elif isinstance(f.dataType, T.ByteType | T.ShortType | T.IntegerType):
            out.append(c.cast("long").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def as_of(spark: SparkSession, sf: str):
    """max(events.ts), the clock of every trailing window, resolved once to a literal so that trailing
    predicates (ts > as_of - h) are pushed into the Parquet scan as row-group filters."""
    from driftwise.functions.exprs import ntz_lit

    return ntz_lit(V.events(spark, sf).agg(F.max("ts")).first()[0])


# ---------------------------------------------------------------------------
# Quality
# ---------------------------------------------------------------------------
def q_validate_missing_pct(spark, sf):
    prof = quality.missing_profile(V.readings(spark, sf), ValidateParams().max_missing_pct)
    return finish(prof.select("column_name", "position", "n_rows", "missing_pct", "over_threshold"))


def q_validate_dates(spark, sf):
    return finish(quality.date_check(V.raw_readings(spark, sf), "Date"))


VALIDATE_PARAMS = ValidateParams(required_columns=("City", "Date", "PM2.5", "PM10", "NO", "AQI"), min_rows=1000)


def q_validate_report(spark, sf):
    r = quality.validate(V.raw_readings(spark, sf), VALIDATE_PARAMS)
    return finish(_report_columns(r))


def q_range_violations(spark, sf):
    raw = V.raw_readings(spark, sf)
    return finish(quality.range_violations(raw, {c: VALUE_RANGES[c] for c in ("PM2.5", "PM10", "AQI")}))


def q_payload_accept_reject(spark, sf):
    out = quality.split_payloads(V.request_payloads(spark, sf), "body", "payload_id", ["PM2.5", "PM10"])
    return finish(out)


# ---------------------------------------------------------------------------
# Features
# ---------------------------------------------------------------------------
def q_impute_ffill_median(spark, sf):
    imp = features.impute(V.readings(spark, sf), P)
    return finish(imp.select("city", "ts", "event_id", "p1", "p2", "target"))


def q_remaining_nulls(spark, sf):
    return finish(features.remaining_nulls(features.impute(V.readings(spark, sf), P), P.pollutants))


def q_lag_features(spark, sf):
    out = features.add_lags_and_rolls(V.readings(spark, sf), P, rolls=())
    return finish(out.drop("target"))


def q_rolling_mean_excl_current(spark, sf):
    out = features.add_lags_and_rolls(V.readings(spark, sf), P, lags=())
    return finish(out.drop("target"))


def _dated(spark, sf):
    return V.readings(spark, sf).where(F.col("ts").isNotNull())


def q_target_encode(spark, sf):
    return finish(features.fit_encoding(_dated(spark, sf), "city", "target"))


def q_encode_unseen(spark, sf):
    dated = _dated(spark, sf)
    enc = features.fit_encoding(dated, "city", "target")
    cust = V.table(spark, sf, "customer").select("c_custkey")
    out = features.apply_encoding(cust, enc, "c_custkey", dated.agg(F.avg("target")).scalar(), enc_key="city")
    return finish(out)


def q_feature_build(spark, sf):
    return finish(features.build_features(V.readings(spark, sf), P))


def _merged(spark, sf):
    base = V.readings(spark, sf)
    fb = V.readings_feedback(spark, sf)
    return feedback.rebuild_rows(base, fb, ["city", "ts"], ["feedback_at", "event_id"])


def q_rebuild_with_feedback(spark, sf):
    return finish(features.build_features(_merged(spark, sf).drop("feedback_at"), P))


def q_incremental_rebuild(spark, sf):
    """C2 kept up to date: the state of all feedback but that of the last day, then that day's as a change."""
    from driftwise.functions.exprs import ntz_lit
    from driftwise.session import scratch_path

    fb, root = V.readings_feedback(spark, sf), scratch_path(spark, "incremental")
    late = F.col("feedback_at") > ntz_lit(fb.agg(F.max("feedback_at")).first()[0]) - F.expr("interval 1 day")
    incremental.start(V.readings(spark, sf), fb.where(~F.coalesce(late, F.lit(False))), root, P)
    incremental.add_feedback(spark, fb.where(late), root, P)
    return finish(incremental.load(spark, root))


def q_duplicate_collapse(spark, sf):
    return finish(feedback.duplicate_collapse(
        V.readings(spark, sf), V.readings_feedback(spark, sf), ["city", "ts"], ["feedback_at", "event_id"]))


# ---------------------------------------------------------------------------
# Baseline and drift
# ---------------------------------------------------------------------------
def _baseline(spark, sf):
    renamed = V.readings(spark, sf).select(*[F.col(k).alias(v) for k, v in BASELINE_FEATURES.items()])
    return baseline.baseline_stats(renamed, list(BASELINE_FEATURES.values()), D.n_bins)


def q_baseline_stats(spark, sf):
    b = _baseline(spark, sf)
    return finish(b.select("feature", "mean", "std", "min", "max", "median", "q25", "q75", "n_observations",
                           F.size("bin_edges").alias("n_edges")))


def q_baseline_histogram(spark, sf):
    return finish(baseline.baseline_histogram(_baseline(spark, sf)))


def _psi(spark, sf):
    return drift.drift_report(V.predictions(spark, sf), _baseline(spark, sf), as_of(spark, sf), D.window_hours, D.epsilon)


def q_psi_report(spark, sf):
    return finish(_psi(spark, sf))


def q_psi_ranked(spark, sf):
    return finish(drift.rank_psi(_psi(spark, sf)))


def q_psi_metrics(spark, sf):
    from driftwise.sources.io import psi_metrics

    return finish(psi_metrics(_psi(spark, sf)))


# ---------------------------------------------------------------------------
# Feedback and monitoring
# ---------------------------------------------------------------------------
def _attached(spark, sf):
    return feedback.attach_ground_truth(V.predictions(spark, sf), V.ground_truth(spark, sf))


def q_attach_ground_truth(spark, sf):
    a = _attached(spark, sf)
    return finish(a.select("id", "model_version", "predicted_aqi", "actual_aqi", "feedback_at"))


def q_unknown_feedback(spark, sf):
    return finish(feedback.unknown_feedback(V.ground_truth(spark, sf), V.predictions(spark, sf)))


def q_rolling_rmse(spark, sf):
    return finish(_rolling(spark, sf))


def q_feedback_count(spark, sf):
    return finish(_rolling(spark, sf).select("feedback_count"))


def q_feedback_recent(spark, sf):
    return finish(feedback.recent_feedback(_attached(spark, sf), 500))


EXPORT_SCHEMA = (
    "prediction_id string, created_at string, feedback_at string, model_version string, model_family string, "
    "city string, date string, predicted_aqi double, actual_aqi double, error double, abs_error double, "
    "latency_ms double"
)


def q_feedback_export(spark, sf):
    from driftwise.session import scratch_path
    from driftwise.sources.io import export_csv

    path = scratch_path(spark, "feedback-export")
    export_csv(feedback.recent_feedback(_attached(spark, sf), None), path)
    back = spark.read.schema(EXPORT_SCHEMA).option("header", True).option("nullValue", "").csv(path)
    return finish(back)


def _rolling(spark, sf):
    now = as_of(spark, sf)
    recent = monitor.recent_attached(V.predictions(spark, sf), V.ground_truth(spark, sf), now, D.window_hours)
    return monitor.rolling_error(recent, now, D.window_hours)


def q_decay_decision(spark, sf):
    return finish(monitor.decay_decision(_rolling(spark, sf), drift.max_psi(_psi(spark, sf)), D))


def q_retrain_status(spark, sf):
    return finish(monitor.retrain_status(_rolling(spark, sf), D))


def q_retrain_branch(spark, sf):
    dec = monitor.decay_decision(_rolling(spark, sf), drift.max_psi(_psi(spark, sf)), D)
    cool = monitor.cooldown_active(V.runs(spark, sf), as_of(spark, sf), D.cooldown_hours)
    return finish(monitor.retrain_branch(dec, cool))


def q_category_bands(spark, sf):
    r = V.readings(spark, sf)
    return finish(r.select("event_id", "target", aqi_band(F.col("target")).alias("band"),
                           aqi_color(F.col("target")).alias("color")))


def q_predictions_by_version(spark, sf):
    return finish(monitor.count_by(V.predictions(spark, sf), ["model_version", "model_family"], "n_predictions"))


def _histograms(spark, sf):
    lat = monitor.cumulative_histogram(V.requests(spark, sf), "duration_s", LATENCY_BUCKETS_S).withColumn(
        "metric", F.lit("request_duration_seconds"))
    pv = monitor.cumulative_histogram(V.predictions(spark, sf), "predicted_aqi", PREDICTION_VALUE_BUCKETS).withColumn(
        "metric", F.lit("prediction_value"))
    return lat.unionByName(pv)


def q_bucket_histogram(spark, sf):
    return finish(_histograms(spark, sf))


def q_histogram_quantile(spark, sf):
    few, many = (F.array(*[F.lit(q) for q in qs]) for qs in ((0.5,), (0.5, 0.95, 0.99)))
    asked = F.when(F.col("metric") == "prediction_value", few).otherwise(many)
    return finish(monitor.histogram_quantiles(_histograms(spark, sf), asked, ["metric"]))


def q_latency_summary(spark, sf):
    return finish(monitor.latency_summary(V.predictions(spark, sf), "latency_ms"))


def q_rate_per_minute(spark, sf):
    return finish(monitor.rate_per_window(V.requests(spark, sf), "ts", "1 minute", 60, ["status"]))


def q_error_ratio_5m(spark, sf):
    return finish(monitor.error_ratio(V.requests(spark, sf), "ts"))


def q_sustained_alerts(spark, sf):
    return finish(alerts.evaluate_alerts(V.requests(spark, sf), _attached(spark, sf), V.predictions(spark, sf),
                                         _baseline(spark, sf)))


def q_dashboard_panels(spark, sf):
    return finish(alerts.dashboard_panels(V.requests(spark, sf), V.predictions(spark, sf), _attached(spark, sf),
                                          as_of(spark, sf), D.window_hours))


# ---------------------------------------------------------------------------
# Splits, training table, metrics
# ---------------------------------------------------------------------------
def q_chronological_split(spark, sf):
    s = split.chronological_split(V.readings(spark, sf), "ts", "event_id", S)
    return finish(s.select("event_id", "row_pos", "split"))


def q_split_summary(spark, sf):
    s = split.chronological_split(V.readings(spark, sf), "ts", "event_id", S)
    return finish(split.split_summary(s, "ts"))


def q_holdout_tail(spark, sf):
    h = split.holdout_tail(V.readings(spark, sf), "ts", "event_id", S)
    return finish(h.select("event_id", "row_pos"))


def q_keyset_page(spark, sf):
    """K7: the page after a (ts, id) cursor; the cursor is as_of - 24 h."""
    from driftwise.operators.paging import keyset_page

    cursor = as_of(spark, sf) - F.make_dt_interval(F.lit(0), F.lit(24))
    page = keyset_page(V.readings(spark, sf), "ts", "event_id", cursor, None, PAGE_SIZE)
    return finish(page.select("city", "ts", "event_id", "p1", "p2", "target"))


def q_recent_predictions(spark, sf):
    """K6: newest 10 predictions."""
    from driftwise.operators.paging import newest

    p = V.predictions(spark, sf).select("id", "created_at", "model_version", "predicted_aqi")
    return finish(newest(p, "created_at", "id", 10))


def q_standardize(spark, sf):
    feats = features.build_features(V.readings(spark, sf), P)
    s = split.chronological_split(feats, "ts", "event_id", S)
    z = split.standardize(s, ["p1", "p2", "p1_lag1", "p2_roll7"], as_float32=False)
    return finish(z.select("event_id", "split", "p1", "p2", "p1_lag1", "p2_roll7"))


def q_training_table(spark, sf):
    feats = features.build_features(V.readings(spark, sf), P)
    t, cols = split.prepare_splits(feats, "target", ["city", "ts"], "ts", "event_id", S)
    return finish(t)


def q_feature_columns(spark, sf):
    """P10: the model feature columns of the built feature table (numeric/boolean, minus target and the
    exclude list) with their type and non-null count (one aggregate over the table)."""
    feats = features.build_features(V.readings(spark, sf), P)
    cols = split.feature_columns(feats, "target", ["city", "ts", "event_id"])
    counts = feats.agg(*[F.count(qcol(c)).alias(f"_n{i}") for i, c in enumerate(cols)])
    types = dict(feats.dtypes)
    entries = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.lit(types[c]).alias("dtype"),
                 F.col(f"_n{i}").alias("n_non_null"))
        for i, c in enumerate(cols)
    ])
    return finish(counts.select(F.inline(entries)))


def q_regression_metrics(spark, sf):
    a = _attached(spark, sf).where(F.col("actual_aqi").isNotNull())
    s = split.chronological_split(a, "created_at", "id", S)
    return finish(monitor.regression_metrics(s, "actual_aqi", "predicted_aqi", "split"))


def q_scoring_rows(spark, sf):
    reqs = scoring.request_batches(V.readings(spark, sf), "city", "ts", "event_id", ["p1", "p2"])
    cols = ["p1", "p2"] + [f"{c}_lag{k}" for c in ("p1", "p2") for k in P.lags] + \
           [f"{c}_roll{k}" for c in ("p1", "p2") for k in P.rolls] + ["city_target_enc"]
    return finish(scoring.feature_rows(reqs, cols, ["p1", "p2"], key="city"))


REQUEST_FIELDS = ("PM2.5", "PM10")


def _parsed_requests(spark, sf):
    return serving.parse_requests(V.nested_requests(spark, sf), "body", "request_id", REQUEST_FIELDS, ["received_at"])


def q_request_errors(spark, sf):
    """P14 on nested bodies: one row per fault, with its place in the body."""
    return finish(serving.request_errors(_parsed_requests(spark, sf), "request_id"))


def q_score_to_log(spark, sf):
    """P14 -> C4 -> C5 -> S8: accepted bodies become log rows, appended twice as a retry would; read back they are there once."""
    from driftwise.session import scratch_path
    from driftwise.sources.io import append_batch, read_batches

    past = features.add_lags_and_rolls(V.readings(spark, sf), P, cols=["p2"], lags=(1,), rolls=())
    past = past.select(F.col("p1").alias("PM2.5"), F.col("p2_lag1").alias("PM10_lag1"), "target")
    model = serving.least_squares(past, ["PM2.5", "PM10_lag1"], "target")
    rows = serving.log_rows(_parsed_requests(spark, sf), "request_id", "received_at", REQUEST_FIELDS, model, "v1", "linear",
                            as_of(spark, sf)).withColumn("created_date", F.to_date("created_at"))
    path = scratch_path(spark, "scored-log")
    for _ in range(2):
        append_batch(rows, path, "scored", ["created_date"])
    log = read_batches(spark, path)
    sent = {name: F.get_json_object("input_features", f"$['{name}']") for name in ("city", "date", *REQUEST_FIELDS)}
    return finish(log.select("id", "created_at", "model_version", "model_family", sent["city"].alias("city"), sent["date"].alias("date"),
                             sent["PM2.5"].cast("double").alias("pm25"), sent["PM10"].cast("double").alias("pm10"),
                             "predicted_aqi", "latency_ms"))


def q_counter_rate(spark, sf):
    return finish(counters.counter_rate(V.scraped_counters(spark, sf), "scraped_at", "total", ["status"], COUNTER_RANGE_S, COUNTER_STEP_S))


def q_psi_history(spark, sf):
    """S11 over time: two monitor passes a day apart, the second one delivered twice; each has its own rows."""
    from driftwise.session import scratch_path
    from driftwise.sources.io import read_batches, record_metrics

    path, now = scratch_path(spark, "metrics"), as_of(spark, sf)
    base, log = _baseline(spark, sf), V.predictions(spark, sf)
    for back in (1, 0, 0):
        at = now - F.make_dt_interval(F.lit(back))
        record_metrics(drift.drift_report(log.where(F.col("created_at") <= at), base, at, D.window_hours, D.epsilon), path, at)
    return finish(read_batches(spark, path).drop("batch_id"))


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------
def q_latest_run_per_family(spark, sf):
    return finish(registry.latest_finished_runs(V.runs(spark, sf)).drop("recency_rank"))


def q_champion(spark, sf):
    return finish(registry.champion(V.runs(spark, sf)))


def q_promote(spark, sf):
    return finish(registry.promote(V.model_versions(spark, sf), registry.champion(V.runs(spark, sf))))


def q_recent_runs(spark, sf):
    return finish(registry.recent_runs(V.dag_runs(spark, sf), 5))


def q_version_family(spark, sf):
    return finish(registry.version_family(V.model_versions(spark, sf), V.runs(spark, sf)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)
}


# ---------------------------------------------------------------------------
# Sources and sinks round trips (S2, S3, S4, S5, S8, S9) and feedback as raw rows
# ---------------------------------------------------------------------------
def q_csv_landing(spark, sf):
    """The raw table written as CSV with missing readings spelled NaN (as exported sensor files do), then
    landed with an explicit schema: NaN tokens become null, text stays text."""
    from pyspark.sql import types as T

    from driftwise.session import scratch_path
    from driftwise.sources.io import read_raw_csv

    path = scratch_path(spark, "raw-csv")
    raw = V.raw_readings(spark, sf)
    raw.write.option("header", True).option("nullValue", "NaN").csv(path)
    schema = T.StructType([T.StructField("City", T.StringType()), T.StructField("Date", T.StringType())]
                          + [T.StructField(c, T.DoubleType()) for c in ("PM2.5", "PM10", "AQI")])
    return finish(read_raw_csv(spark, path, schema))


def q_landing_check(spark, sf):
    """The landing table must exist and hold rows; its row count."""
    import os

    from driftwise.sources.io import landing_check

    return finish(landing_check(spark, os.path.join(sf, "events.parquet")).agg(F.count(F.lit(1)).alias("n_rows")))


def q_features_roundtrip(spark, sf):
    """S3 + S4: the feature table written with a full overwrite, then loaded back."""
    from driftwise.session import scratch_path
    from driftwise.sources.io import load_table, write_table

    path = scratch_path(spark, "features")
    write_table(features.build_features(V.readings(spark, sf), P), path)
    return finish(load_table(spark, path))


def _report_columns(r: DataFrame) -> DataFrame:
    return r.select(
        "n_rows", "n_columns", "target_missing_pct", "unparseable_dates",
        F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"),
        F.array_join("errors", " | ").alias("errors"), F.array_join("warnings", " | ").alias("warnings"),
        "passed",
    )


def q_report_roundtrip(spark, sf):
    """The validation report written with a full overwrite, then loaded back."""
    from driftwise.session import scratch_path
    from driftwise.sources.io import load_table, write_table

    path = scratch_path(spark, "report")
    write_table(quality.validate(V.raw_readings(spark, sf), VALIDATE_PARAMS), path)
    return finish(_report_columns(load_table(spark, path)))


def q_encoding_roundtrip(spark, sf):
    """The encoding table written with a full overwrite, then loaded back."""
    from driftwise.session import scratch_path
    from driftwise.sources.io import load_table, write_table

    path = scratch_path(spark, "encoding")
    write_table(features.fit_encoding(_dated(spark, sf), "city", "target"), path)
    return finish(load_table(spark, path))


def q_uuid_check(spark, sf):
    """F16 over an id text per event: dashed, upper-case dashed (``view``) or without dashes (``error``)."""
    raw = F.md5(F.col("event_id").cast("string"))
    dashed = F.concat_ws("-", *[F.substring(raw, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    text = F.when(F.col("event_type") == "error", raw).when(F.col("event_type") == "view", F.upper(dashed)).otherwise(dashed)
    return finish(V.table(spark, sf, "events").select("event_id", is_uuid(text).alias("is_uuid")))


def q_provenance(spark, sf):
    """The provenance row of a run over the whole readings table."""
    r = V.readings(spark, sf)
    row = registry.provenance_row(spark, "r1", "xgboost", r.count(), len(r.columns), {"stage": "train"})
    return finish(row.select("run_id", "model_family", "dataset_rows", "feature_count", F.col("tags")["stage"].alias("stage")))


def q_baseline_roundtrip(spark, sf):
    """The baseline written as JSON (one row per feature), read back with its schema."""
    from driftwise.session import scratch_path
    from driftwise.sources.io import load_baseline, write_baseline

    path = scratch_path(spark, "baseline")
    write_baseline(_baseline(spark, sf), path)
    return finish(baseline.baseline_histogram(load_baseline(spark, path)))


def q_prediction_log_window(spark, sf):
    """S8 + S9: append the log partitioned by day, scan the trailing 24 h: the day predicate prunes
    partitions, the timestamp predicate is pushed into Parquet, only four columns are read."""
    from driftwise.session import scratch_path
    from driftwise.sources.io import append_predictions, scan_predictions

    path = scratch_path(spark, "prediction-log")
    append_predictions(V.predictions(spark, sf), path)
    now = V.events(spark, sf).agg(F.max("ts")).first()[0]
    return finish(scan_predictions(spark, path, now, D.window_hours, ["id", "created_at", "model_version", "predicted_aqi"]))


def q_feedback_raw_rows(spark, sf):
    """Predictions with ground truth as raw rows (City, Date, pollutants, AQI)."""
    return finish(feedback.feedback_as_raw_rows(_attached(spark, sf), ["PM2.5", "PM10"]).drop("feedback_at"))


def q_monitor_job(spark, sf):
    """C10 as a job: the prediction log and ground truth are written (day-partitioned / Parquet) to the
    shared folder, the baseline as JSON; the monitor job reads them back and returns its decision row."""
    from driftwise.plans.jobs import monitor_job
    from driftwise.session import scratch_path
    from driftwise.sources.io import append_predictions, write_baseline, write_table

    root = scratch_path(spark, "monitor")
    log, gt, base = f"{root}/log", f"{root}/ground_truth", f"{root}/baseline"
    append_predictions(V.predictions(spark, sf), log)
    write_table(V.ground_truth(spark, sf), gt)
    write_baseline(_baseline(spark, sf), base)
    now = V.events(spark, sf).agg(F.max("ts")).first()[0]
    return finish(monitor_job(spark, log, gt, base, f"{root}/out", now, D))


# ---------------------------------------------------------------------------
# Training and scoring (MLlib; checked by row count, model numbers are not SQL-expressible)
# ---------------------------------------------------------------------------
def _training(spark, sf):
    from driftwise.operators import train

    held: list = []
    feats = train.materialize(features.build_features(V.readings(spark, sf), P, cache=held))
    for h in held:
        h.unpersist()
    t, cols = split.prepare_splits(feats, "target", ["city", "ts"], "ts", "event_id", S)
    return train.materialize(t), cols


def q_train_gbt(spark, sf):
    from driftwise.operators import train

    t, cols = _training(spark, sf)
    model = train.train_gbt(t, cols, "target")
    out = finish(train.evaluate(model, t, "target"))
    return out


def q_train_linear(spark, sf):
    from driftwise.operators import train

    t, cols = _training(spark, sf)
    model = train.train_linear(t, cols, "target")
    return finish(train.evaluate(model, t, "target"))


def q_train_network(spark, sf):
    from driftwise.operators import network, train

    t, cols = _training(spark, sf)
    model = network.train_network(t, cols, "target")
    return finish(train.evaluate(model, t, "target"))


def q_feature_importance(spark, sf):
    from driftwise.operators import train

    t, cols = _training(spark, sf)
    model = train.train_gbt(t, cols, "target")
    return finish(train.feature_importance(model, cols, 15))


def q_batch_score(spark, sf):
    """One request per city (newest reading + 14 history rows) scored by the linear pipeline and stamped
    like the prediction log."""
    from driftwise.operators import train

    t, cols = _training(spark, sf)
    model = train.train_linear(t, cols, "target")
    reqs = scoring.request_batches(V.readings(spark, sf), "city", "ts", "event_id", list(P.pollutants))
    rows = scoring.feature_rows(reqs, cols, list(P.pollutants), key="city")
    stamped = scoring.score(rows, model, cols, "v1", "linear", as_of(spark, sf))
    return finish(stamped)


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}

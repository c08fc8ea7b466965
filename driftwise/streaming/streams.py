"""Structured Streaming forms of the monitoring jobs (T-1 ... T-6).

Inputs are file streams over the driver tables; event time is cast from timestamp_ntz to timestamp first
(watermarks refuse NTZ). Results leave the stream through ``foreachBatch`` into Parquet under the shared
checkpoint folder (complete mode overwrites, append mode appends), so nothing is collected to the driver.
``run`` uses ``trigger(availableNow=True)``: process everything present, then stop - the same code runs
continuously with a processing-time trigger.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.functions.exprs import event_time, ntz_from_instant, ntz_from_seconds, parse_double
from driftwise.operators.baseline import bin_index
from driftwise.session import ensure_checkpoint_dir, scratch_path
from driftwise.sources.views import prop_k


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over one driver table. The path is a glob that matches exactly that file, which the
    file source accepts (a bare file path is refused); in production point it at the landing directory."""
    schema = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet")).schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    glob = os.path.join(sf_dir, f"{name}.parq[u]et")
    return r.parquet(glob)


def _drain(query, name: str, timeout_s: int | None) -> None:
    """Wait until the whole backlog is written. A half-filled sink is never returned: a query that is still
    running after ``timeout_s`` (None: no limit) is stopped and reported."""
    done = query.awaitTermination(timeout_s) if timeout_s else query.awaitTermination() is None
    if not done:
        query.stop()
        raise TimeoutError(f"stream {name} did not finish within {timeout_s} s; its sink is incomplete")
    if query.exception() is not None:
        raise RuntimeError(f"stream {name} failed: {query.exception()}")


def run(df: DataFrame, name: str, mode: str = "append", timeout_s: int | None = None, ending: Ending | None = None) -> DataFrame:
    """Drain the stream once (availableNow) into a Parquet table and return that table."""
    return read_sink(df.sparkSession, run_to_path(df, name, mode, timeout_s, ending))


def read_sink(spark: SparkSession, path: str) -> DataFrame:
    """Read a sink table written by ``run_to_path`` (without its micro-batch directory column)."""
    t = spark.read.parquet(path)
    return t.drop("micro_batch") if "micro_batch" in t.columns else t


def _idempotent_write(batch: DataFrame, batch_id: int, out: str, complete: bool) -> None:
    """A replayed micro-batch (same id after a failure) rewrites its own output instead of appending it
    twice: append-mode batches go to ``micro_batch=<id>`` and overwrite it, complete mode overwrites all."""
    if complete:
        batch.write.mode("overwrite").parquet(out)
    else:
        batch.write.mode("overwrite").parquet(os.path.join(out, f"micro_batch={batch_id}"))


class Ending:
    """The end of a replay. A watermark closes what lies before the newest event, so when a bounded input has been drained the
    last windows and the open join rows would never leave. ``mark`` gives a stream a second source that is empty
    at first; ``close`` puts one row of the far future there, and the query, started again from its checkpoint,
    moves its watermark past all data. The row's own window stays open and is never written. A continuous
    query does without: there the next event moves the watermark."""

    FAR = "2999-01-01 00:00:00"

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, []

    def mark(self, stream: DataFrame, **values) -> DataFrame:
        """``values``: SQL of the columns that the row needs on its way to the watermark; the others are null."""
        path = scratch_path(self.spark, "stream-ending")
        self.spark.createDataFrame([], stream.schema).write.parquet(path)
        row = self.spark.range(1).select(*[F.expr(values.get(f.name, "NULL")).cast(f.dataType).alias(f.name) for f in stream.schema])
        self.rows.append((row, path))
        return stream.unionByName(self.spark.readStream.schema(stream.schema).parquet(path))

    def close(self) -> None:
        for row, path in self.rows:
            row.write.mode("append").parquet(path)


def _drained(df: DataFrame, name: str, mode: str, sink, ending: Ending | None, timeout_s: int | None) -> None:
    """Run a sink over the whole backlog, then over what the ending lets go, from one checkpoint."""
    ckpt = scratch_path(df.sparkSession, f"stream-{name}-ckpt")

    def once() -> None:
        q = (df.writeStream.queryName(f"{name}_{ckpt[-8:]}").outputMode(mode)
             .foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        _drain(q, name, timeout_s)

    once()
    if ending is not None:
        ending.close()
        once()


def run_to_path(df: DataFrame, name: str, mode: str = "append", timeout_s: int | None = None, ending: Ending | None = None) -> str:
    """Drain the stream once (availableNow) into a Parquet table under the shared folder; its path."""
    ensure_checkpoint_dir(df.sparkSession)
    out = scratch_path(df.sparkSession, f"stream-{name}")
    complete = mode == "complete"
    _drained(df, name, mode, lambda batch, batch_id: _idempotent_write(batch, batch_id, out, complete), ending, timeout_s)
    return out


# ---------------------------------------------------------------------------
# Stream views (same rules as driftwise.sources.views)
# ---------------------------------------------------------------------------
def submissions_stream(events: DataFrame) -> DataFrame:
    """Feedback submissions derived per event row (first answer, purchase overwrite, unknown id)."""
    k = prop_k()
    e = events
    first = e.where(F.col("event_type") != "view").select(
        F.col("event_id").alias("prediction_id"), (F.col("value") + (k - 50)).cast("double").alias("actual_aqi"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("feedback_at"))
    over = e.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("prediction_id"), (F.col("value") + k).cast("double").alias("actual_aqi"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("feedback_at"))
    unknown = e.where(F.col("event_type") == "error").select(
        (F.lit(-1) - F.col("event_id")).alias("prediction_id"), F.col("value").cast("double").alias("actual_aqi"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("feedback_at"))
    return first.unionByName(over).unionByName(unknown).withColumn("fb_t", event_time(F.col("feedback_at")))


# ---------------------------------------------------------------------------
# T-1 .. T-6
# ---------------------------------------------------------------------------
def run_attach_batched(subs: DataFrame, predictions_static: DataFrame, name: str, horizon_hours: int = 3,
                       timeout_s: int | None = None) -> DataFrame:
    """T-2 (stream-static form): each micro-batch of submissions is joined to the predictions made at most
    ``horizon_hours`` before its feedback times. The static read is filtered to that time span (a pushed
    Parquet predicate / pruned log partitions), so a batch never rescans the whole prediction log.
    Submissions that find no prediction there go to a late table, which one batch join with the whole log
    resolves after the drain: feedback of any age is attached, only unknown ids drop out."""
    import datetime as _dt

    from driftwise.functions.exprs import ntz_lit

    spark = subs.sparkSession
    ensure_checkpoint_dir(spark)
    out = scratch_path(spark, f"stream-{name}")
    late_path = scratch_path(spark, f"stream-{name}-late")
    ckpt = scratch_path(spark, f"stream-{name}-ckpt")
    p_all = predictions_static.select(F.col("id").alias("prediction_id"), "predicted_aqi", "model_version",
                                      "created_at")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            span = batch.agg(F.min("feedback_at").alias("lo"), F.max("feedback_at").alias("hi")).first()
            if span["lo"] is None:
                return
            lo = ntz_lit(span["lo"] - _dt.timedelta(hours=horizon_hours))
            p = p_all.where((F.col("created_at") >= lo) & (F.col("created_at") <= ntz_lit(span["hi"])))
            both = batch.join(p.withColumnRenamed("prediction_id", "_pid"),
                              (F.col("prediction_id") == F.col("_pid")) & (F.col("feedback_at") >= F.col("created_at"))
                              & (F.col("feedback_at") <= F.col("created_at") + F.expr(f"INTERVAL {horizon_hours} HOURS")), "left")
            _idempotent_write(_errors(both.where("_pid is not null")), batch_id, out, False)
            _idempotent_write(both.where("_pid is null").select("prediction_id", "actual_aqi", "feedback_at"),
                              batch_id, late_path, False)
        finally:
            batch.unpersist()

    q = (subs.writeStream.queryName(f"{name}_{os.path.basename(out)[-8:]}").outputMode("append")
         .foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    _drain(q, name, timeout_s)
    sub = subs.select("prediction_id", "actual_aqi", "feedback_at").schema
    late = spark.read.schema(sub).parquet(late_path).drop("micro_batch")
    resolved = _errors(late.join(p_all, "prediction_id").where("feedback_at >= created_at"))
    on_time = spark.read.schema(resolved.schema).parquet(out).drop("micro_batch")
    return on_time.unionByName(resolved)


def _errors(attached: DataFrame) -> DataFrame:
    return attached.select("prediction_id", "model_version", "predicted_aqi", "actual_aqi", "feedback_at",
                           (F.col("actual_aqi") - F.col("predicted_aqi")).alias("error"))


def stream_stream_attach(pred_events: DataFrame, fb_events: DataFrame, within_hours: int = 3,
                         watermark: str = "1 hour", how: str = "leftOuter", ending: Ending | None = None) -> DataFrame:
    """T-2 (stream-stream form): predictions joined with the feedback submissions that arrive within ``within_hours`` after
    the prediction. Both sides are watermarked and the join has an event-time range, so join state is bounded; what
    found no partner is emitted (with nulls) by an outer join once the watermark has passed its window. Feedback that
    comes later than that leaves a full or right outer join without its prediction; ``resolve_late`` attaches it."""
    p = pred_events.select(
        F.col("event_id").alias("id"), F.col("event_type").alias("model_version"),
        F.col("value").alias("predicted_aqi"), event_time(F.col("ts")).alias("pred_t"))
    f = submissions_stream(fb_events).select(F.col("prediction_id"), "actual_aqi", "feedback_at", F.col("fb_t"))
    if ending is not None:
        # ids that are not null, as the join's filters come before the watermarks, and that do not meet
        p = ending.mark(p, id="-9223372036854775808", pred_t=f"timestamp'{ending.FAR}'")
        f = ending.mark(f, prediction_id="-9223372036854775807", fb_t=f"timestamp'{ending.FAR}'")
    p, f = p.withWatermark("pred_t", watermark), f.withWatermark("fb_t", watermark)
    cond = (F.col("prediction_id") == F.col("id")) & (F.col("fb_t") >= F.col("pred_t")) & \
        (F.col("fb_t") <= F.col("pred_t") + F.expr(f"INTERVAL {within_hours} HOURS"))
    return p.join(f, cond, how).select(
        "id", "prediction_id", "model_version", "predicted_aqi", "actual_aqi", "feedback_at", "fb_t",
        ntz_from_instant(F.col("pred_t")).alias("created_at"))


def resolve_late(late: DataFrame, predictions: DataFrame) -> DataFrame:
    """Submissions that came after the stream had given up their prediction, joined with the whole log by id; ids that no
    prediction has drop out."""
    p = predictions.select("id", "model_version", "predicted_aqi", "created_at")
    return late.select("prediction_id", "actual_aqi", "feedback_at").join(p, F.col("prediction_id") == F.col("id")).where("feedback_at >= created_at").select(
        "id", "model_version", "predicted_aqi", "actual_aqi", "feedback_at", "created_at")


def run_join(pred_events: DataFrame, fb_events: DataFrame, predictions: DataFrame, name: str, within_hours: int = 3) -> DataFrame:
    """T-2: every prediction with each of its submissions of any age, or with nulls when it has none."""
    ending = Ending(pred_events.sparkSession)
    joined = stream_stream_attach(pred_events, fb_events, within_hours, how="fullOuter", ending=ending).drop("fb_t")
    table = run(joined, name, "append", ending=ending)
    late = resolve_late(table.where("id is null and prediction_id is not null"), predictions)
    cols = ["id", "model_version", "predicted_aqi", "actual_aqi", "feedback_at", "created_at"]
    answered = table.where("id is not null and prediction_id is not null")
    open_ = table.where("id is not null and prediction_id is null").join(late.select("id").distinct(), "id", "left_anti")
    return answered.select(cols).unionByName(late.select(cols)).unionByName(open_.select(cols))


def _pane_sums(attached: DataFrame, pane_s: int) -> DataFrame:
    """Squared error and count per pane of feedback time. Partial sums of several batches add up; as decimals they do so
    exactly, whatever the order."""
    error = (F.col("actual_aqi") - F.col("predicted_aqi")).cast("double")
    at = F.floor(F.unix_seconds(event_time(F.col("feedback_at"))) / pane_s).cast("long") * pane_s
    return attached.groupBy(at.alias("_p")).agg(F.sum((error * error).cast("decimal(38,12)")).alias("sse"), F.count(error).alias("n"))


def run_panes(pred_events: DataFrame, fb_events: DataFrame, predictions: DataFrame, name: str, pane_s: int = 600, within_hours: int = 3) -> DataFrame:
    """T-1: panes of squared error over all feedback. Each micro-batch of the stream-stream join adds up its own panes and
    writes them, and the submissions that found no prediction in time, under its id (a replayed batch rewrites its
    own). The parts are summed at the end together with those of the late submissions, so no pane waits for a
    watermark and none is lost to it."""
    spark = pred_events.sparkSession
    ensure_checkpoint_dir(spark)
    ending = Ending(spark)
    joined = stream_stream_attach(pred_events, fb_events, within_hours, how="rightOuter", ending=ending)
    panes_path, late_path = scratch_path(spark, f"stream-{name}-panes"), scratch_path(spark, f"stream-{name}-late")

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            _idempotent_write(_pane_sums(batch.where("id is not null"), pane_s), batch_id, panes_path, False)
            _idempotent_write(batch.where("id is null and prediction_id is not null").select("prediction_id", "actual_aqi", "feedback_at"),
                              batch_id, late_path, False)
        finally:
            batch.unpersist()

    _drained(joined, name, "append", sink, ending, None)
    late = spark.read.schema(joined.select("prediction_id", "actual_aqi", "feedback_at").schema).parquet(late_path)
    more = _pane_sums(resolve_late(late, predictions), pane_s)
    on_time = spark.read.schema(more.schema).parquet(panes_path).drop("micro_batch")
    return on_time.unionByName(more).where("n > 0").groupBy("_p").agg(F.sum("sse").cast("double").alias("sse"), F.sum("n").alias("n"))


def sliding_from_panes(panes: DataFrame, window_s: int = 86400, pane_s: int = 600) -> DataFrame:
    """Sliding windows [s, s + window) every pane from pane sums: the same rows a sliding ``window()``
    would emit (windows that received data). A window is the trailing range that ends with its last pane, so these are
    the block-wise trailing sums of the alert grid, over panes; sums of squares accumulate as DECIMAL and stay exact."""
    from driftwise.operators.alerts import occupied_grid, trailing_sums

    at = panes.withColumnRenamed("_p", "_t")
    back = window_s - pane_s
    g = occupied_grid(at, window_s, pane_s, after_s=back).join(at, "_t", "left").na.fill(0, ["sse", "n"])
    win = trailing_sums(g, ["sse", "n"], window_s, pane_s, exact_decimal=["sse"]).where("n > 0")
    win = win.withColumn("_p", F.col("_t") - back)
    return win.select(
        ntz_from_seconds(F.col("_p")).alias("window_start"),
        ntz_from_seconds(F.col("_p") + window_s).alias("window_end"),
        F.col("n").cast("long").alias("n"),
        F.col("sse").cast("double").alias("sse"),
        F.sqrt(F.col("sse").cast("double") / F.col("n")).alias("rmse"),
    )


def stream_dedup_submissions(subs: DataFrame, watermark: str = "3 hours") -> DataFrame:
    """T-5: drop redelivered submissions (same prediction id and feedback time) with state bounded by the
    watermark; the overwrite rule (latest per id) is then resolved at read time, like J2 on the log."""
    return subs.withWatermark("fb_t", watermark).dropDuplicatesWithinWatermark(["prediction_id", "feedback_at"])


def stream_rates(requests: DataFrame, window: str = "1 minute", seconds: int = 60) -> DataFrame:
    """T-4: tumbling request rate by status."""
    w = F.window("t", window)
    return requests.withWatermark("t", "10 minutes").groupBy(w.alias("w"), "status").agg(
        F.count(F.lit(1)).alias("n")).select(
        ntz_from_instant(F.col("w.start")).alias("window_start"), "status",
        (F.col("n") / F.lit(float(seconds))).alias("rate_per_s"))


def sustained_from_windows(win: DataFrame, rule) -> DataFrame:
    """T-6: W10 over the closed windows; grid points without a window (no traffic) are not breaching."""
    from driftwise.operators.alerts import sustained

    v = F.when(F.col("n") > 0, F.col("n5") / F.col("n"))
    return sustained(win.select("_t", v.alias("value")), rule)


def stream_bin_counts(inputs_long: DataFrame, baseline_static: DataFrame, window: str = "1 day") -> DataFrame:
    """T-3: per day window, feature and baseline bin, the count of current values (the static baseline edges
    are one row per feature, broadcast)."""
    e = F.broadcast(baseline_static.select("feature", "bin_edges"))
    j = inputs_long.where(F.col("value").isNotNull()).join(e, "feature")
    return j.withWatermark("t", "1 hour").groupBy(
        F.window("t", window).alias("w"), "feature", bin_index(F.col("value"), F.col("bin_edges")).alias("bin")
    ).agg(F.count(F.lit(1)).alias("n")).select(
        ntz_from_instant(F.col("w.start")).alias("window_start"), "feature", "bin", "n")


def psi_from_counts(counts: DataFrame, baseline: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """PSI per (window, feature) from streamed bin counts (same rules as A6; 0.0 when nothing in range)."""
    from driftwise.functions.exprs import zero_to_eps

    keys = counts.select("window_start", "feature").distinct()
    ref = baseline.select("feature", F.posexplode("reference_distribution").alias("bin", "r"))
    inr = counts.where(F.col("bin").isNotNull())
    tot = inr.groupBy("window_start", "feature").agg(F.sum("n").alias("_tot"))
    grid = keys.join(ref, "feature").join(tot, ["window_start", "feature"])
    terms = grid.join(inr, ["window_start", "feature", "bin"], "left").where(F.col("_tot") > 0).select(
        "window_start", "feature",
        zero_to_eps(F.coalesce(F.col("n"), F.lit(0)) / F.col("_tot"), epsilon).alias("c"),
        zero_to_eps(F.col("r"), epsilon).alias("r"),
    ).groupBy("window_start", "feature").agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("_p"))
    sizes = counts.groupBy("window_start", "feature").agg(
        F.sum("n").alias("n_current"), F.sum(F.when(F.col("bin").isNull(), F.col("n")).otherwise(0)).alias("n_out_of_range"))
    return keys.join(terms, ["window_start", "feature"], "left").join(sizes, ["window_start", "feature"]).select(
        "window_start", "feature", F.coalesce("_p", F.lit(0.0)).alias("psi"), "n_current", "n_out_of_range")


def predictions_inputs_stream(events: DataFrame, features: Sequence[str]) -> DataFrame:
    """(t, feature, value) of prediction inputs, from the event stream (same JSON rule as the batch view)."""
    from driftwise.sources.views import _p1, _p2

    j = F.to_json(F.struct(F.col("user_id").cast("string").alias("city"),
                           F.date_format("ts", "yyyy-MM-dd").alias("date"),
                           _p1().alias("PM2.5"), _p2().alias("PM10")), {"ignoreNullFields": "false"})
    m = F.from_json(j, "map<string,string>")
    return events.select(event_time(F.col("ts")).alias("t"), F.explode(m).alias("feature", "_txt")).select(
        "t", "feature", parse_double(F.col("_txt")).alias("value")).where(F.col("feature").isin(list(features)))


# ---------------------------------------------------------------------------
# T-6 as a custom stateful operator
# ---------------------------------------------------------------------------
ALERT_EVENT_SCHEMA = "alert string, severity string, pending_since timestamp_ntz, firing_since timestamp_ntz"
ALERT_STATE_SCHEMA = "island_start long, last_t long, fired boolean"


def alert_state_machine(windows: DataFrame, rule) -> DataFrame:
    """Sustained-breach state per rule over a stream of closed windows (_t = window end in epoch seconds,
    n, n5). State per rule: start of the current breaching run, last window end seen, fired flag. A missing
    window (no traffic) or a non-breaching one ends the run; a run that reaches ``for`` emits one firing
    event. Input rows are one per window (bounded by time span / step), so the per-rule group is small."""
    import datetime as _dt

    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    # plain values only: the function is shipped to Python workers, which need not have this package
    step, for_s, thr, severity = int(rule.step_s), int(rule.for_s), float(rule.threshold), str(rule.severity)
    epoch = _dt.datetime(1970, 1, 1)

    def fn(key, pdfs, state):
        start, last, fired = state.get if state.exists else (None, None, False)
        frames = [p for p in pdfs if len(p)]
        out = []
        if frames:
            batch = pd.concat(frames).sort_values("_t")
            for t, n, n5 in zip(batch["_t"], batch["n"], batch["n5"]):
                t = int(t)
                breach = n > 0 and (n5 / n) > thr
                if breach:
                    if start is None or last is None or t != last + step:
                        start, fired = t, False
                    if not fired and t - start >= for_s:
                        out.append((key[0], severity, epoch + _dt.timedelta(seconds=start),
                                    epoch + _dt.timedelta(seconds=start + for_s)))
                        fired = True
                else:
                    start, fired = None, False
                last = t
        state.update((start, last, fired))
        if out:
            yield pd.DataFrame(out, columns=["alert", "severity", "pending_since", "firing_since"])

    keyed = windows.withColumn("alert", F.lit(str(rule.name)))
    return keyed.groupBy("alert").applyInPandasWithState(
        fn, ALERT_EVENT_SCHEMA, ALERT_STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def stream_request_panes(requests: DataFrame, step_s: int = 30, watermark: str = "10 minutes") -> DataFrame:
    """Tumbling panes of request and 5xx counts (one state update per request, no window expansion)."""
    w = F.window("t", f"{step_s} seconds")
    return requests.withWatermark("t", watermark).groupBy(w.alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("status").like("5__").cast("long")).alias("n5")).select(
        F.col("w.start").alias("p"), "n", "n5")


def windows_from_panes(panes: DataFrame, range_s: int = 300, step_s: int = 30) -> DataFrame:
    """Sliding windows over the pane stream (panes arrive in order, so no lateness is allowed): the 10x
    window expansion applies to one row per pane, not to every request."""
    w = F.window("p", f"{range_s} seconds", f"{step_s} seconds")
    return panes.withWatermark("p", "0 seconds").groupBy(w.alias("w")).agg(
        F.sum("n").alias("n"), F.sum("n5").alias("n5")).select(F.unix_seconds(F.col("w.end")).alias("_t"), "n", "n5")


def closed_windows(spark: SparkSession, requests: DataFrame, range_s: int = 300, step_s: int = 30) -> str:
    """Path of all sliding windows of a request stream, by way of its panes; both stages run to the end of the input."""
    far = {"t": f"timestamp'{Ending.FAR}'"}
    ending = Ending(spark)
    panes_path = run_to_path(stream_request_panes(ending.mark(requests, **far), step_s), "request-panes", "append", ending=ending)
    ending = Ending(spark)
    panes = spark.readStream.schema(spark.read.parquet(panes_path).schema).parquet(panes_path).drop("micro_batch")
    panes = ending.mark(panes, p=far["t"])
    return run_to_path(windows_from_panes(panes, range_s, step_s), "closed-windows", "append", ending=ending)


def stream_alerts(spark: SparkSession, requests: DataFrame, rule) -> DataFrame:
    """T-6: stage 1 appends closed 30 s panes of the request stream (no per-request window expansion);
    stage 2 turns the pane stream into closed 5 min sliding windows; stage 3 streams those through the
    per-rule state machine. A stateful operator cannot follow an aggregation in append mode, so the stages
    are chained through storage, each one distributed and with bounded state."""
    win_path = closed_windows(spark, requests, rule.range_s, rule.step_s)
    closed = spark.readStream.schema(spark.read.parquet(win_path).schema).parquet(win_path).drop("micro_batch")
    return run(alert_state_machine(closed, rule), "alert-events", "append")

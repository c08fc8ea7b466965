"""Prediction log + ground truth: attach (J2), unknown ids (J3), feedback as raw rows (P16), the feedback
view (P17), newest feedback (K2), and the base/feedback merge (J5, U1, U2, W6).

The log is append-only; an overwrite is a later feedback row, resolved at read time (latest wins).
"Latest per id" and "latest per (city, date)" are grouped ``max_by`` aggregates, not windows: they combine
map-side, so an id or a (city, date) holding a third of all rows still never lands whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.functions.exprs import col as qcol
from driftwise.functions.exprs import iso_ts, json_field


def latest_feedback(gt: DataFrame) -> DataFrame:
    """Effective ground truth per prediction id: the row with the latest feedback_at (ties: larger actual)."""
    best = F.max_by(F.struct("actual_aqi", "feedback_at"), F.struct("feedback_at", "actual_aqi"))
    return gt.groupBy("prediction_id").agg(best.alias("_b"), F.count(F.lit(1)).alias("n_submissions")).select(
        "prediction_id", F.col("_b.actual_aqi").alias("actual_aqi"), F.col("_b.feedback_at").alias("feedback_at"),
        "n_submissions",
    )


def attach_ground_truth(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Every prediction with its effective actual value and feedback time (null when none)."""
    fb = latest_feedback(gt).select(F.col("prediction_id").alias("id"), "actual_aqi", "feedback_at")
    return pred.join(fb, "id", "left")


def unknown_feedback(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """Feedback whose prediction id does not exist (the reference answered 404); one row per id with
    its latest submission and the number of submissions. Pre-aggregated before the anti join."""
    fb = latest_feedback(gt)
    return fb.join(pred.select(F.col("id").alias("prediction_id")), "prediction_id", "left_anti")


def feedback_view(attached: DataFrame) -> DataFrame:
    """P17 + F11: rows with ground truth; error = actual - predicted."""
    err = F.col("actual_aqi") - F.col("predicted_aqi")
    return attached.where(F.col("actual_aqi").isNotNull()).select(
        F.col("id").cast("string").alias("prediction_id"),
        iso_ts(F.col("created_at")).alias("created_at"),
        iso_ts(F.col("feedback_at")).alias("feedback_at"),
        "model_version", "model_family",
        json_field(F.col("input_features"), "city").alias("city"),
        json_field(F.col("input_features"), "date").alias("date"),
        "predicted_aqi", "actual_aqi",
        err.alias("error"), F.abs(err).alias("abs_error"),
        "latency_ms",
        F.col("feedback_at").alias("_fb_ts"), F.col("id").alias("_id"),
    )


def recent_feedback(attached: DataFrame, limit: int | None = 500) -> DataFrame:
    """K2: newest feedback first, tie broken by id. A limit makes it a top-k, ranked on (feedback_at, id) before
    any JSON or text is made; ``limit=None`` returns every answered prediction."""
    ranked = attached.where(F.col("actual_aqi").isNotNull()).orderBy(F.col("feedback_at").desc(), F.col("id").desc())
    return feedback_view(ranked if limit is None else ranked.limit(limit)).drop("_fb_ts", "_id")


def feedback_as_raw_rows(attached: DataFrame, pollutants: Sequence[str], target: str = "AQI") -> DataFrame:
    """Predictions with ground truth re-expressed in the raw table's columns; city/date are the
    lower-case JSON keys; rows lacking either are dropped."""
    j = F.col("input_features")
    cols = [json_field(j, "city").alias("City"), json_field(j, "date").alias("Date")]
    cols += [json_field(j, p).try_cast("double").alias(p) for p in pollutants]
    return (
        attached.where(F.col("actual_aqi").isNotNull())
        .select(*cols, F.col("actual_aqi").alias(target), F.col("feedback_at"))
        .where(F.col("City").isNotNull() & F.col("Date").isNotNull())
    )


def merge_latest(base: DataFrame, feedback: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """J5 + U1 + W6: align by name (missing columns -> null), then keep one row per key: feedback beats
    base, then the latest by ``order_cols``. Done as a grouped max_by so a hot key combines map-side."""
    b = base.withColumn("_src", F.lit(0))
    f = feedback.withColumn("_src", F.lit(1))
    u = b.unionByName(f, allowMissingColumns=True)
    payload = [c for c in u.columns if c not in keys]
    rank = F.struct(F.col("_src"), *[qcol(c) for c in order_cols])
    best = F.max_by(F.struct(*[qcol(c).alias(c) for c in payload]), rank)
    return u.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in payload])


def rebuild_rows(base: DataFrame, feedback: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """C2 input: duplicates collapse only when there is feedback at all (otherwise base rows pass as is)."""
    if feedback.isEmpty():
        return base
    return merge_latest(base, feedback, keys, order_cols).drop("_src")


def duplicate_collapse(base: DataFrame, feedback: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """Rows before and after the merge and how many collapsed."""
    merged = rebuild_rows(base, feedback, keys, order_cols)
    before = base.unionByName(feedback, allowMissingColumns=True).agg(F.count(F.lit(1))).scalar()
    after = merged.agg(F.count(F.lit(1))).scalar()
    return base.sparkSession.range(1).select(
        before.alias("rows_before"), after.alias("rows_after"), (before - after).alias("rows_collapsed")
    )

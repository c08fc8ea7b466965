"""Monitoring aggregates over the prediction log and request log (A9-A17) and the retrain gates.

``as_of`` is always an argument (a literal or a scalar-subquery Column), never the wall clock.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.functions.exprs import col as qcol
from driftwise.functions.exprs import progress_ratio
from driftwise.operators.drift import trailing
from driftwise.operators.feedback import attach_ground_truth
from driftwise.params import DriftParams


# ---------------------------------------------------------------------------
# Error and counts over feedback
# ---------------------------------------------------------------------------
def rolling_error(attached: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """A9 + A10 in one aggregate: RMSE (null when no rows) and the feedback count over rows with ground
    truth whose feedback_at > as_of - hours."""
    fb = trailing(attached.where(F.col("actual_aqi").isNotNull()), "feedback_at", as_of, hours)
    return fb.agg(
        F.sqrt(F.avg(F.pow(F.col("predicted_aqi") - F.col("actual_aqi"), 2))).alias("rolling_rmse"),
        F.count(F.lit(1)).alias("feedback_count"),
    )


def recent_attached(pred: DataFrame, gt: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Predictions with feedback in the trailing window and their effective ground truth. The window is cut
    before the latest-wins aggregate: its upper end is open, so an id with any submission inside has its
    latest one inside too, and only those ids are aggregated and joined."""
    recent = trailing(gt, "feedback_at", as_of, hours)
    answered = pred.join(recent.select(F.col("prediction_id").alias("id")).distinct(), "id", "left_semi")
    return attach_ground_truth(answered, recent)


def regression_metrics(df: DataFrame, label: str, prediction: str, split: str | None = "split") -> DataFrame:
    """RMSE, MAE, R^2 = 1 - SSE/SST per split, one aggregate (SST as population variance times n, which does not cancel)."""
    e = qcol(prediction) - qcol(label)
    y = qcol(label)
    g = df.groupBy(split) if split else df.groupBy()
    out = g.agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sum(e * e).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
    )
    return out.withColumn(
        "r2", F.when(F.col("_sst") > 0, 1 - F.col("_sse") / F.col("_sst"))
    ).drop("_sse", "_sst")


# ---------------------------------------------------------------------------
# Log aggregates
# ---------------------------------------------------------------------------
def count_by(df: DataFrame, labels: Sequence[str], name: str = "n") -> DataFrame:
    """A counter by label set (map-side combined)."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias(name))


def bucket_le_label(le: float | None) -> str:
    return "+Inf" if le is None else repr(float(le))


def cumulative_histogram(df: DataFrame, value_col: str, buckets: Sequence[float],
                         group_cols: Sequence[str] = ()) -> DataFrame:
    """Prometheus-style cumulative buckets: (group..., le_index, le, le_label, cum_count); the last
    bucket is +Inf (le null). Buckets are cumulative ``v <= le``. One aggregate, then unpivot."""
    v = F.col(value_col)
    aggs = [F.sum(F.when(v <= F.lit(float(b)), 1).otherwise(0)).alias(f"_b{i}") for i, b in enumerate(buckets)]
    aggs.append(F.count(v).alias(f"_b{len(buckets)}"))
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    one = g.agg(*aggs)
    entries = F.array(*[
        F.struct(
            F.lit(i).alias("le_index"),
            (F.lit(float(b)) if b is not None else F.lit(None).cast("double")).alias("le"),
            F.lit(bucket_le_label(b)).alias("le_label"),
            F.coalesce(F.col(f"_b{i}"), F.lit(0)).cast("long").alias("cum_count"),
        )
        for i, b in enumerate(list(buckets) + [None])
    ])
    return one.select(*group_cols, F.inline(entries))


def histogram_quantile(hist: DataFrame, q: float, group_cols: Sequence[str] = ()) -> DataFrame:
    """A14 for one quantile."""
    return histogram_quantiles(hist, F.array(F.lit(float(q))), group_cols)


def histogram_quantiles(hist: DataFrame, qs: Column, group_cols: Sequence[str] = ()) -> DataFrame:
    """A14, a row per group and element of ``qs`` (an array that may depend on the group); the histogram is read once. Over a cumulative histogram (le_index, le, cum_count; +Inf last with le null): rank = q * total;
    first finite bucket with cum >= rank; interpolate linearly inside it from the previous bound (0 for
    the lowest bucket, or its own bound if that is <= 0); in the +Inf bucket answer the highest finite
    bound; no observations -> null."""
    w = Window.partitionBy(*group_cols).orderBy("le_index") if group_cols else Window.orderBy("le_index")
    h = hist.select(
        *group_cols, "le_index", "le", "cum_count",
        F.lag("le").over(w).alias("_prev_le"),
        F.coalesce(F.lag("cum_count").over(w), F.lit(0)).alias("_prev_cum"),
    )
    g = h.groupBy(*group_cols) if group_cols else h.groupBy()
    tot = F.max(F.when(F.col("le").isNull(), F.col("cum_count")))
    a = g.agg(
        tot.alias("_total"),
        F.max("le_index").alias("_inf_idx"),
        F.max(F.when(F.col("le").isNotNull(), F.col("le"))).alias("_max_finite"),
        F.collect_list(F.struct("le_index", "le", "cum_count", "_prev_le", "_prev_cum")).alias("_bk"),
    )
    a = a.withColumn("q", F.explode(qs))
    rank = F.col("q") * F.col("_total")
    finite_hits = F.filter(F.array_sort("_bk"), lambda b: b["le"].isNotNull() & (b["cum_count"] >= rank))
    b = F.element_at(finite_hits, 1)
    start = F.when(b["le_index"] == 0, F.lit(0.0)).otherwise(b["_prev_le"])
    cnt = b["cum_count"] - b["_prev_cum"]
    interp = start + (b["le"] - start) * F.try_divide(rank - b["_prev_cum"], cnt)
    val = (
        F.when(F.col("_total").isNull() | (F.col("_total") == 0), F.lit(None).cast("double"))
        .when(F.size(finite_hits) == 0, F.col("_max_finite"))
        .when((b["le_index"] == 0) & (b["le"] <= 0), b["le"])
        .otherwise(interp)
    )
    return a.select(*group_cols, "q", val.alias("value"))


def latency_summary(df: DataFrame, ms_col: str = "latency_ms", id_col: str = "id") -> DataFrame:
    """p50 (interpolated median), p95 as the element at 0-based index int(0.95 n) - 1 of the sorted
    values (a negative index counts from the end, as in Python), mean, n and sequential throughput
    n / (sum(ms) / 1000). The nearest-rank element is found with the scalable global ordinal."""
    from driftwise.operators.ordering import global_ordinal

    v = F.col(ms_col)
    d = df.where(v.isNotNull()).select(ms_col, id_col)
    ranked, n_hint = global_ordinal(d, ms_col, id_col, "_o", with_count=True)   # its bucket pass counts rows
    n = F.lit(n_hint).cast("long")
    idx = F.floor(F.lit(0.95) * n).cast("long") - 1
    pos = F.when(idx < 0, n + idx).otherwise(idx)   # python negative index
    p95 = ranked.where(F.col("_o") - 1 == pos).agg(F.max(ms_col)).scalar()
    from driftwise.operators.quantiles import grouped_quantiles

    p50 = grouped_quantiles(d.select(F.lit(0).alias("_g"), ms_col), "_g", ms_col, [0.5], n_upper=n_hint).get(0, [None])[0]
    return d.agg(
        F.lit(p50).cast("double").alias("p50"),
        F.avg(v).alias("mean"),
        F.count(F.lit(1)).alias("n"),
        F.try_divide(F.count(F.lit(1)), F.sum(v) / 1000.0).alias("throughput_rps"),
    ).withColumn("p95", p95)


def rate_per_window(df: DataFrame, ts_col: str, window: str = "1 minute", seconds: int = 60,
                    labels: Sequence[str] = ()) -> DataFrame:
    """Events per second in tumbling windows, optionally by label."""
    w = F.window(F.col(ts_col), window)     # timestamp_ntz windows align on the wall clock
    return df.groupBy(w.alias("w"), *labels).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), *labels,
        (F.col("n") / F.lit(float(seconds))).alias("rate_per_s"),
    )


def error_ratio(df: DataFrame, ts_col: str, status_col: str = "status", window: str = "5 minutes",
                threshold: float = 0.05) -> DataFrame:
    """Share of 5xx responses per tumbling window, with the alert flag (> threshold)."""
    w = F.window(F.col(ts_col), window)
    return df.groupBy(w.alias("w")).agg(
        F.sum(F.col(status_col).like("5__").cast("long")).alias("n_5xx"),
        F.count(F.lit(1)).alias("n"),
    ).select(
        F.col("w.start").alias("window_start"), "n_5xx", "n",
        (F.col("n_5xx") / F.col("n")).alias("error_ratio"),
        (F.col("n_5xx") / F.col("n") > threshold).alias("breach"),
    )


# ---------------------------------------------------------------------------
# Gates (C10 - C13)
# ---------------------------------------------------------------------------
def decay_decision(rolling: DataFrame, max_psi_df: DataFrame, params: DriftParams) -> DataFrame:
    """One row, 12 fields. Null RMSE never meets the RMSE gate. The inputs are 1-row aggregates,
    read once each."""
    r = rolling.first()
    cnt = F.lit(r["feedback_count"]).cast("long")
    rmse = F.lit(r["rolling_rmse"]).cast("double")
    mpsi = F.lit(max_psi_df.first()["max_psi"]).cast("double")
    count_gate = cnt >= F.lit(params.feedback_count_threshold)
    rmse_gate = F.coalesce(rmse > F.lit(params.rmse_threshold), F.lit(False))
    psi_breach = mpsi > F.lit(params.psi_threshold)
    return rolling.sparkSession.range(1).select(
        cnt.alias("feedback_count"),
        F.lit(params.feedback_count_threshold).alias("feedback_count_threshold"),
        rmse.alias("rolling_rmse"),
        F.lit(params.rmse_threshold).alias("rmse_threshold"),
        mpsi.alias("max_psi"),
        F.lit(params.psi_threshold).alias("psi_threshold"),
        F.lit(params.window_hours).alias("window_hours"),
        count_gate.alias("count_gate_met"),
        rmse_gate.alias("rmse_gate_met"),
        (count_gate & rmse_gate).alias("feedback_breach"),
        psi_breach.alias("psi_breach"),
        ((count_gate & rmse_gate) | psi_breach).alias("should_retrain"),
    )


def retrain_status(rolling: DataFrame, params: DriftParams) -> DataFrame:
    """C11 (+F10 progress): the feedback gates without PSI."""
    r = rolling.first()
    cnt = F.lit(r["feedback_count"]).cast("long")
    rmse = F.lit(r["rolling_rmse"]).cast("double")
    return rolling.sparkSession.range(1).select(
        rmse.alias("rolling_rmse_24h"),
        cnt.alias("feedback_count_window"),
        F.lit(params.window_hours).alias("window_hours"),
        F.lit(params.feedback_count_threshold).alias("feedback_count_threshold"),
        F.lit(params.rmse_threshold).alias("rmse_threshold"),
        F.lit(params.psi_threshold).alias("psi_threshold"),
        (cnt >= F.lit(params.feedback_count_threshold)).alias("count_gate_met"),
        F.coalesce(rmse > F.lit(params.rmse_threshold), F.lit(False)).alias("rmse_gate_met"),
        progress_ratio(cnt, F.lit(params.feedback_count_threshold)).alias("feedback_progress"),
    )


def cooldown_active(runs: DataFrame, as_of, hours: int = 1, start_col: str = "start_time") -> Column:
    """A training run started within the last ``hours`` before as_of (scalar Column)."""
    last = runs.agg(F.max(start_col)).scalar()
    from driftwise.functions.exprs import as_ntz

    lo = as_ntz(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return F.coalesce(last > lo, F.lit(False))


def retrain_branch(decision: DataFrame, cooldown: Column) -> DataFrame:
    """The branch label."""
    return decision.select(
        cooldown.alias("cooldown_active"),
        "should_retrain",
        F.when(cooldown, F.lit("no_retrain_needed"))
        .when(F.col("should_retrain"), F.lit("trigger_retrain"))
        .otherwise(F.lit("no_retrain_needed")).alias("branch"),
    )

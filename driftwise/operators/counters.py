"""A16 over scraped counters: ``rate()`` of cumulative samples with counter resets and extrapolation to the window's ends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.functions.exprs import epoch_micros, ntz_from_seconds


def counter_rate(samples: DataFrame, ts: str, value: str, labels: Sequence[str], range_s: int, step_s: int) -> DataFrame:
    """(labels, window_end, n_samples, increase, rate_per_s) at every multiple of ``step_s`` with two or more samples in
    (window_end - range_s, window_end].

    A value below the one before it is a reset: the counter began again at 0, so the value before it is added. The increase
    is stretched from the sampled interval to the window: up to each end if the nearest sample is within 1.1 mean sample
    distances of it, else by half a distance, and at the start never beyond where the counter would have been 0. Series with
    one sample have no rate. Samples with a null value or time take no part; a sample delivered twice counts once, and of
    different values at one time the least counts first.

    A sample goes to the ``range_s / step_s`` windows that hold it; a group holds one window of one series, which the scrape
    interval bounds, so no series is ordered as a whole."""
    if range_s % step_s:
        raise ValueError("range must be a multiple of step")
    t = epoch_micros(F.col(ts)) / F.lit(1_000_000.0)
    end = (F.ceil(t / step_s) * step_s).cast("long")
    at = samples.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).select(
        *labels, t.alias("_s"), F.col(value).cast("double").alias("_v"),
        F.explode(F.sequence(end, end + (range_s - step_s), F.lit(step_s).cast("long"))).alias("_end"))
    w = at.groupBy(*labels, "_end").agg(F.array_sort(F.collect_set(F.struct("_s", "_v"))).alias("_p"))
    w = w.where(F.size("_p") >= 2)
    first, last = F.element_at("_p", 1), F.element_at("_p", -1)
    resets = F.aggregate(
        F.zip_with(F.slice("_p", 1, F.size("_p") - 1), F.slice("_p", 2, F.size("_p") - 1),
                   lambda a, b: F.when(b["_v"] < a["_v"], a["_v"]).otherwise(F.lit(0.0))),
        F.lit(0.0), lambda acc, x: acc + x)
    w = w.select(*labels, "_end", F.size("_p").cast("long").alias("n_samples"), first["_s"].alias("_first"),
                 first["_v"].alias("_start_value"), last["_s"].alias("_last"),
                 (last["_v"] - first["_v"] + resets).alias("_delta"))
    sampled = F.col("_last") - F.col("_first")
    mean = sampled / (F.col("n_samples") - 1)
    to_start, to_end = F.col("_first") - (F.col("_end") - range_s), F.col("_end") - F.col("_last")
    to_start = F.when(to_start >= mean * 1.1, mean / 2).otherwise(to_start)
    to_end = F.when(to_end >= mean * 1.1, mean / 2).otherwise(to_end)
    to_zero = F.when((F.col("_delta") > 0) & (F.col("_start_value") >= 0), sampled * (F.col("_start_value") / F.col("_delta")))
    w = w.where(sampled > 0)
    increase = F.col("_delta") * (sampled + F.least(to_start, to_zero) + to_end) / sampled
    out = w.select(*labels, ntz_from_seconds(F.col("_end")).alias("window_end"), "n_samples", increase.alias("increase"))
    return out.withColumn("rate_per_s", F.col("increase") / F.lit(float(range_s)))

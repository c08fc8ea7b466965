"""Baseline statistics (A3), quantile bin edges (A4, F9, F13) and histograms on given edges (A5).

Plan shape: the values are kept in a column per feature while the passes run, which read them as (feature, value) - one
grouped aggregate for the moments and all quantiles, one grouped count per (feature, bin). The edges table has one row
per feature (a bounded broadcast); everything per-row is a native expression.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.functions.exprs import col as qcol
from driftwise.functions.exprs import quantile_grid
from driftwise.operators.features import present
from driftwise.operators.quantiles import at_most, grouped_quantiles


BASELINE_DDL = ("feature string, mean double, std double, min double, max double, median double, q25 double, "
                "q75 double, n_observations long, bin_edges array<double>, reference_distribution array<double>")


def unpivot(df: DataFrame, cols: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide -> long (feature, value); the value is cast to double."""
    return df.select(*[qcol(c).cast("double").alias(c) for c in cols]).unpivot([], [qcol(c) for c in cols], name, value)


def bin_index(v: Column, edges: Column) -> Column:
    """Bin of ``v`` on sorted ``edges``: [e_i, e_i+1), the last bin closed; null when out of range or when
    there are fewer than two edges."""
    nb = F.size(edges) - 1
    idx = F.size(F.filter(edges, lambda e: e <= v)) - 1
    return (
        F.when(v.isNull() | (nb <= 0), F.lit(None))
        .when(v == F.element_at(edges, -1), nb - 1)
        .when((idx >= 0) & (idx < nb), idx)
        .cast("int")
    )


def bin_counts(long: DataFrame, edges: DataFrame) -> DataFrame:
    """(feature, bin, n) for every bin of every feature in ``edges`` (empty bins present with n = 0), and
    out-of-range values counted under bin = null. ``edges`` is (feature, bin_edges) with one row per feature."""
    e = edges.select("feature", "bin_edges")
    j = long.where(F.col("value").isNotNull()).join(F.broadcast(e), "feature")
    counted = j.groupBy("feature", bin_index(F.col("value"), F.col("bin_edges")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    all_bins = e.select(
        "feature",
        F.explode(
            F.when(F.size("bin_edges") >= 2, F.sequence(F.lit(0), F.size("bin_edges") - 2)).otherwise(
                F.array().cast("array<int>"))
        ).alias("bin"),
    )
    in_range = all_bins.join(counted.where(F.col("bin").isNotNull()), ["feature", "bin"], "left").select(
        "feature", "bin", F.coalesce(F.col("n"), F.lit(0)).alias("n")
    )
    return in_range.unionByName(counted.where(F.col("bin").isNull()))


def baseline_stats(df: DataFrame, cols: Sequence[str], n_bins: int = 10) -> DataFrame:
    """A3: per feature mean, sample std, min, max, median, q25, q75, n_observations, quantile bin edges
    (duplicates removed, so possibly fewer than n_bins bins) and the reference distribution on them.
    Unknown columns and all-null columns are skipped.

    Jobs: one grouped aggregate for the moments, the quantile passes, one grouped count per (feature, bin).
    Their results are bounded by features x bins, so the baseline is assembled on the driver as a small
    local table (like a fitted model): drift jobs read it many times without touching the raw data."""
    cols = present(df, cols)
    if not cols:
        return df.sparkSession.createDataFrame([], BASELINE_DDL)
    # every pass below reads the values: kept (spill-able, a column per feature) for the time of the fit, so the table behind
    # them is read once
    wide = df.select(*[qcol(c).cast("double").alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _fitted(unpivot(wide, cols).where(F.col("value").isNotNull()), n_bins)
    finally:
        wide.unpersist()


def _fitted(long: DataFrame, n_bins: int) -> DataFrame:
    grid = quantile_grid(n_bins)
    qs = grid + [0.25, 0.5, 0.75]
    m = len(grid)
    # moments: one grouped aggregate, one row per feature (read once on the driver: bounded by #features)
    mom = long.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count(F.lit(1)).alias("n_observations"),
    ).collect()
    spark = long.sparkSession
    if not mom:
        return spark.createDataFrame([], BASELINE_DDL)
    qv = grouped_quantiles(long, "feature", "value", qs,
                           stats={r["feature"]: (r["n_observations"], r["min"], r["max"]) for r in mom})
    # quantile bin edges: sorted distinct grid quantiles (so possibly fewer than n_bins bins)
    edges = {f: sorted(set(float(x) for x in v[:m])) for f, v in qv.items()}
    # reference distribution: one count per (feature, bin); all values lie within their feature's edges, the last bin is closed
    binx = F.lit(None).cast("int")
    for f, e in edges.items():
        binx = F.when(F.col("feature") == F.lit(f), F.least(at_most(e, F.col("value")), F.lit(len(e) - 1)) - 1).otherwise(binx)
    counts = {f: [0] * max(len(e) - 1, 0) for f, e in edges.items()}
    for r in long.groupBy("feature", binx.alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect():
        if 0 <= r["bin"] < len(counts[r["feature"]]):
            counts[r["feature"]][r["bin"]] = r["n"]
    final = []
    for r in mom:
        f = r["feature"]
        q = qv[f]
        c = counts[f]
        total = sum(c)
        dist = [x / total for x in c] if total else []
        final.append((f, r["mean"], r["std"], r["min"], r["max"], float(q[m + 1]), float(q[m]), float(q[m + 2]),
                      r["n_observations"], edges[f], dist))
    # The baseline is a small fitted artifact (features x bins): a local table, never recomputed.
    return spark.createDataFrame(final, BASELINE_DDL)


def baseline_histogram(baseline: DataFrame) -> DataFrame:
    """A5 in long form: (feature, bin, low, high, ref_share) from a baseline table."""
    return baseline.select(
        "feature", "bin_edges", F.posexplode("reference_distribution").alias("bin", "ref_share")
    ).select(
        "feature", "bin",
        F.element_at("bin_edges", F.col("bin") + 1).alias("low"),
        F.element_at("bin_edges", F.col("bin") + 2).alias("high"),
        "ref_share",
    )

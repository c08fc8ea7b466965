"""Drift: PSI per feature (A6, A7), max PSI (A8), severity (F5), ranking (K3), metric rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwise.functions.exprs import parse_double, psi_severity, zero_to_eps
from driftwise.operators.baseline import bin_index
from driftwise.params import POLLUTANTS


def trailing(df: DataFrame, ts_col: str, as_of, hours: int) -> DataFrame:
    """Rows with ts > as_of - hours (strict, no upper bound). ``as_of`` is a literal or a Column."""
    from driftwise.functions.exprs import as_ntz

    return df.where(F.col(ts_col) > as_ntz(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours)))


def json_inputs_long(df: DataFrame, json_col: str = "input_features") -> DataFrame:
    """F3 + F2: (feature, value) for every key of every JSON object; values coerced to double."""
    m = F.from_json(F.col(json_col), "map<string,string>")
    return df.select(F.explode(m).alias("feature", "_txt")).select("feature", parse_double(F.col("_txt")).alias("value"))


def psi(current_long: DataFrame, baseline: DataFrame, epsilon: float = 1e-4) -> DataFrame:
    """A6 per feature: sum((c - r) * ln(c / r)) over the baseline bins, zero shares replaced by epsilon
    (no renormalising). A feature present in both inputs is reported (J4: inner join on feature); 0.0 when
    it has no usable current values or none inside the baseline range. Extra columns n_current,
    n_out_of_range.

    Plan: the (small) baseline is broadcast, every current value gets its bin index, and one grouped
    aggregate counts all bins as columns (map-side combined) - one shuffle of a features-sized table.
    The PSI itself is a projection with higher-order array functions."""
    nb = baseline.agg(F.max(F.size("reference_distribution"))).first()[0] or 0
    b = F.broadcast(baseline.select("feature", "bin_edges", "reference_distribution"))
    j = current_long.join(b, "feature")
    v = F.col("value")
    binx = bin_index(v, F.col("bin_edges"))
    agg = j.groupBy("feature").agg(
        F.any_value("reference_distribution").alias("_ref"),
        F.count(v).alias("n_current"),
        F.sum(F.when(v.isNotNull() & binx.isNull(), 1).otherwise(0)).cast("long").alias("n_out_of_range"),
        *[F.sum(F.when(binx == i, 1).otherwise(0)).alias(f"_c{i}") for i in range(nb)],
    )
    counts = F.slice(F.array(*[F.col(f"_c{i}") for i in range(nb)]) if nb else F.array().cast("array<long>"),
                     1, F.size("_ref"))
    tot = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def term(c, r):
        cs = zero_to_eps(c / tot, epsilon)
        rs = zero_to_eps(r, epsilon)
        return (cs - rs) * F.ln(cs / rs)

    total_psi = F.aggregate(F.zip_with(counts, F.col("_ref"), term), F.lit(0.0), lambda a, x: a + x)
    return agg.select(
        "feature",
        F.when(tot > 0, total_psi).otherwise(F.lit(0.0)).alias("psi"),
        F.col("n_current").cast("long").alias("n_current"),
        "n_out_of_range",
    ).withColumn("severity", psi_severity(F.col("psi")))


def drift_report(pred_log: DataFrame, baseline: DataFrame, as_of, hours: int = 24, epsilon: float = 1e-4,
                 features: Sequence[str] | None = POLLUTANTS) -> DataFrame:
    """PSI of recent prediction inputs (created_at > as_of - hours) against the baseline, for the
    pollutant features (the target and other payload keys are not drift features); only the JSON payload
    column is read."""
    recent = trailing(pred_log.select("created_at", "input_features"), "created_at", as_of, hours)
    long = json_inputs_long(recent)
    if features is not None:
        long = long.where(F.col("feature").isin(list(features)))
    return psi(long, baseline, epsilon)


def max_psi(report: DataFrame) -> DataFrame:
    """One row; 0.0 for an empty report."""
    return report.agg(F.coalesce(F.max("psi"), F.lit(0.0)).alias("max_psi"))


def rank_psi(report: DataFrame) -> DataFrame:
    """K3: rank 1 = largest PSI, ties by feature name. The report has one row per feature (small)."""
    w = Window.orderBy(F.col("psi").desc(), F.col("feature").asc())
    return report.withColumn("psi_rank", F.row_number().over(w))

"""PSI cases from the reference plus the out-of-range edge."""

import numpy as np
import pytest

from driftwise.operators import baseline, drift


def _baseline(spark, edges, ref):
    return spark.createDataFrame([("x", [float(e) for e in edges], [float(r) for r in ref])],
                                 "feature string, bin_edges array<double>, reference_distribution array<double>")


def _current(spark, values):
    return spark.createDataFrame([("x", float(v)) for v in values], "feature string, value double")


def _psi(spark, values, edges, ref):
    rows = drift.psi(_current(spark, values), _baseline(spark, edges, ref)).collect()
    return rows[0]["psi"] if rows else 0.0


def test_identical_distribution_is_near_zero(spark):
    rng = np.random.default_rng(42)
    ref_vals = rng.normal(50, 10, 1000)
    edges = np.linspace(ref_vals.min(), ref_vals.max(), 11)
    counts, _ = np.histogram(ref_vals, bins=edges)
    assert _psi(spark, ref_vals, edges, counts / counts.sum()) < 0.05


def test_shifted_distribution_is_large(spark):
    rng = np.random.default_rng(42)
    ref_vals = rng.normal(50, 10, 1000)
    cur = rng.normal(100, 10, 1000)
    edges = np.linspace(min(ref_vals.min(), cur.min()) - 5, max(ref_vals.max(), cur.max()) + 5, 11)
    counts, _ = np.histogram(ref_vals, bins=edges)
    assert _psi(spark, cur, edges, counts / counts.sum()) > 0.5


def test_empty_current_is_zero(spark):
    assert _psi(spark, [], [0, 1, 2, 3], [0.3, 0.3, 0.4]) == 0.0


def test_zero_bins_are_finite(spark):
    v = _psi(spark, [25, 26, 27, 28, 29], [0, 10, 20, 30], [0.5, 0.5, 0.0])
    assert np.isfinite(v) and v > 0


def test_all_out_of_range_is_zero_and_counted(spark):
    rows = drift.psi(_current(spark, [100, 200]), _baseline(spark, [0, 10, 20], [0.5, 0.5])).collect()
    assert rows[0]["psi"] == 0.0 and rows[0]["n_out_of_range"] == 2


def test_matches_numpy_formula(spark):
    rng = np.random.default_rng(7)
    ref_vals, cur = rng.normal(0, 1, 500), rng.normal(0.3, 1.2, 400)
    edges = np.unique(np.quantile(ref_vals, np.linspace(0, 1, 11)))
    rc, _ = np.histogram(ref_vals, bins=edges)
    ref = rc / rc.sum()
    cc, _ = np.histogram(cur, bins=edges)
    c = cc / cc.sum()
    r = np.where(ref == 0, 1e-4, ref)
    c = np.where(c == 0, 1e-4, c)
    expected = float(np.sum((c - r) * np.log(c / r)))
    assert _psi(spark, cur, edges, ref) == pytest.approx(expected, rel=1e-9)


def test_severity_bands(spark):
    from pyspark.sql import functions as F

    from driftwise.functions.exprs import psi_severity

    df = spark.createDataFrame([(0.05,), (0.10,), (0.25,), (0.26,)], "psi double")
    got = [r[0] for r in df.select(psi_severity(F.col("psi"))).collect()]
    assert got == ["none", "moderate", "moderate", "significant"]


def test_bin_counts_zero_bins_and_out_of_range(spark):
    from driftwise.operators.baseline import bin_counts

    edges = spark.createDataFrame([("x", [0.0, 1.0, 2.0, 3.0])], "feature string, bin_edges array<double>")
    got = {r["bin"]: r["n"] for r in bin_counts(_current(spark, [0.0, 0.5, 3.0, 3.0, 7.0, -1.0]), edges).collect()}
    assert got == {0: 2, 1: 0, 2: 2, None: 2}   # last bin closed at 3.0; 7.0 and -1.0 out of range


def test_baseline_reads_its_input_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        seen.add(1)
        return v

    df = spark.range(400).select(counted((F.col("id") % 97).cast("double")).alias("a"))
    row = baseline.baseline_stats(df, ["a"]).first()
    assert (row["n_observations"], row["min"], row["max"], row["median"]) == (400, 0.0, 96.0, 46.5)
    assert seen.value == 400


def test_baseline_bins_are_counted_once_per_value(spark, monkeypatch):
    """The reference distribution is a count per compiled bin, not a lookup in an array for every bin."""
    df = spark.createDataFrame([(float(i % 10), 5.0) for i in range(100)], "a double, b double")

    def refused(*_):
        raise AssertionError("a bin looked up in an array")

    monkeypatch.setattr(baseline, "bin_index", refused)
    got = {r["feature"]: r for r in baseline.baseline_stats(df, ["a", "b"], 4).collect()}
    assert got["a"]["bin_edges"] == [0.0, 2.0, 4.5, 7.0, 9.0] and got["a"]["reference_distribution"] == [0.2, 0.3, 0.2, 0.3]
    assert got["b"]["bin_edges"] == [5.0] and got["b"]["reference_distribution"] == []


def test_values_of_the_baseline_are_kept_in_a_column_per_feature(spark):
    from driftwise.operators import baseline

    df = spark.createDataFrame([(1.0, 2, None), (None, 4, None), (3.0, None, None)], "`PM2.5` double, n int, void double")
    long = baseline.unpivot(df, ["PM2.5", "n", "void"])
    assert sorted(map(tuple, long.where("value is not null").collect())) == [("PM2.5", 1.0), ("PM2.5", 3.0), ("n", 2.0), ("n", 4.0)]
    assert "Generate" not in long._jdf.queryExecution().executedPlan().toString()       # no array of rows is made for each row
    got = {r["feature"]: (r["mean"], r["n_observations"]) for r in baseline.baseline_stats(df, ["PM2.5", "n", "void", "gone"]).collect()}
    assert got == {"PM2.5": (2.0, 2), "n": (3.0, 2)}
    assert baseline.baseline_stats(df, ["gone"]).collect() == []

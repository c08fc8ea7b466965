"""Exact quantiles: the bracketing path (used for large groups) must equal numpy's linear interpolation."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from driftwise.operators import quantiles
from driftwise.operators.quantiles import grouped_quantiles


def test_bracket_path_is_exact(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(0, 1, 3000)
    b = rng.integers(0, 7, 2000).astype(float)          # heavy ties
    pdf = pd.DataFrame({"g": ["a"] * len(a) + ["b"] * len(b), "v": np.concatenate([a, b])})
    pdf.loc[5, "v"] = np.nan                              # nulls are ignored
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    qs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = grouped_quantiles(df, "g", "v", qs, exact_limit=10, accuracy=200, max_collect=40)
    for g in ("a", "b"):
        vals = pdf[pdf.g == g].v.dropna().to_numpy()
        assert np.allclose(got[g], np.quantile(vals, qs), rtol=0, atol=1e-12)


def test_builtin_and_hint_paths_agree(spark):
    pdf = pd.DataFrame({"g": ["x"] * 5, "v": [5.0, 1.0, 3.0, 2.0, 4.0]})
    df = spark.createDataFrame(pdf)
    assert grouped_quantiles(df, "g", "v", [0.5, 0.75]) == {"x": [3.0, 4.0]}
    assert grouped_quantiles(df, "g", "v", [0.5, 0.75], n_upper=5) == {"x": [3.0, 4.0]}
    assert grouped_quantiles(df.limit(0), "g", "v", [0.5]) == {}


def test_heavy_ties_are_not_gathered(spark):
    from pyspark.sql import functions as F

    from driftwise.operators import quantiles

    df = spark.range(30_000).select((F.col("id") % 3).cast("double").alias("v"), F.lit("g").alias("g"))
    got = quantiles.grouped_quantiles(df, "g", "v", [0.0, 0.25, 0.5, 0.75, 1.0], exact_limit=100, max_collect=100)
    assert got == {"g": [0.0, 0.0, 1.0, 2.0, 2.0]}
    two = spark.range(30_000).select(F.when(F.col("id") < 15_000, 1.0).otherwise(2.0).alias("v"), F.lit("g").alias("g"))
    assert quantiles.grouped_quantiles(two, "g", "v", [0.5], exact_limit=100, max_collect=100) == {"g": [1.5]}


def test_one_sketch_serves_all_quantiles_of_a_group(spark, monkeypatch):
    from pyspark.sql import functions as F

    from driftwise.operators import quantiles

    sketches = []
    real = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: sketches.append(a) or real(*a))
    rng = np.random.default_rng(5)
    values = {"a": rng.lognormal(0, 3, 4000), "b": rng.integers(-3, 4, 4000) * 1e300, "c": np.repeat([1.5, 2.5], 2000)}
    df = spark.createDataFrame(pd.DataFrame({"g": np.repeat(list(values), 4000), "v": np.concatenate(list(values.values()))}))
    qs = [i / 10 for i in range(11)] + [0.33]
    got = quantiles.grouped_quantiles(df, "g", "v", qs, exact_limit=10, accuracy=300, max_collect=60)
    for g, v in values.items():
        assert np.allclose(got[g], np.quantile(v, qs), rtol=1e-12, atol=1e-12)
    assert 1 <= len(sketches) <= 4                  # one aggregate a round, not one for every rank


def test_cuts_are_compared_by_compiled_expressions(spark, monkeypatch):
    """No pass over all rows may look values up in arrays, which is interpreted row by row."""
    rows = [("a", float(i * 7919 % 5000)) for i in range(5000)] + [("b", float(i % 3)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)

    def refused(*_):
        raise AssertionError("a higher-order function")

    monkeypatch.setattr(quantiles.F, "filter", refused)
    got = quantiles.grouped_quantiles(df, "g", "v", [0.0, 0.25, 0.5, 1.0], exact_limit=100, accuracy=100, max_collect=400)
    assert got["a"] == [0.0, 1249.75, 2499.5, 4999.0] and got["b"] == [0.0, 0.0, 1.0, 2.0]


def test_at_most_counts_like_bisect(spark):
    from bisect import bisect_right

    values, seen = [-2.5, -0.0, 1.0, 1.5, float("inf")], [-3.0, -2.5, 0.0, 0.5, 1.0, 7.0, float("inf"), float("-inf")]
    df = spark.createDataFrame([(x,) for x in seen], "v double").select("v", quantiles.at_most(values, F.col("v")).alias("n"))
    assert {r["v"]: r["n"] for r in df.collect()} == {x: bisect_right(values, x) for x in seen}
    assert df.sparkSession.createDataFrame([(float("nan"),)], "v double").select(quantiles.at_most(values, F.col("v"))).first()[0] == 5


def test_a_value_that_many_rows_share_takes_one_round(spark, monkeypatch):
    sketches = []
    real = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda *a: sketches.append(a) or real(*a))
    rng = np.random.default_rng(11)
    v = np.concatenate([np.repeat(np.arange(100.0), 300), rng.normal(50, 20, 3000), np.repeat([-0.0, np.inf], 40)])
    df = spark.createDataFrame(pd.DataFrame({"v": rng.permutation(v)})).select(F.lit("g").alias("g"), "v")
    qs = [i / 10 for i in range(10)] + [0.25, 0.333, 0.75]
    got = quantiles.grouped_quantiles(df, "g", "v", qs, exact_limit=100, accuracy=1000, max_collect=250)
    assert np.allclose(got["g"], np.quantile(v, qs), rtol=1e-12, atol=1e-12)
    assert len(sketches) == 1                       # such a value was cut off its bracket one neighbour a round before

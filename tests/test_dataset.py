"""Chronological split, holdout, feature selection and model-edge casts (reference dataset tests)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftwise.operators import split
from driftwise.operators.ordering import global_ordinal
from driftwise.params import SplitParams


@pytest.fixture(scope="module")
def toy_split(spark):
    import random

    rnd = random.Random(0)
    rows = [("A", dt.datetime(2023, 1, 1) + dt.timedelta(days=i), i, float(i), rnd.random(), rnd.random(), "Moderate")
            for i in range(100)]
    return spark.createDataFrame(
        rows, "City string, Date timestamp_ntz, rid int, AQI double, `PM2.5` double, PM10 double, AQI_Bucket string")


def test_split_sizes_and_order(toy_split):
    s = split.chronological_split(toy_split, "Date", "rid", SplitParams(val_size=0.2, test_size=0.2))
    summ = {r["split"]: r for r in split.split_summary(s, "Date").collect()}
    assert {k: v["n_rows"] for k, v in summ.items()} == {"train": 60, "val": 20, "test": 20}
    assert summ["train"]["max_ts"] < summ["val"]["min_ts"]
    assert summ["val"]["max_ts"] < summ["test"]["min_ts"]


def test_feature_selection(toy_split):
    cols = split.feature_columns(toy_split, "AQI", ["City", "Date", "AQI_Bucket", "rid"])
    assert cols == ["PM2.5", "PM10"]


def test_prepared_table_is_float32(toy_split):
    t, cols = split.prepare_splits(toy_split, "AQI", ["City", "AQI_Bucket"], "Date", "rid",
                                   SplitParams(val_size=0.2, test_size=0.2))
    assert cols == ["PM2.5", "PM10"]
    types = dict(t.dtypes)
    assert types["PM2.5"] == "float" and types["AQI"] == "float"
    counts = {r["split"]: r["count"] for r in t.groupBy("split").count().collect()}
    assert counts == {"train": 60, "val": 20, "test": 20}


def test_holdout_tail(toy_split):
    h = split.holdout_tail(toy_split, "Date", "rid", SplitParams(holdout_frac=0.15))
    assert h.count() == 15
    assert h.agg(F.min("rid")).first()[0] == 85


def test_global_ordinal_with_tiny_buckets_equals_row_number(spark):
    from driftwise.sources.views import readings
    from pyspark.sql import Window

    r = readings(spark, "/root/testdata/sf0.001")
    a = global_ordinal(r, "ts", "event_id", "o", bucket_seconds=60, segment_rows=7)
    b = r.withColumn("o", F.row_number().over(Window.orderBy("ts", "event_id")))
    assert a.select("event_id", "o").exceptAll(b.select("event_id", "o")).count() == 0


def test_standardize_population_std_train_only(spark):
    df = spark.createDataFrame([("train", 1.0), ("train", 3.0), ("test", 10.0), ("train", 5.0)], "split string, x double")
    z = {r["x_raw"]: r["x"] for r in split.standardize(df.withColumn("x_raw", F.col("x")), ["x"], as_float32=False).collect()}
    sd = (8 / 3) ** 0.5
    assert z[1.0] == pytest.approx(-2 / sd) and z[10.0] == pytest.approx(7 / sd)


def test_standardize_zero_std(spark):
    df = spark.createDataFrame([("train", 2.0), ("train", 2.0)], "split string, x double")
    assert [r["x"] for r in split.standardize(df, ["x"], as_float32=False).collect()] == [0.0, 0.0]


def test_global_ordinal_splits_single_timestamp_buckets(spark):
    """Daily data: every row of a bucket has the same timestamp; heavy buckets split by the tiebreak."""
    from pyspark.sql import Window

    rows = [(dt.datetime(2024, 1, 1 + (i % 3)), i) for i in range(300)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, rid long")
    a = global_ordinal(df, "d", "rid", "o", segment_rows=7)
    b = df.withColumn("o", F.row_number().over(Window.orderBy("d", "rid")))
    assert a.select("rid", "o").exceptAll(b.select("rid", "o")).count() == 0


def test_global_ordinal_isolates_a_heavy_instant(spark):
    """One instant holds most rows of a bucket that also has other timestamps: recursive refinement."""
    from pyspark.sql import Window

    t0 = dt.datetime(2024, 1, 1, 0, 30)
    rows = [(t0, i) for i in range(200)] + [(t0 + dt.timedelta(seconds=j * 37), 1000 + j) for j in range(1, 60)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, rid long")
    a = global_ordinal(df, "d", "rid", "o", segment_rows=9)
    b = df.withColumn("o", F.row_number().over(Window.orderBy("d", "rid")))
    assert a.select("rid", "o").exceptAll(b.select("rid", "o")).count() == 0


def test_global_ordinal_string_tiebreak_on_copies(spark):
    from pyspark.sql import Window

    words = ["b", "ab", "abc", "ba", "a", "zz", "é", "éa", "aa", "z"] * 8
    rows = [(dt.datetime(2024, 1, 1), f"{w}-{i:03d}") for i, w in enumerate(words)]
    df = spark.createDataFrame(rows, "d timestamp_ntz, rid string")
    a = global_ordinal(df, "d", "rid", "o", segment_rows=6)
    b = df.withColumn("o", F.row_number().over(Window.orderBy("d", "rid")))
    assert a.select("rid", "o").exceptAll(b.select("rid", "o")).count() == 0

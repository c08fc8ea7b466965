"""Reference unit cases for lags, trailing means, forward fill and baseline keys, plus the hot-key path."""

from pyspark.sql import functions as F

from driftwise.operators import baseline, features
from driftwise.params import FeatureParams, SkewParams

P = FeatureParams(key="City", ts="Date", tiebreak="rid", pollutants=("PM2.5",), target="AQI")


def _rows(df, city):
    return [r.asDict() for r in df.where(F.col("City") == city).orderBy("Date").collect()]


def test_lag_columns_and_values(toy_features):
    out = features.add_lags_and_rolls(toy_features, P, lags=(1, 2), rolls=())
    assert "PM2.5_lag1" in out.columns and "PM2.5_lag2" in out.columns
    a = _rows(out, "A")
    assert a[0]["PM2.5_lag1"] is None
    assert a[1]["PM2.5_lag1"] == 10.0


def test_no_lag_leak_across_cities(toy_features):
    b = _rows(features.add_lags_and_rolls(toy_features, P, lags=(1,), rolls=()), "B")
    assert b[0]["PM2.5_lag1"] is None


def test_rolling_excludes_current_row(toy_features):
    out = features.add_lags_and_rolls(toy_features, P, lags=(), rolls=(3,))
    a = _rows(out, "A")
    assert a[2]["PM2.5_roll3"] == 15.0
    # per-city frame: the first row of the second city has no history (deliberate, see README)
    assert _rows(out, "B")[0]["PM2.5_roll3"] is None


def test_forward_fill(toy_features):
    holed = toy_features.withColumn(
        "PM2.5", F.when((F.col("City") == "A") & (F.col("rid") == 1), None).otherwise(F.col("`PM2.5`")))
    a = _rows(features.forward_fill(holed, P), "A")
    assert a[1]["PM2.5"] == 10.0


def test_median_fill_is_global_and_leading_nulls_use_it(spark):
    df = spark.createDataFrame(
        [("A", 1, 1, None), ("A", 2, 2, 4.0), ("B", 1, 3, 10.0), ("B", 2, 4, None)],
        "City string, Date int, rid int, v double").withColumn("Date", F.timestamp_seconds("Date").cast("timestamp_ntz"))
    p = FeatureParams(key="City", ts="Date", tiebreak="rid", pollutants=("v",), target="AQI")
    out = {r["rid"]: r["v"] for r in features.impute(df, p).collect()}
    # after ffill: A = [null, 4], B = [10, 10] -> median of (4, 10, 10) = 10
    assert out == {1: 10.0, 2: 4.0, 3: 10.0, 4: 10.0}


def test_baseline_keys_and_skip(toy_features):
    b = baseline.baseline_stats(toy_features, ["PM2.5", "AQI", "not_a_column"], n_bins=4)
    rows = {r["feature"]: r.asDict() for r in b.collect()}
    assert set(rows) == {"PM2.5", "AQI"}
    for key in ("mean", "std", "min", "max", "median", "q25", "q75", "bin_edges", "reference_distribution"):
        assert key in rows["PM2.5"]
    assert abs(sum(rows["PM2.5"]["reference_distribution"]) - 1.0) < 1e-12


def test_hot_key_segments_equal_plain_windows(spark):
    """Force every key to be 'hot' and cut into tiny segments: results must equal the unsplit plan."""
    from driftwise.sources.views import readings

    r = readings(spark, "/root/testdata/sf0.001")
    plain = FeatureParams()
    split = FeatureParams(skew=SkewParams(hot_key_rows=5, segment_rows=3))
    a = features.build_features(r, plain)
    b = features.build_features(r, split)
    cols = sorted(a.columns)
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0
    assert b.select(cols).exceptAll(a.select(cols)).count() == 0
    assert a.count() == b.count() > 0


def test_null_key_rows_do_not_form_a_group(spark):
    df = spark.createDataFrame(
        [(None, 1, 1, 5.0, 1.0), (None, 2, 2, 6.0, 1.0), ("A", 1, 3, 1.0, 2.0)],
        "City string, Date int, rid int, v double, AQI double").withColumn(
        "Date", F.timestamp_seconds("Date").cast("timestamp_ntz"))
    p = FeatureParams(key="City", ts="Date", tiebreak="rid", pollutants=("v",), target="AQI", lags=(1,), rolls=())
    out = features.build_features(df, p)
    assert out.count() == 0   # A has one row (no lag), null-city rows never get lags


def test_hot_key_forward_fill_equals_plain(spark):
    from driftwise.sources.views import readings

    r = readings(spark, "/root/testdata/sf0.001")
    a = features.impute(r, FeatureParams())
    b = features.impute(r, FeatureParams(skew=SkewParams(hot_key_rows=4, segment_rows=2)))
    cols = sorted(a.columns)
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0 and a.count() == b.count()


def test_hot_key_of_copies_split_by_tiebreak(spark):
    """A hot key whose rows all share one timestamp is split by tiebreak ranges; results stay exact."""
    import datetime as dt

    rows = [("H", dt.datetime(2024, 1, 1), i, float(i % 5) if i % 4 else None) for i in range(60)]
    rows += [("c", dt.datetime(2024, 1, 1 + i), 100 + i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, rid long, v double")
    base = FeatureParams(key="k", ts="t", tiebreak="rid", pollutants=("v",), target="none", lags=(1, 3), rolls=(2,))
    hot = FeatureParams(key="k", ts="t", tiebreak="rid", pollutants=("v",), target="none", lags=(1, 3), rolls=(2,),
                        skew=SkewParams(hot_key_rows=20, segment_rows=7))
    a = features.build_features(df, base)
    b = features.build_features(df, hot)
    cols = sorted(a.columns)
    assert a.count() == b.count() > 0
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0


def test_hot_key_with_a_heavy_instant_inside_its_range(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    rows = [("H", t0 + dt.timedelta(hours=5), i, float(i % 7)) for i in range(80)]
    rows += [("H", t0 + dt.timedelta(minutes=13 * j), 500 + j, None if j % 5 == 0 else float(j)) for j in range(40)]
    rows += [("c", t0 + dt.timedelta(days=i), 900 + i, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "k string, t timestamp_ntz, rid long, v double")
    kw = dict(key="k", ts="t", tiebreak="rid", pollutants=("v",), target="none", lags=(1, 4), rolls=(3,))
    a = features.build_features(df, FeatureParams(**kw))
    b = features.build_features(df, FeatureParams(**kw, skew=SkewParams(hot_key_rows=30, segment_rows=6)))
    cols = sorted(a.columns)
    assert a.count() == b.count() > 0
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0


def test_one_key_with_forty_percent_of_rows_is_split_and_exact(spark):
    """Skew as the design assumes it: one key holds ~40% of all rows."""
    from driftwise.operators.ordering import SEG, assign_segments
    from driftwise.sources.views import events, readings

    ev = events(spark, "/root/testdata/sf0.001").select("event_id", "event_type")
    r = readings(spark, "/root/testdata/sf0.001").join(ev, "event_id").withColumn(
        "city", F.when(F.col("event_type").isin("view", "click"), F.lit(-1)).otherwise(F.col("city"))).drop("event_type")
    skew = SkewParams(hot_key_rows=200, segment_rows=40)
    seg, has_hot = assign_segments(r, "city", "ts", skew, tiebreak="event_id")
    assert has_hot
    sizes = seg.groupBy("city", SEG).count()
    hot_parts = sizes.where(F.col("city") == -1)
    assert hot_parts.count() >= 5 and hot_parts.agg(F.max("count")).first()[0] <= 2 * 40
    a = features.build_features(r, FeatureParams())
    b = features.build_features(r, FeatureParams(skew=skew))
    cols = sorted(a.columns)
    assert a.count() == b.count() > 0
    assert a.select(cols).exceptAll(b.select(cols)).count() == 0

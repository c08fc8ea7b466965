"""Nested request bodies, coefficient models, log rows, batches that are appended once, metrics over time."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from driftwise.operators import serving
from driftwise.sources import io

T0 = dt.datetime(2025, 4, 23, 12)
FIELDS = ["PM2.5", "PM10"]


def _parse(spark, bodies):
    df = spark.createDataFrame([(i, T0, b) for i, b in enumerate(bodies)], "id long, at timestamp_ntz, body string")
    return serving.parse_requests(df, "body", "id", FIELDS, ["at"])


def _errors(spark, body):
    text = body if isinstance(body, str) or body is None else json.dumps(body)
    return [(r["path"], r["reason"]) for r in serving.request_errors(_parse(spark, [text]), "id").collect()]


GOOD = {"city": "Delhi", "date": "2025-04-23", "PM2.5": 110.5, "pm10": "180"}


@pytest.mark.parametrize("body, want", [
    ({"reading": GOOD}, []),
    ({"reading": {"city": "Delhi", "date": "x"}, "history": []}, []),
    ({"reading": {**GOOD, "PM2.5": None}, "history": [GOOD], "more": 1}, []),
    ({"reading": {**GOOD, "city": 7, "date": None}}, [("reading.city", "not text"), ("reading.date", "missing")]),
    ({"reading": {**GOOD, "PM2.5": "bad", "pm10": [1]}}, [("reading.PM2.5", "not a number"), ("reading.PM10", "not a number")]),
    ({"reading": GOOD, "history": [GOOD, {"city": "Delhi"}, 3, None]},
     [("history[1].date", "missing"), ("history[2]", "not an object"), ("history[3]", "not an object")]),
    ({"reading": GOOD, "history": None}, [("history", "not a list")]),
    ({"reading": [GOOD], "history": {}}, [("reading", "not an object"), ("history", "not a list")]),
    ({}, [("reading", "missing")]), ("[]", [("reading", "missing")]), ("{", [("body", "not JSON")]), ("", [("body", "not JSON")]),
    (None, [("body", "not JSON")]),
])
def test_each_fault_has_its_place(spark, body, want):
    assert _errors(spark, body) == want


def test_log_rows_of_accepted_bodies(spark):
    past = [{**GOOD, "date": f"2025-04-{d:02d}", "PM2.5": float(d)} for d in (20, 22, 21, 22)]
    parsed = _parse(spark, [json.dumps({"reading": GOOD, "history": past}), json.dumps({"reading": {"city": 1}}), json.dumps({"reading": GOOD})])
    model = spark.createDataFrame([(serving.INTERCEPT, 1.0), ("PM2.5", 2.0), ("PM2.5_lag1", 10.0), ("other", 5.0)], "feature string, weight double")
    got = {r["id"]: r for r in serving.log_rows(parsed, "id", "at", FIELDS, model, "v1", "linear", T0 + dt.timedelta(seconds=2)).collect()}
    assert set(got) == {0, 2}
    assert got[0]["predicted_aqi"] == 1.0 + 221.0 + 220.0 and got[2]["predicted_aqi"] == 222.0 and got[0]["latency_ms"] == 2000.0
    assert json.loads(got[0]["input_features"]) == {"city": "Delhi", "date": "2025-04-23", "PM2.5": 110.5, "PM10": 180.0}


def test_least_squares_finds_the_plane_and_shares_equal_columns(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7), 3.0 + 2.0 * i - (i * i % 7)) for i in range(40)], "a double, b double, y double")
    df = df.unionByName(spark.createDataFrame([(1.0, 1.0, None)], df.schema))
    w = {r["feature"]: r["weight"] for r in serving.least_squares(df, ["a", "b"], "y").collect()}
    assert w == pytest.approx({serving.INTERCEPT: 3.0, "a": 2.0, "b": -1.0})
    w = {r["feature"]: r["weight"] for r in serving.least_squares(df.withColumn("y", F.col("a")).withColumn("b", F.col("a")), ["a", "b"], "y").collect()}
    assert w["a"] == pytest.approx(0.5) and w["b"] == pytest.approx(0.5)
    w = {r["feature"]: r["weight"] for r in serving.least_squares(df.where("a > 99"), ["a"], "y").collect()}
    assert w == {serving.INTERCEPT: None, "a": None}


def test_batches_are_appended_once_and_seen_when_committed(spark, tmp_path):
    path = str(tmp_path / "log")
    with pytest.raises(FileNotFoundError):
        io.read_batches(spark, path)
    rows = spark.range(10).withColumn("day", F.col("id") % 2)
    assert io.append_batch(rows, path, "1", ["day"]) and not io.append_batch(rows, path, "1", ["day"])
    rows.where("id < 3").write.partitionBy("day").parquet(f"{path}/data/batch_id=b-2")          # a writer that died before its manifest entry
    assert sorted(r["id"] for r in io.read_batches(spark, path).collect()) == list(range(10))
    assert io.append_batch(rows.where("id >= 5"), path, "2", ["day"])                              # the retry replaces what it left
    got = io.read_batches(spark, path)
    assert sorted(r["id"] for r in got.where("batch_id = 'b-2'").collect()) == [5, 6, 7, 8, 9] and got.count() == 15
    assert io.append_batch(rows.where("id < 0"), path, "none", ["day"]) and io.read_batches(spark, path).count() == 15
    assert sorted(r["n_rows"] for r in spark.read.parquet(f"{path}/manifest").collect()) == [0, 5, 10]
    with pytest.raises(ValueError):
        io.append_batch(rows, path, "../x")


def test_two_passes_give_two_points_in_time(spark, tmp_path):
    path = str(tmp_path / "metrics")
    report = spark.createDataFrame([("a", 0.3), ("b", 0.1)], "feature string, psi double")
    for at in (T0, T0 + dt.timedelta(hours=1), T0):
        io.record_metrics(report, path, at)
    got = io.read_batches(spark, path)
    assert got.count() == 6 and {r["as_of"] for r in got.select("as_of").distinct().collect()} == {T0, T0 + dt.timedelta(hours=1)}


def test_bodies_are_taken_apart_once(spark):
    body = '{"reading":{"city":"a","date":"d","pm10":"x"},"history":[{"city":"b","date":"d"},3,{"city":1,"date":null,"PM10":true}]}'
    df = spark.createDataFrame([(1, body), (2, "{"), (3, '{"reading":null,"history":{}}')], "id long, body string").repartition(2)
    parsed = serving.parse_requests(df, "body", "id", ["PM10"])
    out = serving.request_errors(parsed, "id")
    assert sorted(map(tuple, out.collect())) == [
        (1, "history[1]", "not an object"), (1, "history[2].city", "not text"), (1, "history[2].date", "missing"),
        (1, "reading.PM10", "not a number"), (2, "body", "not JSON"), (3, "history", "not a list"), (3, "reading", "not an object")]
    for df in (out, parsed.where(F.size("errors") == 0)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1 and plan.count("schemaOfVariant") <= 4      # city and date, of the reading and of an element


def test_members_are_taken_out_by_name(spark):
    """Only the asked members are taken out, under names that may differ by case only, without a map of every observation."""
    item = {"city": "Delhi", "date": "2025-04-23", "PM10": None, "pm10": "12", "pm25": True, "more": {"x": [1]}}
    parsed = _parse(spark, [json.dumps({"reading": {**item, "PM10": 7}, "history": [item, {**item, "city": {"a": 1}}]})])
    row = parsed.first()
    assert (row["reading"]["PM2.5"], row["reading"]["PM10"]) == (1.0, 7.0)
    assert [(h["city"], h["PM10"]) for h in row["history"]] == [("Delhi", 12.0), ('{"a":1}', 12.0)]
    assert [(e["path"], e["reason"]) for e in row["errors"]] == [("history[1].city", "not text")]
    plan = parsed._jdf.queryExecution().toString()
    assert "MapType" not in plan and "schema_of_variant" not in plan

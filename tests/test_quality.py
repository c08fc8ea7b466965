"""Validation report, scans with NaN handling, range checks and payload accept/reject."""

import json

from pyspark.sql import functions as F

from driftwise.operators import quality
from driftwise.params import ValidateParams
from driftwise.sources import io


def test_csv_scan_nan_tokens_become_null(spark, tmp_path):
    p = tmp_path / "raw.csv"
    header = "City,Date," + ",".join(f.name for f in io.RAW_SCHEMA.fields[2:])
    n_pol = len(io.RAW_SCHEMA.fields) - 4
    p.write_text(header + "\n" + "Delhi,2024-01-01," + ",".join(["NaN"] + ["1.5"] * (n_pol - 1)) + ",NA,Good\n"
                 + "Delhi,not-a-date," + ",".join([""] * n_pol) + ",100.0,\n")
    df = io.read_raw_csv(spark, str(p))
    rows = df.collect()
    assert rows[0]["PM2.5"] is None and rows[0]["PM10"] == 1.5 and rows[0]["AQI"] is None
    assert rows[1]["PM2.5"] is None and rows[1]["AQI"] == 100.0
    rep = quality.validate(df, ValidateParams(min_rows=10)).first()
    assert rep["passed"] is False
    assert any("Only 2 rows, fewer than 10" in e for e in rep["errors"])
    assert rep["unparseable_dates"] == 1
    assert rep["missing_pct_per_column"]["PM2.5"] == 1.0
    assert any("'PM2.5' is 100.0% empty" in w for w in rep["warnings"])


def test_missing_required_columns_sorted(spark):
    df = spark.createDataFrame([(1,)], "City int")
    rep = quality.validate(df, ValidateParams(required_columns=("Date", "City", "AQI"), min_rows=1)).first()
    assert rep["errors"] == ["Required columns not found: ['AQI', 'Date']"]


def test_warning_threshold_is_strict(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "x double")
    prof = {r["column_name"]: r for r in quality.missing_profile(df, 0.5).collect()}
    assert prof["x"]["missing_pct"] == 0.5 and prof["x"]["over_threshold"] is False


def test_range_violations(spark):
    df = spark.createDataFrame([(-1.0,), (5.0,), (2001.0,), (None,)], "`PM2.5` double")
    r = quality.range_violations(df, {"PM2.5": (0.0, 2000.0), "absent": (0.0, 1.0)}).collect()
    assert len(r) == 1 and r[0]["n_below"] == 1 and r[0]["n_above"] == 1 and r[0]["n_null"] == 1


def test_payload_rules(spark):
    bodies = [
        (1, json.dumps({"city": "Delhi", "date": "2025-04-23", "PM2.5": 110.5, "pm10": "180"})),
        (2, json.dumps({"city": "Delhi", "date": "2025-04-23"})),          # all pollutants missing: accepted
        (3, json.dumps({"city": "Delhi", "date": None, "PM2.5": 1.0})),    # null date: rejected
        (4, json.dumps({"city": "Delhi", "date": "x", "PM10": "bad"})),     # any string date passes; bad number rejects
    ]
    df = spark.createDataFrame(bodies, "id long, body string")
    out = {r["id"]: r for r in quality.split_payloads(df, "body", "id", ["PM2.5", "PM10"]).collect()}
    assert out[1]["accepted"] and out[1]["PM10"] == 180.0 and out[1]["PM2.5"] == 110.5
    assert out[2]["accepted"]
    assert not out[3]["accepted"] and out[3]["reject_reason"] == "missing date"
    assert not out[4]["accepted"] and out[4]["reject_reason"] == "not a number: PM10"


def test_parse_helpers(spark):
    from driftwise.functions.exprs import parse_double, parse_ts

    df = spark.createDataFrame([("true", "2024-01-02"), ("bad", "nope"), ("3.5", None)], "a string, d string")
    got = df.select(parse_double(F.col("a")).alias("x"), parse_ts(F.col("d")).isNull().alias("bad")).collect()
    assert [r["x"] for r in got] == [1.0, None, 3.5]
    assert [r["bad"] for r in got] == [False, True, True]


def test_uuid_check_and_provenance_row(spark):
    from driftwise.functions.exprs import is_uuid
    from driftwise.operators.registry import provenance_row

    df = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000",), ("not-a-uuid",)], "id string")
    assert [r[0] for r in df.select(is_uuid(F.col("id"))).collect()] == [True, False]
    row = provenance_row(spark, "r1", "xgboost", 24771, 97, {"git_sha": "abc"}).first()
    assert row["feature_count"] == 97 and row["tags"]["git_sha"] == "abc"

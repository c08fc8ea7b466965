"""Views derived from the driver tables (events stands in for the per-entity sensor stream).

Every view is a projection of the whole ``events`` table; rows are never sampled or capped. Values that
play the role of missing readings, feedback or failed runs are chosen by event content (event type),
so the same rule written in SQL gives the same rows (see ``driftwise.plans.oracle``).
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = [
    "table", "events", "readings", "raw_readings", "readings_feedback", "predictions", "ground_truth",
    "requests", "request_payloads", "nested_requests", "scraped_counters", "runs", "dag_runs", "model_versions", "prop_k",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def prop_k(props: Column | str = "props") -> Column:
    p = F.col(props) if isinstance(props, str) else props
    return F.get_json_object(p, "$.k").try_cast("bigint")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _p1() -> Column:
    return F.when(F.col("event_type") == "error", F.lit(None)).otherwise(F.col("value")).cast("double")


def _p2() -> Column:
    return F.when(F.col("event_type") == "signup", F.lit(None)).otherwise(prop_k()).cast("double")


def _target() -> Column:
    return F.when(F.col("event_type") == "view", F.lit(None)).otherwise(F.col("value") + prop_k()).cast("double")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city = user_id, ordered by (ts, event_id); an 'error' event carries no p1, 'signup' no p2, 'view' no target."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("user_id").alias("city"), "ts", "event_id",
        _p1().alias("p1"), _p2().alias("p2"), _target().alias("target"),
    )


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text-typed landing view (like a CSV read): City, Date as strings; error events carry a corrupt date."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("user_id").cast("string").alias("City"),
        F.when(F.col("event_type") == "error", F.lit("n/a"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("Date"),
        _p1().alias("PM2.5"),
        _p2().alias("PM10"),
        _target().alias("AQI"),
    )


def readings_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected readings for 'purchase' events: same (city, ts), target + 100, stamped feedback_at = ts."""
    e = events(spark, sf_dir).where(F.col("event_type") == "purchase")
    k = prop_k()
    return e.select(
        F.col("user_id").alias("city"),
        "ts",
        "event_id",
        F.col("value").cast("double").alias("p1"),
        k.cast("double").alias("p2"),
        (F.col("value") + k + F.lit(100.0)).alias("target"),
        F.col("ts").alias("feedback_at"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction log: one row per event; input_features is the JSON request body."""
    e = events(spark, sf_dir)
    features = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("city"),
            F.date_format("ts", "yyyy-MM-dd").alias("date"),
            _p1().alias("PM2.5"),
            _p2().alias("PM10"),
        ),
        {"ignoreNullFields": "false"},
    )
    return e.select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("created_at"),
        F.col("event_type").alias("model_version"),
        F.when(F.col("event_type").isin("view", "click"), F.lit("gbt")).otherwise(F.lit("linear")).alias("model_family"),
        features.alias("input_features"),
        F.col("value").alias("predicted_aqi"),
        prop_k().cast("double").alias("latency_ms"),
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback submissions: every non-view event gets one, purchases a later overwrite, errors an unknown id."""
    e = events(spark, sf_dir)
    k = prop_k()
    first = e.where(F.col("event_type") != "view").select(
        F.col("event_id").alias("prediction_id"),
        (F.col("value") + (k - 50)).cast("double").alias("actual_aqi"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("feedback_at"),
    )
    overwrite = e.where(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("prediction_id"),
        (F.col("value") + k).cast("double").alias("actual_aqi"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("feedback_at"),
    )
    unknown = e.where(F.col("event_type") == "error").select(
        (F.lit(-1) - F.col("event_id")).alias("prediction_id"),
        F.col("value").cast("double").alias("actual_aqi"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("feedback_at"),
    )
    return first.unionByName(overwrite).unionByName(unknown)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP handler log: status 500 for error events; duration = k / 200 seconds."""
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("request_id"),
        "ts",
        F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")).alias("status"),
        (prop_k() / F.lit(200.0)).alias("duration_s"),
    )


def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw request bodies: error events lack a date, click events send PM10 as 'n/a'."""
    e = events(spark, sf_dir)
    body = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("city"),
            F.when(F.col("event_type") == "error", F.lit(None).cast("string"))
            .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("date"),
            F.col("value").alias("PM2.5"),
            F.when(F.col("event_type") == "click", F.lit("n/a"))
            .otherwise(prop_k().cast("string")).alias("PM10"),
        ),
        {"ignoreNullFields": "false"},
    )
    return e.select(F.col("event_id").alias("payload_id"), body.alias("body"))


def nested_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, received_at, body): per event a body with its reading and the city's 14 readings before it.

    Faults by content: readings of 'error' events name the city by a number, 'signup' events with k % 10 = 4 carry no date;
    history elements of 'view' events with k % 20 = 4 carry no date, those of 'error' events with k % 20 = 3 the PM10 ``n/a``;
    'purchase' events with k = 7 send a null history, 'click' events with k = 99 a body that is cut off."""
    from driftwise.operators.features import add_lags_and_rolls
    from driftwise.params import FeatureParams

    k, kind = prop_k(), F.col("event_type")
    day, city = F.date_format("ts", "yyyy-MM-dd"), F.col("user_id").cast("string")
    none = F.lit(None).cast("string")

    def observation(date: Column, pm10: Column, city: Column = city) -> Column:
        item = F.struct(city.alias("city"), date.alias("date"), F.col("value").cast("double").alias("PM2.5"), pm10.alias("PM10"))
        return F.to_json(item, {"ignoreNullFields": "false"})

    no_day = F.when((kind == "signup") & (k % 10 == 4), none).otherwise(day)
    sent = events(spark, sf_dir).select(
        "event_id", "user_id", "ts", "event_type", k.alias("_k"),
        F.when(kind == "error", observation(no_day, k, F.col("user_id"))).otherwise(observation(no_day, k.cast("string"))).alias("_reading"),
        observation(F.when((kind == "view") & (k % 20 == 4), none).otherwise(day),
                    F.when((kind == "error") & (k % 20 == 3), F.lit("n/a")).otherwise(k.cast("string"))).alias("_item"))
    ago = range(14, 0, -1)
    p = FeatureParams(key="user_id", ts="ts", tiebreak="event_id")
    d = add_lags_and_rolls(sent, p, cols=["_item"], lags=tuple(ago), rolls=())
    items = F.concat(F.lit("["), F.array_join(F.array(*[F.col(f"_item_lag{n}") for n in ago]), ","), F.lit("]"))
    history = F.when((kind == "purchase") & (F.col("_k") == 7), F.lit("null")).otherwise(items)
    body = F.concat(F.lit('{"reading":'), F.col("_reading"), F.lit(',"history":'), history, F.lit("}"))
    cut = (kind == "click") & (F.col("_k") == 99)
    return d.select(F.col("event_id").alias("request_id"), F.col("ts").alias("received_at"),
                    F.when(cut, F.substring(body, 1, 20)).otherwise(body).alias("body"))


def scraped_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(status, scraped_at, total): the request counter of each status, sampled at the end of every minute that saw a request
    of it; the counting process starts again every day, so a day bounds the running sum."""
    from pyspark.sql import Window

    from driftwise.functions.exprs import epoch_micros, ntz_from_seconds

    minute = F.ceil(epoch_micros(F.col("ts")) / F.lit(60_000_000.0)).cast("long")
    per = requests(spark, sf_dir).groupBy("status", minute.alias("_m")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("status", F.floor(F.col("_m") / 1440)).orderBy("_m")
    return per.select("status", ntz_from_seconds(F.col("_m") * 60).alias("scraped_at"),
                      F.sum("_n").over(w).cast("double").alias("total"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training runs: one per signup event; k < 50 -> xgboost else pytorch_nn; value < 5 -> FAILED; value > 300 -> no metric."""
    e = events(spark, sf_dir).where(F.col("event_type") == "signup")
    k = prop_k()
    return e.select(
        F.col("event_id").cast("string").alias("run_id"),
        F.when(k < 50, F.lit("xgboost")).otherwise(F.lit("pytorch_nn")).alias("model_family"),
        F.when(F.col("value") < 5, F.lit("FAILED")).otherwise(F.lit("FINISHED")).alias("status"),
        F.col("ts").alias("start_time"),
        (k * 100).alias("dataset_rows"),
        F.lit(97).alias("feature_count"),
        F.when(F.col("value") > 300, F.lit(None).cast("double")).otherwise(F.col("value")).alias("val_rmse"),
    )


def dag_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return e.select(
        F.col("event_type").alias("dag_id"),
        F.col("event_id").cast("string").alias("run_id"),
        F.when(F.col("value") > 100, F.lit("failed")).otherwise(F.lit("success")).alias("state"),
        F.col("ts").alias("start_date"),
    )


def model_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered versions: every finished xgboost run with a metric, numbered by start time; newest is Production."""
    from driftwise.operators.ordering import global_ordinal

    r = runs(spark, sf_dir).where(
        (F.col("status") == "FINISHED") & (F.col("model_family") == "xgboost") & F.col("val_rmse").isNotNull()
    )
    ranked = global_ordinal(r, "start_time", "run_id", out="version")
    newest = ranked.agg(F.max("version")).scalar()
    return ranked.select(
        F.lit("aqi_regressor").alias("name"),
        F.col("version").cast("int").alias("version"),
        "run_id",
        F.when(F.col("version") == newest, F.lit("Production")).otherwise(F.lit("Archived")).alias("stage"),
    )

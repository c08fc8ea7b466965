"""Scans and sinks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.exprs import col as qcol
from driftwise.params import POLLUTANTS

__all__ = [
    "RAW_SCHEMA", "BASELINE_SCHEMA", "PREDICTION_LOG_SCHEMA", "nan_to_null", "read_raw_csv", "landing_check",
    "write_table", "load_table", "write_baseline", "load_baseline", "append_predictions", "scan_predictions",
    "append_batch", "read_batches", "record_metrics", "export_csv", "psi_metrics",
]

# Raw sensor table as landed: text keys, doubles for readings (explicit schema, never inferred).
RAW_SCHEMA = T.StructType(
    [T.StructField("City", T.StringType()), T.StructField("Date", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in POLLUTANTS]
    + [T.StructField("AQI", T.DoubleType()), T.StructField("AQI_Bucket", T.StringType())]
)

BASELINE_SCHEMA = T.StructType([
    T.StructField("feature", T.StringType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("median", T.DoubleType()),
    T.StructField("q25", T.DoubleType()),
    T.StructField("q75", T.DoubleType()),
    T.StructField("n_observations", T.LongType()),
    T.StructField("bin_edges", T.ArrayType(T.DoubleType())),
    T.StructField("reference_distribution", T.ArrayType(T.DoubleType())),
])

PREDICTION_LOG_SCHEMA = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("created_at", T.TimestampNTZType(), False),
    T.StructField("model_version", T.StringType(), False),
    T.StructField("model_family", T.StringType(), False),
    T.StructField("input_features", T.StringType(), False),
    T.StructField("predicted_aqi", T.DoubleType(), False),
    T.StructField("latency_ms", T.DoubleType(), False),
])


def nan_to_null(df: DataFrame) -> DataFrame:
    """T4: NaN is missing. Applied to every float/double column right at the scan."""
    fix = {
        f.name: F.when(F.isnan(qcol(f.name)), F.lit(None).cast(f.dataType)).otherwise(qcol(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, T.DoubleType | T.FloatType)
    }
    return df.withColumns(fix) if fix else df


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """CSV with header and an explicit schema; pandas' NA tokens become null, NaN becomes null."""
    df = (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("nullValue", "")
        .option("nanValue", "NaN")
        .csv(path)
    )
    # The texts pandas reads as missing.
    tokens = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
              "NULL", "NaN", "None", "n/a", "nan", "null")
    df = df.withColumns({
        f.name: F.when(qcol(f.name).isin(*tokens), F.lit(None).cast("string")).otherwise(qcol(f.name))
        for f in schema.fields if isinstance(f.dataType, T.StringType)
    })
    return nan_to_null(df)


def landing_check(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Fail clearly when the landing path is absent or holds no rows; return the loaded table."""
    try:
        df = spark.read.format(fmt).option("header", True).load(path)
    except Exception as exc:  # AnalysisException: path does not exist
        raise FileNotFoundError(f"landing path missing: {path}") from exc
    if df.isEmpty():
        raise FileNotFoundError(f"landing path is empty: {path}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Full overwrite."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def load_table(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Load a stage output; a missing path is a clear error."""
    r = spark.read.format(fmt)
    if schema is not None:
        r = r.schema(schema)
    try:
        return r.load(path)
    except Exception as exc:
        raise FileNotFoundError(f"no table at {path}; run the producing stage first") from exc


def write_baseline(baseline: DataFrame, path: str) -> None:
    """One JSON row per feature."""
    baseline.select(*[f.name for f in BASELINE_SCHEMA.fields]).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return load_table(spark, path, "json", BASELINE_SCHEMA)


def append_predictions(df: DataFrame, path: str) -> None:
    """Append-only log partitioned by day of ``created_at`` (partition pruning for trailing windows).
    The rebalance hint lets AQE size the output files per day and split a hot day across tasks, instead of
    every task writing a small file into every day or one task writing a whole day."""
    (df.withColumn("created_date", F.to_date("created_at")).hint("rebalance", "created_date")
       .write.mode("append").partitionBy("created_date").parquet(path))


def _batch_name(batch_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_-]+", batch_id):
        raise ValueError(f"batch id must be letters, digits, _ or -: {batch_id!r}")
    return f"b-{batch_id}"          # never read back as a number or a date


def _load_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_batch(df: DataFrame, path: str, batch_id: str, partition_by: Sequence[str] = ()) -> bool:
    """Append a batch once, however often it is retried; False when it was there already.

    The rows go to a folder of the batch's own, which a retry overwrites, and a manifest entry written afterwards commits
    them: a writer that dies in between leaves rows that no reader sees. One writer per batch id at a time."""
    spark, name = df.sparkSession, _batch_name(batch_id)
    manifest = _load_if_there(spark, f"{path}/manifest")
    if manifest is not None and not manifest.where(F.col("batch_id") == name).isEmpty():
        return False
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(f"{path}/data/batch_id={name}")
    entry = spark.createDataFrame([(seen.get["n_rows"],)], "n_rows long")
    entry.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/batch_id={name}")
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches, with their ``batch_id`` folder as a column."""
    manifest = _load_if_there(spark, f"{path}/manifest")
    if manifest is None:
        raise FileNotFoundError(f"no committed batch at {path}")
    return spark.read.parquet(f"{path}/data").join(manifest.select("batch_id"), "batch_id", "left_semi")


def scan_predictions(spark: SparkSession, path: str, as_of, hours: int, columns: Sequence[str]) -> DataFrame:
    """S9 + P13: only rows with created_at > as_of - hours, only the needed columns. The date-partition
    predicate prunes whole directories; the timestamp predicate is pushed into the Parquet scan."""
    from driftwise.functions.exprs import as_ntz

    lo = as_ntz(as_of) - F.make_dt_interval(F.lit(0), F.lit(hours))
    df = spark.read.parquet(path)
    return (
        df.where(F.col("created_date") >= F.to_date(lo))
        .where(F.col("created_at") > lo)
        .select(*columns)
    )


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with header; nulls written as empty strings."""
    (df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "")
       .csv(path))


def psi_metrics(report: DataFrame) -> DataFrame:
    """Gauge rows (metric, feature, value): one per feature plus the max row (absent when empty)."""
    per = report.select(F.lit("feature_psi").alias("metric"), "feature", F.col("psi").alias("value"))
    mx = report.agg(F.max("psi").alias("value")).where(F.col("value").isNotNull()).select(
        F.lit("feature_psi_max").alias("metric"), F.lit(None).cast("string").alias("feature"), "value"
    )
    return per.unionByName(mx)


def record_metrics(report: DataFrame, path: str, as_of) -> bool:
    """S11 over time: the metric rows of a pass with its time ``as_of``, appended once; False when that pass is there."""
    from driftwise.functions.exprs import as_ntz

    at = as_ntz(as_of)
    name = report.sparkSession.range(1).select(F.date_format(at, "yyyyMMdd-HHmmss-SSSSSS")).first()[0]
    return append_batch(psi_metrics(report).select(at.alias("as_of"), "*"), path, name)

"""Run tracking and model registry as plain tables: latest run per family (W8), latest N per pipeline (W9),
champion (K5), promotion (C8), provenance rows (C9), version -> family (J6)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Candidate order decides ties (the first candidate wins).
CANDIDATE_FAMILIES = ("xgboost", "pytorch_nn")


def latest_per_group(df: DataFrame, group: str, order_col: str, tiebreak: str, n: int = 1) -> DataFrame:
    """Top-n newest per group: row_number <= n is planned as a WindowGroupLimit (partial top-n before
    the shuffle), so even a group with a third of all rows ships only n rows per map task."""
    w = Window.partitionBy(group).orderBy(F.col(order_col).desc_nulls_last(), F.col(tiebreak).desc())
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= n).withColumnRenamed("_rk", "recency_rank")


def latest_finished_runs(runs: DataFrame) -> DataFrame:
    """Newest FINISHED run per family."""
    return latest_per_group(runs.where(F.col("status") == "FINISHED"), "model_family", "start_time", "run_id", 1)


def recent_runs(dag_runs: DataFrame, n: int = 5) -> DataFrame:
    """Newest n runs per pipeline."""
    return latest_per_group(dag_runs, "dag_id", "start_date", "run_id", n)


def champion(runs: DataFrame, families: Sequence[str] = CANDIDATE_FAMILIES) -> DataFrame:
    """K5: lowest val_rmse among the latest finished run of each candidate family (missing metric = +inf,
    ties -> earlier candidate). Empty when there is no candidate."""
    cands = latest_finished_runs(runs.where(F.col("model_family").isin(list(families))))
    fam_rank = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("model_family"))
    key = F.struct(F.coalesce(F.col("val_rmse"), F.lit(float("inf"))), fam_rank)
    return cands.agg(
        F.min_by(F.struct("model_family", "run_id", "val_rmse"), key).alias("_c"), F.count(F.lit(1)).alias("_n")
    ).where(F.col("_n") > 0).select(
        F.col("_c.model_family").alias("winning_family"), F.col("_c.run_id").alias("run_id"),
        F.col("_c.val_rmse").alias("val_rmse"),
    )


def promote(model_versions: DataFrame, champ: DataFrame, name: str = "aqi_regressor") -> DataFrame:
    """Register the champion as version max+1 of ``name`` in Production; earlier Production versions of
    that name -> Archived, other names stay as they are. Without a champion nothing is changed: it raises."""
    if not champ.head(1):
        raise ValueError("no candidate run to promote")
    own = F.col("name") == name
    nxt = F.coalesce(model_versions.where(own).agg(F.max("version")).scalar(), F.lit(0)) + 1
    old = model_versions.select(
        "name", "version", "run_id",
        F.when(own & (F.col("stage") == "Production"), F.lit("Archived")).otherwise(F.col("stage")).alias("stage"),
    )
    new = champ.select(F.lit(name).alias("name"), nxt.cast("int").alias("version"), "run_id",
                       F.lit("Production").alias("stage"))
    return old.unionByName(new)


def version_family(model_versions: DataFrame, runs: DataFrame, stage: str = "Production") -> DataFrame:
    """Serving version -> family of its originating run ('unknown' when untagged)."""
    r = runs.select("run_id", "model_family")
    return model_versions.where(F.col("stage") == stage).join(r, "run_id", "left").select(
        "name", "version", "run_id", F.coalesce("model_family", F.lit("unknown")).alias("model_family")
    )


def provenance_row(spark, run_id: str, family: str, dataset_rows: int, feature_count: int,
                   extra: Mapping[str, str] | None = None) -> DataFrame:
    """One runs-table row with tags; append it with ``append_run``."""
    return spark.createDataFrame(
        [(run_id, family, int(dataset_rows), int(feature_count), dict(extra or {}))],
        "run_id string, model_family string, dataset_rows long, feature_count int, tags map<string,string>",
    )

"""Batch scoring: request rows with newest-first history (F12) -> model feature rows (C4) -> scored log
rows (C5)."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftwise.functions.exprs import col as qcol

MAX_HISTORY = 14


def request_batches(readings: DataFrame, key: str, ts: str, tiebreak: str, value_cols: Sequence[str],
                    history: int = MAX_HISTORY) -> DataFrame:
    """One scoring request per key: its newest row is the reading, the ``history`` rows before it form the
    history array (oldest first, as a client would send it). Top-(history+1) per key is a WindowGroupLimit,
    so a hot key contributes only history+1 rows per map task to the shuffle."""
    w = Window.partitionBy(key).orderBy(F.col(ts).desc(), F.col(tiebreak).desc())
    top = readings.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= history + 1)
    item = F.struct(F.col(ts).alias("date"), *[qcol(c).alias(c) for c in value_cols])
    return top.groupBy(key).agg(
        F.max_by(item, F.col("_rk") == 1).alias("reading"),
        F.array_sort(
            F.collect_list(F.when(F.col("_rk") > 1, F.struct(F.col(ts).alias("_t"), F.col(tiebreak).alias("_id"), item.alias("r")))),
        ).alias("_h"),
    ).select(key, "reading", F.transform("_h", lambda x: x["r"]).alias("history"))


def newest_first(history) -> F.Column:
    """sort history by date descending, stable for equal dates (original position breaks ties)."""
    indexed = F.transform(history, lambda x, i: F.struct(x.alias("r"), i.alias("i")))
    ordered = F.array_sort(
        indexed,
        lambda a, b: F.when(a["r"]["date"] > b["r"]["date"], -1)
        .when(a["r"]["date"] < b["r"]["date"], 1)
        .when(a["i"] < b["i"], -1)
        .when(a["i"] > b["i"], 1)
        .otherwise(0),
    )
    return F.transform(F.slice(ordered, 1, MAX_HISTORY), lambda x: x["r"])


def feature_rows(requests: DataFrame, feature_cols: Sequence[str], value_cols: Sequence[str],
                 key: str | None = None, encoding: DataFrame | None = None, global_mean=None,
                 encoding_col: str = "city_target_enc") -> DataFrame:
    """C4: model input per request as float32: current values, ``{c}_lag{k}`` from the k-th newest history
    entry, every other feature 0.0 (trailing means and the encoding included, like the serving path).
    With ``encoding`` (a fit_encoding table keyed like ``key``) and ``global_mean``, the encoding feature is
    looked up instead (J1) - the fix for the serving skew, off by default for parity."""
    if encoding is not None and key is not None:
        from driftwise.operators.features import apply_encoding

        requests = apply_encoding(requests, encoding, key, global_mean, out="_enc")
    hist = newest_first(F.col("history"))
    exprs = []
    for f in feature_cols:
        val = None
        if f in value_cols:
            val = F.col("reading")[f]
        else:
            for c in value_cols:
                prefix = f"{c}_lag"
                if f.startswith(prefix) and f[len(prefix):].isdigit():
                    k = int(f[len(prefix):])
                    if 1 <= k <= MAX_HISTORY:
                        val = F.try_element_at(hist, F.lit(k))[c]
        if f == encoding_col and encoding is not None and key is not None:
            val = F.col("_enc")
        exprs.append(F.coalesce(val, F.lit(0.0)).cast("float").alias(f) if val is not None
                     else F.lit(0.0).cast("float").alias(f))
    keep = [key] if key else []
    return requests.select(*keep, *exprs)


def score(rows: DataFrame, model, feature_cols: Sequence[str], model_version: str, model_family: str,
          created_at) -> DataFrame:
    """Predict with a fitted PipelineModel (its first stage assembles the feature vector) and stamp
    version/family/created_at (a literal or scalar Column)."""
    pred = model.transform(rows)
    pred = pred.drop(*[c for c in pred.columns if re.fullmatch(r"_f\d+", c)])
    return pred.select(
        *[c for c in rows.columns if c not in feature_cols],
        F.col("prediction").alias("predicted_aqi"),
        F.lit(model_version).alias("model_version"),
        F.lit(model_family).alias("model_family"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
    )

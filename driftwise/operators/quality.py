"""Data-quality operators (P1-P6, P14, P15). Every check over the data is one aggregate pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.exprs import col as qcol
from driftwise.functions.exprs import json_field, parse_double, parse_ts, pct_text
from driftwise.params import POLLUTANT_ALIASES, ValidateParams


def _is_missing(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.DoubleType | T.FloatType):
        return qcol(c).isNull() | F.isnan(qcol(c))
    return qcol(c).isNull()


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    """Required columns that are absent, sorted (schema-only, no job)."""
    return sorted(set(required) - set(df.columns))


def missing_profile(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """P2 + P3: (column_name, position, n_rows, missing_pct rounded to 4, over_threshold on the unrounded
    fraction, strict >). One aggregate over all columns, then unpivoted to one row per column."""
    cols = df.columns
    one = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(_is_missing(df, c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)],
    )
    entries = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"_m{i}").alias("frac"))
        for i, c in enumerate(cols)
    ])
    return one.select(F.col("_n").alias("n_rows"), F.inline(entries)).select(
        "column_name", "position", "n_rows",
        F.round("frac", 4).alias("missing_pct"),
        (F.col("frac") > F.lit(threshold)).alias("over_threshold"),
        "frac",
    )


def date_check(df: DataFrame, date_col: str) -> DataFrame:
    """P5: unparseable dates (originally-null dates count too)."""
    parsed = parse_ts(qcol(date_col))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(parsed.isNull().cast("long")).alias("unparseable_dates"),
        F.sum(qcol(date_col).isNull().cast("long")).alias("null_dates"),
    )


def validate(df: DataFrame, params: ValidateParams) -> DataFrame:
    """One-row report. Errors (missing required columns, too few rows) fail; warnings do not.

    Columns: n_rows, n_columns, columns, missing_required, missing_pct_per_column (map), target_missing_pct,
    unparseable_dates, errors, warnings, passed."""
    cols = df.columns
    miss = missing_columns(df, params.required_columns)
    has_target = params.target in cols
    has_date = params.date_col in cols
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs += [F.avg(_is_missing(df, c).cast("double")).alias(f"_m{i}") for i, c in enumerate(cols)]
    if has_date:
        aggs.append(F.sum(parse_ts(qcol(params.date_col)).isNull().cast("long")).alias("unparseable_dates"))
    one = df.agg(*aggs)
    thr_txt = f"{params.max_missing_pct:.0%}"
    errors: list[Column] = []
    if miss:
        errors.append(F.lit(f"Required columns not found: {miss}"))
    errors.append(F.when(
        F.col("n_rows") < params.min_rows,
        F.concat(F.lit("Only "), F.col("n_rows").cast("string"), F.lit(f" rows, fewer than {params.min_rows}")),
    ))
    warnings: list[Column] = [
        F.when(
            F.col(f"_m{i}") > params.max_missing_pct,
            F.concat(F.lit(f"Column '{c}' is "), pct_text(F.col(f"_m{i}")), F.lit(f" empty (allowed: {thr_txt})")),
        )
        for i, c in enumerate(cols)
    ]
    if has_target:
        t = F.col(f"_m{cols.index(params.target)}")
        warnings.append(F.when(
            t > params.target_missing_warn,
            F.concat(F.lit(f"Target '{params.target}' is "), pct_text(t), F.lit(" empty; rows without a target are dropped")),
        ))
    if has_date:
        warnings.append(F.when(
            F.col("unparseable_dates") > 0,
            F.concat(F.col("unparseable_dates").cast("string"), F.lit(f" dates that do not parse in '{params.date_col}'")),
        ))
    pct_map = F.map_from_arrays(
        F.array(*[F.lit(c) for c in cols]), F.array(*[F.round(F.col(f"_m{i}"), 4) for i in range(len(cols))])
    )
    return one.select(
        "n_rows",
        F.lit(len(cols)).alias("n_columns"),
        F.array(*[F.lit(c) for c in cols]).alias("columns"),
        F.array(*[F.lit(c) for c in miss]).cast("array<string>").alias("missing_required"),
        pct_map.alias("missing_pct_per_column"),
        (F.round(F.col(f"_m{cols.index(params.target)}"), 4) if has_target else F.lit(None).cast("double"))
        .alias("target_missing_pct"),
        (F.col("unparseable_dates") if has_date else F.lit(None).cast("long")).alias("unparseable_dates"),
        F.array_compact(F.array(*errors)).alias("errors"),
        F.array_compact(F.array(*warnings)).alias("warnings"),
    ).withColumn("passed", F.size("errors") == 0)


def range_violations(df: DataFrame, ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per column, values outside the inclusive [low, high] range. Missing columns are skipped."""
    cols = [c for c in ranges if c in df.columns]
    aggs = []
    for i, c in enumerate(cols):
        lo, hi = ranges[c]
        v = qcol(c)
        aggs += [
            F.count(v).alias(f"_c{i}"),
            F.sum(v.isNull().cast("long")).alias(f"_n{i}"),
            F.sum((v < lo).cast("long")).alias(f"_b{i}"),
            F.sum((v > hi).cast("long")).alias(f"_a{i}"),
        ]
    one = df.agg(*aggs)
    entries = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.lit(float(ranges[c][0])).alias("low"),
            F.lit(float(ranges[c][1])).alias("high"), F.col(f"_c{i}").alias("n_checked"),
            F.col(f"_n{i}").alias("n_null"), F.coalesce(F.col(f"_b{i}"), F.lit(0)).alias("n_below"),
            F.coalesce(F.col(f"_a{i}"), F.lit(0)).alias("n_above"),
        )
        for i, c in enumerate(cols)
    ])
    return one.select(F.inline(entries)).withColumn("n_violations", F.col("n_below") + F.col("n_above"))


def split_payloads(df: DataFrame, body_col: str, id_col: str, fields: Sequence[str]) -> DataFrame:
    """Parse JSON request bodies into typed columns and mark each accepted or rejected.

    ``city`` and ``date`` must be non-null text; every pollutant field (canonical or alias spelling) must be
    absent/null or castable to double. ``reject_reason`` names the first failing rule."""
    body = F.col(body_col)
    alias_of = {v: k for k, v in POLLUTANT_ALIASES.items()}
    city = json_field(body, "city")
    date = json_field(body, "date")
    outs = [F.col(id_col), city.alias("city"), date.alias("date")]
    reasons = [
        F.when(city.isNull(), F.lit("missing city")),
        F.when(date.isNull(), F.lit("missing date")),
    ]
    for f in fields:
        raw = json_field(body, f)
        if f in alias_of:
            raw = F.coalesce(raw, json_field(body, alias_of[f]))
        val = parse_double(raw)
        outs.append(val.alias(f))
        reasons.append(F.when(raw.isNotNull() & val.isNull(), F.lit(f"not a number: {f}")))
    reason = F.coalesce(*reasons)
    return df.select(*outs, reason.alias("reject_reason")).withColumn("accepted", F.col("reject_reason").isNull())

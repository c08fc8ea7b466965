"""Feature operators: impute (W1, A2, W2), lags (W3), trailing means (W4), target encoding (A1, J1),
and the full feature pipeline (C1 with P7, P8, P9, P11)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.functions.exprs import col as qcol
from driftwise.operators.ordering import assign_segments, drop_segments, keyed_ffill, keyed_lag_roll
from driftwise.operators.quantiles import grouped_quantiles
from driftwise.params import FeatureParams


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Keep the wanted columns that exist, in the wanted order; missing ones are skipped silently."""
    have = set(df.columns)
    return [c for c in cols if c in have]


def forward_fill(df: DataFrame, p: FeatureParams, cols: Sequence[str] | None = None) -> DataFrame:
    """Per-key forward fill in (ts, tiebreak) order; leading nulls stay null. Rows with a null key
    get no fill (a null key is not a group)."""
    cols = present(df, cols if cols is not None else p.pollutants)
    keyed = df.where(F.col(p.key).isNotNull())
    unkeyed = df.where(F.col(p.key).isNull())
    filled = drop_segments(keyed_ffill(keyed, p.key, p.ts, p.tiebreak, cols, p.skew))
    # A null key is not a group: its rows get no fill value at all (they fall out at the lag stage).
    unkeyed = unkeyed.withColumns({c: F.lit(None).cast(unkeyed.schema[c].dataType) for c in cols})
    return filled.unionByName(unkeyed)


def median_fill(df: DataFrame, cols: Sequence[str], n_upper: int | None = None) -> DataFrame:
    """A2 + W2: fill remaining nulls with the column-wide median (not per key), exact with interpolation.
    The medians are computed distributed (see ``grouped_quantiles``) and applied as literals."""
    cols = present(df, cols)
    if not cols:
        return df
    wide = df.select(*[qcol(c).cast("double").alias(c) for c in cols])
    meds = grouped_quantiles(wide.unpivot([], [qcol(c) for c in cols], "feature", "value"), "feature", "value", [0.5], n_upper=n_upper)
    return df.withColumns({
        c: F.coalesce(qcol(c), F.lit(meds.get(c, [None])[0]).cast(df.schema[c].dataType)) for c in cols
    })


def impute(df: DataFrame, p: FeatureParams, cols: Sequence[str] | None = None, cache: list | None = None) -> DataFrame:
    """W1 + A2 + W2. The forward-filled frame feeds both the median job and the result, so it is persisted
    (spill-able) and the ordered shuffle runs once; pass ``cache`` to collect it for ``unpersist``."""
    cols = present(df, cols if cols is not None else p.pollutants)
    filled = forward_fill(df, p, cols).persist(StorageLevel.MEMORY_AND_DISK)
    if cache is not None:
        cache.append(filled)
    return median_fill(filled, cols)


def remaining_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Total nulls left across the given columns."""
    cols = present(df, cols)
    total = sum((F.sum(qcol(c).isNull().cast("long")) for c in cols), F.lit(0).cast("long"))
    return df.agg(F.coalesce(total, F.lit(0)).alias("remaining_nulls"))


def add_lags_and_rolls(
    df: DataFrame, p: FeatureParams, cols: Sequence[str] | None = None,
    lags: Sequence[int] | None = None, rolls: Sequence[int] | None = None,
) -> DataFrame:
    """W3 + W4 in one (partition, order) spec: one shuffle, one sort for all of them."""
    cols = present(df, cols if cols is not None else p.pollutants)
    lags = p.lags if lags is None else lags
    rolls = p.rolls if rolls is None else rolls
    keyed = df.where(F.col(p.key).isNotNull())
    out = drop_segments(keyed_lag_roll(keyed, p.key, p.ts, p.tiebreak, cols, lags, rolls, p.skew))
    unkeyed = df.where(F.col(p.key).isNull())
    return out.unionByName(unkeyed, allowMissingColumns=True)


def fit_encoding(df: DataFrame, key: str, target: str) -> DataFrame:
    """Per-key target mean plus the global mean (null keys count in the global mean only).

    One row per non-null key: (key, n_target, key_mean, global_mean)."""
    glob = df.agg(F.avg(target)).scalar()
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(target).alias("n_target"), F.avg(target).alias("key_mean"))
        .withColumn("global_mean", glob)
    )


def apply_encoding(df: DataFrame, enc: DataFrame, key: str, global_mean, out: str = "city_target_enc",
                   enc_key: str | None = None) -> DataFrame:
    """Lookup with default ``global_mean`` (a Column, e.g. a scalar subquery). The map has one row per
    key, so it grows with the data: no unconditional broadcast hint; AQE broadcasts it only when its
    measured size is under the threshold, else it is a shuffle join."""
    enc_key = enc_key or key
    m = enc.select(F.col(enc_key).alias("_ek"), F.col("key_mean").alias("_km"))
    return (
        df.join(m, F.col(key) == F.col("_ek"), "left")
        .withColumn(out, F.coalesce(F.col("_km"), global_mean))
        .drop("_ek", "_km")
    )


def build_features(df: DataFrame, p: FeatureParams, cache: list | None = None) -> DataFrame:
    """P7 -> W1 -> A2/W2 -> W3+W4 -> A1/J1 -> P8 -> P9. Windows see rows whose target is null.

    Forward fill and lags/means share one (key, segment) partitioning: one shuffle of the data for all
    ordered features. The median is one aggregate over the forward-filled values. Null-key rows only
    matter for the global target mean (they never get lags), so they leave before the windows.

    ``cache``: when given, persisted intermediates are appended so the caller can ``unpersist`` them once
    the features are written."""
    cols = present(df, p.pollutants)
    d = df.where(F.col(p.ts).isNotNull())                                  # P7
    keyed = d.where(F.col(p.key).isNotNull())                              # T5: null key cannot lag
    seg, has_hot, total = assign_segments(keyed, p.key, p.ts, p.skew, with_total=True, tiebreak=p.tiebreak)
    filled = keyed_ffill(seg, p.key, p.ts, p.tiebreak, cols, p.skew, has_hot=has_hot)   # W1
    # The median job and the feature plan both read the forward-filled frame: keep it (spill-able) so the
    # ordered shuffle runs once; the cached frame keeps its (key) partitioning, so the lag/mean window reads
    # it without another exchange. Lost blocks are recomputed from lineage. Callers release via ``cache``.
    filled = filled.persist(StorageLevel.MEMORY_AND_DISK)
    if cache is not None:
        cache.append(filled)
    imputed = median_fill(filled, cols, n_upper=total)                    # A2, W2
    feats = drop_segments(keyed_lag_roll(imputed, p.key, p.ts, p.tiebreak, cols, p.lags, p.rolls, p.skew,
                                         has_hot=has_hot))                 # W3, W4
    if p.target in df.columns:
        dated = df.where(F.col(p.ts).isNotNull()).select(p.key, p.target)
        enc = fit_encoding(dated, p.key, p.target)                         # A1 on all dated rows
        feats = apply_encoding(feats, enc, p.key, dated.agg(F.avg(p.target)).scalar())  # J1
        feats = feats.where(F.col(p.target).isNotNull())                   # P8
    return drop_warmup(feats)


def drop_warmup(df: DataFrame) -> DataFrame:
    """Drop rows where any column whose name contains '_lag' is null."""
    lag_cols = [c for c in df.columns if "_lag" in c]
    if not lag_cols:
        return df
    cond = None
    for c in lag_cols:
        cond = qcol(c).isNotNull() if cond is None else cond & qcol(c).isNotNull()
    return df.where(cond)

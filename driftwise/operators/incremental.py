"""C2 kept up to date: the feature table after new feedback, recomputed only where the feedback reaches.

The state is four tables under one root. ``rows`` (merged readings), ``counts`` (how often each forward-filled value
stands) and ``features`` are partitioned by ``part``, a hash of the key; ``fit`` has one row: the number of parts and the
medians that the features were made with. New feedback goes this way:

1. the parts of its keys are merged anew (latest wins) and overwritten, and so are their counts;
2. the medians come from the counts, which are sums over a change and not a pass over the rows;
3. the features of these parts are made anew. A median reaches other parts only through values that have nothing
   before them to be filled from; where a median changed, the parts that hold such values of that column are made anew too.

All writes are dynamic partition overwrites of whole parts, and ``fit`` comes last: the same feedback given again, also
after a run that died in between, leads to the same state. One writer at a time. Rows without key or time have no features
and are not kept. Parts never lose rows (rows without features are marked, not left out), so no part goes stale by
becoming empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.functions.exprs import col as qcol
from driftwise.operators.features import apply_encoding, fit_encoding, present
from driftwise.operators.ordering import assign_segments, drop_segments, keyed_ffill, keyed_lag_roll
from driftwise.operators.quantiles import counted_medians
from driftwise.params import FeatureParams

PART, KEPT, SOURCE = "_part", "_kept", "_src"


def _replace(df: DataFrame, path: str) -> None:
    """Overwrite the parts that ``df`` holds; large parts are written by several tasks."""
    (df.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path))


def _of_parts(spark: SparkSession, path: str, parts: Sequence[int] | None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if parts is None else df.where(F.col(PART).isin([int(x) for x in parts]))


def _keyed(df: DataFrame, p: FeatureParams, n_parts: int, source: int) -> DataFrame:
    part = F.pmod(F.xxhash64(F.col(p.key)), F.lit(n_parts)).cast("int")
    return df.where(F.col(p.key).isNotNull() & F.col(p.ts).isNotNull()).withColumn(PART, part).withColumn(SOURCE, F.lit(source))


def _latest(rows: DataFrame, p: FeatureParams, stamp: str) -> DataFrame:
    """One row per (key, time): feedback before readings, then the latest."""
    keys = [PART, p.key, p.ts]
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*[qcol(c).alias(c) for c in rest]), F.struct(SOURCE, stamp, p.tiebreak))
    return rows.groupBy(*keys).agg(best.alias("_b")).select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest])


def _filled(rows: DataFrame, p: FeatureParams) -> tuple[DataFrame, bool]:
    seg, has_hot = assign_segments(rows, p.key, p.ts, p.skew, tiebreak=p.tiebreak)
    return keyed_ffill(seg, p.key, p.ts, p.tiebreak, present(rows, p.pollutants), p.skew, has_hot=has_hot), has_hot


def _counted(rows: DataFrame, p: FeatureParams) -> DataFrame:
    """(part, feature, value, n): how often each forward-filled value stands; a null value is one that the median fills."""
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), qcol(c).cast("double").alias("value")) for c in present(rows, p.pollutants)])
    long = _filled(rows, p)[0].select(PART, F.inline(entries))
    return long.groupBy(PART, "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def _built(rows: DataFrame, p: FeatureParams, medians: dict) -> DataFrame:
    """Features of whole keys with given medians; ``_kept`` marks the rows of the feature table."""
    cols = present(rows, p.pollutants)
    filled, has_hot = _filled(rows, p)
    filled = filled.withColumns({c: F.coalesce(qcol(c), F.lit(medians.get(c)).cast(rows.schema[c].dataType)) for c in cols})
    feats = drop_segments(keyed_lag_roll(filled, p.key, p.ts, p.tiebreak, cols, p.lags, p.rolls, p.skew, has_hot=has_hot))
    kept = [qcol(c).isNotNull() for c in feats.columns if "_lag" in c]
    if p.target in rows.columns:
        # The default of the encoding would only reach keys without any target, and these rows have no features.
        feats = apply_encoding(feats, fit_encoding(rows, p.key, p.target), p.key, F.lit(None).cast("double"))
        kept.append(F.col(p.target).isNotNull())
    whole = F.lit(True)
    for k in kept:
        whole = whole & k
    return feats.withColumn(KEPT, whole)


def _bring_up(spark: SparkSession, root: str, p: FeatureParams, n_parts: int, parts: Sequence[int] | None, old: dict | None) -> list[int] | None:
    """Counts, medians and features after the rows of ``parts`` (None: all) changed; returns the parts made anew."""
    _replace(_counted(_of_parts(spark, f"{root}/rows", parts), p), f"{root}/counts")
    counts = spark.read.parquet(f"{root}/counts")
    medians = counted_medians(counts, "feature", "value", "n")
    if parts is not None and medians != old:
        moved = [c for c in {*medians, *old} if medians.get(c) != old.get(c)]
        reached = counts.where(F.col("value").isNull() & F.col("feature").isin(moved)).select(PART).distinct().collect()   # at most n_parts
        parts = sorted({*parts, *(r[0] for r in reached)})
    _replace(_built(_of_parts(spark, f"{root}/rows", parts), p, medians), f"{root}/features")
    fit = spark.createDataFrame([(n_parts, medians)], "n_parts int, medians map<string,double>")
    fit.coalesce(1).write.mode("overwrite").parquet(f"{root}/fit")
    return parts


def start(base: DataFrame, feedback: DataFrame, root: str, p: FeatureParams, n_parts: int = 64, stamp: str = "feedback_at") -> None:
    """The state of readings and the feedback so far. ``n_parts`` bounds what a change of one key rewrites."""
    rows = _keyed(base, p, n_parts, 0).unionByName(_keyed(feedback, p, n_parts, 1), allowMissingColumns=True)
    if rows.isEmpty():
        raise ValueError("no row has a key and a time")
    _latest(rows, p, stamp).hint("rebalance", PART).write.mode("overwrite").partitionBy(PART).parquet(f"{root}/rows")
    _bring_up(base.sparkSession, root, p, n_parts, None, None)


def add_feedback(spark: SparkSession, feedback: DataFrame, root: str, p: FeatureParams, stamp: str = "feedback_at") -> list[int]:
    """Take new feedback into the state; returns the parts whose features were made anew (none without feedback)."""
    fit = spark.read.parquet(f"{root}/fit").first()
    new = _keyed(feedback, p, fit["n_parts"], 1)
    parts = sorted(r[0] for r in new.select(PART).distinct().collect())          # at most n_parts
    if not parts:
        return []
    rows = _of_parts(spark, f"{root}/rows", parts)
    _replace(_latest(rows.unionByName(new, allowMissingColumns=True).select(*rows.columns), p, stamp), f"{root}/rows")
    return _bring_up(spark, root, p, fit["n_parts"], parts, dict(fit["medians"]))


def load(spark: SparkSession, root: str, stamp: str = "feedback_at") -> DataFrame:
    """The feature table."""
    return spark.read.parquet(f"{root}/features").where(KEPT).drop(PART, KEPT, SOURCE, stamp)

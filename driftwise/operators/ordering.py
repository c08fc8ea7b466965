"""Ordered-window building blocks that stay balanced under skew.

* ``refine_ranges``: cuts a heavy group into contiguous (ts, tiebreak)-ordered ranges of about
  ``segment_rows`` rows - by time, by tiebreak where rows share one timestamp, recursively where one heavy
  instant sits inside a longer range; one bounded broadcast and one partial aggregate per level.
* ``global_ordinal``: a total order over the whole table without ``Window.orderBy`` on one partition
  (row counts per bucket -> offsets computed from that small table -> ``row_number`` inside buckets; heavy
  buckets refined as above).
* ``assign_segments``: keys with more than ``hot_key_rows`` rows are cut into ranges as above, so no window
  task ever holds a whole hot key. Cold keys keep one segment (0) and the plain per-key window.
* ``keyed_ffill`` / ``keyed_lag_roll``: per-key forward fill, lags and trailing means, computed per
  (key, segment) and made exact across segment borders: forward fill takes a carried-in value per segment;
  lags/means recompute only the first K rows of each hot segment with a halo of the K preceding rows.

All side tables that are broadcast are bounded by construction: the hot-key table by
total_rows / hot_key_rows, the segment tables by total_rows / segment_rows + number of hot keys, the
bucket table by ``max_buckets``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftwise.functions.exprs import col as qcol
from driftwise.functions.exprs import epoch_seconds
from driftwise.params import SkewParams

SEG = "_seg"
HOT = "_hot"


def _order(ts: str, tiebreak: str, desc: bool = False) -> list[Column]:
    if desc:
        return [F.col(ts).desc_nulls_last(), F.col(tiebreak).desc_nulls_last()]
    return [F.col(ts).asc_nulls_first(), F.col(tiebreak).asc_nulls_first()]


# ---------------------------------------------------------------------------
# Global ordinal
# ---------------------------------------------------------------------------
def tiebreak_value(df: DataFrame, c: str | None) -> Column:
    """A number that never decreases along the tiebreak's order, used only to cut heavy groups into ranges:
    the value itself for numbers; for strings the first 7 UTF-8 bytes read as a big-endian integer (byte
    order is Spark's string order, shorter strings padded with zero bytes); null otherwise."""
    if c is None:
        return F.lit(None).cast("double")
    dt = df.schema[c].dataType
    if isinstance(dt, T.NumericType):
        return qcol(c).cast("double")
    if isinstance(dt, T.StringType):
        prefix = F.substring(F.rpad(F.hex(F.encode(qcol(c), "UTF-8")), 14, "0"), 1, 14)
        return F.conv(prefix, 16, 10).cast("double")
    return F.lit(None).cast("double")


def _numeric_order_value(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType
    if isinstance(dt, T.TimestampType | T.TimestampNTZType | T.DateType):
        return epoch_seconds(qcol(c))
    return qcol(c).cast("double")


# ---------------------------------------------------------------------------
# Recursive range splitting of heavy groups
# ---------------------------------------------------------------------------
def _splittable(st) -> bool:
    n, tmn, tmx, bmn, bmx = st
    return (tmn is not None and tmx is not None and tmx > tmn) or (bmn is not None and bmx is not None and bmx > bmn)


def refine_ranges(d: DataFrame, group_cols: Sequence[str], roots: dict, segment_rows: int,
                  max_depth: int = 8, fanout_cap: int = 4096):
    """Cut heavy groups into contiguous (ts, tiebreak)-ordered sub-ranges of at most about ``segment_rows``.

    ``d`` carries ``_ep`` (numeric order value) and ``_tb`` (numeric tiebreak or null); ``roots`` maps a
    group tuple to (n, min _ep, max _ep, min _tb, max _tb). A heavy node is cut into equal-width ranges of
    ``_ep`` - or of ``_tb`` when all its rows share one order value - and children that are still heavy are
    cut again (a single heavy instant inside a long range is isolated after a few levels, then split by
    tiebreak). Each level is one bounded broadcast join (node -> cut parameters) and one partial aggregate
    over the rows of the cut nodes. Returns (frame with ``_path`` array<long>, {group: [(path, n), ...]}
    in order); rows of untouched groups have an empty path."""
    spark = d.sparkSession
    gtypes = {c: d.schema[c].dataType.simpleString() for c in group_cols}
    d = d.withColumn("_path", F.array().cast("array<bigint>"))
    leaves = {g: {(): st} for g, st in roots.items()}
    frontier = [(g, (), st) for g, st in roots.items() if st[0] > segment_rows and _splittable(st)]
    depth = 0
    while frontier and depth < max_depth:
        specs = []
        for g, path, st in frontier:
            n, tmn, tmx, bmn, bmx = st
            k = int(min(fanout_cap, max(2, -(-n // segment_rows))))
            by_time = tmn is not None and tmx is not None and tmx > tmn
            lo, hi = (tmn, tmx) if by_time else (bmn, bmx)
            specs.append((*g, list(path), by_time, float(lo), float(hi), k))
        ddl = ", ".join(f"`{c}` {gtypes[c]}" for c in group_cols) + \
            ", _path array<bigint>, _bytime boolean, _lo double, _hi double, _k bigint"
        spec_df = spark.createDataFrame(specs, ddl)      # bounded: one row per heavy node
        j = d.join(F.broadcast(spec_df), [*group_cols, "_path"], "left")
        x = F.when(F.col("_bytime"), F.col("_ep")).otherwise(F.col("_tb"))
        sub = F.coalesce(
            F.least(F.col("_k") - 1, F.floor((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + F.lit(1e-9)) * F.col("_k"))),
            F.lit(-1)).cast("bigint")                     # null order values sort first
        d = (j.withColumn("_new", F.col("_k").isNotNull())
             .withColumn("_path", F.when(F.col("_new"), F.concat("_path", F.array(sub))).otherwise(F.col("_path")))
             .drop("_bytime", "_lo", "_hi", "_k"))
        rows = (d.where("_new").groupBy(*group_cols, "_path")
                .agg(F.count(F.lit(1)).alias("n"), F.min("_ep").alias("a"), F.max("_ep").alias("b"),
                     F.min("_tb").alias("c"), F.max("_tb").alias("e")).collect())
        d = d.drop("_new")
        refined = {(g, path) for g, path, _ in frontier}
        for g, path in refined:
            leaves[g].pop(path, None)
        frontier = []
        for r in rows:
            g = tuple(r[c] for c in group_cols)
            path = tuple(r["_path"])
            st = (r["n"], r["a"], r["b"], r["c"], r["e"])
            leaves[g][path] = st
            if st[0] > segment_rows and _splittable(st):
                frontier.append((g, path, st))
        depth += 1
    ordered = {g: sorted(((p, st[0]) for p, st in lv.items()), key=lambda t: t[0]) for g, lv in leaves.items()}
    return d, ordered



def global_ordinal(
    df: DataFrame,
    ts: str,
    tiebreak: str,
    out: str = "_ord",
    bucket_seconds: float | None = None,
    segment_rows: int = 1_000_000,
    max_buckets: int = 200_000,
    with_count: bool = False,
):
    """Add ``out`` = 1-based position of each row in (ts, tiebreak) order (nulls first). ``ts`` may be a
    timestamp/date (fixed buckets of ``bucket_seconds``, default one hour) or any numeric column
    (``max_buckets`` equal-width buckets over its range).

    Plan: one partial aggregate gives the row count per bucket; that table (at most ``max_buckets`` rows)
    is read on the driver, where buckets heavier than ``segment_rows`` get sub-ranges and cumulative
    offsets are computed; the offsets travel back as a bounded broadcast table and each row's position is
    offset + ``row_number`` inside its (bucket, sub-range). Heavy buckets are refined recursively (see
    ``refine_ranges``): by time, by a numeric tiebreak where rows share one timestamp, so no task sorts more
    than about ``segment_rows`` rows unless they are identical in (timestamp, tiebreak).
    """
    spark = df.sparkSession
    ep = _numeric_order_value(df, ts)
    timey = isinstance(df.schema[ts].dataType, T.TimestampType | T.TimestampNTZType | T.DateType)
    if bucket_seconds is None and timey:
        bucket_seconds = 3600.0
    lo = 0.0
    if not bucket_seconds:
        span = df.agg(F.min(ep).alias("lo"), F.max(ep).alias("hi")).first()
        lo = span["lo"] if span["lo"] is not None else 0.0
        hi = span["hi"] if span["hi"] is not None else 0.0
        bucket_seconds = (hi - lo) / max_buckets + 1e-9
    width = float(bucket_seconds)

    def bucket_of(e):
        return F.coalesce(F.floor((e - F.lit(lo)) / F.lit(width)), F.lit(-(2 ** 62))).cast("bigint")

    tbv = tiebreak_value(df, tiebreak)
    stats = df.groupBy(bucket_of(ep).alias("_b")).agg(
        F.count(F.lit(1)).alias("n"), F.min(ep).alias("mn"), F.max(ep).alias("mx"),
        F.min(tbv).alias("tmn"), F.max(tbv).alias("tmx")).collect()
    if len(stats) > max_buckets and timey:   # very long time span: retry with wider buckets
        return global_ordinal(df, ts, tiebreak, out, width * (len(stats) // max_buckets + 1), segment_rows,
                              max_buckets, with_count)
    stats.sort(key=lambda r: r["_b"])
    # Heavy buckets are cut into ordered sub-ranges: by time, by tiebreak where rows share one timestamp
    # (date-granular data: a bucket is one day), recursively where a heavy instant sits inside a range.
    d = df.withColumn("_ep", ep).withColumn("_tb", tbv).withColumn("_b", bucket_of(F.col("_ep")))
    roots = {(r["_b"],): (r["n"], r["mn"], r["mx"], r["tmn"], r["tmx"]) for r in stats if r["n"] > segment_rows}
    if roots:
        d, leaves = refine_ranges(d, ["_b"], roots, segment_rows)
    else:
        d, leaves = d.withColumn("_path", F.array().cast("array<bigint>")), {}
    parts = []
    for r in stats:
        if (r["_b"],) in leaves:
            parts += [((r["_b"], list(p)), n) for p, n in leaves[(r["_b"],)]]
        else:
            parts.append(((r["_b"], []), r["n"]))
    offs, acc = [], 0
    for (b, path), n in parts:
        offs.append((int(b), path, acc))
        acc += n
    # bounded: one row per bucket (+ sub-ranges of heavy buckets)
    off_df = spark.createDataFrame(offs, "_b bigint, _path array<bigint>, _off bigint")
    d = d.join(F.broadcast(off_df), ["_b", "_path"])
    w = Window.partitionBy("_b", "_path").orderBy(*_order(ts, tiebreak))
    res = d.withColumn(out, F.col("_off") + F.row_number().over(w)).drop("_b", "_path", "_off", "_ep", "_tb")
    return (res, acc) if with_count else res


# ---------------------------------------------------------------------------
# Hot-key segmentation
# ---------------------------------------------------------------------------
def assign_segments(df: DataFrame, key: str, ts: str, skew: SkewParams, with_total: bool = False,
                    tiebreak: str | None = None):
    """Add ``_seg`` (segment id within key, monotone in (ts, tiebreak)) and ``_hot`` (key was split).
    A hot key is cut into ranges of about ``segment_rows`` rows by ``refine_ranges`` (time, then tiebreak
    for copies that share one timestamp).

    Returns (frame, has_hot) or, with ``with_total``, (frame, has_hot, total_rows). Finding hot keys is one
    partial aggregate (count/min/max per key, then max/sum over keys). When no key is hot the plan is the
    plain per-key window (no side tables, no fix-up branches)."""
    if SEG in df.columns and HOT in df.columns:
        return (df, True, None) if with_total else (df, True)
    ep = epoch_seconds(F.col(ts))
    tbv = tiebreak_value(df, tiebreak)
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("_kn"), F.min(ep).alias("_kmin"), F.max(ep).alias("_kmax"),
        F.min(tbv).alias("_tmin"), F.max(tbv).alias("_tmax"))
    # one job: total rows, and the hot keys themselves (at most total_rows / hot_key_rows of them)
    hot_item = F.when(F.col("_kn") > F.lit(skew.hot_key_rows),
                      F.struct(F.col(key).alias("k"), "_kn", "_kmin", "_kmax", "_tmin", "_tmax"))
    top = per_key.agg(F.sum("_kn").alias("tot"), F.collect_list(hot_item).alias("hot")).first()
    total = int(top["tot"] or 0)
    if not top["hot"]:
        out = df.withColumn(HOT, F.lit(False)).withColumn(SEG, F.lit(0).cast("long"))
        return (out, False, total) if with_total else (out, False)
    key_type = df.schema[key].dataType.simpleString()
    # Hot keys are cut into ordered ranges: by time, by tiebreak for copies sharing one timestamp,
    # recursively where one heavy instant sits inside a key's time range.
    roots = {(h["k"],): (h["_kn"], h["_kmin"], h["_kmax"], h["_tmin"], h["_tmax"]) for h in top["hot"]}
    d = df.withColumn("_ep", ep).withColumn("_tb", tbv)
    d, leaves = refine_ranges(d, [key], roots, skew.segment_rows)
    # segment id = position of the range within its key; one row per range (bounded), broadcast
    seg_rows = [(g[0], list(p), i) for g, lv in leaves.items() for i, (p, _) in enumerate(lv)]
    seg_df = df.sparkSession.createDataFrame(seg_rows, f"`{key}` {key_type}, _path array<bigint>, _sid bigint")
    d = d.join(F.broadcast(seg_df), [key, "_path"], "left")
    out = (
        d.withColumn(HOT, F.col("_sid").isNotNull())
        .withColumn(SEG, F.coalesce(F.col("_sid"), F.lit(0)).cast("long"))
        .drop("_sid", "_path", "_ep", "_tb")
    )
    return (out, True, total) if with_total else (out, True)


def _w(key: str, ts: str, tiebreak: str):
    return Window.partitionBy(key, SEG).orderBy(*_order(ts, tiebreak))


# ---------------------------------------------------------------------------
# Forward fill
# ---------------------------------------------------------------------------
def keyed_ffill(
    df: DataFrame, key: str, ts: str, tiebreak: str, cols: Sequence[str], skew: SkewParams,
    suffix: str = "", has_hot: bool | None = None,
) -> DataFrame:
    """Replace each column by the last non-null value at or before the row within its key.

    Output keeps ``_seg``/``_hot`` so later ordered steps reuse the same partitioning."""
    if has_hot is None:
        d, has_hot = assign_segments(df, key, ts, skew, tiebreak=tiebreak)
    else:
        d = df
    if not cols:
        return d
    wf = _w(key, ts, tiebreak).rowsBetween(Window.unboundedPreceding, 0)
    if not has_hot:
        filled = [F.last(qcol(c), ignorenulls=True).over(wf).alias(c + suffix) for c in cols]
        keep = [qcol(c) for c in d.columns if suffix or c not in cols]
        return d.select(*keep, *filled)
    order_struct = F.struct(F.col(ts), F.col(tiebreak))
    # Per hot segment: the last non-null value of each column (bounded table, see module doc).
    last_nn = d.where(F.col(HOT)).groupBy(key, SEG).agg(
        *[F.max_by(qcol(c), F.when(qcol(c).isNotNull(), order_struct)).alias(f"_ln{i}") for i, c in enumerate(cols)]
    )
    ws = Window.partitionBy(key).orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carry = last_nn.select(
        key, SEG, *[F.last(f"_ln{i}", ignorenulls=True).over(ws).alias(f"_ci{i}") for i in range(len(cols))]
    )
    d = d.join(F.broadcast(carry), [key, SEG], "left")
    filled = [
        F.coalesce(F.last(qcol(c), ignorenulls=True).over(wf), F.col(f"_ci{i}")).alias(c + suffix)
        for i, c in enumerate(cols)
    ]
    keep = [qcol(c) for c in d.columns if not c.startswith("_ci") and (suffix or c not in cols)]
    return d.select(*keep, *filled)


# ---------------------------------------------------------------------------
# Lags and trailing means
# ---------------------------------------------------------------------------
def _lag_roll_exprs(w, cols: Sequence[str], lags: Sequence[int], rolls: Sequence[int]) -> list[Column]:
    out = []
    for c in cols:
        for k in lags:
            out.append(F.lag(qcol(c), k).over(w).alias(f"{c}_lag{k}"))
    for c in cols:
        for k in rolls:
            out.append(F.avg(qcol(c)).over(w.rowsBetween(-k, -1)).alias(f"{c}_roll{k}"))
    return out


def keyed_lag_roll(
    df: DataFrame, key: str, ts: str, tiebreak: str, cols: Sequence[str],
    lags: Sequence[int], rolls: Sequence[int], skew: SkewParams, has_hot: bool | None = None,
) -> DataFrame:
    """Add ``{c}_lag{k}`` (row-position lag) and ``{c}_roll{k}`` (mean of the k previous rows, nulls skipped)."""
    if has_hot is None:
        d, has_hot = assign_segments(df, key, ts, skew, tiebreak=tiebreak)
    else:
        d = df
    if not cols or (not lags and not rolls):
        return d
    w = _w(key, ts, tiebreak)
    if not has_hot:
        return d.select(*[qcol(c) for c in d.columns], *_lag_roll_exprs(w, cols, lags, rolls))
    kmax = max(list(lags) + list(rolls))
    base_cols = [qcol(c) for c in d.columns]
    main = d.select(*base_cols, F.row_number().over(w).alias("_rn"), *_lag_roll_exprs(w, cols, lags, rolls))
    cold_or_settled = main.where(~(F.col(HOT) & (F.col("_rn") <= kmax))).drop("_rn")

    # Exact fix-up for the first kmax rows of every hot segment, using a halo of the kmax previous rows.
    hot = d.where(F.col(HOT))
    heads = (
        hot.withColumn("_r", F.row_number().over(_w(key, ts, tiebreak)))
        .where(F.col("_r") <= kmax).drop("_r").withColumn("_halo", F.lit(False))
    )
    tails = (
        hot.withColumn("_r", F.row_number().over(Window.partitionBy(key, SEG).orderBy(*_order(ts, tiebreak, True))))
        .where(F.col("_r") <= kmax).drop("_r")
    )
    # A tail row feeds every later segment whose first tail row is within the next kmax tail rows.
    wt = Window.partitionBy(key).orderBy(*_order(ts, tiebreak)).rowsBetween(1, kmax)
    halo = (
        tails.withColumn("_targets", F.array_except(F.collect_set(SEG).over(wt), F.array(F.col(SEG))))
        .withColumn(SEG, F.explode("_targets")).drop("_targets").withColumn("_halo", F.lit(True))
    )
    fix_in = heads.unionByName(halo)
    fixed = fix_in.select(
        *[qcol(c) for c in d.columns], "_halo", *_lag_roll_exprs(w, cols, lags, rolls)
    ).where(~F.col("_halo")).drop("_halo")
    return cold_or_settled.unionByName(fixed)


def drop_segments(df: DataFrame) -> DataFrame:
    return df.drop(SEG, HOT)

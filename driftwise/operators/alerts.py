"""Alert rules on an evaluation grid (C14), sustained-breach detection (W10) and dashboard panels.

Each rule is evaluated at grid points t (bucket ends, one every ``step`` seconds up to the last
observation) over a trailing range (t - range, t]. The raw logs are first reduced to one row per
grid bucket (partial aggregation). The grid is cut into blocks of a fixed number of points: only blocks that hold
an observation, or follow one that does, exist at all (windows elsewhere are empty, and an empty window is no
breach), and every ordered window runs inside one block. A breach alert fires at the first grid point where the
condition has held without a gap for ``for`` seconds (gaps-and-islands); islands that touch a block's border are
merged from the per-block islands.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.functions.exprs import epoch_seconds, ntz_from_seconds
from driftwise.operators.train import materialize
from driftwise.params import LATENCY_BUCKETS_S


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    threshold: float
    range_s: int
    for_s: int
    step_s: int


# The four alert rules (name, severity, threshold, range, for, evaluation interval).
ERROR_RATE_RULE = Rule("HighInferenceErrorRate", "critical", 0.05, 300, 120, 30)
LATENCY_P95_RULE = Rule("HighInferenceLatencyP95", "warning", 0.2, 300, 300, 30)
DRIFT_RULE = Rule("ModelDriftDetected", "warning", 0.2, 86400, 600, 60)
RMSE_RULE = Rule("ModelPerformanceDecay", "warning", 15.0, 86400, 600, 60)


def bucket_end(ts: Column, step_s: int) -> Column:
    """End of the ``step_s`` bucket holding ts, in epoch seconds (bucket = (end - step, end])."""
    return ((F.ceil(epoch_seconds(ts) / step_s)) * step_s).cast("long")


#: Grid points of a block, at least; a trailing range never reaches further back than the block before.
BLOCK_POINTS = 1024


def _block_length(range_s: int, step_s: int) -> int:
    """Seconds of a block: a multiple of the step, and not shorter than the trailing range."""
    return step_s * max(BLOCK_POINTS, -(-range_s // step_s))


def _block(length: int | Column) -> Column:
    return F.floor(F.col("_t") / length).cast("long")


def occupied_grid(per_bucket: DataFrame, range_s: int, step_s: int, after_s: int = 0) -> DataFrame:
    """Grid points ``_t`` of every block that holds a bucket and of the block behind it, up to ``after_s`` seconds past
    the last bucket. All other points have empty trailing ranges, so a stray timestamp adds two blocks and no more."""
    length = _block_length(range_s, step_s)
    blocks = per_bucket.select(_block(length).alias("_b")).distinct()
    blocks = blocks.select(F.explode(F.array(F.col("_b"), F.col("_b") + 1)).alias("_b")).distinct()
    start = F.col("_b") * length
    points = blocks.select(F.explode(F.sequence(start, start + (length - step_s), F.lit(step_s).cast("long"))).alias("_t"))
    return points.where(F.col("_t") <= per_bucket.agg(F.max("_t") + after_s).scalar())


def trailing_sums(g: DataFrame, cols: Sequence[str], range_s: int, step_s: int, part: Sequence[str] = (),
                  exact_decimal: Sequence[str] = ()) -> DataFrame:
    """Replace each column by its sum over the trailing range (t - range, t] of an ``occupied_grid``.

    Computed per block as running sum minus the running sum ``range / step`` rows earlier: both are linear-time
    window frames (a sliding RANGE frame would re-aggregate the whole frame for every row). The last
    ``range / step`` rows of a block also go to the next one as a halo. Columns in ``exact_decimal`` accumulate as
    DECIMAL(38, 9) so the subtraction is exact."""
    k, length = range_s // step_s, _block_length(range_s, step_s)
    w = Window.partitionBy(*part, "_b").orderBy("_t")
    keep = [c for c in g.columns if c not in cols]
    own = _block(length)
    halo = F.col("_t") - own * length >= length - range_s
    rows = g.select(*g.columns, F.explode(F.when(halo, F.array(own, own + 1)).otherwise(F.array(own))).alias("_b"))

    def acc(c):
        return F.col(c).cast("decimal(38,9)") if c in exact_decimal else F.col(c)

    run = rows.select(*keep, "_b", *[F.sum(acc(c)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in cols])
    out = run.select(*keep, "_b", *[(F.col(c) - F.coalesce(F.lag(c, k).over(w), F.lit(0))).alias(c) for c in cols])
    out = out.where(F.col("_b") == own)
    return out.select(*keep, *[(F.col(c).cast("double") if c in exact_decimal else F.col(c)).alias(c) for c in cols])


def request_grid(requests: DataFrame, rule: Rule, les: Sequence[float] = LATENCY_BUCKETS_S) -> DataFrame:
    """One pass over the request log: per grid step the request count, the 5xx count and the cumulative
    latency bucket counts, summed over the trailing range on the grid. Every request rule (error
    ratio, latency quantile) is a projection of this table."""
    d = F.col("duration_s")
    b = requests.groupBy(bucket_end(F.col("ts"), rule.step_s).alias("_t")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col("status").like("5__").cast("long")).alias("_n5"),
        *[F.sum(F.when(d <= F.lit(float(le)), 1).otherwise(0)).alias(f"_c{i}") for i, le in enumerate(les)],
        F.count(d).alias(f"_c{len(les)}"),
    )
    b = materialize(b)          # the grid reads it three times; the log is read once
    names = ["_n", "_n5"] + [f"_c{i}" for i in range(len(les) + 1)]
    g = occupied_grid(b, rule.range_s, rule.step_s).join(b, "_t", "left").na.fill(0, names)
    return trailing_sums(g, names, rule.range_s, rule.step_s)


def error_rate_series(requests: DataFrame, rule: Rule = ERROR_RATE_RULE, grid: DataFrame | None = None) -> DataFrame:
    """(t, value): 5xx share of requests in (t - range, t]."""
    g = grid if grid is not None else request_grid(requests, rule)
    return g.select("_t", F.try_divide(F.col("_n5"), F.col("_n")).alias("value"))


def _hq(les: Sequence[float], cum: list[Column], q: float) -> Column:
    """Prometheus histogram_quantile for fixed finite bounds ``les`` and cumulative counts ``cum``
    (len(les) + 1 entries, the last one +Inf)."""
    n = len(les)
    total = cum[n]
    rank = F.lit(float(q)) * total
    idx = None
    for i in range(n):
        idx = F.when(cum[i] >= rank, F.lit(i)) if idx is None else idx.when(cum[i] >= rank, F.lit(i))
    idx = idx.otherwise(F.lit(n))
    les_a = F.array(*[F.lit(float(x)) for x in les])
    cum_a = F.array(*cum)
    end = F.element_at(les_a, idx + 1)
    start = F.when(idx == 0, F.lit(0.0)).otherwise(F.element_at(les_a, F.greatest(idx, F.lit(1))))
    prev = F.when(idx == 0, F.lit(0)).otherwise(F.element_at(cum_a, F.greatest(idx, F.lit(1))))
    cnt = F.element_at(cum_a, idx + 1) - prev
    interp = start + (end - start) * F.try_divide(rank - prev, cnt)
    return (
        F.when(total.isNull() | (total == 0), F.lit(None).cast("double"))
        .when(idx == n, F.lit(float(les[-1])))
        .when((idx == 0) & (F.lit(float(les[0])) <= 0), F.lit(float(les[0])))
        .otherwise(interp)
    )


def latency_p95_series(requests: DataFrame, rule: Rule = LATENCY_P95_RULE,
                       les: Sequence[float] = LATENCY_BUCKETS_S, q: float = 0.95,
                       grid: DataFrame | None = None) -> DataFrame:
    """(t, value): histogram_quantile(q) of request durations over (t - range, t]."""
    g = grid if grid is not None else request_grid(requests, rule, les)
    names = [f"_c{i}" for i in range(len(les) + 1)]
    return g.select("_t", _hq(les, [F.col(c) for c in names], q).alias("value"))


def rmse_series(attached: DataFrame, rule: Rule = RMSE_RULE) -> DataFrame:
    """(t, value): RMSE of feedback rows with feedback_at in (t - range, t]."""
    fb = attached.where(F.col("actual_aqi").isNotNull())
    e2 = F.pow(F.col("predicted_aqi") - F.col("actual_aqi"), 2)
    b = fb.groupBy(bucket_end(F.col("feedback_at"), rule.step_s).alias("_t")).agg(
        F.sum(e2).alias("_s"), F.count(F.lit(1)).alias("_n"))
    b = materialize(b)
    g = occupied_grid(b, rule.range_s, rule.step_s).join(b, "_t", "left").na.fill(0, ["_s", "_n"])
    g = trailing_sums(g, ["_s", "_n"], rule.range_s, rule.step_s, exact_decimal=["_s"])
    return g.select("_t", F.sqrt(F.try_divide(F.col("_s"), F.col("_n"))).alias("value"))


def psi_series(predictions: DataFrame, baseline: DataFrame, rule: Rule = DRIFT_RULE,
               epsilon: float = 1e-4) -> DataFrame:
    """(feature, t, value): PSI of prediction inputs with created_at in (t - range, t] against the
    baseline bins, at every grid point (0.0 when the window holds no value inside the baseline range).

    Inputs are reduced to one row per (grid bucket, feature) with the bin counts as columns; the table is
    grid x features (a literal generator, features are few), and an ordered window per feature and block
    sums every bin over the trailing range."""
    from driftwise.functions.exprs import parse_double, zero_to_eps
    from driftwise.operators.baseline import bin_index

    base = baseline.select("feature", F.size("reference_distribution").alias("n")).collect()  # one row per feature
    if not base:
        return predictions.sparkSession.createDataFrame([], "feature string, _t long, value double")
    feats = [r["feature"] for r in base]
    nb = max([r["n"] for r in base] + [1])
    long = predictions.select(
        bucket_end(F.col("created_at"), rule.step_s).alias("_t"),
        F.explode(F.from_json("input_features", "map<string,string>")).alias("feature", "_txt"),
    ).where(F.col("feature").isin(feats)).select("_t", "feature", parse_double(F.col("_txt")).alias("value"))
    edges = F.broadcast(baseline.select("feature", "bin_edges"))
    binned = long.join(edges, "feature").select(
        "_t", "feature", F.when(F.col("value").isNotNull(), bin_index(F.col("value"), F.col("bin_edges"))).alias("bin"))
    counts = materialize(binned.groupBy("_t", "feature").agg(
        *[F.sum(F.when(F.col("bin") == i, 1).otherwise(0)).alias(f"_n{i}") for i in range(nb)]))
    grid = occupied_grid(counts, rule.range_s, rule.step_s).select("_t", F.explode(F.array(*[F.lit(f) for f in feats])).alias("feature"))
    g = grid.join(counts, ["_t", "feature"], "left").na.fill(0, [f"_n{i}" for i in range(nb)])
    g = trailing_sums(g, [f"_n{i}" for i in range(nb)], rule.range_s, rule.step_s, part=["feature"])
    refs = F.broadcast(baseline.select("feature", F.col("reference_distribution").alias("_ref")))
    g = g.join(refs, "feature").select("feature", "_t", "_ref", F.array(*[F.col(f"_n{i}") for i in range(nb)]).alias("_n"))
    g = g.withColumn("_total", F.aggregate("_n", F.lit(0).cast("long"), lambda a, n: a + n))

    def term(n, ref):
        c, r = zero_to_eps(n / F.col("_total"), epsilon), zero_to_eps(ref, epsilon)
        return F.coalesce((c - r) * F.ln(c / r), F.lit(0.0))          # bins the feature lacks give null -> 0

    psi = F.aggregate(F.zip_with("_n", "_ref", term), F.lit(0.0), lambda a, x: a + x)
    return g.select("feature", "_t", F.when(F.col("_total") > 0, psi).otherwise(F.lit(0.0)).alias("value"))


def islands(points: DataFrame, labels: Sequence[str] = ()) -> DataFrame:
    """(labels, _step, _start, _end, n_points) of the runs of points (labels, _t, _step) that are one step apart.

    Runs are found inside blocks of ``BLOCK_POINTS`` grid points. Those that touch a border of their block, at most two
    per block, are then merged in the order of time; all others are final."""
    length = F.col("_step") * BLOCK_POINTS
    w = Window.partitionBy(*labels, "_step", "_b").orderBy("_t")
    p = points.withColumn("_b", _block(length))
    p = p.withColumn("_new", F.coalesce(F.col("_t") - F.lag("_t").over(w) != F.col("_step"), F.lit(True)).cast("int"))
    p = p.withColumn("_isl", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = p.groupBy(*labels, "_step", "_b", "_isl").agg(
        F.min("_t").alias("_start"), F.max("_t").alias("_end"), F.count(F.lit(1)).alias("n_points"))
    first = F.col("_b") * length
    border = (F.col("_start") < first + F.col("_step")) | (F.col("_end") >= first + length - F.col("_step"))
    runs = runs.withColumn("_border", border)
    v = Window.partitionBy(*labels, "_step").orderBy("_start")
    open_ = runs.where("_border")
    open_ = open_.withColumn("_new", F.coalesce(F.col("_start") - F.lag("_end").over(v) != F.col("_step"), F.lit(True)).cast("int"))
    open_ = open_.withColumn("_isl", F.sum("_new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    merged = open_.groupBy(*labels, "_step", "_isl").agg(
        F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.sum("n_points").alias("n_points"))
    cols = [*labels, "_step", "_start", "_end", "n_points"]
    return runs.where(~F.col("_border")).select(*cols).unionByName(merged.select(*cols))


def _fired(isl: DataFrame, alert: Column, severity: Column, for_s: Column, label_cols: Sequence[str]) -> DataFrame:
    return isl.where(F.col("_end") - F.col("_start") >= for_s).select(
        alert.alias("alert"), severity.alias("severity"), *label_cols,
        ntz_from_seconds(F.col("_start")).alias("pending_since"),
        ntz_from_seconds(F.col("_start") + for_s).alias("firing_since"),
        ntz_from_seconds(F.col("_end")).alias("last_breach"),
        F.col("n_points").cast("long").alias("n_points"),
    )


def sustained(series: DataFrame, rule: Rule, label_cols: Sequence[str] = ()) -> DataFrame:
    """Islands of consecutive grid points with value > threshold; one row per island that lasted at
    least ``for`` seconds: (alert, severity, pending_since, firing_since, last_breach, n_points). A missing grid point
    breaks an island (no evaluation = no breach)."""
    points = series.where(F.col("value") > rule.threshold).select(*label_cols, "_t", F.lit(rule.step_s).cast("long").alias("_step"))
    return _fired(islands(points, label_cols), F.lit(rule.name), F.lit(rule.severity), F.lit(rule.for_s), label_cols)


def sustained_rules(series: DataFrame, rules: Sequence[Rule], label_cols: Sequence[str] = ()) -> DataFrame:
    """W10 for several rules at once: ``series`` is long (alert, labels, _t, value); thresholds, steps, ``for`` and
    severity come from the rule list (literals). One islands pass for all rules."""
    def per_rule(attr):
        e = None
        for r in rules:
            v = F.lit(getattr(r, attr))
            e = F.when(F.col("alert") == r.name, v) if e is None else e.when(F.col("alert") == r.name, v)
        return e

    points = series.where(F.col("value") > per_rule("threshold")).select(
        "alert", *label_cols, "_t", per_rule("step_s").cast("long").alias("_step"))
    return _fired(islands(points, ["alert", *label_cols]), F.col("alert"), per_rule("severity"), per_rule("for_s"), label_cols)


def evaluate_alerts(requests: DataFrame, attached: DataFrame, predictions: DataFrame | None = None,
                    baseline: DataFrame | None = None) -> DataFrame:
    """C14: error-rate, latency-p95, drift (per feature) and RMSE rules -> one table of fired alerts with a
    ``label`` column (the feature for the drift rule)."""
    # both request rules evaluate every 30 s over 5 min: one grid (one pass over the request log); all rules' series
    # side by side as (alert, label, t, value) rows go through one islands pass
    assert (ERROR_RATE_RULE.step_s, ERROR_RATE_RULE.range_s) == (LATENCY_P95_RULE.step_s, LATENCY_P95_RULE.range_s)
    grid = request_grid(requests, ERROR_RATE_RULE)
    les = LATENCY_BUCKETS_S
    nolabel = F.lit(None).cast("string").alias("label")
    series = grid.select("_t", nolabel, F.inline(F.array(
        F.struct(F.lit(ERROR_RATE_RULE.name).alias("alert"), F.try_divide(F.col("_n5"), F.col("_n")).alias("value")),
        F.struct(F.lit(LATENCY_P95_RULE.name).alias("alert"),
                 _hq(les, [F.col(f"_c{i}") for i in range(len(les) + 1)], 0.95).alias("value")),
    )))
    series = series.unionByName(rmse_series(attached).select("_t", nolabel, F.lit(RMSE_RULE.name).alias("alert"), "value"))
    rules = [ERROR_RATE_RULE, LATENCY_P95_RULE, RMSE_RULE]
    if predictions is not None and baseline is not None:
        series = series.unionByName(psi_series(predictions, baseline).select(
            "_t", F.col("feature").alias("label"), F.lit(DRIFT_RULE.name).alias("alert"), "value"))
        rules.append(DRIFT_RULE)
    return sustained_rules(series, rules, ["label"])


def dashboard_panels(requests: DataFrame, predictions: DataFrame, attached: DataFrame, as_of,
                     window_hours: int = 24) -> DataFrame:
    """Nine panels as one long table (panel, window_start, label, value)."""
    from driftwise.operators.monitor import rolling_error

    def tumbling(df, ts, width):
        return F.window(F.col(ts), width)["start"]

    # one pass over the request log: per (minute, status) the count and the cumulative latency buckets;
    # the three request panels are roll-ups of that small table
    d = F.col("duration_s")
    les = LATENCY_BUCKETS_S
    names = [f"_c{i}" for i in range(len(les) + 1)]
    per_min = requests.groupBy(tumbling(requests, "ts", "1 minute").alias("_m"), "status").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(F.when(d <= F.lit(float(le)), 1).otherwise(0)).alias(f"_c{i}") for i, le in enumerate(les)],
        F.count(d).alias(names[-1]),
    )
    nolab = F.lit(None).cast("string").alias("label")
    rate = per_min.groupBy(F.col("_m").alias("window_start")).agg((F.sum("_n") / 60.0).alias("value")).select(
        F.lit("request_rate").alias("panel"), "window_start", nolab, "value")
    by_status = per_min.select(F.lit("request_rate_by_status").alias("panel"), F.col("_m").alias("window_start"),
                               F.col("status").alias("label"), (F.col("_n") / 60.0).alias("value"))
    lat = per_min.groupBy(F.window(F.col("_m"), "5 minutes")["start"].alias("window_start")).agg(
        *[F.sum(c).alias(c) for c in names]).select("window_start", nolab, F.inline(F.array(*[
            F.struct(F.lit(panel).alias("panel"), _hq(les, [F.col(c) for c in names], q).alias("value"))
            for panel, q in (("latency_p50", 0.5), ("latency_p95", 0.95))]))).select("panel", "window_start", "label", "value")
    from driftwise.params import PREDICTION_VALUE_BUCKETS as PV
    pv = F.col("predicted_aqi")
    pval = predictions.groupBy(tumbling(predictions, "created_at", "5 minutes").alias("window_start")).agg(
        *[F.sum(F.when(pv <= F.lit(float(le)), 1).otherwise(0)).alias(f"_c{i}") for i, le in enumerate(PV)],
        F.count(pv).alias(f"_c{len(PV)}"),
    ).select("window_start", nolab, F.inline(F.array(*[
        F.struct(F.lit(panel).alias("panel"), _hq(PV, [F.col(f"_c{i}") for i in range(len(PV) + 1)], q).alias("value"))
        for panel, q in (("predicted_value_p50", 0.5), ("predicted_value_p95", 0.95))]))).select("panel", "window_start", "label", "value")
    answered = predictions.groupBy(tumbling(predictions, "created_at", "1 minute").alias("window_start")).agg(
        (F.count(F.lit(1)) / 60.0).alias("value")).select(F.lit("prediction_rate").alias("panel"), "window_start", nolab, "value")
    by_version = predictions.groupBy("model_version", "model_family").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("predictions_by_version").alias("panel"), F.lit(None).cast("timestamp_ntz").alias("window_start"),
        F.concat_ws("/", "model_version", "model_family").alias("label"), F.col("n").cast("double").alias("value"))
    rm = rolling_error(attached, as_of, window_hours).select(
        F.lit("rolling_rmse").alias("panel"), F.lit(None).cast("timestamp_ntz").alias("window_start"),
        F.lit(None).cast("string").alias("label"), F.col("rolling_rmse").alias("value"))
    out = rate
    for p in (lat, by_status, by_version, pval, answered, rm):
        out = out.unionByName(p)
    return out

"""Independent DuckDB SQL for every registered query (same view rules, plain SQL semantics).

Doubles are rounded to 6 digits and integers are BIGINT, like ``driftwise.plans.queries.finish``.
"""

from __future__ import annotations

from driftwise.params import LATENCY_BUCKETS_S, PREDICTION_VALUE_BUCKETS, VALUE_RANGES
from driftwise.plans import oracle_views as OV
from driftwise.plans.queries import COUNTER_RANGE_S, COUNTER_STEP_S, PAGE_SIZE, VALIDATE_PARAMS

AS_OF = "(SELECT max(ts) FROM events)"
LAGS = (1, 2, 3, 7)
ROLLS = (3, 7, 14)
POLS = ("p1", "p2")


def q(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def R(inner: str, doubles: list[str] | tuple[str, ...]) -> str:
    """Round the listed double columns to 6 digits."""
    if not doubles:
        return inner
    rep = ", ".join(f"CAST(round(TRY_CAST(CAST({q(c)} AS DOUBLE) AS DECIMAL(38, 9)), 6) AS DOUBLE) AS {q(c)}"
                    for c in doubles)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS _r"


def W(*views: str) -> str:
    return OV.with_views(*views)


def pd_double(x: str) -> str:
    """Text -> double like the pandas coercion: 'true'/'false' -> 1/0, junk -> NULL."""
    t = f"lower(trim({x}))"
    return (f"(CASE WHEN {t} = 'true' THEN 1.0::DOUBLE WHEN {t} = 'false' THEN 0.0::DOUBLE "
            f"ELSE TRY_CAST({t} AS DOUBLE) END)")


def iso(ts: str) -> str:
    return (f"(CASE WHEN {ts} IS NULL THEN NULL WHEN strftime({ts}, '%f') = '000000' "
            f"THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END)")


LAG_COLS = [f"{c}_lag{k}" for c in POLS for k in LAGS]
ROLL_COLS = [f"{c}_roll{k}" for c in POLS for k in ROLLS]


def lag_exprs(part="city", order="ts, event_id") -> list[str]:
    return [f"lag({c}, {k}) OVER (PARTITION BY {part} ORDER BY {order}) AS {c}_lag{k}" for c in POLS for k in LAGS]


def roll_exprs(part="city", order="ts, event_id") -> list[str]:
    return [f"avg({c}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING) "
            f"AS {c}_roll{k}" for c in POLS for k in ROLLS]


def impute_ctes(src: str) -> str:
    """ff / med / imp CTEs over ``src`` (city, ts, event_id, p1, p2, target)."""
    return f"""ff AS (SELECT city, ts, event_id, target,
    CASE WHEN city IS NULL THEN NULL ELSE last_value(p1 IGNORE NULLS) OVER w END AS p1f,
    CASE WHEN city IS NULL THEN NULL ELSE last_value(p2 IGNORE NULLS) OVER w END AS p2f
  FROM {src} WHERE ts IS NOT NULL
  WINDOW w AS (PARTITION BY city ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
med AS (SELECT quantile_cont(p1f, 0.5) AS m1, quantile_cont(p2f, 0.5) AS m2 FROM ff),
imp AS (SELECT city, ts, event_id, target, coalesce(p1f, m1) AS p1, coalesce(p2f, m2) AS p2 FROM ff, med)"""


def built_ctes(src: str) -> str:
    """C1 over ``src``: impute -> lags/rolls -> encoding -> drop null target -> drop warm-up."""
    sel = ",\n  ".join(lag_exprs() + roll_exprs())
    return f"""{impute_ctes(src)},
feat AS (SELECT *, {sel} FROM imp WHERE city IS NOT NULL),
enc AS (SELECT city, avg(target) AS m FROM {src} WHERE ts IS NOT NULL AND city IS NOT NULL GROUP BY city),
g AS (SELECT avg(target) AS gm FROM {src} WHERE ts IS NOT NULL),
built AS (SELECT feat.*, coalesce(enc.m, g.gm) AS city_target_enc FROM feat LEFT JOIN enc USING (city) CROSS JOIN g
  WHERE target IS NOT NULL AND {' AND '.join(c + ' IS NOT NULL' for c in LAG_COLS)})"""


PIPE_DOUBLES = ["p1", "p2", "target", *LAG_COLS, *ROLL_COLS, "city_target_enc"]

MERGED = """u AS (SELECT city, ts, event_id, p1, p2, target, CAST(NULL AS TIMESTAMP) AS feedback_at, 0 AS src FROM readings
  UNION ALL SELECT city, ts, event_id, p1, p2, target, feedback_at, 1 AS src FROM readings_feedback),
merged AS (SELECT city, ts, event_id, p1, p2, target FROM (
  SELECT *, row_number() OVER (PARTITION BY city, ts ORDER BY src DESC, feedback_at DESC NULLS LAST, event_id DESC) AS rn
  FROM u) WHERE rn = 1)"""

GRID = [repr(i / 10) for i in range(11)]
BASE_CTES = f"""bpart AS (SELECT * FROM readings),
blong AS (SELECT 'PM2.5' AS feature, p1 AS value FROM bpart UNION ALL SELECT 'PM10', p2 FROM bpart
  UNION ALL SELECT 'AQI', target FROM bpart),
st AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max,
    count(*) AS n_observations, quantile_cont(value, [{', '.join(g + '::DOUBLE' for g in GRID)}]) AS qs,
    quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.75) AS q75
  FROM blong WHERE value IS NOT NULL GROUP BY feature),
edges AS (SELECT feature, list_sort(list_distinct(qs)) AS e FROM st)"""


def bin_expr(v: str, e: str) -> str:
    n = f"len({e})"
    idx = f"(len(list_filter({e}, lambda x: x <= {v})) - 1)"
    return (f"(CASE WHEN {v} IS NULL OR {n} < 2 THEN NULL WHEN {v} = {e}[{n}] THEN {n} - 2 "
            f"WHEN {idx} >= 0 AND {idx} < {n} - 1 THEN {idx} END)")


HIST_CTES = f"""bbin AS (SELECT l.feature, {bin_expr('l.value', 'edges.e')} AS bin FROM blong l JOIN edges USING (feature)
  WHERE l.value IS NOT NULL),
bcnt AS (SELECT feature, bin, count(*) AS n FROM bbin WHERE bin IS NOT NULL GROUP BY ALL),
ball AS (SELECT feature, e, unnest(range(0, len(e) - 1)) AS bin FROM edges),
hist AS (SELECT a.feature, a.bin, a.e[a.bin + 1] AS low, a.e[a.bin + 2] AS high,
    coalesce(c.n, 0) / sum(coalesce(c.n, 0)) OVER (PARTITION BY a.feature) AS ref_share
  FROM ball a LEFT JOIN bcnt c USING (feature, bin))"""

PSI_CTES = f"""recent AS (SELECT input_features AS j FROM predictions WHERE created_at > {AS_OF} - INTERVAL 24 HOUR),
keys AS (SELECT j, unnest(json_keys(j)) AS feature FROM recent),
cur AS (SELECT feature, {pd_double("json_extract_string(j, '$.\"' || feature || '\"')")} AS value FROM keys),
feats AS (SELECT DISTINCT c.feature FROM cur c JOIN edges USING (feature)),
cbin AS (SELECT c.feature, {bin_expr('c.value', 'edges.e')} AS bin FROM cur c JOIN edges USING (feature)
  WHERE c.value IS NOT NULL),
ccnt AS (SELECT feature, bin, count(*) AS n FROM cbin GROUP BY ALL),
ctot AS (SELECT feature, sum(n) AS tot FROM ccnt WHERE bin IS NOT NULL GROUP BY feature),
terms AS (SELECT h.feature,
    CASE WHEN coalesce(c.n, 0) / t.tot = 0 THEN 1e-4 ELSE coalesce(c.n, 0) / t.tot END AS cs,
    CASE WHEN h.ref_share = 0 THEN 1e-4 ELSE h.ref_share END AS rs
  FROM hist h JOIN feats USING (feature) JOIN ctot t USING (feature)
  LEFT JOIN ccnt c ON c.feature = h.feature AND c.bin = h.bin WHERE t.tot > 0),
pagg AS (SELECT feature, sum((cs - rs) * ln(cs / rs)) AS psi FROM terms GROUP BY feature),
psizes AS (SELECT feature, sum(n) AS n_current, sum(CASE WHEN bin IS NULL THEN n ELSE 0 END) AS n_oor
  FROM ccnt GROUP BY feature),
psi AS (SELECT f.feature, coalesce(a.psi, 0.0) AS psi, CAST(coalesce(s.n_current, 0) AS BIGINT) AS n_current,
    CAST(coalesce(s.n_oor, 0) AS BIGINT) AS n_out_of_range,
    CASE WHEN coalesce(a.psi, 0.0) < 0.1 THEN 'none' WHEN coalesce(a.psi, 0.0) <= 0.25 THEN 'moderate'
         ELSE 'significant' END AS severity
  FROM feats f LEFT JOIN pagg a USING (feature) LEFT JOIN psizes s USING (feature))"""

ATTACHED = f"""lf AS (SELECT prediction_id, actual_aqi, feedback_at, n_submissions FROM (
  SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY feedback_at DESC, actual_aqi DESC) AS rn,
    count(*) OVER (PARTITION BY prediction_id) AS n_submissions FROM ground_truth) WHERE rn = 1),
attached AS (SELECT p.*, lf.actual_aqi, lf.feedback_at FROM predictions p LEFT JOIN lf ON lf.prediction_id = p.id)"""

ROLLING = f"""rolling AS (SELECT sqrt(avg(pow(predicted_aqi - actual_aqi, 2))) AS rolling_rmse, count(*) AS feedback_count
  FROM attached WHERE actual_aqi IS NOT NULL AND feedback_at > {AS_OF} - INTERVAL 24 HOUR)"""

FEEDBACK_VIEW = f"""fview AS (SELECT CAST(id AS VARCHAR) AS prediction_id, {iso('created_at')} AS created_at,
    {iso('feedback_at')} AS feedback_at, model_version, model_family,
    json_extract_string(input_features, '$.city') AS city, json_extract_string(input_features, '$.date') AS date,
    predicted_aqi, actual_aqi, actual_aqi - predicted_aqi AS error, abs(actual_aqi - predicted_aqi) AS abs_error,
    latency_ms, feedback_at AS _fb, id AS _id
  FROM attached WHERE actual_aqi IS NOT NULL)"""
FVIEW_DOUBLES = ["predicted_aqi", "actual_aqi", "error", "abs_error", "latency_ms"]


def hist_sql(table: str, col: str, buckets, metric: str) -> str:
    parts = []
    for i, b in enumerate(list(buckets) + [None]):
        le = "CAST(NULL AS DOUBLE)" if b is None else f"{float(b)!r}::DOUBLE"
        label = "+Inf" if b is None else repr(float(b))
        cnt = f"count({col})" if b is None else f"sum(CASE WHEN {col} <= {float(b)!r} THEN 1 ELSE 0 END)"
        parts.append(f"SELECT '{metric}' AS metric, {i}::BIGINT AS le_index, {le} AS le, '{label}' AS le_label, "
                     f"CAST(coalesce({cnt}, 0) AS BIGINT) AS cum_count FROM {table}")
    return " UNION ALL ".join(parts)


HISTS = ("hists AS (" + hist_sql("requests", "duration_s", LATENCY_BUCKETS_S, "request_duration_seconds")
         + " UNION ALL " + hist_sql("predictions", "predicted_aqi", PREDICTION_VALUE_BUCKETS, "prediction_value") + ")")


def hq_sql(les, cum: list[str], qv: float) -> str:
    """Prometheus histogram_quantile over fixed bounds (SQL CASE form)."""
    n = len(les)
    total = cum[n]
    rank = f"({qv!r}::DOUBLE * {total})"
    idx = "CASE " + " ".join(f"WHEN {cum[i]} >= {rank} THEN {i}" for i in range(n)) + f" ELSE {n} END"
    les_a = "[" + ", ".join(f"{float(x)!r}::DOUBLE" for x in les) + "]"
    cum_a = "[" + ", ".join(cum) + "]"
    end = f"{les_a}[({idx}) + 1]"
    start = f"(CASE WHEN ({idx}) = 0 THEN 0.0::DOUBLE ELSE {les_a}[greatest({idx}, 1)] END)"
    prev = f"(CASE WHEN ({idx}) = 0 THEN 0 ELSE {cum_a}[greatest({idx}, 1)] END)"
    cnt = f"({cum_a}[({idx}) + 1] - {prev})"
    interp = f"{start} + ({end} - {start}) * (({rank} - {prev}) / NULLIF({cnt}, 0))"
    return (f"(CASE WHEN {total} IS NULL OR {total} = 0 THEN NULL WHEN ({idx}) = {n} THEN {float(les[-1])!r}::DOUBLE "
            f"WHEN ({idx}) = 0 AND {float(les[0])!r} <= 0 THEN {float(les[0])!r}::DOUBLE ELSE {interp} END)")


def grid_series(name: str, bucket_sql: str, step: int, range_s: int, value_sql: str, cols: list[str]) -> str:
    """CTEs {name}_b (per bucket), {name}_g (dense grid), {name} (t, value)."""
    fill = ", ".join(f"coalesce({c}, 0) AS {c}" for c in cols)
    return f"""{name}_b AS ({bucket_sql}),
{name}_g AS (SELECT unnest(range((SELECT min(t) FROM {name}_b), (SELECT max(t) FROM {name}_b) + {step}, {step})) AS t),
{name}_f AS (SELECT g.t, {fill} FROM {name}_g g LEFT JOIN {name}_b b USING (t)),
{name} AS (SELECT t, {value_sql} AS value FROM {name}_f
  WINDOW w AS (ORDER BY t RANGE BETWEEN {range_s - step} PRECEDING AND CURRENT ROW))"""


def islands(name: str, series: str, alert: str, severity: str, thr: float, for_s: int, label: str | None = None) -> str:
    lab = label or "CAST(NULL AS VARCHAR)"
    part = "PARTITION BY label " if label else ""
    return f"""{name}_fl AS (SELECT {lab} AS label, t, coalesce(value > {thr!r}, false) AS f FROM {series}),
{name}_ch AS (SELECT label, t, f, CASE WHEN f <> coalesce(lag(f) OVER ({part}ORDER BY t), false)
  THEN 1 ELSE 0 END AS chg FROM {name}_fl),
{name}_is AS (SELECT label, t, f, sum(chg) OVER ({part}ORDER BY t
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM {name}_ch),
{name} AS (SELECT '{alert}' AS alert, '{severity}' AS severity, label, make_timestamp(min(t) * 1000000) AS pending_since,
    make_timestamp((min(t) + {for_s}) * 1000000) AS firing_since, make_timestamp(max(t) * 1000000) AS last_breach,
    count(*) AS n_points FROM {name}_is WHERE f GROUP BY label, isl HAVING max(t) - min(t) >= {for_s})"""


def _psi_series_sql() -> str:
    """CTE ps (feature, t, value): trailing-24 h PSI of prediction inputs on a 60 s grid."""
    return f"""pin AS (SELECT {bucket_end('created_at', 60)} AS t, unnest(json_keys(input_features)) AS feature,
    input_features AS j FROM predictions),
pv AS (SELECT t, feature, {pd_double("json_extract_string(j, '$.\"' || feature || '\"')")} AS value FROM pin
  WHERE feature IN (SELECT feature FROM edges)),
pall AS (SELECT t, count(*) AS n FROM pv GROUP BY t),
pg AS (SELECT unnest(range((SELECT min(t) FROM pall), (SELECT max(t) FROM pall) + 60, 60)) AS t),
pb AS (SELECT pv.t, pv.feature, {bin_expr('pv.value', 'edges.e')} AS bin FROM pv JOIN edges USING (feature)
  WHERE pv.value IS NOT NULL),
pc AS (SELECT t, feature, bin, count(*) AS n FROM pb WHERE bin IS NOT NULL GROUP BY ALL),
pd AS (SELECT pg.t, h.feature, h.bin, h.ref_share AS r, coalesce(pc.n, 0) AS n FROM pg CROSS JOIN hist h
  LEFT JOIN pc ON pc.t = pg.t AND pc.feature = h.feature AND pc.bin = h.bin),
pw AS (SELECT t, feature, bin, r, sum(n) OVER (PARTITION BY feature, bin ORDER BY t
  RANGE BETWEEN 86340 PRECEDING AND CURRENT ROW) AS c FROM pd),
pt AS (SELECT *, sum(c) OVER (PARTITION BY feature, t) AS tot FROM pw),
ps AS (SELECT feature, t, coalesce(sum(CASE WHEN tot > 0 THEN
    ((CASE WHEN c / tot = 0 THEN 1e-4 ELSE c / tot END) - (CASE WHEN r = 0 THEN 1e-4 ELSE r END))
    * ln((CASE WHEN c / tot = 0 THEN 1e-4 ELSE c / tot END) / (CASE WHEN r = 0 THEN 1e-4 ELSE r END)) END), 0.0) AS value
  FROM pt GROUP BY feature, t)"""


def bucket_end(ts: str, step: int) -> str:
    return f"CAST(ceil(epoch_us({ts}) / 1e6 / {step}) * {step} AS BIGINT)"


def _alerts_sql() -> str:
    les = LATENCY_BUCKETS_S
    nl = len(les)
    lat_b = ("SELECT " + bucket_end("ts", 30) + " AS t, "
             + ", ".join(f"sum(CASE WHEN duration_s <= {float(x)!r} THEN 1 ELSE 0 END) AS c{i}" for i, x in enumerate(les))
             + f", count(duration_s) AS c{nl} FROM requests GROUP BY 1")
    cum = [f"sum(c{i}) OVER w" for i in range(nl + 1)]
    err = grid_series(
        "es", f"SELECT {bucket_end('ts', 30)} AS t, count(*) AS n, sum(CASE WHEN status LIKE '5__' THEN 1 ELSE 0 END) AS n5 "
        "FROM requests GROUP BY 1", 30, 300, "sum(n5) OVER w / NULLIF(sum(n) OVER w, 0)", ["n", "n5"])
    lat = grid_series("ls", lat_b, 30, 300, hq_sql(les, cum, 0.95), [f"c{i}" for i in range(nl + 1)])
    rm = grid_series(
        "rs", f"SELECT {bucket_end('feedback_at', 60)} AS t, sum(pow(predicted_aqi - actual_aqi, 2)) AS s, count(*) AS n "
        "FROM attached WHERE actual_aqi IS NOT NULL GROUP BY 1", 60, 86400, "sqrt(sum(s) OVER w / NULLIF(sum(n) OVER w, 0))",
        ["s", "n"])
    return R(W(OV.READINGS, OV.REQUESTS, OV.PREDICTIONS, OV.GROUND_TRUTH) + f""",
{ATTACHED},
{BASE_CTES},
{HIST_CTES},
{err},
{lat},
{rm},
{_psi_series_sql()},
{islands('a1', 'es', 'HighInferenceErrorRate', 'critical', 0.05, 120)},
{islands('a2', 'ls', 'HighInferenceLatencyP95', 'warning', 0.2, 300)},
{islands('a3', 'rs', 'ModelPerformanceDecay', 'warning', 15.0, 600)},
{islands('a4', 'ps', 'ModelDriftDetected', 'warning', 0.2, 600, label='feature')}
SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM a3 UNION ALL SELECT * FROM a4""", [])


def _dashboard_sql() -> str:
    les, pv = LATENCY_BUCKETS_S, PREDICTION_VALUE_BUCKETS
    lat_cols = ", ".join(f"sum(CASE WHEN duration_s <= {float(x)!r} THEN 1 ELSE 0 END) AS c{i}" for i, x in enumerate(les))
    pv_cols = ", ".join(f"sum(CASE WHEN predicted_aqi <= {float(x)!r} THEN 1 ELSE 0 END) AS c{i}" for i, x in enumerate(pv))
    return R(W(OV.REQUESTS, OV.PREDICTIONS, OV.GROUND_TRUTH) + f""",
{ATTACHED},
{ROLLING},
lat AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, {lat_cols}, count(duration_s) AS c{len(les)}
  FROM requests GROUP BY 1),
pvh AS (SELECT time_bucket(INTERVAL 5 MINUTE, created_at) AS window_start, {pv_cols}, count(predicted_aqi) AS c{len(pv)}
  FROM predictions GROUP BY 1)
SELECT 'request_rate' AS panel, time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, CAST(NULL AS VARCHAR) AS label,
  count(*) / 60.0::DOUBLE AS value FROM requests GROUP BY 2
UNION ALL SELECT 'latency_p50', window_start, NULL, {hq_sql(les, [f'c{i}' for i in range(len(les) + 1)], 0.5)} FROM lat
UNION ALL SELECT 'latency_p95', window_start, NULL, {hq_sql(les, [f'c{i}' for i in range(len(les) + 1)], 0.95)} FROM lat
UNION ALL SELECT 'prediction_rate', time_bucket(INTERVAL 1 MINUTE, created_at), NULL, count(*) / 60.0::DOUBLE FROM predictions GROUP BY 2
UNION ALL SELECT 'request_rate_by_status', time_bucket(INTERVAL 1 MINUTE, ts), status, count(*) / 60.0::DOUBLE
  FROM requests GROUP BY 2, 3
UNION ALL SELECT 'predictions_by_version', NULL, model_version || '/' || model_family, CAST(count(*) AS DOUBLE)
  FROM predictions GROUP BY model_version, model_family
UNION ALL SELECT 'predicted_value_p50', window_start, NULL, {hq_sql(pv, [f'c{i}' for i in range(len(pv) + 1)], 0.5)} FROM pvh
UNION ALL SELECT 'predicted_value_p95', window_start, NULL, {hq_sql(pv, [f'c{i}' for i in range(len(pv) + 1)], 0.95)} FROM pvh
UNION ALL SELECT 'rolling_rmse', NULL, NULL, rolling_rmse FROM rolling""", ["value"])


def _validate_report_sql() -> str:
    cols = ["City", "Date", "PM2.5", "PM10", "AQI"]
    p = VALIDATE_PARAMS
    miss = sorted(set(p.required_columns) - set(cols))
    ms = ", ".join(f"avg(CASE WHEN {q(c)} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m{i}" for i, c in enumerate(cols))
    thr = f"{p.max_missing_pct:.0%}"
    errs = []
    if miss:
        errs.append("'" + f"Required columns not found: {miss}".replace("'", "''") + "'")
    errs.append(f"CASE WHEN n_rows < {p.min_rows} THEN 'Only ' || n_rows || ' rows, fewer than {p.min_rows}' END")
    warns = [f"CASE WHEN m{i} > {p.max_missing_pct!r} THEN 'Column ''{c}'' is ' || CAST(round(m{i} * 100, 1) AS VARCHAR) "
             f"|| '% empty (allowed: {thr})' END" for i, c in enumerate(cols)]
    ti = cols.index(p.target)
    warns.append(f"CASE WHEN m{ti} > {p.target_missing_warn!r} THEN 'Target ''{p.target}'' is ' || "
                 f"CAST(round(m{ti} * 100, 1) AS VARCHAR) || '% empty; rows without a target are dropped' END")
    warns.append(f"CASE WHEN ud > 0 THEN ud || ' dates that do not parse in ''{p.date_col}''' END")
    return R(W(OV.RAW_READINGS) + f""",
a AS (SELECT count(*) AS n_rows, {ms},
  CAST(sum(CASE WHEN TRY_CAST("Date" AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS ud FROM raw_readings),
e AS (SELECT *, list_filter([{', '.join(errs)}], lambda x: x IS NOT NULL) AS errs,
  list_filter([{', '.join(warns)}], lambda x: x IS NOT NULL) AS warns FROM a)
SELECT n_rows, {len(cols)}::BIGINT AS n_columns, round(m{ti}, 4) AS target_missing_pct, ud AS unparseable_dates,
  CAST(len(errs) AS BIGINT) AS n_errors, CAST(len(warns) AS BIGINT) AS n_warnings,
  array_to_string(errs, ' | ') AS errors, array_to_string(warns, ' | ') AS warnings, len(errs) = 0 AS passed FROM e""",
             ["target_missing_pct"])


def _missing_pct_sql() -> str:
    cols = ["city", "ts", "event_id", "p1", "p2", "target"]
    ms = ", ".join(f"avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS m{i}" for i, c in enumerate(cols))
    sel = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {i}::BIGINT AS position, n AS n_rows, round(m{i}, 4) AS missing_pct, "
        f"m{i} > 0.5 AS over_threshold FROM a" for i, c in enumerate(cols))
    return R(W(OV.READINGS) + f", a AS (SELECT count(*) AS n, {ms} FROM readings) {sel}", ["missing_pct"])


def _range_sql() -> str:
    parts = []
    for c in ("PM2.5", "PM10", "AQI"):
        lo, hi = VALUE_RANGES[c]
        v = q(c)
        parts.append(
            f"SELECT '{c}' AS column_name, {lo!r}::DOUBLE AS low, {hi!r}::DOUBLE AS high, count({v}) AS n_checked, "
            f"CAST(sum(CASE WHEN {v} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, "
            f"CAST(coalesce(sum(CASE WHEN {v} < {lo!r} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_below, "
            f"CAST(coalesce(sum(CASE WHEN {v} > {hi!r} THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_above FROM raw_readings")
    return R(W(OV.RAW_READINGS) + ", x AS (" + " UNION ALL ".join(parts) + ") SELECT *, n_below + n_above AS n_violations FROM x",
             ["low", "high"])


def _payload_sql() -> str:
    raw0 = "coalesce(json_extract_string(body, '$.\"PM2.5\"'), json_extract_string(body, '$.\"pm25\"'))"
    raw1 = "coalesce(json_extract_string(body, '$.\"PM10\"'), json_extract_string(body, '$.\"pm10\"'))"
    return R(W(OV.REQUEST_PAYLOADS) + f""",
p AS (SELECT payload_id, json_extract_string(body, '$.city') AS city, json_extract_string(body, '$.date') AS date,
  {raw0} AS r0, {raw1} AS r1 FROM request_payloads),
v AS (SELECT *, {pd_double('r0')} AS "PM2.5", {pd_double('r1')} AS "PM10" FROM p),
x AS (SELECT payload_id, city, date, "PM2.5", "PM10", coalesce(
  CASE WHEN city IS NULL THEN 'missing city' END, CASE WHEN date IS NULL THEN 'missing date' END,
  CASE WHEN r0 IS NOT NULL AND "PM2.5" IS NULL THEN 'not a number: PM2.5' END,
  CASE WHEN r1 IS NOT NULL AND "PM10" IS NULL THEN 'not a number: PM10' END) AS reject_reason FROM v)
SELECT *, reject_reason IS NULL AS accepted FROM x""", ["PM2.5", "PM10"])


def _split_ctes(src: str, order: str) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (ORDER BY {order}) AS row_pos, count(*) OVER () AS n FROM {src}),
sized AS (SELECT *, n - CAST(floor(n * 0.15::DOUBLE) AS BIGINT) - CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS n_train,
  CAST(floor(n * 0.15::DOUBLE) AS BIGINT) AS n_val FROM ranked),
splitted AS (SELECT *, CASE WHEN row_pos <= n_train THEN 'train' WHEN row_pos <= n_train + n_val THEN 'val'
  ELSE 'test' END AS split FROM sized)"""


def _scoring_sql() -> str:
    lag_sel = ", ".join(
        f"CAST(coalesce(max(CASE WHEN rk = {k + 1} THEN {c} END), 0.0) AS FLOAT) AS {c}_lag{k}" for c in POLS for k in LAGS)
    roll_sel = ", ".join(f"CAST(0.0 AS FLOAT) AS {c}" for c in ROLL_COLS)
    doubles = ["p1", "p2", *LAG_COLS, *ROLL_COLS, "city_target_enc"]
    return R(W(OV.READINGS) + f""",
rk AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY ts DESC, event_id DESC) AS rk FROM readings)
SELECT city, CAST(coalesce(max(CASE WHEN rk = 1 THEN p1 END), 0.0) AS FLOAT) AS p1,
  CAST(coalesce(max(CASE WHEN rk = 1 THEN p2 END), 0.0) AS FLOAT) AS p2, {lag_sel}, {roll_sel},
  CAST(0.0 AS FLOAT) AS city_target_enc
FROM rk WHERE rk <= 15 GROUP BY city""", doubles)


def _score_to_log_sql() -> str:
    """Least squares of two features by their closed form, then the accepted requests of ``NESTED_REQUESTS``."""
    return R(W(OV.READINGS, OV.NESTED_REQUESTS) + f""",
tr AS (SELECT coalesce(p1, 0.0) AS a, coalesce(p2_lag1, 0.0) AS b, target AS y FROM (
  SELECT *, lag(p2) OVER (PARTITION BY city ORDER BY ts, event_id) AS p2_lag1 FROM readings) WHERE target IS NOT NULL),
st AS (SELECT covar_pop(a, a) AS aa, covar_pop(a, b) AS ab, covar_pop(b, b) AS bb, covar_pop(a, y) AS ay, covar_pop(b, y) AS byy,
  avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM tr),
ab AS (SELECT *, (ay * bb - byy * ab) / (aa * bb - ab * ab) AS wa, (byy * aa - ay * ab) / (aa * bb - ab * ab) AS wb FROM st),
newest AS (SELECT request_id, arg_min(pm10, i) AS pm10_lag1 FROM (
  SELECT request_id, pm10, i, d, max(d) OVER (PARTITION BY request_id) AS dm FROM request_items) WHERE d = dm GROUP BY 1)
SELECT r.request_id AS id, {AS_OF} AS created_at, 'v1' AS model_version, 'linear' AS model_family,
  CAST(r.user_id AS VARCHAR) AS city, strftime(r.ts, '%Y-%m-%d') AS date, CAST(r.value AS DOUBLE) AS pm25, CAST(r.k AS DOUBLE) AS pm10,
  my - wa * ma - wb * mb + wa * CAST(CAST(coalesce(r.value, 0.0) AS FLOAT) AS DOUBLE)
    + wb * CAST(CAST(coalesce(n.pm10_lag1, 0.0) AS FLOAT) AS DOUBLE) AS predicted_aqi,
  (epoch_us({AS_OF}) - epoch_us(r.ts)) / 1000.0::DOUBLE AS latency_ms
FROM request_rows r LEFT JOIN newest n USING (request_id), ab
WHERE r.request_id NOT IN (SELECT request_id FROM request_errors)""", ["pm25", "pm10", "predicted_aqi", "latency_ms"])


def _counter_rate_sql(range_s: int = COUNTER_RANGE_S, step_s: int = COUNTER_STEP_S) -> str:
    steps = ", ".join(str(i * step_s) for i in range(range_s // step_s))
    return R(W(OV.REQUESTS, OV.SCRAPED_COUNTERS) + f""",
x AS (SELECT status, epoch_us(scraped_at) / 1000000.0::DOUBLE AS s, total AS v,
  unnest([CAST(ceil(epoch_us(scraped_at) / 1000000.0::DOUBLE / {step_s}) * {step_s} AS BIGINT) + o for o in [{steps}]]) AS e FROM scraped_counters),
y AS (SELECT *, lag(v) OVER (PARTITION BY status, e ORDER BY s) AS pv FROM x),
g AS (SELECT status, e, count(*) AS n_samples, min(s) AS f, max(s) AS l, arg_min(v, s) AS fv,
  arg_max(v, s) - arg_min(v, s) + sum(CASE WHEN v < pv THEN pv ELSE 0 END) AS delta FROM y GROUP BY 1, 2 HAVING count(*) >= 2),
m AS (SELECT *, l - f AS si, (l - f) / (n_samples - 1) AS av FROM g),
t AS (SELECT *, CASE WHEN f - (e - {range_s}) >= av * 1.1::DOUBLE THEN av / 2 ELSE f - (e - {range_s}) END AS ds,
  CASE WHEN e - l >= av * 1.1::DOUBLE THEN av / 2 ELSE e - l END AS de FROM m),
z AS (SELECT *, delta * (si + CASE WHEN delta > 0 AND fv >= 0 THEN least(ds, si * (fv / delta)) ELSE ds END + de) / si AS increase FROM t)
SELECT status, make_timestamp(e * 1000000) AS window_end, n_samples, increase, increase / {float(range_s)!r}::DOUBLE AS rate_per_s FROM z""",
             ["increase", "rate_per_s"])


RUNS_LATEST = """latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_family
  ORDER BY start_time DESC NULLS LAST, run_id DESC) AS rk FROM runs WHERE status = 'FINISHED') WHERE rk = 1),
champ AS (SELECT model_family AS winning_family, run_id, val_rmse FROM latest WHERE model_family IN ('xgboost', 'pytorch_nn')
  ORDER BY coalesce(val_rmse, 'inf'::DOUBLE), CASE model_family WHEN 'xgboost' THEN 1 ELSE 2 END LIMIT 1)"""


def build() -> dict[str, str]:
    V = OV
    d: dict[str, str] = {}
    d["validate_missing_pct"] = _missing_pct_sql()
    d["validate_dates"] = W(V.RAW_READINGS) + """ SELECT count(*) AS n_rows,
  CAST(sum(CASE WHEN TRY_CAST("Date" AS TIMESTAMP) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unparseable_dates,
  CAST(sum(CASE WHEN "Date" IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_dates FROM raw_readings"""
    d["validate_report"] = _validate_report_sql()
    d["range_violations"] = _range_sql()
    d["payload_accept_reject"] = _payload_sql()
    d["impute_ffill_median"] = R(W(V.READINGS) + ",\n" + impute_ctes("readings")
                                 + " SELECT city, ts, event_id, p1, p2, target FROM imp", ["p1", "p2", "target"])
    d["remaining_nulls"] = W(V.READINGS) + ",\n" + impute_ctes("readings") + """ SELECT CAST(coalesce(
  sum(CASE WHEN p1 IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN p2 IS NULL THEN 1 ELSE 0 END), 0) AS BIGINT)
  AS remaining_nulls FROM imp"""
    d["lag_features"] = R(W(V.READINGS) + f" SELECT city, ts, event_id, p1, p2, {', '.join(lag_exprs())} FROM readings",
                          ["p1", "p2", *LAG_COLS])
    d["rolling_mean_excl_current"] = R(W(V.READINGS) + f" SELECT city, ts, event_id, p1, p2, {', '.join(roll_exprs())} "
                                       "FROM readings", ["p1", "p2", *ROLL_COLS])
    d["target_encode"] = R(W(V.READINGS) + """ SELECT city, count(target) AS n_target, avg(target) AS key_mean,
  (SELECT avg(target) FROM readings WHERE ts IS NOT NULL) AS global_mean FROM readings
  WHERE ts IS NOT NULL AND city IS NOT NULL GROUP BY city""", ["key_mean", "global_mean"])
    d["encode_unseen"] = R(W(V.READINGS) + """, enc AS (SELECT city, avg(target) AS m FROM readings
  WHERE ts IS NOT NULL AND city IS NOT NULL GROUP BY city)
SELECT c_custkey, coalesce(enc.m, (SELECT avg(target) FROM readings WHERE ts IS NOT NULL)) AS city_target_enc
FROM customer LEFT JOIN enc ON enc.city = customer.c_custkey""", ["city_target_enc"])
    d["feature_build"] = R(W(V.READINGS) + ",\n" + built_ctes("readings") + " SELECT * FROM built", PIPE_DOUBLES)
    d["rebuild_with_feedback"] = R(W(V.READINGS, V.READINGS_FEEDBACK) + ",\n" + MERGED + ",\n" + built_ctes("merged")
                                   + " SELECT * FROM built", PIPE_DOUBLES)
    d["incremental_rebuild"] = d["rebuild_with_feedback"]
    d["duplicate_collapse"] = W(V.READINGS, V.READINGS_FEEDBACK) + ",\n" + MERGED + """ SELECT
  (SELECT count(*) FROM u) AS rows_before, (SELECT count(*) FROM merged) AS rows_after,
  (SELECT count(*) FROM u) - (SELECT count(*) FROM merged) AS rows_collapsed"""
    base = W(V.READINGS) + ",\n" + BASE_CTES
    d["baseline_stats"] = R(base + """ SELECT feature, mean, std, min, max, median, q25, q75, n_observations,
  CAST(len(list_distinct(qs)) AS BIGINT) AS n_edges FROM st""", ["mean", "std", "min", "max", "median", "q25", "q75"])
    d["baseline_histogram"] = R(base + ",\n" + HIST_CTES + " SELECT feature, CAST(bin AS BIGINT) AS bin, low, high, ref_share FROM hist",
                                ["low", "high", "ref_share"])
    psi_base = W(V.READINGS, V.PREDICTIONS) + ",\n" + BASE_CTES + ",\n" + HIST_CTES + ",\n" + PSI_CTES
    d["psi_report"] = R(psi_base + " SELECT * FROM psi", ["psi"])
    d["psi_ranked"] = R(psi_base + " SELECT *, row_number() OVER (ORDER BY psi DESC, feature ASC) AS psi_rank FROM psi", ["psi"])
    d["psi_metrics"] = R(psi_base + """ SELECT 'feature_psi' AS metric, feature, psi AS value FROM psi
  UNION ALL SELECT 'feature_psi_max', NULL, max(psi) FROM psi HAVING count(*) > 0""", ["value"])
    att = W(V.PREDICTIONS, V.GROUND_TRUTH) + ",\n" + ATTACHED
    d["attach_ground_truth"] = R(att + " SELECT id, model_version, predicted_aqi, actual_aqi, feedback_at FROM attached",
                                 ["predicted_aqi", "actual_aqi"])
    d["unknown_feedback"] = R(att + " SELECT * FROM lf WHERE prediction_id NOT IN (SELECT id FROM predictions)",
                              ["actual_aqi"])
    d["rolling_rmse"] = R(att + ",\n" + ROLLING + " SELECT * FROM rolling", ["rolling_rmse"])
    d["feedback_count"] = att + ",\n" + ROLLING + " SELECT feedback_count FROM rolling"
    d["feedback_recent"] = R(att + ",\n" + FEEDBACK_VIEW + " SELECT * EXCLUDE (_fb, _id) FROM fview "
                             "ORDER BY _fb DESC, _id DESC LIMIT 500", FVIEW_DOUBLES)
    d["feedback_export"] = R(att + ",\n" + FEEDBACK_VIEW + " SELECT * EXCLUDE (_fb, _id) FROM fview "
                             "ORDER BY _fb DESC, _id DESC", FVIEW_DOUBLES)
    mon = W(V.READINGS, V.PREDICTIONS, V.GROUND_TRUTH, V.RUNS) + ",\n" + ATTACHED + ",\n" + ROLLING + ",\n" + BASE_CTES \
        + ",\n" + HIST_CTES + ",\n" + PSI_CTES + """,
mp AS (SELECT coalesce(max(psi), 0.0) AS max_psi FROM psi),
dec AS (SELECT r.feedback_count, 10::BIGINT AS feedback_count_threshold, r.rolling_rmse, 100.0::DOUBLE AS rmse_threshold,
  mp.max_psi, 0.2::DOUBLE AS psi_threshold, 24::BIGINT AS window_hours, r.feedback_count >= 10 AS count_gate_met,
  coalesce(r.rolling_rmse > 100.0, false) AS rmse_gate_met,
  r.feedback_count >= 10 AND coalesce(r.rolling_rmse > 100.0, false) AS feedback_breach, mp.max_psi > 0.2 AS psi_breach,
  (r.feedback_count >= 10 AND coalesce(r.rolling_rmse > 100.0, false)) OR mp.max_psi > 0.2 AS should_retrain
  FROM rolling r, mp)"""
    d["decay_decision"] = R(mon + " SELECT * FROM dec", ["rolling_rmse", "rmse_threshold", "max_psi", "psi_threshold"])
    d["retrain_status"] = R(att + ",\n" + ROLLING + """ SELECT rolling_rmse AS rolling_rmse_24h,
  feedback_count AS feedback_count_window, 24::BIGINT AS window_hours, 10::BIGINT AS feedback_count_threshold,
  100.0::DOUBLE AS rmse_threshold, 0.2::DOUBLE AS psi_threshold, feedback_count >= 10 AS count_gate_met,
  coalesce(rolling_rmse > 100.0, false) AS rmse_gate_met,
  least(feedback_count / greatest(10.0::DOUBLE, 1.0::DOUBLE), 1.0::DOUBLE) AS feedback_progress FROM rolling""",
                            ["rolling_rmse_24h", "rmse_threshold", "psi_threshold", "feedback_progress"])
    d["retrain_branch"] = mon + f""", cool AS (SELECT coalesce((SELECT max(start_time) FROM runs) > {AS_OF} - INTERVAL 1 HOUR,
  false) AS c)
SELECT cool.c AS cooldown_active, dec.should_retrain, CASE WHEN cool.c THEN 'no_retrain_needed'
  WHEN dec.should_retrain THEN 'trigger_retrain' ELSE 'no_retrain_needed' END AS branch FROM dec, cool"""
    d["category_bands"] = R(W(V.READINGS) + """ SELECT event_id, target,
  CASE WHEN target IS NULL THEN NULL WHEN target <= 50 THEN 'Good' WHEN target <= 100 THEN 'Satisfactory'
       WHEN target <= 200 THEN 'Moderate' WHEN target <= 300 THEN 'Poor' WHEN target <= 400 THEN 'Very Poor'
       ELSE 'Severe' END AS band,
  CASE WHEN target IS NULL THEN NULL WHEN target <= 50 THEN '#00b050' WHEN target <= 100 THEN '#a9d08e'
       WHEN target <= 200 THEN '#ffc000' WHEN target <= 300 THEN '#ed7d31' WHEN target <= 400 THEN '#c00000'
       ELSE '#7030a0' END AS color FROM readings""", ["target"])
    d["predictions_by_version"] = W(V.PREDICTIONS) + """ SELECT model_version, model_family, count(*) AS n_predictions
  FROM predictions GROUP BY ALL"""
    hq = W(V.REQUESTS, V.PREDICTIONS) + ",\n" + HISTS
    d["bucket_histogram"] = R(hq + " SELECT * FROM hists", ["le"])
    d["histogram_quantile"] = R(hq + """,
hb AS (SELECT *, lag(le) OVER (PARTITION BY metric ORDER BY le_index) AS prev_le,
  coalesce(lag(cum_count) OVER (PARTITION BY metric ORDER BY le_index), 0) AS prev_cum FROM hists),
tot AS (SELECT metric, max(CASE WHEN le IS NULL THEN cum_count END) AS total, max(le) AS max_finite FROM hists GROUP BY metric),
qs AS (SELECT * FROM (VALUES ('request_duration_seconds', 0.5::DOUBLE), ('request_duration_seconds', 0.95::DOUBLE),
  ('request_duration_seconds', 0.99::DOUBLE), ('prediction_value', 0.5::DOUBLE)) t(metric, q)),
pick AS (SELECT qs.metric, qs.q, tot.total, tot.max_finite, (SELECT min(le_index) FROM hb WHERE hb.metric = qs.metric
  AND hb.le IS NOT NULL AND hb.cum_count >= qs.q * tot.total) AS b FROM qs JOIN tot USING (metric))
SELECT pick.metric, pick.q, CASE WHEN total IS NULL OR total = 0 THEN NULL WHEN b IS NULL THEN max_finite
  WHEN b = 0 AND hb.le <= 0 THEN hb.le
  ELSE (CASE WHEN b = 0 THEN 0.0 ELSE hb.prev_le END) + (hb.le - (CASE WHEN b = 0 THEN 0.0 ELSE hb.prev_le END))
       * ((pick.q * total - hb.prev_cum) / NULLIF(hb.cum_count - hb.prev_cum, 0)) END AS value
FROM pick LEFT JOIN hb ON hb.metric = pick.metric AND hb.le_index = pick.b""", ["q", "value"])
    d["latency_summary"] = R(W(V.PREDICTIONS) + """,
dd AS (SELECT latency_ms, id FROM predictions WHERE latency_ms IS NOT NULL),
nn AS (SELECT count(*) AS n, CAST(floor(0.95::DOUBLE * count(*)) AS BIGINT) - 1 AS idx FROM dd),
o AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms, id) - 1 AS i FROM dd)
SELECT (SELECT quantile_cont(latency_ms, 0.5) FROM dd) AS p50, (SELECT avg(latency_ms) FROM dd) AS mean, nn.n AS n,
  nn.n / ((SELECT sum(latency_ms) FROM dd) / 1000.0::DOUBLE) AS throughput_rps,
  (SELECT max(latency_ms) FROM o WHERE o.i = CASE WHEN nn.idx < 0 THEN nn.n + nn.idx ELSE nn.idx END) AS p95 FROM nn""",
                             ["p50", "mean", "throughput_rps", "p95"])
    d["rate_per_minute"] = R(W(V.REQUESTS) + """ SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, status,
  count(*) / 60.0::DOUBLE AS rate_per_s FROM requests GROUP BY ALL""", ["rate_per_s"])
    d["error_ratio_5m"] = R(W(V.REQUESTS) + """, x AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start,
  CAST(sum(CASE WHEN status LIKE '5__' THEN 1 ELSE 0 END) AS BIGINT) AS n_5xx, count(*) AS n FROM requests GROUP BY 1)
SELECT *, n_5xx / n AS error_ratio, n_5xx / n > 0.05 AS breach FROM x""", ["error_ratio"])
    d["sustained_alerts"] = _alerts_sql()
    d["dashboard_panels"] = _dashboard_sql()
    sp = W(V.READINGS) + ",\n" + _split_ctes("readings", "ts NULLS FIRST, event_id NULLS FIRST")
    d["chronological_split"] = sp + " SELECT event_id, row_pos, split FROM splitted"
    d["split_summary"] = sp + " SELECT split, count(*) AS n_rows, min(ts) AS min_ts, max(ts) AS max_ts FROM splitted GROUP BY split"
    d["holdout_tail"] = sp + """ SELECT event_id, row_pos FROM ranked
  WHERE row_pos - 1 >= CAST(floor(n * (1.0::DOUBLE - 0.15::DOUBLE)) AS BIGINT)"""
    d["keyset_page"] = R(W(V.READINGS) + f""" SELECT city, ts, event_id, p1, p2, target FROM readings
  WHERE ts > {AS_OF} - INTERVAL 24 HOUR ORDER BY ts, event_id LIMIT {PAGE_SIZE}""", ["p1", "p2", "target"])
    d["recent_predictions"] = R(W(V.PREDICTIONS) + """ SELECT id, created_at, model_version, predicted_aqi FROM predictions
  ORDER BY created_at DESC, id DESC LIMIT 10""", ["predicted_aqi"])
    zc = ["p1", "p2", "p1_lag1", "p2_roll7"]
    fit = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in zc)
    zs = ", ".join(f"({c} - mu_{c}) / (CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1.0 ELSE sd_{c} END) AS {c}" for c in zc)
    d["standardize"] = R(W(V.READINGS) + ",\n" + built_ctes("readings") + ",\n"
                         + _split_ctes("built", "ts NULLS FIRST, event_id NULLS FIRST")
                         + f", fit AS (SELECT {fit} FROM splitted WHERE split = 'train') SELECT event_id, split, {zs} "
                         "FROM splitted, fit", zc)
    tcols = ["p1", "p2", *LAG_COLS, *ROLL_COLS, "city_target_enc"]
    d["training_table"] = R(W(V.READINGS) + ",\n" + built_ctes("readings") + ",\n"
                            + _split_ctes("built", "ts NULLS FIRST, event_id NULLS FIRST")
                            + " SELECT ts, event_id, split, " + ", ".join(f"CAST({c} AS FLOAT) AS {c}" for c in tcols)
                            + ", CAST(target AS FLOAT) AS target FROM splitted", tcols + ["target"])
    d["regression_metrics"] = R(att + ",\n" + _split_ctes("(SELECT * FROM attached WHERE actual_aqi IS NOT NULL)",
                                                          "created_at NULLS FIRST, id NULLS FIRST") + """
SELECT split, count(*) AS n, sqrt(avg(pow(predicted_aqi - actual_aqi, 2))) AS rmse, avg(abs(predicted_aqi - actual_aqi)) AS mae,
  CASE WHEN sum(actual_aqi * actual_aqi) - pow(sum(actual_aqi), 2) / count(actual_aqi) > 0
    THEN 1 - sum(pow(predicted_aqi - actual_aqi, 2)) / (sum(actual_aqi * actual_aqi) - pow(sum(actual_aqi), 2) / count(actual_aqi))
  END AS r2 FROM splitted GROUP BY split""", ["rmse", "mae", "r2"])
    d["scoring_rows"] = _scoring_sql()
    d["request_errors"] = W(V.NESTED_REQUESTS) + " SELECT * FROM request_errors"
    d["score_to_log"] = _score_to_log_sql()
    d["counter_rate"] = _counter_rate_sql()
    before = f"{AS_OF} - INTERVAL 24 HOUR"
    earlier = d["psi_metrics"].replace(f"created_at > {before}", f"created_at > {AS_OF} - INTERVAL 48 HOUR AND created_at <= {before}")
    assert earlier != d["psi_metrics"]
    d["psi_history"] = f"""SELECT {before} AS as_of, * FROM ({earlier})
  UNION ALL SELECT {AS_OF}, * FROM ({d["psi_metrics"]})"""
    runs = W(V.RUNS) + ",\n" + RUNS_LATEST
    d["latest_run_per_family"] = R(runs + " SELECT * EXCLUDE (rk) FROM latest", ["val_rmse"])
    d["champion"] = R(runs + " SELECT * FROM champ", ["val_rmse"])
    mv = W(V.RUNS) + ",\n" + V.MODEL_VERSIONS[:-0 or None] + ",\n" + RUNS_LATEST
    d["promote"] = mv + """ SELECT name, version, run_id, CASE WHEN stage = 'Production' THEN 'Archived' ELSE stage END AS stage
  FROM model_versions UNION ALL SELECT 'aqi_regressor', CAST(coalesce((SELECT max(version) FROM model_versions), 0) + 1 AS INTEGER),
  run_id, 'Production' FROM champ"""
    d["recent_runs"] = W(V.DAG_RUNS) + """ SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dag_id
  ORDER BY start_date DESC NULLS LAST, run_id DESC) AS recency_rank FROM dag_runs) WHERE recency_rank <= 5"""
    d["version_family"] = W(V.RUNS) + ",\n" + V.MODEL_VERSIONS + """ SELECT name, version, run_id,
  coalesce(r.model_family, 'unknown') AS model_family FROM model_versions LEFT JOIN (SELECT run_id, model_family FROM runs) r
  USING (run_id) WHERE stage = 'Production'"""
    fcols = ["p1", "p2", *LAG_COLS, *ROLL_COLS, "city_target_enc"]
    d["feature_columns"] = W(V.READINGS) + ",\n" + built_ctes("readings") + " " + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{c}' AS feature, 'double' AS dtype, count({c}) AS n_non_null FROM built"
        for i, c in enumerate(fcols))
    d["landing_check"] = "SELECT count(*) AS n_rows FROM events"
    d["csv_landing"] = R(W(V.RAW_READINGS) + """ SELECT * REPLACE (nullif("Date", 'n/a') AS "Date") FROM raw_readings""", ["PM2.5", "PM10", "AQI"])
    d["monitor_job"] = d["decay_decision"]
    d["features_roundtrip"] = d["feature_build"]
    d["report_roundtrip"] = d["validate_report"]
    d["encoding_roundtrip"] = d["target_encode"]
    d["uuid_check"] = """ WITH t AS (SELECT event_id, event_type, md5(CAST(event_id AS VARCHAR)) AS raw FROM events),
u AS (SELECT *, substr(raw, 1, 8) || '-' || substr(raw, 9, 4) || '-' || substr(raw, 13, 4) || '-' || substr(raw, 17, 4)
  || '-' || substr(raw, 21, 12) AS dashed FROM t)
SELECT event_id, regexp_full_match(CASE WHEN event_type = 'error' THEN raw WHEN event_type = 'view' THEN upper(dashed)
  ELSE dashed END, '[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}') AS is_uuid FROM u"""
    d["provenance"] = W(V.READINGS) + """ SELECT 'r1' AS run_id, 'xgboost' AS model_family, count(*) AS dataset_rows,
  (SELECT count(*) FROM (DESCRIBE SELECT * FROM readings)) AS feature_count, 'train' AS stage FROM readings"""
    d["baseline_roundtrip"] = d["baseline_histogram"]
    d["prediction_log_window"] = R(W(V.PREDICTIONS) + f""" SELECT id, created_at, model_version, predicted_aqi
  FROM predictions WHERE created_at > {AS_OF} - INTERVAL 24 HOUR""", ["predicted_aqi"])
    d["feedback_raw_rows"] = R(att + """, raw AS (SELECT json_extract_string(input_features, '$.city') AS "City",
  json_extract_string(input_features, '$.date') AS "Date",
  TRY_CAST(json_extract_string(input_features, '$."PM2.5"') AS DOUBLE) AS "PM2.5",
  TRY_CAST(json_extract_string(input_features, '$."PM10"') AS DOUBLE) AS "PM10", actual_aqi AS "AQI"
  FROM attached WHERE actual_aqi IS NOT NULL)
SELECT * FROM raw WHERE "City" IS NOT NULL AND "Date" IS NOT NULL""", ["PM2.5", "PM10", "AQI"])
    return d


ORACLE: dict[str, str] = build()

"""DuckDB definitions of the derived views (same rules as ``driftwise.sources.views``)."""

K = "TRY_CAST(json_extract_string(props, '$.k') AS BIGINT)"

READINGS = f"""readings AS (
  SELECT user_id AS city, ts, event_id,
    CAST(CASE WHEN event_type = 'error' THEN NULL ELSE value END AS DOUBLE) AS p1,
    CAST(CASE WHEN event_type = 'signup' THEN NULL ELSE {K} END AS DOUBLE) AS p2,
    CAST(CASE WHEN event_type = 'view' THEN NULL ELSE value + {K} END AS DOUBLE) AS target
  FROM events)"""

RAW_READINGS = f"""raw_readings AS (
  SELECT CAST(user_id AS VARCHAR) AS "City",
    CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS "Date",
    CAST(CASE WHEN event_type = 'error' THEN NULL ELSE value END AS DOUBLE) AS "PM2.5",
    CAST(CASE WHEN event_type = 'signup' THEN NULL ELSE {K} END AS DOUBLE) AS "PM10",
    CAST(CASE WHEN event_type = 'view' THEN NULL ELSE value + {K} END AS DOUBLE) AS "AQI"
  FROM events)"""

READINGS_FEEDBACK = f"""readings_feedback AS (
  SELECT user_id AS city, ts, event_id, CAST(value AS DOUBLE) AS p1, CAST({K} AS DOUBLE) AS p2,
    value + {K} + 100.0 AS target, ts AS feedback_at
  FROM events WHERE event_type = 'purchase')"""

PREDICTIONS = f"""predictions AS (
  SELECT event_id AS id, ts AS created_at, event_type AS model_version,
    CASE WHEN event_type IN ('view', 'click') THEN 'gbt' ELSE 'linear' END AS model_family,
    json_object('city', CAST(user_id AS VARCHAR), 'date', strftime(ts, '%Y-%m-%d'),
      'PM2.5', CAST(CASE WHEN event_type = 'error' THEN NULL ELSE value END AS DOUBLE),
      'PM10', CAST(CASE WHEN event_type = 'signup' THEN NULL ELSE {K} END AS DOUBLE)) AS input_features,
    value AS predicted_aqi, CAST({K} AS DOUBLE) AS latency_ms
  FROM events)"""

GROUND_TRUTH = f"""ground_truth AS (
  SELECT event_id AS prediction_id, CAST(value + ({K} - 50) AS DOUBLE) AS actual_aqi,
    ts + INTERVAL 1 HOUR AS feedback_at FROM events WHERE event_type <> 'view'
  UNION ALL
  SELECT event_id, CAST(value + {K} AS DOUBLE), ts + INTERVAL 2 HOUR FROM events WHERE event_type = 'purchase'
  UNION ALL
  SELECT -1 - event_id, CAST(value AS DOUBLE), ts + INTERVAL 1 HOUR FROM events WHERE event_type = 'error')"""

REQUESTS = f"""requests AS (
  SELECT event_id AS request_id, ts, CASE WHEN event_type = 'error' THEN '500' ELSE '200' END AS status,
    {K} / 200.0 AS duration_s
  FROM events)"""

REQUEST_PAYLOADS = f"""request_payloads AS (
  SELECT event_id AS payload_id,
    json_object('city', CAST(user_id AS VARCHAR),
      'date', CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d') END,
      'PM2.5', value,
      'PM10', CASE WHEN event_type = 'click' THEN 'n/a' ELSE CAST({K} AS VARCHAR) END) AS body
  FROM events)"""

#: Requests with nested bodies: their rows, the history elements of the well-formed ones, and every fault.
NESTED_REQUESTS = f"""request_rows AS (
  SELECT event_id AS request_id, user_id, ts, event_type, value, {K} AS k,
    event_type = 'click' AND {K} = 99 AS broken, event_type = 'purchase' AND {K} = 7 AS no_list,
    list({{'d': CASE WHEN event_type = 'view' AND {K} % 20 = 4 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END,
      'bad': event_type = 'error' AND {K} % 20 = 3, 'k': {K}}})
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS hist FROM events),
request_items AS (
  SELECT request_id, i, hist[i + 1].d AS d, hist[i + 1].bad AS bad, CAST(hist[i + 1].k AS DOUBLE) AS pm10
  FROM (SELECT request_id, hist, unnest(range(len(hist))) AS i FROM request_rows WHERE NOT broken AND NOT no_list)),
request_errors AS (
  SELECT request_id, 'body' AS path, 'not JSON' AS reason FROM request_rows WHERE broken
  UNION ALL SELECT request_id, 'reading.city', 'not text' FROM request_rows WHERE NOT broken AND event_type = 'error'
  UNION ALL SELECT request_id, 'reading.date', 'missing' FROM request_rows WHERE NOT broken AND event_type = 'signup' AND k % 10 = 4
  UNION ALL SELECT request_id, 'history', 'not a list' FROM request_rows WHERE no_list
  UNION ALL SELECT request_id, 'history[' || i || '].date', 'missing' FROM request_items WHERE d IS NULL
  UNION ALL SELECT request_id, 'history[' || i || '].PM10', 'not a number' FROM request_items WHERE bad)"""

#: Counter per status, sampled each minute that saw a request of the status, starting again every day.
SCRAPED_COUNTERS = """scraped_counters AS (
  SELECT status, make_timestamp(CAST(ceil(epoch_us(ts) / 60000000.0::DOUBLE) AS BIGINT) * 60000000) AS scraped_at,
    CAST(sum(count(*)) OVER (PARTITION BY status, CAST(ceil(epoch_us(ts) / 60000000.0::DOUBLE) AS BIGINT) // 1440
      ORDER BY CAST(ceil(epoch_us(ts) / 60000000.0::DOUBLE) AS BIGINT)) AS DOUBLE) AS total
  FROM requests GROUP BY status, CAST(ceil(epoch_us(ts) / 60000000.0::DOUBLE) AS BIGINT))"""

RUNS = f"""runs AS (
  SELECT CAST(event_id AS VARCHAR) AS run_id,
    CASE WHEN {K} < 50 THEN 'xgboost' ELSE 'pytorch_nn' END AS model_family,
    CASE WHEN value < 5 THEN 'FAILED' ELSE 'FINISHED' END AS status,
    ts AS start_time, {K} * 100 AS dataset_rows, 97 AS feature_count,
    CASE WHEN value > 300 THEN NULL ELSE value END AS val_rmse
  FROM events WHERE event_type = 'signup')"""

DAG_RUNS = """dag_runs AS (
  SELECT event_type AS dag_id, CAST(event_id AS VARCHAR) AS run_id,
    CASE WHEN value > 100 THEN 'failed' ELSE 'success' END AS state, ts AS start_date
  FROM events)"""

MODEL_VERSIONS = """model_versions AS (
  SELECT 'aqi_regressor' AS name, CAST(v AS INTEGER) AS version, run_id,
    CASE WHEN v = max(v) OVER () THEN 'Production' ELSE 'Archived' END AS stage
  FROM (SELECT run_id, row_number() OVER (ORDER BY start_time NULLS FIRST, run_id NULLS FIRST) AS v
        FROM runs WHERE status = 'FINISHED' AND model_family = 'xgboost' AND val_rmse IS NOT NULL))"""


def with_views(*views: str) -> str:
    return "WITH " + ",\n".join(views)

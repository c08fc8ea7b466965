"""Registered streaming queries. Each drains a file stream once (availableNow) and returns the result
table; the oracle SQL computes the same result in batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftwise.operators.alerts import ERROR_RATE_RULE
from driftwise.plans import oracle_views as OV
from driftwise.plans.oracle import BASE_CTES, HIST_CTES, R, W, bin_expr, islands, pd_double
from driftwise.plans.queries import _baseline, finish
from driftwise.sources import views as V
from driftwise.streaming import streams as S


def _events(spark, sf):
    return S.table_stream(spark, sf, "events")


def _requests(spark, sf):
    e = _events(spark, sf)
    from driftwise.functions.exprs import event_time

    return e.select(event_time(F.col("ts")).alias("t"),
                    F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200")).alias("status"))


def q_stream_feedback_join(spark, sf):
    subs = S.submissions_stream(_events(spark, sf)).drop("fb_t")
    return finish(S.run_attach_batched(subs, V.predictions(spark, sf), "feedback_join"))


def q_stream_join_watermarked(spark, sf):
    return finish(S.run_join(_events(spark, sf), _events(spark, sf), V.predictions(spark, sf), "stream_join"))


def q_stream_rmse(spark, sf):
    """T-1: 10-minute panes of the joined streams, late feedback included; 24-hour sliding windows are running-sum
    differences over the pane table (the rows of a sliding window(), without 144 state updates per event)."""
    return finish(S.sliding_from_panes(S.run_panes(_events(spark, sf), _events(spark, sf), V.predictions(spark, sf), "rmse")))


def q_stream_dedup(spark, sf):
    """T-5: the submission stream is delivered at least once (the events file read by two sources), the
    stream drops the redeliveries (bounded state), latest-wins per id is resolved on the deduplicated table."""
    from driftwise.operators.feedback import latest_feedback

    subs = S.submissions_stream(_events(spark, sf)).unionByName(S.submissions_stream(_events(spark, sf)))
    deduped = S.run(S.stream_dedup_submissions(subs), "dedup", "append")
    return finish(latest_feedback(deduped.drop("fb_t")))


def q_stream_rates(spark, sf):
    ending = S.Ending(spark)
    return finish(S.run(S.stream_rates(ending.mark(_requests(spark, sf), t=f"timestamp'{ending.FAR}'")), "rates", "append", ending=ending))


def q_stream_cooldown(spark, sf):
    """T-6 (batch-W10 form): closed windows from the pane pipeline, then gaps-and-islands in batch."""
    win = S.read_sink(spark, S.closed_windows(spark, _requests(spark, sf)))
    return finish(S.sustained_from_windows(win, ERROR_RATE_RULE))


def q_stream_alert_state(spark, sf):
    return finish(S.stream_alerts(spark, _requests(spark, sf), ERROR_RATE_RULE))


def q_stream_psi(spark, sf):
    base = _baseline(spark, sf)
    feats = ["PM2.5", "PM10"]
    ending = S.Ending(spark)
    inputs = ending.mark(S.predictions_inputs_stream(_events(spark, sf), feats), t=f"timestamp'{ending.FAR}'", feature=f"'{feats[0]}'", value="0")
    counts = S.run(S.stream_bin_counts(inputs, base), "psi_counts", "append", ending=ending)
    return finish(S.psi_from_counts(counts, base))


STREAM_QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_stream_")}

_SUBS = OV.GROUND_TRUTH.replace("ground_truth AS", "subs AS")
_STREAM_ATT = "satt AS (SELECT s.prediction_id, p.model_version, p.predicted_aqi, s.actual_aqi, s.feedback_at, " \
              "s.actual_aqi - p.predicted_aqi AS error FROM subs s JOIN predictions p ON p.id = s.prediction_id " \
              "AND s.feedback_at >= p.created_at)"

STREAM_ORACLE = {
    "stream_feedback_join": R(W(OV.PREDICTIONS, _SUBS) + ",\n" + _STREAM_ATT + " SELECT * FROM satt",
                              ["predicted_aqi", "actual_aqi", "error"]),
    "stream_join_watermarked": R(W(_SUBS) + """,
m AS (SELECT e.event_id AS id, e.event_type AS model_version, e.value AS predicted_aqi, s.actual_aqi, s.feedback_at,
    e.ts AS created_at FROM events e JOIN subs s ON s.prediction_id = e.event_id AND s.feedback_at >= e.ts),
un AS (SELECT e.event_id AS id, e.event_type AS model_version, e.value AS predicted_aqi,
    CAST(NULL AS DOUBLE) AS actual_aqi, CAST(NULL AS TIMESTAMP) AS feedback_at, e.ts AS created_at FROM events e
  WHERE NOT EXISTS (SELECT 1 FROM subs s WHERE s.prediction_id = e.event_id AND s.feedback_at >= e.ts))
SELECT * FROM m UNION ALL SELECT * FROM un""", ["predicted_aqi", "actual_aqi"]),
    "stream_rmse": R(W(OV.PREDICTIONS, _SUBS) + ",\n" + _STREAM_ATT + """,
x AS (SELECT unnest(generate_series(time_bucket(INTERVAL 10 MINUTE, feedback_at) - INTERVAL 1430 MINUTE,
  time_bucket(INTERVAL 10 MINUTE, feedback_at), INTERVAL 10 MINUTE)) AS window_start, error FROM satt)
SELECT window_start, window_start + INTERVAL 24 HOUR AS window_end, count(*) AS n, sum(error * error) AS sse,
  sqrt(sum(error * error) / count(*)) AS rmse FROM x GROUP BY window_start""", ["sse", "rmse"]),
    "stream_dedup": R(W(OV.GROUND_TRUTH) + """, lf AS (SELECT prediction_id, actual_aqi, feedback_at, n_submissions FROM (
  SELECT *, row_number() OVER (PARTITION BY prediction_id ORDER BY feedback_at DESC, actual_aqi DESC) AS rn,
    count(*) OVER (PARTITION BY prediction_id) AS n_submissions FROM ground_truth) WHERE rn = 1) SELECT * FROM lf""",
                      ["actual_aqi"]),
    "stream_rates": R(W(OV.REQUESTS) + """ SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS window_start, status,
  count(*) / 60.0::DOUBLE AS rate_per_s FROM requests
  GROUP BY 1, 2""", ["rate_per_s"]),
    "stream_cooldown": W(OV.REQUESTS) + """,
rp AS (SELECT CAST(floor(epoch_us(ts) / 1e6 / 30) * 30 AS BIGINT) AS p,
    CASE WHEN status LIKE '5__' THEN 1 ELSE 0 END AS e FROM requests),
sw AS (SELECT p + 30 * j AS t, e FROM rp, range(1, 11) r(j)),
wb AS (SELECT t, count(*) AS n, sum(e) AS n5 FROM sw GROUP BY t),
wg AS (SELECT unnest(range((SELECT min(t) FROM wb), (SELECT max(t) FROM wb) + 30, 30)) AS t),
es AS (SELECT g.t, CASE WHEN b.n > 0 THEN b.n5 / b.n END AS value FROM wg g LEFT JOIN wb b USING (t)),
""" + islands("a1", "es", ERROR_RATE_RULE.name, ERROR_RATE_RULE.severity, ERROR_RATE_RULE.threshold,
              ERROR_RATE_RULE.for_s) + " SELECT * EXCLUDE (label) FROM a1",
    "stream_alert_state": W(OV.REQUESTS) + """,
-- stage 1: 30 s panes
rp AS (SELECT CAST(floor(epoch_us(ts) / 1e6 / 30) * 30 AS BIGINT) AS p,
    CASE WHEN status LIKE '5__' THEN 1 ELSE 0 END AS e FROM requests),
-- stage 2: 5 min windows over the panes
sw AS (SELECT p + 30 * j AS t, e FROM rp, range(1, 11) r(j)),
wb AS (SELECT t, count(*) AS n, sum(e) AS n5 FROM sw GROUP BY t),
wg AS (SELECT unnest(range((SELECT min(t) FROM wb), (SELECT max(t) FROM wb) + 30, 30)) AS t),
es AS (SELECT g.t, CASE WHEN b.n > 0 THEN b.n5 / b.n END AS value FROM wg g LEFT JOIN wb b USING (t)),
""" + islands("a1", "es", ERROR_RATE_RULE.name, ERROR_RATE_RULE.severity, ERROR_RATE_RULE.threshold,
              ERROR_RATE_RULE.for_s) + " SELECT alert, severity, pending_since, firing_since FROM a1",
    "stream_psi": R(W(OV.READINGS, OV.PREDICTIONS) + ",\n" + BASE_CTES + ",\n" + HIST_CTES + f""",
keys AS (SELECT created_at, input_features AS j, unnest(json_keys(input_features)) AS feature FROM predictions),
cur AS (SELECT time_bucket(INTERVAL 1 DAY, created_at) AS window_start, feature,
  {pd_double("json_extract_string(j, '$.\"' || feature || '\"')")} AS value FROM keys
  WHERE feature IN ('PM2.5', 'PM10')),
cb AS (SELECT c.window_start, c.feature, {bin_expr('c.value', 'edges.e')} AS bin FROM cur c JOIN edges USING (feature)
  WHERE c.value IS NOT NULL),
cnt AS (SELECT window_start, feature, bin, count(*) AS n FROM cb GROUP BY ALL),
wk AS (SELECT DISTINCT window_start, feature FROM cnt),
tot AS (SELECT window_start, feature, sum(n) AS tot FROM cnt WHERE bin IS NOT NULL GROUP BY ALL),
terms AS (SELECT k.window_start, k.feature,
    CASE WHEN coalesce(c.n, 0) / t.tot = 0 THEN 1e-4 ELSE coalesce(c.n, 0) / t.tot END AS cs,
    CASE WHEN h.ref_share = 0 THEN 1e-4 ELSE h.ref_share END AS rs
  FROM wk k JOIN hist h USING (feature) JOIN tot t USING (window_start, feature)
  LEFT JOIN cnt c ON c.window_start = k.window_start AND c.feature = k.feature AND c.bin = h.bin WHERE t.tot > 0),
agg AS (SELECT window_start, feature, sum((cs - rs) * ln(cs / rs)) AS psi FROM terms GROUP BY ALL),
sz AS (SELECT window_start, feature, sum(n) AS n_current, sum(CASE WHEN bin IS NULL THEN n ELSE 0 END) AS n_out_of_range
  FROM cnt GROUP BY ALL)
SELECT k.window_start, k.feature, coalesce(a.psi, 0.0) AS psi, CAST(s.n_current AS BIGINT) AS n_current,
  CAST(s.n_out_of_range AS BIGINT) AS n_out_of_range
FROM wk k LEFT JOIN agg a USING (window_start, feature) JOIN sz s USING (window_start, feature)""", ["psi"]),
}

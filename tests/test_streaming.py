"""Streaming semantics beyond the batch oracles: late data against the watermark, across micro-batches."""

import datetime as dt
import os

from pyspark.sql import functions as F

from driftwise.functions.exprs import event_time
from driftwise.streaming import streams as S

T0 = dt.datetime(2024, 1, 1)


def _write(spark, path, rows):
    spark.createDataFrame(rows, "ts timestamp_ntz, status string").coalesce(1).write.mode("append").parquet(path)


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    _write(spark, src, [(T0 + dt.timedelta(minutes=m), "200") for m in range(0, 60, 2)])   # 00:00 .. 00:58
    schema = spark.read.parquet(src).schema

    def drain():
        req = spark.readStream.schema(schema).parquet(src).select(event_time(F.col("ts")).alias("t"), "status")
        q = (S.stream_rates(req).writeStream.outputMode("append")
             .foreachBatch(lambda b, i: b.write.mode("append").parquet(out))
             .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
        q.awaitTermination(300)
        assert q.exception() is None

    drain()
    first = {r["window_start"] for r in spark.read.parquet(out).collect()}
    # watermark is now 00:58 - 10 min = 00:48: windows before it are closed and emitted
    assert T0 + dt.timedelta(minutes=46) in first and T0 + dt.timedelta(minutes=56) not in first
    # second file: one row far behind the watermark (00:10), one on time (01:30) that advances it
    _write(spark, src, [(T0 + dt.timedelta(minutes=10, seconds=30), "500"), (T0 + dt.timedelta(minutes=90), "200")])
    drain()
    got = spark.read.parquet(out)
    late = got.where(F.col("window_start") == T0 + dt.timedelta(minutes=10)).collect()
    assert len(late) == 1 and late[0]["status"] == "200"        # the late 500 never reached the window
    assert got.where(F.col("status") == "500").count() == 0
    assert got.where(F.col("window_start") == T0 + dt.timedelta(minutes=58)).count() == 1   # closed by 01:30
    assert os.path.isdir(ckpt)


def test_replayed_micro_batch_does_not_duplicate_output(spark, tmp_path):
    out = str(tmp_path / "sink")
    b0 = spark.range(5).withColumnRenamed("id", "x")
    S._idempotent_write(b0, 0, out, complete=False)
    S._idempotent_write(spark.range(5, 8).withColumnRenamed("id", "x"), 1, out, complete=False)
    S._idempotent_write(b0, 0, out, complete=False)          # batch 0 replayed after a failure
    got = sorted(r["x"] for r in S.read_sink(spark, out).collect())
    assert got == list(range(8))


def test_feedback_of_any_age_is_attached(spark, tmp_path):
    import datetime as dt

    from driftwise.streaming import streams as S

    t = dt.datetime(2024, 1, 1)
    pred = spark.createDataFrame([(1, 10.0, "v1", t), (2, 20.0, "v1", t)],
                                 "id long, predicted_aqi double, model_version string, created_at timestamp_ntz")
    rows = [(1, 11.0, t + dt.timedelta(hours=2)), (1, 15.0, t + dt.timedelta(days=2)), (7, 1.0, t + dt.timedelta(hours=1)),
            (2, 21.0, t + dt.timedelta(days=30))]
    schema = "prediction_id long, actual_aqi double, feedback_at timestamp_ntz"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "subs"))
    subs = spark.readStream.schema(schema).parquet(str(tmp_path / "subs"))
    got = {(r["prediction_id"], r["error"]) for r in S.run_attach_batched(subs, pred, "late").collect()}
    assert got == {(1, 1.0), (1, 5.0), (2, 1.0)}


def test_a_stream_that_runs_out_of_time_raises():
    import pytest

    from driftwise.streaming import streams as S

    class Slow:
        stopped = False

        def awaitTermination(self, timeout=None):
            return False

        def stop(self):
            self.stopped = True

    q = Slow()
    with pytest.raises(TimeoutError):
        S._drain(q, "slow", 1)
    assert q.stopped


def test_feedback_of_any_age_and_last_windows(spark):
    """The streams give up a prediction after an hour here, so the overwrites two hours later come too late for them: the
    result is that of a join which waits long enough, and holds every submission and every prediction."""
    from driftwise.sources import views as V
    from driftwise.streaming.queries import _events
    from tests.conftest import SF_SMALL

    def both(hours):
        events, log = [lambda: _events(spark, SF_SMALL), V.predictions(spark, SF_SMALL)]
        joined = S.run_join(events(), events(), log, f"join{hours}", within_hours=hours)
        panes = S.run_panes(events(), events(), log, f"panes{hours}", within_hours=hours)
        return [sorted(map(str, df.collect())) for df in (joined, panes)]

    early, late = both(1), both(3)
    assert early == late
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert len({r.split("id=")[1].split(",")[0] for r in early[0]}) == events.count()
    answers = events.where("event_type != 'view'").count() + events.where("event_type = 'purchase'").count()
    assert len(early[0]) == answers + events.where("event_type = 'view'").count()

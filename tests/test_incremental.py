"""The feature table kept up to date by changes equals the full rebuild, and only what a change reaches is written."""

import datetime as dt
import os
import random
import statistics
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from driftwise.operators import features, feedback, incremental
from driftwise.operators.quantiles import counted_medians
from driftwise.params import FeatureParams, SkewParams

P = FeatureParams(lags=(1, 2), rolls=(2, 3))
SCHEMA = "city string, ts timestamp_ntz, event_id long, p1 double, p2 double, target double"
T0 = dt.datetime(2024, 1, 1)


def _readings():
    """Twelve cities; those from 8 on begin without p1, so that the median fills it; some rows without key, time or target."""
    rng, rows = random.Random(4), []
    for c in range(12):
        for i in range(20):
            p1 = None if (c >= 8 and i < 3) or rng.random() < 0.2 else float(rng.randrange(100))
            rows.append((f"c{c}", T0 + dt.timedelta(days=i), len(rows), p1, float(rng.randrange(50)), None if rng.random() < 0.1 else float(rng.randrange(300))))
    rows.append((rows[5][0], rows[5][1], len(rows), 7.0, 7.0, 7.0))                     # a second reading of one time
    return [*rows, (None, T0, 9001, 1.0, 1.0, 1.0), ("c1", None, 9002, 1.0, 1.0, 1.0)]


def _feedback(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", feedback_at timestamp_ntz")


def _full(base, fb, p=P):
    merged = feedback.merge_latest(base, fb, ["city", "ts"], ["feedback_at", "event_id"]).drop("_src", "feedback_at")
    return features.build_features(merged, p)


def _rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in (r[c] for c in cols)) for r in df.collect()), key=str)


def _files(root, table):
    return {(d, f) for d in os.listdir(f"{root}/{table}") if "=" in d for f in os.listdir(f"{root}/{table}/{d}") if f.endswith(".parquet")}


@pytest.mark.parametrize("skew", [SkewParams(), SkewParams(hot_key_rows=4, segment_rows=5)])
def test_changes_equal_the_full_rebuild(spark, tmp_path, skew):
    p, root = replace(P, skew=skew), str(tmp_path / "state")
    base = spark.createDataFrame(_readings(), SCHEMA)
    at = lambda d: T0 + dt.timedelta(days=d)
    first = [("c0", at(3), 500, 5.0, None, 50.0, at(40)), ("c0", at(3), 501, 6.0, 2.0, 60.0, at(41)), ("c9", at(90), 502, None, 1.0, 9.0, at(41))]
    incremental.start(base, _feedback(spark, first), root, p, n_parts=8)
    assert _rows(incremental.load(spark, root)) == _rows(_full(base, _feedback(spark, first), p))
    before = _files(root, "features")

    # No pollutant changes: the medians stay, and only the part of this city is written.
    row = incremental.load(spark, root).where("city = 'c1'").orderBy("ts").first()
    quiet = spark.read.parquet(f"{root}/rows").where(F.col("city") == "c1").where(F.col("ts") == F.lit(row["ts"])).first()
    same = [("c1", row["ts"], 503, quiet["p1"], quiet["p2"], 77.0, at(50))]
    parts = incremental.add_feedback(spark, _feedback(spark, same), root, p)
    assert len(parts) == 1
    assert _rows(incremental.load(spark, root)) == _rows(_full(base, _feedback(spark, first + same), p))
    after = _files(root, "features")
    assert {d for d, _ in before - after} == {f"_part={parts[0]}"} == {d for d, _ in after - before}

    # The median of p1 moves: cities whose first values it fills are made anew too. Late, repeated and new keys.
    moved = [("c2", at(d), 600 + d, 99.5, 1.0, 1.0, at(60)) for d in range(20)] + [("new", at(d), 700 + d, 98.5, 3.0, 4.0, at(60)) for d in range(5)]
    old = [("c0", at(3), 400, 1.0, 1.0, 1.0, at(30)), (None, at(1), 800, 1.0, 1.0, 1.0, at(60)), ("c3", None, 801, 1.0, 1.0, 1.0, at(60))]
    for _ in range(2):                                                                  # given twice: the same state
        reached = incremental.add_feedback(spark, _feedback(spark, moved + old), root, p)
        assert _rows(incremental.load(spark, root)) == _rows(_full(base, _feedback(spark, first + same + moved + old), p))
    assert incremental.add_feedback(spark, _feedback(spark, []), root, p) == [] and reached


def test_a_run_that_died_is_repeated(spark, tmp_path, monkeypatch):
    root, base = str(tmp_path / "state"), spark.createDataFrame(_readings(), SCHEMA)
    incremental.start(base, _feedback(spark, []), root, P, n_parts=8)
    change = _feedback(spark, [("c2", T0 + dt.timedelta(days=d), 600 + d, 99.5, 1.0, 1.0, T0) for d in range(20)])

    def dies(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(incremental, "_built", dies)                                           # rows and counts are written already
        with pytest.raises(RuntimeError):
            incremental.add_feedback(spark, change, root, P)
    incremental.add_feedback(spark, change, root, P)
    assert _rows(incremental.load(spark, root)) == _rows(_full(base, change))


def test_rows_without_keys_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="key and a time"):
        incremental.start(spark.createDataFrame([(None, T0, 1, 1.0, 1.0, 1.0)], SCHEMA), _feedback(spark, []), str(tmp_path / "s"), P)


@pytest.mark.parametrize("leaf", [20_000, 3])
def test_counted_medians(spark, leaf):
    rng = random.Random(8)
    groups = {"even": [float(i) for i in range(100)], "ties": [1.0] * 50 + [2.0] * 50, "one": [3.5], "odd": [rng.uniform(-1e300, 1e300) for _ in range(101)],
              "mixed": [rng.choice([1e-300, -0.5, 1e9, 7.0, 7.25]) for _ in range(64)]}
    rows = [(g, v, vs.count(v)) for g, vs in groups.items() for v in set(vs)]
    split = [(g, v, m) for g, v, k in rows for m in ([k] if k < 2 else [1, k - 1])]        # a value may stand in several rows
    got = counted_medians(spark.createDataFrame([*split, ("even", None, 9), ("none", None, 2)], "g string, v double, k long"), "g", "v", "k", leaf=leaf)
    assert got == {g: pytest.approx(statistics.median(vs)) for g, vs in groups.items()}

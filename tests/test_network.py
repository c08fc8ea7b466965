"""The network: beats the linear family where the target bends, does not depend on the partitioning, stops early, is storable."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.operators import network, train


def _bent(spark, n=600):
    rng = np.random.default_rng(3)
    x = rng.uniform(-2, 2, (n, 2))
    rows = [(float(a), float(b) if i % 9 else None, float(abs(a) * 10 + (b if i % 9 else 0.0)), "val" if i % 4 == 0 else "train") for i, (a, b) in enumerate(x)]
    return spark.createDataFrame(rows, "a double, b double, y double, split string")


def _rmse(model, df):
    return {r["split"]: r["rmse"] for r in train.evaluate(model, df, "y").collect()}


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    sizes, x, y = (3, 4, 2, 1), rng.normal(size=(7, 3)), rng.normal(size=7)
    flat = network._start(sizes, 1) + 0.01
    _, g = network._gradient(x, y, network._layers(flat, sizes))
    for i in range(len(flat)):
        e = np.zeros(len(flat))
        e[i] = 1e-6
        up, down = (network._gradient(x, y, network._layers(flat + s * e, sizes))[0] for s in (1, -1))
        assert g[i] == pytest.approx((up - down) / 4e-6, abs=1e-4)


def test_beats_the_line_and_ignores_the_partitioning(spark, monkeypatch):
    df = _bent(spark).repartition(3)
    model = network.train_network(df, ["a", "b"], "y", hidden=(8,), max_rounds=40, patience=40, step=0.05)
    assert _rmse(model, df)["val"] < 0.5 * _rmse(train.train_linear(df, ["a", "b"], "y"), df)["val"]
    assert min(model.history) == pytest.approx(_rmse(model, df)["val"], rel=1e-6)
    monkeypatch.setattr(network, "FAN_IN", 2)                                   # the partial sums go through groups
    other = network.train_network(df.repartition(7), ["a", "b"], "y", hidden=(8,), max_rounds=40, patience=40, step=0.05)
    assert other.history == pytest.approx(model.history, rel=1e-6)
    again = network.Network.from_rows(model.rows(df))
    assert again == model


def test_patience_missing_val_and_missing_rows(spark):
    df = _bent(spark, 80).repartition(2)
    noise = df.withColumn("y", F.when(F.col("split") == "val", -F.col("y")).otherwise(F.col("y")))     # val gets worse as train gets better
    model = network.train_network(noise, ["a", "b"], "y", hidden=(8,), max_rounds=60, patience=3, step=0.05)
    assert len(model.history) < 60 and int(np.argmin(model.history)) == len(model.history) - 4
    only = network.train_network(df.where("split = 'train'"), ["a"], "y", hidden=(4,), max_rounds=4)
    assert len(only.history) == 5
    assert only.transform(df.where("a > 9")).count() == 0
    with pytest.raises(ValueError):
        network.train_network(df.where("a > 9"), ["a"], "y")


def test_rounds_read_whole_batches_as_bytes(spark):
    """The rows are converted once: what the rounds read has a row per Arrow batch, with every number of it, in order."""
    rows = [([float(i), -float(i)], i / 7, i % 3 == 0) for i in range(100)]
    df = spark.createDataFrame(rows, "x array<double>, y double, is_val boolean").coalesce(1)
    blocks = df.mapInArrow(network._blocks(2), "x binary, y binary, is_val binary").collect()
    assert len(blocks) == 1
    x, y, val = (np.frombuffer(c, kind) for c, kind in zip(blocks[0], ("<f8", "<f8", "?")))
    assert x.reshape(-1, 2).tolist() == [r[0] for r in rows] and y.tolist() == [r[1] for r in rows] and val.tolist() == [r[2] for r in rows]

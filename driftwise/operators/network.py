"""A small feed-forward network. Each round sends the weights out, every partition adds up the gradient of its rows, and
the partial gradients are summed in a tree; the data never leaves the executors."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.functions.exprs import col as qcol

PARTIAL = "part long, n long, sse double, n_val long, sse_val double, gradient array<double>"
#: Partial gradients that the driver adds up by itself; beyond it they are first summed in groups of about the square root.
FAN_IN = 64


def _start(sizes: Sequence[int], seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for a, b in zip(sizes, sizes[1:]):
        parts += [rng.normal(0.0, math.sqrt(2.0 / a), a * b), np.zeros(b)]
    return np.concatenate(parts)


def _layers(flat: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _forward(x: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The inputs of every layer, then the output."""
    seen = [x]
    for i, (w, b) in enumerate(layers):
        z = seen[-1] @ w + b
        seen.append(z if i == len(layers) - 1 else np.maximum(z, 0.0))
    return seen


def _gradient(x: np.ndarray, y: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray]:
    """Squared error summed over the rows, and the gradient of its half."""
    seen = _forward(x, layers)
    d = seen[-1] - y[:, None]
    sse, parts = float((d * d).sum()), []
    for i in range(len(layers) - 1, -1, -1):
        parts = [(seen[i].T @ d).ravel(), d.sum(axis=0), *parts]
        if i:
            d = (d @ layers[i][0].T) * (seen[i] > 0)
    return sse, np.concatenate(parts)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _blocks(width: int):
    """Each Arrow batch as one row: its inputs, targets and marks as bytes, so that a round need not convert the rows again."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_matrix(batch.column("x"), width).astype("<f8").tobytes()], pa.binary()),
                     pa.array([batch.column("y").to_numpy().astype("<f8").tobytes()], pa.binary()),
                     pa.array([batch.column("is_val").to_numpy(zero_copy_only=False).astype("?").tobytes()], pa.binary())], names=["x", "y", "is_val"])
    return run


def _partials(flat: np.ndarray, sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = _layers(flat, sizes)
        total, n, sse, n_val, sse_val = np.zeros(len(flat)), 0, 0.0, 0, 0.0
        for batch in batches:
            for cells in zip(*batch.columns, strict=True):
                x, y, val = (np.frombuffer(c.as_buffer(), kind) for c, kind in zip(cells, ("<f8", "<f8", "?"), strict=True))
                x = x.reshape(-1, sizes[0])
                if val.any():
                    e = _forward(x[val], layers)[-1][:, 0] - y[val]
                    n_val, sse_val = n_val + int(val.sum()), sse_val + float(e @ e)
                if not val.all():
                    e, g = _gradient(x[~val], y[~val], layers)
                    total, n, sse = total + g, n + int((~val).sum()), sse + e
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "n": [n], "sse": [sse], "n_val": [n_val],
                                          "sse_val": [sse_val], "gradient": [total.tolist()]})
    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("part")
    one = {c: [pdf[c].sum()] for c in ("n", "sse", "n_val", "sse_val")}
    return pd.DataFrame({"part": [int(pdf["part"].min())], **one, "gradient": [np.stack(pdf["gradient"]).sum(axis=0).tolist()]})


@dataclass(frozen=True)
class Network:
    """A fitted network: standardisation of inputs and target, layer sizes, weights, and its validation RMSE per round."""
    cols: tuple[str, ...]
    sizes: tuple[int, ...]
    weights: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    target_mean: float
    target_scale: float
    history: tuple[float, ...]

    def transform(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """``df`` with the prediction; missing inputs count as 0.0. Rows are scored in Arrow batches."""
        flat, sizes, mid, factor = np.array(self.weights), self.sizes, self.target_mean, self.target_scale

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype="float64")
            return pd.Series(_forward(np.stack(x.to_numpy()), _layers(flat, sizes))[-1][:, 0] * factor + mid)

        return df.withColumn(out, predict(_inputs(self.cols, self.mean, self.scale)))

    def rows(self, df: DataFrame) -> DataFrame:
        """The model as a table (name, position, value), to be stored beside other model tables."""
        parts = {"weights": self.weights, "mean": self.mean, "scale": self.scale, "sizes": self.sizes,
                 "target": (self.target_mean, self.target_scale), "history": self.history}
        cells = [(name, i, float(v), None) for name, values in parts.items() for i, v in enumerate(values)]
        cells += [("cols", i, None, c) for i, c in enumerate(self.cols)]
        return df.sparkSession.createDataFrame(cells, "name string, position int, value double, text string")

    @staticmethod
    def from_rows(table: DataFrame) -> "Network":
        got: dict[str, list] = {}
        for r in table.orderBy("name", "position").collect():               # one row per weight
            got.setdefault(r["name"], []).append(r["text"] if r["name"] == "cols" else r["value"])
        return Network(tuple(got["cols"]), tuple(int(s) for s in got["sizes"]), tuple(got["weights"]), tuple(got["mean"]),
                       tuple(got["scale"]), *got["target"], tuple(got.get("history", [])))


def _inputs(cols: Sequence[str], mean: Sequence[float], scale: Sequence[float]):
    return F.array(*[(F.coalesce(qcol(c).cast("double"), F.lit(0.0)) - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, mean, scale)])


def train_network(splits: DataFrame, cols: Sequence[str], target: str, hidden: Sequence[int] = (32, 16), max_rounds: int = 150,
                  patience: int = 5, step: float = 0.02, seed: int = 42) -> Network:
    """Fit on train, keep the weights of the best round on val, stop after ``patience`` rounds without improvement (all
    rounds without val rows). Inputs and target are standardised on train.

    Every round uses the gradient over all training rows (Adam steps), so the result depends on the data's partitioning
    only through the order of floating-point sums. What a round moves is the number of weights, whatever the data's size."""
    rows = splits.where(F.col("split").isin("train", "val") & qcol(target).isNotNull())
    names, train = [*cols, target], F.col("split") == "train"
    values = [F.when(train, F.coalesce(qcol(c).cast("double"), F.lit(0.0))) for c in names]
    stats = rows.agg(*[F.avg(v).alias(f"m{i}") for i, v in enumerate(values)],
                     *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(values)]).first()
    if stats["m0"] is None:
        raise ValueError("no labelled training rows")
    mean = tuple(stats[f"m{i}"] for i in range(len(names)))
    scale = tuple(stats[f"s{i}"] or 1.0 for i in range(len(names)))
    data = rows.select(_inputs(cols, mean, scale).alias("x"), ((qcol(target).cast("double") - mean[-1]) / scale[-1]).alias("y"),
                       (~train).alias("is_val"))
    sizes = (len(cols), *hidden, 1)
    data = data.mapInArrow(_blocks(sizes[0]), "x binary, y binary, is_val binary").persist(StorageLevel.MEMORY_AND_DISK)
    flat = _start(sizes, seed)
    best, least, best_at, history = flat, float("inf"), 0, []
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    try:
        n_parts = data.select(F.spark_partition_id().alias("p")).distinct().count()
        for at in range(1, max_rounds + 2):                                 # the last pass only judges the last step
            parts = data.mapInArrow(_partials(flat, sizes), PARTIAL)
            if n_parts > FAN_IN:
                group = F.col("part") % F.lit(math.ceil(math.sqrt(n_parts)))
                parts = parts.groupBy(group.alias("_g")).applyInPandas(_add_up, PARTIAL)
            got = sorted(parts.collect(), key=lambda r: r["part"])
            n, n_val = sum(r["n"] for r in got), sum(r["n_val"] for r in got)
            error = math.sqrt(sum(r["sse_val"] for r in got) / n_val if n_val else sum(r["sse"] for r in got) / n) * scale[-1]
            history.append(error)
            if error < least or not n_val:
                best, least, best_at = flat, error, at
            elif at - best_at >= patience:
                break
            g = np.sum([r["gradient"] for r in got], axis=0) / n
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            flat = flat - step * (m / (1 - 0.9 ** at)) / (np.sqrt(v / (1 - 0.999 ** at)) + 1e-8)
    finally:
        data.unpersist()
    return Network(tuple(cols), sizes, tuple(best.tolist()), mean[:-1], scale[:-1], mean[-1], scale[-1], tuple(history))

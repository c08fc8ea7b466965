"""Factorisation machine for document quality.

A document's features are its hashed words (log frequencies, unit length), structure statistics of the text (raw and
in bins) and its length as metadata. The score is
``sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))``: all pairwise interactions through
``rank`` factors in time linear in the non-zero features, by the sum-of-squares identity.

Fitting takes a bounded sample of the labelled rows (``max_rows``, chosen by a hash of the id); feature rows are
packed in the scan's tasks and one task runs AdaGrad over them. Scoring is one pass over all rows with the
model (a fixed size: ``SPACE`` features by rank + 1 numbers) as a broadcast.

Defined results: a null or empty text has statistics of an empty text and gets a score like any other; null and
repeated ids are rows like any other; labels that are null or not 0/1, and ids without a text row, are not used.
Without any usable label every score is 0.5.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import carried, utf8

WORDS, BINS = 1 << 15, 16
STATS = 14
SPACE = WORDS + STATS + STATS * BINS + 32       # hashed words, raw statistics, binned statistics, length in powers of two

_CLASS = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = ("A" <= _c <= "Z", "0" <= _c <= "9", _b < 128 and not _c.isalnum() and not _c.isspace(), _c.isspace() and _b < 128,
                  _c in "|#*$%&<>{}[]=_~^\\", _c in "!?")


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a document's features."""
    size = max(1, len(text))
    upper, digit, punct, space, odd, shout = np.bincount(np.frombuffer(text, "u1"), minlength=256) @ _CLASS / size
    words = text.lower().split()
    n = max(1, len(words))
    counts = Counter(words)
    tf = np.fromiter(counts.values(), "f8", len(counts))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
    share = tf / n
    entropy = float(-(share * np.log(share)).sum()) / math.log(max(2, n)) if len(tf) else 0.0
    stats = np.clip([math.log1p(len(words)) / 12, len(text) / n / 20, upper * 2, digit * 4, punct * 4, space * 2, odd * 8, shout * 8,
                     len(counts) / n, tf.max() / n if len(tf) else 0.0, repeated, len(text) / max(1, len(lines)) / 1000,
                     entropy, sum(not w.isalpha() for w in counts) / max(1, len(counts))], 0.0, 1.0)
    hashed = np.fromiter(map(zlib.crc32, counts), "i8", len(counts)) % WORDS
    tf = np.log1p(tf)
    bins = np.minimum((stats * BINS).astype("i8"), BINS - 1)
    meta = 0 if n_chars is None or n_chars < 0 else min(31, 1 + int(n_chars).bit_length())
    at = np.concatenate([hashed, WORDS + np.arange(STATS), WORDS + STATS + np.arange(STATS) * BINS + bins,
                         [WORDS + STATS + STATS * BINS + meta]])
    values = np.concatenate([tf / max(1e-9, float(np.sqrt((tf * tf).sum()))), stats, np.full(STATS + 1, 0.5)])
    return at.astype("i4"), values.astype("f4")


def _rows(texts: list[bytes], chars: list[int | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: offsets, indices, values. No row is empty."""
    each = [features(t, n) for t, n in zip(texts, chars, strict=True)]
    ends = np.cumsum([0, *[len(a) for a, _ in each]])
    return ends[:-1], np.concatenate([a for a, _ in each]), np.concatenate([v for _, v in each])


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    def margin(self, starts: np.ndarray, at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        linear = np.add.reduceat(self.w[at] * x, starts)
        return self.bias + linear + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def score(self, starts: np.ndarray, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(starts, at, x)[0], -30, 30)))

    def packed(self) -> bytes:
        return np.concatenate([[self.bias], self.w, self.v.ravel()]).astype("<f4").tobytes()

    @classmethod
    def unpacked(cls, blob: bytes, rank: int) -> Machine:
        a = np.frombuffer(blob, "<f4")
        return cls(float(a[0]), a[1:1 + SPACE].copy(), a[1 + SPACE:].reshape(SPACE, rank).copy())

    @classmethod
    def fit(cls, y: np.ndarray, starts: np.ndarray, at: np.ndarray, x: np.ndarray, rank: int, epochs: int, rate: float, l2: float) -> Machine:
        rng = np.random.default_rng(7)
        m = cls(0.0, np.zeros(SPACE, "f4"), rng.normal(0, 0.02, (SPACE, rank)).astype("f4"))
        if not len(y):
            return cls(0.0, np.zeros(SPACE, "f4"), np.zeros((SPACE, rank), "f4"))
        gw, gv, gb = np.full(SPACE, 1e-4, "f4"), np.full((SPACE, rank), 1e-4, "f4"), 1e-4
        lengths = np.diff(np.append(starts, len(at)))
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 128):
                rows = order[lo:lo + 128]
                n = lengths[rows]
                ends = np.cumsum(n)
                own = np.repeat(np.arange(len(rows)), n)
                flat = np.arange(ends[-1]) - np.repeat(ends - n, n) + np.repeat(starts[rows], n)
                i, xs = at[flat], x[flat]
                margin, sums = m.margin(ends - n, i, xs)
                err = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[rows]) / len(rows)
                slope = (err[own] * xs).astype("f4")
                used, back = np.unique(i, return_inverse=True)
                dw = np.bincount(back, slope, len(used)).astype("f4") + l2 * m.w[used]
                part = slope[:, None] * (sums[own] - m.v[i] * xs[:, None])
                dv = np.stack([np.bincount(back, part[:, f], len(used)) for f in range(rank)], axis=1).astype("f4") + l2 * m.v[used]
                gw[used] += dw * dw
                gv[used] += dv * dv
                gb += float(err.sum()) ** 2
                m.w[used] -= rate * dw / np.sqrt(gw[used])
                m.v[used] -= rate * dv / np.sqrt(gv[used])
                m.bias -= rate * float(err.sum()) / math.sqrt(gb)
        return m


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per 512 labelled documents: packed labels and sparse rows, with its place in the order of all. The training task
    reads few, wide rows."""
    part, at_row = TaskContext.get().partitionId(), 0
    for batch in batches:
        chars, y = batch.column("n_chars").to_pylist(), batch.column("y").to_pylist()
        for lo in range(0, batch.num_rows, 512):
            starts, at, x = _rows(utf8(batch.column("text").slice(lo, 512)), chars[lo:lo + 512])
            sizes = np.diff(np.append(starts, len(at)))
            parts = [np.array(y[lo:lo + 512], "<f4"), sizes.astype("<i8"), at.astype("<i4"), x.astype("<f4")]
            at_row += 1
            yield pa.RecordBatch.from_pydict({"one": pa.array([0], pa.int32()), "part": [part], "nth": [at_row]} | {
                n: pa.array([p.tobytes()], pa.binary()) for n, p in zip("ysax", parts, strict=True)})


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, rank: int = 8, epochs: int = 6, rate: float = 0.1,
          l2: float = 1e-5) -> bytes:
    """Fit on ``docs`` (doc_id, text, n_chars) with ``labels`` (doc_id, y); at most about ``max_rows`` of them, by hash."""
    usable = labels.select("doc_id", F.col("y").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    n = usable.count()
    if n > max_rows:
        usable = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    # The sample is bounded by max_rows: (id, label) pairs of a few hundred kilobytes.
    rows = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(usable), "doc_id")

    # In the order of a hash, so that neither the order of arrival nor the partitioning changes the model.
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit("order")), "doc_id", F.md5("text"), "n_chars")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["part", "nth"])
        cat = lambda c, kind: np.concatenate([np.frombuffer(b, kind) for b in frame[c]])
        y, sizes, at, x = cat("y", "<f4"), cat("s", "<i8"), cat("a", "<i4"), cat("x", "<f4")
        m = Machine.fit(y, np.cumsum(sizes) - sizes, at, x, rank, epochs, rate, l2)
        return pd.DataFrame({"model": [m.packed()]})

    packed = rows.select("text", "n_chars", "y").mapInArrow(_packed_rows, "one int, part long, nth long, y binary, s binary, a binary, x binary")
    found = packed.groupBy("one").applyInPandas(fit, "model binary").first()
    return bytes(found["model"]) if found else Machine(0.0, np.zeros(SPACE), np.zeros((SPACE, rank))).packed()


def score(docs: DataFrame, model: bytes, text: str = "text", n_chars: str = "n_chars", rank: int = 8,
          out: str = "quality_score") -> DataFrame:
    """``docs`` with the score (0 to 1) as its last column ``out``, in place of a column of that name."""
    row, names = carried(docs, [text, n_chars, out])
    work = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"), F.col(f"`{n_chars}`").alias("n_chars"))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Machine.unpacked(held.value, rank)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                s = m.score(*_rows(utf8(batch.column("text")), batch.column("n_chars").to_pylist())).astype("f8")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s)], names=[*batch.schema.names, "score"])

    own = {text: F.col("text"), n_chars: F.col("n_chars")}
    return work.mapInArrow(run, work.withColumn("score", F.lit(0.0)).schema).select(
        *[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns if c in names or c in own], F.col("score").alias(out))

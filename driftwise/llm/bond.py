"""Hard negatives by a vertical branch-and-bound scan (BOND).

Vectors are stored in shards column by column, with the least and the largest value of every column. An anchor
reads the columns in descending order of its own components' magnitude, so that the first few give most of the
product. After some columns, the rest can add at least the sum of the smaller and at most the sum of the larger of
component times least and component times largest: these two sums bound every candidate's score. A candidate leaves
the bitmap when its bounds miss every window of scores, or when a window surely holds enough better ones. What is left
after the last column has exact scores and is ranked per window.

First scan: candidates of the anchor's label, one open window; its best are the anchor's positives. Second scan:
candidates of other labels, one window per positive, from ``low`` to ``high`` percent of the positive's score.

The anchors go in blocks to every shard (a stated query set against all rows). They are broadcast when their measured
size is at most ``broadcast_bytes``; beyond it shards and blocks meet in a shuffle on (block, slot). Per anchor and
window a shard keeps as many rows as the result can use, and a ranking window merges them.

Defined results: components become floor(scale * x), x as double; rows with a null id or label, a null vector, or a
null or non-finite component (also after scaling) take no part; vectors of different lengths are not compared; of rows
with one id the one with the smallest (label, vector) stands for all. Ties go to the smaller id. Products are exact:
float32 while all sums stay below 2**24, float64 below 2**53, Python integers beyond, clipped to a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import stored

SHARD = "shard long, dim int, n int, ids binary, labels binary, columns binary"
HITS = "anchor_id long, positive_id long, positive_score long, vec_id long, score long"
#: Parts of the columns after which candidates are pruned.
CHECKS = (0.25, 0.5, 0.75, 0.875)


def _matrix(flat: pa.Array, dim: int, scale: float) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(scale * flat.cast(pa.float64()).to_numpy(zero_copy_only=False)).reshape(-1, dim)


def _shards(scale: float, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seq = TaskContext.get().partitionId() << 32
        held: dict[int, list[tuple]] = {}
        size: dict[int, int] = {}

        def shard(dim: int) -> pa.RecordBatch:
            nonlocal seq
            ids, labels, rows = (np.concatenate(c) for c in zip(*held.pop(dim), strict=True))
            size.pop(dim)
            columns = np.ascontiguousarray(rows.T, dtype="<f8")
            seq += 1
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([seq], pa.int64()), "dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()),
                "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "labels": pa.array([labels.astype("<i8").tobytes()], pa.binary()),
                "columns": pa.array([columns.tobytes()], pa.binary())})

        for batch in batches:
            ids, labels, vectors = batch.columns
            lengths = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths):
                take = pa.array(np.flatnonzero(lengths == dim))
                rows = _matrix(vectors.take(take).flatten(), int(dim), scale) if dim else np.zeros((len(take), 0))
                good = np.isfinite(rows).all(axis=1)
                own = tuple(c.take(take).to_numpy(zero_copy_only=False)[good] for c in (ids, labels))
                per = max(256, shard_bytes // (8 * max(1, int(dim))))
                rows = rows[good]
                for at in range(0, len(rows), per):
                    part = (own[0][at:at + per], own[1][at:at + per], rows[at:at + per])
                    held.setdefault(int(dim), []).append(part)
                    size[int(dim)] = size.get(int(dim), 0) + len(part[0])
                    if size[int(dim)] >= per:
                        yield shard(int(dim))
        for dim in list(held):
            yield shard(dim)
    return run


def survivors(q: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray, bitmap: np.ndarray,
              windows: list[tuple], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the candidates in ``bitmap`` that the vertical scan cannot rule out, and their exact scores. A window
    (low, high) asks for its ``k`` best; equal scores at the border stay."""
    order = np.argsort(-np.abs(q.astype("f8")), kind="stable")
    a, b = q[order] * least[order], q[order] * most[order]
    none = np.zeros(1, a.dtype)
    down = np.concatenate([np.cumsum(np.minimum(a, b)[::-1])[::-1], none])      # what the columns from here on add at least
    up = np.concatenate([np.cumsum(np.maximum(a, b)[::-1])[::-1], none])
    at = np.flatnonzero(bitmap)
    partial = np.zeros(len(at), columns.dtype)
    lo, hi = min(w[0] for w in windows), max(w[1] for w in windows)
    done = 0
    for stop in sorted({int(c * len(q)) for c in CHECKS} | {len(q)}):
        if stop == done or not len(at):
            continue
        dims = order[done:stop]
        rows = columns[dims] if len(at) == columns.shape[1] else columns[dims[:, None], at]
        partial = partial + q[dims] @ rows
        done = stop
        if stop == len(q):
            break
        lower, upper = partial + down[stop], partial + up[stop]
        keep = (upper >= lo) & (lower <= hi)
        if len(at) > k:
            needed = np.zeros(len(at), bool)
            for low, high in windows:
                sure = lower[(lower >= low) & (upper <= high)]
                floor = max(low, np.partition(sure, len(sure) - k)[len(sure) - k]) if len(sure) >= k else low
                needed |= (upper >= floor) & (lower <= high)
            keep &= needed
        at, partial = at[keep], partial[keep]
    return at, partial


def _number(bound: float):
    return np.float32 if bound < 2 ** 24 else np.float64 if bound < 2 ** 53 else object


def _clip(x) -> int:
    return min(max(int(x), -2 ** 63), 2 ** 63 - 1)


def _scan(same_label: bool, k: int, scale: float, low: int, high: int):
    """Tiles of an anchor block and a shard to hits: the k best of every anchor and window."""
    def tile(t, out: list[tuple]) -> None:
        ids, labels = np.frombuffer(t.ids, "<i8"), np.frombuffer(t.labels, "<i8")
        columns = np.frombuffer(t.columns, "<f8").reshape(t.dim, t.n)
        anchors = np.floor(scale * np.asarray(t.a_vectors, "f8")).reshape(len(t.a_ids), t.dim)
        reach = np.abs(columns).max(axis=1, initial=0)
        kind = _number(float((np.abs(anchors) @ reach).max(initial=0)))
        if kind is object:
            columns = np.array([[int(x) for x in c] for c in columns], object).reshape(columns.shape)
            anchors = np.array([[int(x) for x in q] for q in anchors], object).reshape(anchors.shape)
        else:
            columns, anchors = columns.astype(kind), anchors.astype(kind)
        least, most = columns.min(axis=1), columns.max(axis=1)
        same = {label: labels == label for label in set(t.a_labels)}
        start = 0
        for i, (own, label) in enumerate(zip(t.a_ids, t.a_labels, strict=True)):
            n = int(t.a_sizes[i])
            positives = [(int(t.p_ids[j]), int(t.p_scores[j])) for j in range(start, start + n)]
            start += n
            if same_label:
                windows = {(-np.inf, np.inf): [(None, None)]}
            else:
                windows = {}
                for p, s in positives:
                    span = (-(-low * s // 100), high * s // 100)
                    if span[0] <= span[1]:
                        windows.setdefault(span, []).append((p, s))
            if not windows:
                continue
            bitmap = same[label] if same_label else ~same[label]
            at, scores = survivors(anchors[i], columns, least, most, bitmap, list(windows), k + same_label)
            for span, asked in windows.items():
                fit = np.flatnonzero((scores >= span[0]) & (scores <= span[1]))
                if kind is object:
                    fit = np.array(sorted(fit, key=lambda j: (-scores[j], ids[at[j]])), "i8")
                else:
                    fit = fit[np.lexsort((ids[at[fit]], -scores[fit]))]
                best = [(int(ids[at[j]]), scores[j]) for j in fit[:k + same_label]]
                best = [(v, _clip(s)) for v, s in best if v != own][:k]
                out += [(int(own), p, s, v, score) for p, s in asked for v, score in best]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples(index=False):
                out: list[tuple] = []
                tile(t, out)
                yield pd.DataFrame(out, columns=["anchor_id", "positive_id", "positive_score", "vec_id", "score"]).astype("Int64")
    return run


def _blocks(anchors: DataFrame, n_blocks: int) -> DataFrame:
    """Anchors (vec_id, label, embedding, positives) in rows of one block and length."""
    return (anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).withColumn("dim", F.size("embedding"))
            .groupBy("block", "dim").agg(F.collect_list(F.struct("vec_id", "label", "embedding", "positives")).alias("r"))
            .select("block", "dim", F.col("r.vec_id").alias("a_ids"), F.col("r.label").alias("a_labels"), F.flatten("r.embedding").alias("a_vectors"),
                    F.transform("r", lambda r: F.size(r["positives"])).alias("a_sizes"), F.flatten("r.positives").alias("p"))
            .select("*", F.col("p.vec_id").alias("p_ids"), F.col("p.score").alias("p_scores")).drop("p"))


def _tiles(shards: DataFrame, blocks: DataFrame, n_blocks: int, n_shards: int, small: bool) -> DataFrame:
    if small:
        return shards.join(F.broadcast(blocks), "dim")
    slots = max(1, n_shards // 16)
    to_blocks = shards.select("*", F.pmod(F.xxhash64("shard"), F.lit(slots)).alias("slot"),
                              F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"))
    to_slots = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    return to_blocks.join(to_slots, ["block", "slot", "dim"])


def hard_negatives(df: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: float = 256.0, block_rows: int = 256, shard_bytes: int = 4 << 20, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each of an anchor's ``positives`` best
    rows of its label, the ``negatives`` best rows of other labels with ``low`` to ``high`` percent of its score.
    ``is_anchor`` and ``label`` (an integer) are expressions over the rows of ``df`` (vec_id, embedding)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding"), is_anchor.alias("anchor"))
    rows = rows.where("vec_id is not null and label is not null and embedding is not null").where(finite)
    if rows.groupBy("vec_id").count().where("count > 1").head(1):
        rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "anchor")).alias("r")).select("vec_id", "r.*")
    shards = stored(rows.select("vec_id", "label", "embedding").mapInArrow(_shards(scale, shard_bytes), SHARD), "bond-shards")
    none = F.expr("cast(array() as array<struct<vec_id: bigint, score: bigint>>)")
    anchors = stored(rows.where("anchor").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"), none.alias("positives")), "bond-anchors")
    n, numbers = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    n_blocks, n_shards = max(1, -(-n // block_rows)), shards.count()
    small = 8 * numbers + 128 * n <= broadcast_bytes

    def best(scanned: DataFrame, by: list[str], k: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id"))
        return scanned.withColumn("rank", rank).where(F.col("rank") <= k)

    first = _tiles(shards, _blocks(anchors, n_blocks), n_blocks, n_shards, small).mapInPandas(_scan(True, positives, scale, low, high), HITS)
    own = best(first.select("anchor_id", "vec_id", "score"), ["anchor_id"], positives)
    own = own.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("vec_id", "score"))).alias("positives"))
    ready = stored(anchors.drop("positives").join(own.withColumnRenamed("anchor_id", "vec_id"), "vec_id"), "bond-positives")
    second = _tiles(shards, _blocks(ready, n_blocks), n_blocks, n_shards, small).mapInPandas(_scan(False, negatives, scale, low, high), HITS)
    return best(second, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))

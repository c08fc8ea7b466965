"""Exact top-k search: tiled matrix products, partial selection per tile, tree merge of the top lists.

Candidates are packed into shards of at most ``shard_rows`` vectors by the tasks that scan them (no shuffle of
single vectors); queries are packed into blocks of about ``block_rows``. Every shard is sent to every query block
(the query set is stated, so this is a block product, not a cross join of rows), one task computes the tile
``block x shard`` as a matrix product and keeps ``k`` rows of it per query. The lists then meet in a tree whose
nodes merge ``fan_in`` of them, so no task ever holds more than ``fan_in * k`` entries of a query.

Defined results: each component x becomes floor(256 * x) (x as double); vectors that are null or hold a null or
non-finite component take no part; vectors of different lengths are not compared; of repeated rows with one
vec_id a query takes the smallest vector in array order, and a candidate counts once, with its best score;
rows with a null vec_id take no part. Ties go to the smaller vec_id. Products are exact: float64 while every sum
stays below 2**53, Python integers beyond (clipped to the range of a long).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = "shard long, dim int, ids binary, vectors binary"
TOP = "query_id long, shard long, vec_id long, score long"
EXACT = float(2 ** 53)


def _packed(ids: np.ndarray, matrix: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype("<i8").tobytes(), np.ascontiguousarray(matrix, dtype="<f8").tobytes()


def _usable(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of a batch by length: ids and the floor(256 x) matrix."""
    ids, vecs = batch.column(0), batch.column(1)
    lengths = np.array([-1 if n is None else n for n in pa.compute.list_value_length(vecs).to_pylist()], dtype="i8")
    flat = vecs.flatten()
    values = np.floor(256.0 * flat.cast(pa.float64()).to_numpy(zero_copy_only=False)) if len(flat) else np.zeros(0)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))]).astype("i8")
    known = ids.is_valid().to_numpy(zero_copy_only=False)
    id_values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = {}
    for dim in np.unique(lengths[lengths >= 0]):
        rows = np.flatnonzero((lengths == dim) & known)
        matrix = values[starts[rows][:, None] + np.arange(dim)[None, :]] if dim else np.zeros((len(rows), 0))
        good = np.isfinite(matrix).all(axis=1)
        if good.any():
            out[int(dim)] = id_values[rows[good]], matrix[good]
    return out


def _shards(shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            for dim, (ids, matrix) in _usable(batch).items():
                for at in range(0, len(ids), shard_rows):
                    a, b = _packed(ids[at:at + shard_rows], matrix[at:at + shard_rows])
                    yield pa.RecordBatch.from_pydict(
                        {"shard": pa.array([shard], pa.int64()), "dim": pa.array([dim], pa.int32()),
                         "ids": pa.array([a], pa.binary()), "vectors": pa.array([b], pa.binary())})
                    shard += 1
    return run


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products, queries by candidates."""
    if not q.shape[1]:
        return np.zeros((len(q), len(c)), dtype="i8")
    if np.abs(q).max() * np.abs(c).max() * q.shape[1] < EXACT:
        return (q @ c.T).astype("i8")
    exact = [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in c] for a in q]
    return np.array([[min(max(v, -2 ** 63), 2 ** 63 - 1) for v in row] for row in exact], dtype="i8")


def _select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
    """The k best (vec_id, score) of one row of a tile, each vec_id once."""
    take = np.arange(len(ids))
    if len(ids) > 4 * k + 16:       # everything not below the k-th best of the rows, own row and repeats allowed for
        for spare in (2 * k + 1, len(ids)):
            cut = np.partition(scores, len(ids) - min(spare, len(ids)))[len(ids) - min(spare, len(ids))]
            take = np.flatnonzero(scores >= cut)
            if len(np.unique(ids[take][ids[take] != own])) >= k:
                break
    order = take[np.lexsort((ids[take], ~scores[take]))]     # ~s falls as s rises, without overflow
    out: list[tuple[int, int]] = []
    seen = {own}
    for i in order:
        if int(ids[i]) not in seen:
            seen.add(int(ids[i]))
            out.append((int(ids[i]), int(scores[i])))
            if len(out) == k:
                break
    return out


def _tiles(k: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t in frame.itertuples(index=False):
                q_ids, c_ids = np.frombuffer(t.q_ids, "<i8"), np.frombuffer(t.ids, "<i8")
                q = np.frombuffer(t.q_vectors, "<f8").reshape(len(q_ids), t.dim)
                c = np.frombuffer(t.vectors, "<f8").reshape(len(c_ids), t.dim)
                scores = _products(q, c)
                rows = [(int(own), t.shard, v, s) for own, row in zip(q_ids, scores, strict=True)
                        for v, s in _select(row, c_ids, int(own), k)]
                yield pd.DataFrame(rows, columns=["query_id", "shard", "vec_id", "score"]).astype("int64")
    return run


def _queries(df: DataFrame, is_query: Column) -> DataFrame:
    return (df.where(is_query & F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
            .groupBy("vec_id").agg(F.min("embedding").alias("embedding")))


def _blocks(queries: DataFrame, n_blocks: int) -> DataFrame:
    """Query blocks: one row per (block, length) with packed ids and vectors."""
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        rows = pa.RecordBatch.from_arrays([pa.array(frame["vec_id"]), pa.array(frame["embedding"], pa.list_(pa.float64()))],
                                          ["vec_id", "embedding"])
        block = int(frame["q_block"].iloc[0])
        return pd.DataFrame([(block, dim, *_packed(ids, m)) for dim, (ids, m) in _usable(rows).items()],
                            columns=["q_block", "dim", "q_ids", "q_vectors"])

    return (queries.withColumn("embedding", F.col("embedding").cast("array<double>"))
            .withColumn("q_block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
            .groupBy("q_block").applyInPandas(pack, "q_block long, dim int, q_ids binary, q_vectors binary"))


def _merged(tops: DataFrame, by: list[str], k: int) -> DataFrame:
    """One node of the tree per group of ``by``: its k best hits in order, each vec_id once, as array ``top``."""
    hits = F.array_sort(F.collect_list(F.struct((-F.col("score").cast("decimal(20,0)")).alias("low"), "vec_id", "score")))
    none = F.slice(F.col("hits"), 1, 0)
    new = lambda acc, x: (F.size(acc) < k) & ~F.exists(acc, lambda a: a["vec_id"] == x["vec_id"])
    keep = F.aggregate("hits", none, lambda acc, x: F.when(new(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return tops.groupBy(*by).agg(hits.alias("hits")).select(*by, keep.alias("top"))


def exact_top_k(df: DataFrame, is_query: Column, k: int = 5, block_rows: int = 1024, shard_rows: int = 2048,
                fan_in: int = 64, broadcast_bytes: int = 32 << 20) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score) for every row of ``df`` (vec_id, embedding) that ``is_query`` keeps.

    The query blocks are broadcast when their measured size is at most ``broadcast_bytes``; beyond it shards and
    blocks meet in a shuffle on (block, slot), with every shard sent to each block and every block to each slot.
    """
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"))
    queries = _queries(df, is_query)
    n, numbers = queries.agg(F.count("*"), F.sum(F.size("embedding"))).first()
    n_blocks = max(1, -(-n // block_rows))
    blocks = _blocks(queries, n_blocks)
    shards = df.mapInArrow(_shards(shard_rows), TILE)
    tasks, rows = df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("task"), F.sum("count")).first()
    if 8 * (numbers or 0) <= broadcast_bytes:
        tiles = shards.join(F.broadcast(blocks), "dim")
    else:
        slots = max(1, (rows or 0) // (4 * shard_rows))
        to_blocks = shards.select("*", F.pmod(F.xxhash64("shard"), F.lit(slots)).alias("slot"),
                                  F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("q_block"))
        to_slots = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
        tiles = to_blocks.join(to_slots, ["q_block", "slot", "dim"])
    tops = tiles.mapInPandas(_tiles(k), TOP)
    level, width = tops.withColumn("node", F.shiftright("shard", 32)), (tasks or 0) + 1      # leaves: the scan's tasks
    while width > 1:
        merged = _merged(level, ["query_id", "node"], k)
        level = merged.select("query_id", F.floor(F.col("node") / fan_in).cast("long").alias("node"), F.inline("top"))
        width = -(-width // fan_in)
    ranked = _merged(level, ["query_id"], k)
    return (ranked.select("query_id", F.posexplode("top").alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"))

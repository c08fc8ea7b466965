"""Weighted rendezvous sharding of stable record keys, with built-in expressions only.

Every (record key, shard) pair has a uniform draw u in (0, 1) from xxhash64; the record goes to the shard with the
highest score -weight / ln(u). The draw of a pair does not depend on the other shards, so a new shard only takes
the records whose draw for it wins, and a removed shard only gives up its own. Equal scores (practically
impossible) go to the smaller shard number.

Slots number the rows of a shard without gaps in the order of the key. No window spans a shard: rows are
range-partitioned by key (equal keys may spread, by the hash of their text), sorted inside the tasks and stored
with a running id; rows are counted per (shard, chunk of ids), and a row's slot is the chunk's offset plus its rank
inside the chunk. A chunk has at most ``chunk_rows`` rows, whatever the size of a shard or of a key.

Defined results: a null key is a key like any other (its draws are those of an absent value); a null text has no
bytes, size 1 and crc32 0; repeated rows get the same shard and different slots.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import stored


def draw(key: Column, shard: int) -> Column:
    """Uniform in (0, 1), from the high 53 bits of the pair's hash."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + 0.5) / float(2 ** 53)


def rendezvous(key: Column, weights: Mapping[int, float]) -> Column:
    """Number of the winning shard; shards of weight 0 or less never win."""
    scores = [F.struct((-F.lit(float(w)) / F.log(draw(key, s))).alias("score"), F.lit(-s).alias("shard"))
              for s, w in sorted(weights.items()) if w > 0]
    return (-F.array_max(F.array(*scores))["shard"]).cast("int")


def assign(df: DataFrame, key: str, text: str, weights: Mapping[int, float], grown: Mapping[int, float] | None = None,
           chunk_rows: int = 50_000) -> DataFrame:
    """key, size, text_crc32, shard, slot and, given the ``grown`` weights, grown_shard."""
    k, t = F.col(f"`{key}`"), F.col(f"`{text}`")
    rows = df.select(k.alias("key"), (F.coalesce(F.octet_length(t), F.lit(0)) + 1).cast("long").alias("size"),
                     F.coalesce(F.crc32(t), F.lit(0)).cast("long").alias("text_crc32"))
    rows = rows.withColumn("shard", rendezvous(F.col("key"), weights))
    rows = rows.withColumn("grown_shard", rendezvous(F.col("key"), grown) if grown else F.lit(None).cast("int"))
    ordered = (rows.repartitionByRange("key", "text_crc32", "size").sortWithinPartitions("key", "text_crc32", "size")
               .withColumn("at", F.monotonically_increasing_id()))
    ordered = stored(ordered, "sharding").withColumn("chunk", F.floor(F.col("at") / chunk_rows).cast("long"))
    # (task, index) ids: a chunk never spans two tasks, because a task's ids start at a multiple of 2**33
    # only up to the chunk size; chunks are ordered like their ids either way.
    counts = ordered.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("shard", "chunk", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("at")) - 1
    return (ordered.withColumn("rank", rank).join(offsets, ["shard", "chunk"])
            .select(F.col("key").alias(key), "size", "text_crc32", "shard",
                    (F.col("offset") + F.col("rank")).cast("long").alias("slot"), "grown_shard"))

"""Prefix trie of conversations by vertical bitmaps.

Conversations are dealt in ascending order to shards of bounded size. A shard indexes its own: (position, turn) leads
to the bitset of the conversations that have this turn there, and each length to the bitset of those that end there.
A depth-first walk starts with the bitset of all; the lowest conversation left names the next turn, the parent's
bitset and that posting intersect to a child, and so on until no conversation is left. A node's popcount is its
members in the shard, its lowest bit the smallest of them.

A node is told apart by a 128-bit hash of its turns, so the shards' nodes are merged by an aggregation. A hot first turn
is one row per shard there, however many conversations have it. The sums over subtrees use that a walk lists a
subtree without gaps: per shard one pass over its nodes closes them with a stack of the open path, each node of the trie
counts in the one shard that holds its smallest member, and the shards' sums are added.

Memory: a task holds one shard, at most ``shard_convs`` conversations and about ``shard_turns`` turns at 16 bytes; only
a conversation longer than that makes its shard longer. Member lists are made per shard; the SHA-256 of a list
reads its pieces in ascending order as a stream.

Defined results: rows with a null conv_id take no part; a null role or text is empty; turns are ordered by ``turn`` (null
first), rows that share one by the MD5 of role and text, so repeated rows stay as turns of their own; ``c - c % 5`` has
SQL's remainder (towards zero). An empty table has no node, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwise.llm.common import stored

ROOT = bytes(16)
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "shard long, pre long, depth long, node binary, parent binary, n long, low long, size long, ends binary"
SUMS = "node binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
MOST_LED = 8        # the head of a conversation has crc32 % 9 turns


def head_turns(conv: Column) -> Column:
    """How many first turns of a conversation come from the conversation that leads its five."""
    return F.crc32(conv.cast("string")) % 9


def turns(df: DataFrame) -> DataFrame:
    """conv, pos (from 0), key (16 bytes of role and text) and size (UTF-8 bytes of the text) of every turn. Only the keys
    are sorted and shuffled from here on, never the texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("at"), key.alias("key"),
                     F.octet_length(text).cast("long").alias("size")).where("conv is not null")
    pos = F.row_number().over(Window.partitionBy("conv").orderBy(F.col("at").asc_nulls_first(), "key")).cast("long") - 1
    return rows.select("conv", pos.alias("pos"), "key", "size")


def rebuilt(turns_: DataFrame) -> DataFrame:
    """Every conversation c as the first h turns of c - c % 5, then its own turns after its first h. Rows (conv, half, pos,
    key, size): half -1 marks a conversation that exists, 0 its led turns, 1 its own. Turns led to conversations
    that do not exist have no mark."""
    conv, pos = F.col("conv"), F.col("pos")

    def row(c: Column, half: int, at: Column, key: Column, size: Column) -> Column:
        return F.struct(c.alias("conv"), F.lit(half).alias("half"), at.alias("pos"), key.alias("key"), size.alias("size"))

    key, size = F.col("key"), F.col("size")
    none = F.array(row(conv, 1, pos, key, size))
    none = F.slice(none, 1, 0)
    mark = F.when(pos == 0, F.array(row(conv, -1, F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long")))).otherwise(none)
    own = F.when((conv % 5 == 0) | (pos >= head_turns(conv)), F.array(row(conv, 1, pos, key, size))).otherwise(none)
    near = F.transform(F.sequence(F.lit(-4), F.lit(4)), lambda i: F.try_add(conv, i.cast("long")))
    led = F.filter(near, lambda c: c.isNotNull() & (c != conv) & (c - c % 5 == conv) & (pos < head_turns(c)))
    leads = F.when((conv % 5 == 0) & (pos < MOST_LED), F.transform(led, lambda c: row(c, 0, pos, key, size))).otherwise(none)
    return turns_.select(F.inline(F.concat(mark, leads, own)))


class Shard:
    """Vertical bitmaps of some conversations, added in ascending order."""

    def __init__(self):
        self.ids: list[int] = []
        self.turns: list[list[tuple[bytes, int]]] = []
        self.postings: dict[tuple[int, bytes], int] = {}
        self.n_turns = 0

    def open(self, conv: int) -> None:
        self.ids.append(conv)
        self.turns.append([])

    def add(self, key: bytes, size: int) -> None:
        own = self.turns[-1]
        at = (len(own), key)
        self.postings[at] = self.postings.get(at, 0) | 1 << (len(self.ids) - 1)
        own.append((key, size))
        self.n_turns += 1

    def nodes(self) -> Iterator[tuple]:
        """Rows of NODES in the order of the walk."""
        ended: dict[int, int] = {}
        for i, own in enumerate(self.turns):
            ended[len(own)] = ended.get(len(own), 0) | 1 << i
        stack: list[tuple] = [(ROOT, None, 0, (1 << len(self.ids)) - 1, 0)]
        pre = 0
        while stack:
            node, parent, depth, members, size = stack.pop()
            ends = members & ended.get(depth, 0)
            low = self.ids[(members & -members).bit_length() - 1]
            yield self.ids[0], pre, depth, node, parent, members.bit_count(), low, size, self.listed(ends)
            pre += 1
            rest, children = members ^ ends, []
            while rest:
                key, length = self.turns[(rest & -rest).bit_length() - 1][depth]
                child = members & self.postings[depth, key]
                children.append((hashlib.md5(node + key, usedforsecurity=False).digest(), node, depth + 1, child, length))
                rest ^= child
            stack.extend(reversed(children))

    def listed(self, bits: int) -> bytes | None:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return ",".join(map(str, out)).encode() if out else None


def _batches(rows: Iterator[tuple], schema: str, size: int = 8192) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), fields, strict=True)], schema=fields)

    for row in rows:
        held.append(row)
        if len(held) == size:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _walks(shard_convs: int, shard_turns: int):
    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        shard, current = Shard(), None
        for conv, half, key, size in _rows(batches):
            if half < 0:
                if len(shard.ids) >= shard_convs or shard.n_turns >= shard_turns:
                    yield from shard.nodes()
                    shard = Shard()
                shard.open(conv)
                current = conv
            elif conv == current:       # else led to a conversation that does not exist
                shard.add(key, size)
        if shard.ids:
            yield from shard.nodes()

    return lambda batches: _batches(nodes(batches), NODES)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of whole shards in the order of their walks; closes each node when its subtree has gone by."""
    def closed() -> Iterator[tuple]:
        path: list[list] = []
        shard = None

        def close(depth: int) -> Iterator[tuple]:
            while path and path[-1][1] >= depth:
                row = path.pop()
                if path:
                    path[-1][6] += row[6]
                    path[-1][7] += row[7]
                yield tuple(row)

        for own, depth, node, local_low, low, n, size, children in _rows(batches):
            yield from close(depth if own == shard else 0)
            shard = own
            here = local_low == low          # this shard has the node's smallest member: the node counts here
            path.append([node, depth, low, path[-1][2] if path else None, n, children,
                         int(here and not children), (n - 1) * size if here else 0])
        yield from close(0)

    return _batches(closed(), SUMS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's member list, its pieces read in ascending order."""
    def done() -> Iterator[tuple]:
        current, sha = None, None
        for node, piece in _rows(batches):
            if node != current:
                if sha:
                    yield current, sha.hexdigest()
                current, sha = node, hashlib.sha256(piece)
            else:
                sha.update(b"," + piece)
        if sha:
            yield current, sha.hexdigest()

    return _batches(done(), "node binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, shard_convs: int = 4096, shard_turns: int = 1 << 17) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations; ``node`` is the hash of its turns."""
    ordered = rebuilt(turns(conversations)).repartitionByRange("conv").sortWithinPartitions("conv", "half", "pos")
    # Conversations do not straddle shards and shards are ranges of ids, so a shard's first id is its key and its place.
    nodes = stored(ordered.select("conv", "half", "key", "size").mapInArrow(_walks(shard_convs, shard_turns), NODES), "trie-nodes")
    whole = nodes.groupBy("node", "parent").agg(F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"))
    children = whole.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    merged = whole.drop("parent").join(children, "node", "left")
    local = nodes.select("shard", "pre", "depth", "node", "low", "size").join(merged, "node")
    local = local.repartition("shard").sortWithinPartitions("shard", "pre").select(
        "shard", "depth", "node", "low", "conv_id", "n_convs", "size", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"))
    sums = local.mapInArrow(_sums, SUMS).groupBy("node", "depth", "conv_id", "n_convs", "n_children").agg(
        F.min("parent_conv_id").alias("parent_conv_id"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    lists = nodes.where("ends is not null").select("node", "shard", "ends").repartition("node").sortWithinPartitions("node", "shard")
    digests = lists.select("node", "ends").mapInArrow(_digests, "node binary, ends_sha256 string")
    return sums.join(digests, "node", "left").select(
        "node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))

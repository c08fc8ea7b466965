"""Near duplicates by an inverted join of MinHash signature coordinates.

A text's set holds the 64-bit hashes of its distinct n-word shingles; its signature is the smallest value of each of
``coordinates`` hash functions over the set. Two sets agree in a coordinate with the probability of their Jaccard
similarity, so sets that link agree in at least ``threshold(coordinates, percent)`` of them but for a chance of
``miss`` per pair (1e-9 by default; a component needs only a chain of its links).

1. Documents with equal sets become one representative; its signature is posted under (coordinate, value) pairs.
   Prefix: with t agreements of K wanted, two sets share a pair among the first K - t + 1 pairs of either, in any one
   global order. The order has rare pairs first (counted over all signatures in a sketch of fixed size), so that
   passages that many documents share open few lists.
2. Lists with the same members are one. In each list one member, the pivot, is compared with all others: first by a byte
   of each coordinate (values that agree have equal bytes, so no pair is lost), then collisions are counted block by
   block of the signature, skipping pairs that can no longer reach t. Pairs above the threshold whose
   parity bitmaps are near enough (their distance never exceeds the size of the sets' difference) are confirmed on the
   sets of their whole texts, and links give components. The pivot is the member whose pairs are most common, which in
   a group of near copies is what they were copied from: the group becomes one component without its pairs being
   listed. A few rounds follow with the next pivots of the lists that still hold several components.
3. Then all members of such lists are compared across components, in blocks inside tasks; only pairs that pass both
   filters leave a task.

Defined results: words are runs without ASCII white space after lower-casing A-Z; a document with fewer than n words
has its whole word sequence as one element; without words or with a null text its set is empty, it links with
nothing and the row keeps its own id. Null ids take no part: a null component, and they stay. Rows with one id and words
hang together, whatever their texts, and carry the smallest id they reach. Extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import discard, slices, stored, utf8
from driftwise.llm.jaccard import Shingles, _bitmap, _distance, _most, components

COUNTERS = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def threshold(coordinates: int, percent: int, miss: float) -> int:
    """Most agreements that sets of this similarity miss with a chance of at most ``miss``."""
    p, chance, t = percent / 100, 0.0, 0
    while t < coordinates:
        chance += comb(coordinates, t) * p ** t * (1 - p) ** (coordinates - t)
        if chance > miss:
            break
        t += 1
    return max(1, t)


def multipliers(coordinates: int) -> np.ndarray:
    return np.random.default_rng(20_250_101).integers(0, 2 ** 64, coordinates, "u8") | np.uint64(1)


def signature(elements: np.ndarray, by: np.ndarray) -> np.ndarray:
    """High 32 bits of the smallest product per multiplier; the elements are mixed hashes already."""
    low = np.full(len(by), 2 ** 64 - 1, "u8")
    for at in range(0, len(elements), 1024):
        np.minimum(low, (elements[at:at + 1024, None] * by).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _signed(n: int, coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, by = Shingles(n), multipliers(coordinates)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                sizes, digests, signatures, bitmaps = [], [], [], []
                for text in utf8(batch.column(1)):
                    e = sets.of(text)
                    sizes.append(len(e))
                    digests.append(hashlib.blake2b(e.tobytes(), digest_size=16).digest())
                    signatures.append(signature(e, by).tobytes() if len(e) else None)
                    bitmaps.append(_bitmap(e).tobytes() if len(e) else None)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary()),
                                                  pa.array(bitmaps, pa.binary())], names=["id", "n", "digest", "signature", "bitmap"])
    return run


def _pairs_of(signatures: np.ndarray) -> np.ndarray:
    """(coordinate, value) as one number, per row of a signature matrix."""
    return (np.arange(signatures.shape[1], dtype="u8") << np.uint64(32)) | signatures


def _counter(pairs: np.ndarray) -> np.ndarray:
    h = pairs * _MIX
    return ((h ^ (h >> np.uint64(29))) * _MIX >> np.uint64(44)).astype("i8")


def _counts(coordinates: int):
    """Per task: how many signatures fall on each counter, in chunks of 2**14 counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, "i8")
        for batch in batches:
            if batch.num_rows:
                counts += np.bincount(_counter(_pairs_of(_matrix(batch.column(0).to_pylist(), coordinates))).ravel(), minlength=COUNTERS)
        for chunk, part in enumerate(counts.reshape(-1, 1 << 14)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([part.astype("<i8").tobytes()], pa.binary())})
    return run


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(b, "<i8") for b in frame["counts"])
    return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})


def _matrix(signatures: list[bytes], coordinates: int) -> np.ndarray:
    return np.frombuffer(b"".join(signatures), "<u4").reshape(-1, coordinates)


def levels(reps: DataFrame, coordinates: int) -> np.ndarray:
    """How common each counter's pairs are, in quarter octaves: 1 MB, whatever the corpus."""
    chunks = reps.select("signature").mapInArrow(_counts(coordinates), "chunk int, counts binary")
    out = np.zeros((COUNTERS >> 14, 1 << 14), "u1")
    for r in chunks.groupBy("chunk").applyInPandas(_summed, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.ceil(4 * np.log2(1 + np.frombuffer(r["counts"], "<i8").astype("f8")))
    return out.ravel()


def _prefixes(coordinates: int, first: int, held):
    """The first pairs of each signature in the global order, and how common its pairs are together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            pairs = _pairs_of(_matrix(batch.column(1).to_pylist(), coordinates))
            common = level[_counter(pairs)]
            order = np.lexsort((pairs, common), axis=1)[:, :first]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(common.sum(axis=1, dtype="i8")),
                                              pa.array(list(np.take_along_axis(pairs, order, axis=1).astype("i8")), pa.list_(pa.int64()))],
                                             names=["r", "weight", "prefix"])
    return run


def collisions(a: np.ndarray, b: np.ndarray, least: int, step: int = 32) -> np.ndarray:
    """Positions of the row pairs that agree in at least ``least`` coordinates; counted by blocks of coordinates, and
    pairs that cannot reach it any more are skipped."""
    at, count, width = np.arange(len(a)), np.zeros(len(a), "i8"), a.shape[1]
    for lo in range(0, width, step):
        hi = min(lo + step, width)
        count += (a[at, lo:hi] == b[at, lo:hi]).sum(axis=1)
        keep = count + (width - hi) >= least
        at, count = at[keep], count[keep]
    return at


def short(signatures: np.ndarray) -> np.ndarray:
    """The low byte of every coordinate."""
    return signatures.astype("u1")


def _shortened(coordinates: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                low = short(_matrix(batch.column(2).to_pylist(), coordinates))
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([row.tobytes() for row in low], pa.binary())], names=["r", "n", "short"])
    return run


def _may_agree(coordinates: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "u1").reshape(-1, coordinates) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([c.take(pa.array(collisions(x, y, least))) for c in batch.columns[:2]], names=["a", "b"])
    return run


def _near(x: bytes, y: bytes, total: int, percent: int) -> bool:
    return _distance(np.frombuffer(x, "u1"), np.frombuffer(y, "u1")) <= _most(total, percent)


def _above(coordinates: int, least: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_matrix(batch.column(i).to_pylist(), coordinates) for i in (2, 3))
                batch = batch.take(pa.array(collisions(x, y, least)))
                keep = [_near(v, w, n, percent) for v, w, n in zip(*(c.to_pylist() for c in batch.columns[4:]), strict=True)]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])
    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(n)
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                elements = [sets.of(t).tobytes() for t in utf8(batch.column(0).slice(lo, 2000))]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(e, digest_size=16).digest() for e in elements], pa.binary()),
                                                  pa.array(elements, pa.binary())], names=["digest", "elements"])
    return run


def _confirm(percent: int):
    """Rows sorted by (a, chunk), the set of ``a`` before those of its partners: holds two sets at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mine = None, np.zeros(0, "u8")
        for batch in batches:
            left, right = [], []
            for a, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                e = np.frombuffer(raw, "<u8")
                if a == b:
                    own, mine = a, e
                    continue
                assert own == a
                small, large = (mine, e) if len(mine) <= len(e) else (e, mine)
                if 100 * len(small) < percent * len(large):
                    continue
                near = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common = int((large[near] == small).sum())
                if 100 * common >= percent * (len(mine) + len(e) - common):
                    left.append(a)
                    right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
    return run


class _Maps:
    """Parity bitmaps of some sets, folded to a common length where two differ in it."""

    def __init__(self, maps: list[bytes]):
        self.maps = [np.frombuffer(m, "u1") for m in maps]
        self.length = np.array([len(m) for m in maps])
        self.folded: dict[int, np.ndarray] = {}

    def at(self, length: int) -> np.ndarray:
        """All bitmaps of at least this length, folded to it."""
        if length not in self.folded:
            out = np.zeros((len(self.maps), length), "u1")
            for i in np.flatnonzero(self.length >= length):
                out[i] = np.bitwise_xor.reduce(self.maps[i].reshape(-1, length), axis=0)
            self.folded[length] = out
        return self.folded[length]

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        shorter = np.minimum(self.length[others], self.length[i])
        out = np.zeros(len(others), "i8")
        for length in np.unique(shorter):
            rows, take = self.at(int(length)), shorter == length
            out[take] = np.bitwise_count(rows[others[take]] ^ rows[i]).sum(axis=1)
        return out


def _cross(coordinates: int, least: int, percent: int):
    """Pairs of one pair of blocks of a list that are in different components and pass both filters."""
    half = coordinates // 2

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 2), "i8")]
        for (_, left, right), part in frame.groupby(["list", "left", "right"], sort=False):
            part = part.sort_values("n", kind="stable")
            ids, comp, size, side = (part[c].to_numpy() for c in ("r", "component", "n", "side"))
            sig, maps = _matrix(list(part["signature"]), coordinates), _Maps(list(part["bitmap"]))
            first, last = np.ascontiguousarray(sig[:, :half]), np.ascontiguousarray(sig[:, half:])
            for i in range(len(ids) - 1):
                end = int(np.searchsorted(size, 100 * size[i] // percent, "right"))       # sizes ascend: larger ones cannot link
                may = comp[i + 1:end] != comp[i]
                if left != right:
                    may &= side[i + 1:end] != side[i]
                if not may.any():
                    continue
                count = np.count_nonzero(first[i + 1:end] == first[i], axis=1)
                rest = np.flatnonzero(may & (count + (coordinates - half) >= least))       # the others cannot reach it: skipped
                rest = rest[count[rest] + np.count_nonzero(last[rest + i + 1] == last[i], axis=1) >= least] + i + 1
                if len(rest):
                    hit = rest[maps.distances(i, rest) <= _most(size[rest] + size[i], percent)]
                    out.append(np.stack([np.minimum(ids[i], ids[hit]), np.maximum(ids[i], ids[hit])], axis=1))
        return pd.DataFrame(np.unique(np.concatenate(out), axis=0), columns=["a", "b"])
    return run


class _Join:
    """The stored representatives of a corpus and the steps on pairs of them."""

    def __init__(self, docs: DataFrame, reps: DataFrame, n: int, percent: int, coordinates: int, least: int, partners: int, broadcast_ids: int):
        self.docs, self.reps, self.n, self.percent = docs, reps, n, percent
        self.coordinates, self.least, self.partners, self.broadcast_ids = coordinates, least, partners, broadcast_ids
        self.short = stored(reps.select("r", "n", "signature").mapInArrow(_shortened(coordinates), "r long, n long, short binary"), "minhash-short")

    def only(self, ids: DataFrame) -> DataFrame:
        """Size, signature and bitmap of the representatives that ``ids`` (r) names."""
        ids = stored(ids.distinct(), "minhash-named")
        ids = F.broadcast(ids) if ids.count() <= self.broadcast_ids else ids
        return self.reps.select("r", "n", "signature", "bitmap").join(ids, "r", "left_semi")

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """Those of the distinct ``pairs`` (a, b) whose sizes fit, whose signatures agree often enough and whose bitmaps are near."""
        both = pairs.join(self.short.toDF("a", "n", "x"), "a").join(self.short.toDF("b", "m", "y"), "b")
        both = both.where(F.least("n", "m") * 100 >= F.greatest("n", "m") * self.percent)
        # Few pairs get so far: whole signatures and bitmaps are joined to these alone.
        pairs = stored(both.select("a", "b", "x", "y").mapInArrow(_may_agree(self.coordinates, self.least), "a long, b long"), "minhash-may")
        side = self.only(pairs.select(F.explode(F.array("a", "b")).alias("r")))
        both = pairs.join(side.toDF("a", "n", "x", "v"), "a").join(side.toDF("b", "m", "y", "w"), "b")
        return both.select("a", "b", "x", "y", "v", "w", (F.col("n") + F.col("m")).alias("total")).mapInArrow(
            _above(self.coordinates, self.least, self.percent), "a long, b long")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """Those of the stored ``pairs`` that link, decided on the sets of their whole texts."""
        if not pairs.head(1):
            return pairs
        wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("r")).groupBy("r").agg(F.count("*").alias("k"))
                        .join(self.reps.select("r", "doc", "digest"), "r"), "minhash-wanted")
        ids = wanted.select(F.col("doc").alias("id")).distinct()
        if wanted.count() <= self.broadcast_ids:
            ids = F.broadcast(ids)
        # The end with more pairs reads the other ends' sets, so a set travels once per pair, not twice.
        side = wanted.select("r", "k", "digest")
        both = pairs.join(side.toDF("a", "i", "x"), "a").join(side.toDF("b", "j", "y"), "b")
        more = F.struct("i", "a") >= F.struct("j", "b")
        both = both.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("a"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("b"),
                           F.when(more, F.col("x")).otherwise(F.col("y")).alias("own"), F.when(more, F.col("y")).otherwise(F.col("x")).alias("digest"),
                           F.greatest("i", "j").alias("k"))
        parts = both.withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / self.partners).cast("long")))
        rows = parts.select("a", "chunk", "b", "digest").unionByName(parts.select("a", "chunk", F.col("a").alias("b"), F.col("own").alias("digest")).distinct())
        # An id may have several texts and a set several documents: one row per set, dealt by what it is joined on.
        sets = self.docs.join(ids, "id", "left_semi").select("text").mapInArrow(_sets(self.n), "digest binary, elements binary").dropDuplicates(["digest"])
        loaded = rows.join(sets, "digest")
        ordered = loaded.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("a") != F.col("b"))
        links = ordered.select("a", "b", "elements").mapInArrow(_confirm(self.percent), "a long, b long")
        return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _mixed(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Members of the lists that hold several components, with their component."""
    if comp is None:
        return members.withColumn("component", F.col("r"))
    placed = members.join(comp.toDF("r", "c"), "r", "left").withColumn("component", F.coalesce("c", "r")).drop("c")
    several = placed.groupBy("list").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("list")
    return placed.join(several, "list")


def _blocked(members: DataFrame, reps: DataFrame, block: int, rows: int) -> DataFrame:
    """Members (list, r, k, component) at every pair of blocks of their list, in tasks of about ``rows`` members; ``reps``
    are those of the members."""
    blocks = F.ceil(F.col("k") / block).cast("long")
    placed = members.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("r"), F.col("blocks")))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("list", "r", "component", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                           (F.col("own") > F.col("other")).cast("int").alias("side"))
    tasks = slices(members.count(), rows)
    return (paired.join(reps, "r")
            .withColumn("task", F.pmod(F.xxhash64("list", "left", "right"), F.lit(tasks))))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, coordinates: int = 64, miss: float = 1e-9,
                    rounds: int = 3, block: int = 2_000, rows: int = 4_000, partners: int = 256, broadcast_ids: int = 1_000_000) -> DataFrame:
    """key, n_shingles, component_id (smallest key reachable by links) and kept (key = component_id) of every row."""
    spark = df.sparkSession
    least = threshold(coordinates, percent, miss)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    gone: list[str] = []             # tables that the next ones replace: deleted as soon as these are written
    signed = stored(docs.mapInArrow(_signed(n, coordinates), "id long, n long, digest binary, signature binary, bitmap binary"), "minhash-signatures", gone)
    live = signed.where("n > 0 and id is not null")
    of_set = live.groupBy("digest").agg(F.min("id").alias("doc"), F.min("n").alias("n"), F.count("*").alias("copies"), F.min("signature").alias("signature"),
                                        F.min("bitmap").alias("bitmap"))
    reps = stored(of_set.withColumn("r", F.monotonically_increasing_id()), "minhash-reps")
    every = stored(signed.select("id", "n", "digest"), "minhash-rows")
    live = every.where("n > 0 and id is not null")
    discard(spark, gone)
    held = spark.sparkContext.broadcast(levels(reps, coordinates))
    opened = reps.select("r", "signature").mapInArrow(_prefixes(coordinates, coordinates - least + 1, held), "r long, weight long, prefix array<bigint>")
    opened = stored(opened, "minhash-posted", gone)
    posted = opened.select(F.explode("prefix").alias("list"), "r")      # the weight stays behind: only members that meet need it
    shared = posted.groupBy("list").agg(F.count("*").alias("k")).where("k > 1")
    met = stored(posted.join(shared, "list"), "minhash-lists", gone)
    # Near copies meet in many lists: of lists with the same members one is enough.
    prints = met.groupBy("list", "k").agg(F.bit_xor(F.xxhash64("r")).alias("p"), F.bit_xor(F.xxhash64("r", F.lit(1))).alias("q"))
    alone = prints.groupBy("k", "p", "q").agg(F.min("list").alias("list")).select("list")
    met = stored(met.join(alone, "list").join(opened.select("r", "weight"), "r"), "minhash-met")
    discard(spark, gone)

    # Only what is in some list is ever compared: the signatures that the rounds shuffle.
    inside = stored(met.select("r").distinct(), "minhash-inside")
    inside = F.broadcast(inside) if inside.count() <= broadcast_ids else inside
    listed = stored(reps.join(inside, "r", "left_semi"), "minhash-listed")
    join = _Join(docs, listed, n, percent, coordinates, least, partners, broadcast_ids)
    links = spark.createDataFrame([], "a long, b long")
    tested, comp, mixed = links, None, _mixed(met, None)
    for turn in range(rounds):
        rank = F.struct("weight", F.xxhash64("r", F.lit(turn)), F.col("r"))
        pivots = mixed.groupBy("list").agg(F.max_by(F.struct("r", "component"), rank).alias("p")).select("list", F.col("p.r").alias("p"), F.col("p.component").alias("c"))
        mixed = stored(mixed.join(pivots, "list").where("r != p"), "minhash-turn")
        pairs = mixed.where("component != c").select(F.least("r", "p").alias("a"), F.greatest("r", "p").alias("b")).distinct()
        pairs = stored(join.agreeing(pairs).join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
        found = stored(join.confirmed(pairs), "minhash-links")
        links, tested = links.unionByName(found), tested.unionByName(pairs)
        comp = stored(components(spark, links), "minhash-components")
        mixed = stored(_mixed(mixed.select("list", "r", "k", "weight"), comp), "minhash-mixed")
        if not mixed.head(1):
            break
    # What is left is compared across components, without the pivots, which have met all members of their lists.
    if mixed.head(1):
        more = _blocked(mixed, join.only(mixed.select("r")), block, rows).groupBy("task").applyInPandas(_cross(coordinates, least, percent), "a long, b long")
        more = stored(more.distinct().join(tested, ["a", "b"], "left_anti"), "minhash-more")
        links = links.unionByName(stored(join.confirmed(more), "minhash-links"))
    # Rows with one id are one node: the sets of its texts hang together.
    several = live.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo != hi").select("id")
    if several.head(1):
        own = live.join(several, "id").select("id", "digest").distinct().join(reps.select("digest", "r"), "digest").select("id", "r")
        links = links.unionByName(own.join(own.groupBy("id").agg(F.min("r").alias("a")), "id").select("a", F.col("r").alias("b")).where("a != b"))
    comp = stored(components(spark, links), "minhash-components")
    low = comp.toDF("r", "c").join(reps.select("r", "doc"), "r").groupBy("c").agg(F.min("doc").alias("low"))
    low = comp.toDF("r", "c").join(low, "c").select("r", "low")
    # Only sets with copies or links have a component other than the row's own id.
    named = reps.join(low, "r", "left").where("copies > 1 or low is not null").select("digest", F.coalesce("low", "doc").alias("component"))
    out = every.select("id", "n", "digest").join(named, "digest", "left")
    reached = F.when(F.col("id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("id")).otherwise(F.coalesce("component", "id"))
    out = out.select("id", "n", reached.alias("c"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept"))

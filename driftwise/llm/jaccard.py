"""N-gram Jaccard self-join by a prefix tree, and the components of its links.

A document's set holds the 64-bit hashes of its distinct n-word shingles, in one global order. Sets that link have
``100 * |x & y| >= percent * |x | y|``, so with o = ceil(percent/100 * n) two linked sets share an element among the
first n - o + 1 of either: these open the document's paths in the tree, and only documents that meet on one can
link. The global order puts elements that the corpus repeats last (counted over all documents in a sketch of fixed
size), so shared passages open few paths.

Paths also carry the size: sets that link have sizes in one class or in adjacent ones, and a path is entered once for
each of the two.

1. Documents with equal sets become one representative (the smallest id).
2. Representatives that meet on an element form a group; the first of it is its pivot. Every other member is checked
   against the pivot, and the links give first components. Groups inside one component are done: however many
   copies a group holds, its pairs are never listed.
3. In the remaining groups, members of different components are compared by parity bitmaps (their distance never
   exceeds the size of the sets' difference, so no link is lost), in blocks of ``block`` members; only pairs that
   may link leave the task.
4. Candidate pairs are decided by the tree: a document's partners are stored as paths of ordered elements, the
   document walks it once, paths share their partial overlaps, and a subtree is cut when what remains of the path
   and of the document cannot reach the needed overlap.

Defined results: words are runs without ASCII white space after lower-casing A-Z; a document with fewer than n words
has its whole word sequence as one element; without words or with a null text its set is empty and it links with
nothing. Null ids take no part and keep a null component; rows with one id and words hang together, whatever their
texts, and carry the smallest id they reach; a row without words keeps its own id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.llm.common import slices, stored, utf8

COUNTERS = 1 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class Shingles:
    """Sets of texts. Word hashes are kept for the task, up to ``most`` words."""

    def __init__(self, n: int, most: int = 500_000):
        self.n, self.most, self.known = n, most, {}

    def of(self, text: bytes) -> np.ndarray:
        """Ascending distinct 64-bit elements; bytes.lower and bytes.split know ASCII only, as the definition asks."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, "u8")
        known = self.known
        try:
            hashes = [known[w] for w in words]
        except KeyError:
            if len(known) > self.most:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            hashes = [known[w] for w in words]
        h = np.array(hashes, "u8")
        width = min(self.n, len(h))
        out = np.full(len(h) - width + 1, np.uint64(width))
        for j in range(width):
            out = _mixed(out + h[j:len(h) - width + 1 + j])
        return np.unique(out)


def _counter(elements: np.ndarray) -> np.ndarray:
    return (elements >> np.uint64(44)).astype("i8")      # log2(COUNTERS) high bits


def _sketch(n: int):
    """Per task: how many documents hold an element of each counter, up to 65,535; in chunks of 2**14 counters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sets = np.zeros(COUNTERS, "i8"), Shingles(n)
        for batch in batches:
            for text in utf8(batch.column(0)):
                np.add.at(counts, _counter(sets.of(text)), 1)
        for chunk, part in enumerate(np.minimum(counts, 65_535).astype("<u2").reshape(-1, 1 << 14)):
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})
    return run


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << 14, "i8")
    for b in frame["counts"]:
        total += np.frombuffer(b, "<u2")
    return pd.DataFrame({"chunk": frame["chunk"].iloc[:1], "counts": [np.minimum(total, 2 ** 32 - 1).astype("<u4").tobytes()]})


def element_counts(texts: DataFrame, n: int) -> np.ndarray:
    """Counters of fixed size over all documents: 4 MB, whatever the corpus."""
    chunks = texts.mapInArrow(_sketch(n), "chunk int, counts binary").groupBy("chunk").applyInPandas(_summed, "chunk int, counts binary")
    out = np.zeros((COUNTERS >> 14, 1 << 14), "u4")
    for r in chunks.collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def need(sizes, percent: int):
    """Least overlap that a set of this size has with any set it links with."""
    return -(-percent * sizes // 100)


def _bitmap(elements: np.ndarray) -> np.ndarray:
    """Parity of the number of elements per bit; about two bits an element, a power of two."""
    bits = max(256, 1 << int(2 * max(1, len(elements)) - 1).bit_length())
    own = np.bincount((elements >> np.uint64(3)).astype("i8") & (bits - 1), minlength=bits) & 1
    return np.packbits(own.astype("u1"))


def size_classes(percent: int, most: int = 1 << 40) -> np.ndarray:
    """First size of each class; two sets that link are in one class or in adjacent ones."""
    out = [1]
    while out[-1] < most:
        out.append(100 * out[-1] // percent + 1)
    return np.array(out, "i8")


def _paths(n: int, percent: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = size_classes(percent)
        level = np.ceil(4 * np.log2(1 + held.value.astype("f8"))).astype("i8")       # quarter octaves of the counters
        sets = Shingles(n)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                sizes, digests, bitmaps, paths = [], [], [], []
                for text in utf8(batch.column(1)):
                    e = sets.of(text)
                    size = len(e)
                    first = size - need(size, percent) + 1 if size else 0
                    order = np.lexsort((e, level[_counter(e)]))[:first]
                    sizes.append(size)
                    digests.append(hashlib.blake2b(e.tobytes(), digest_size=16).digest())
                    bitmaps.append(_bitmap(e).tobytes())
                    paths.append(e[order].astype("i8"))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(np.searchsorted(classes, sizes, "right"), pa.int64()), pa.array(digests, pa.binary()), pa.array(bitmaps, pa.binary()),
                     pa.array(paths, pa.list_(pa.int64()))], names=["id", "n", "class", "digest", "bitmap", "paths"])
    return run


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """Lower bound of the size of the symmetric difference; the longer bitmap is folded to the shorter."""
    while len(a) > len(b):
        a = _half(a)
    while len(b) > len(a):
        b = _half(b)
    return int(np.bitwise_count(a ^ b).sum())


def _half(bits: np.ndarray) -> np.ndarray:
    return bits[:len(bits) // 2] ^ bits[len(bits) // 2:]


def _most(total, percent: int):
    """Largest symmetric difference of linked sets with ``total`` elements together."""
    return total - 2 * -(-percent * total // (100 + percent))


def _may_link(percent: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keep = [_distance(np.frombuffer(x, "u1"), np.frombuffer(y, "u1")) <= _most(n + m, percent)
                    for x, y, n, m in zip(f["bitmap"], f["other_bitmap"], f["n"], f["other_n"], strict=True)]
            yield f.loc[keep, ["a", "b"]]
    return run


def tree_overlaps(walker: np.ndarray, paths: list[np.ndarray], percent: int) -> list[int]:
    """Positions in ``paths`` (ascending element arrays) of those that link with ``walker``.

    The tree is the sorted list of paths: a node is a range of paths with a common beginning, its edge the elements
    up to the first difference. The walk carries the overlap so far, so a shared beginning is compared once, and
    leaves a node when neither the elements left in its longest path nor those left in the walker can lift
    the overlap to what its shortest path needs.
    """
    order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u8").tobytes())
    sizes = [len(paths[i]) for i in order]
    out: list[int] = []
    nodes = [(0, len(order), 0, 0)]
    while nodes:
        lo, hi, depth, overlap = nodes.pop()
        first, last = paths[order[lo]], paths[order[hi - 1]]
        short = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:short] != last[depth:short]) if hi - lo > 1 else ()
        end = depth + int(differ[0]) if len(differ) else short if hi - lo > 1 else len(first)
        shortest, longest = min(sizes[lo:hi]), max(sizes[lo:hi])
        least = -(-percent * (len(walker) + shortest) // (100 + percent))
        for at in range(depth, end, 64):
            edge = first[at:min(at + 64, end)]
            near = np.searchsorted(walker, edge)
            overlap += int((walker[np.minimum(near, len(walker) - 1)] == edge).sum())
            if overlap + min(longest - at - len(edge), len(walker) - int(near[-1])) < least:
                break
        else:
            while lo < hi and sizes[lo] == end:             # paths that end here
                if 100 * overlap >= percent * (len(walker) + end - overlap):
                    out.append(order[lo])
                lo += 1
            start = lo
            for i in range(lo + 1, hi + 1):
                if i == hi or paths[order[i]][end] != paths[order[start]][end]:
                    nodes.append((start, i, end, overlap))
                    start = i
    return out


def _decide(percent: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (a, _), part in frame.groupby(["a", "chunk"], sort=False):
            own = part["b"] == a
            walker = np.frombuffer(part.loc[own, "elements"].iloc[0], "<u8")
            rest = part[~own]
            hits = tree_overlaps(walker, [np.frombuffer(x, "<u8") for x in rest["elements"]], percent)
            out += [(a, int(rest["b"].iloc[i])) for i in hits]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")
    return run


def _elements(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Shingles(n)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sets.of(t).tobytes() for t in utf8(batch.column(1))], pa.binary())],
                                             names=["id", "elements"])
    return run


def _linked(docs: DataFrame, pairs: DataFrame, n: int, percent: int, partners: int = 256, rows: int = 2_000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Those of the candidate ``pairs`` (a, b) that link, decided on the sets of their whole texts."""
    spark = docs.sparkSession
    total = pairs.count()
    if not total:
        return spark.createDataFrame([], "a long, b long")
    ids = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "jaccard-ids")
    wanted = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    sets = stored(docs.join(wanted, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text")).mapInArrow(_elements(n), "id long, elements binary"),
                  "jaccard-sets")
    # A document with many partners walks several trees of about `partners` paths.
    per = pairs.groupBy("a").agg(F.count("*").alias("k"))
    parts = pairs.join(per, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / partners).cast("long"))).select("a", "chunk", "b")
    rows_of = parts.unionByName(parts.select("a", "chunk", F.col("a").alias("b")).distinct())
    tasks = slices(2 * total, rows)
    loaded = rows_of.join(sets.withColumnRenamed("id", "b"), "b").withColumn("task", F.pmod(F.xxhash64("a", "chunk"), F.lit(tasks)))
    return loaded.groupBy("task").applyInPandas(_decide(percent), "a long, b long")


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """id and the smallest id it reaches, of all ids in ``links`` (a, b): alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "stars")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = (large.join(least, F.col("u") == F.col("w"))
                 .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
                 .select("e.*").where("u != v").distinct())
        after = stored(small, "stars")
        same = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if same == edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first():
            break
        edges = after
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _cross_pairs(percent: int):
    """Pairs of one block pair of a group that are in different components and may link by size and bitmap."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for (_, left, right), part in frame.groupby(["element", "left", "right"], sort=False):
            part = part.sort_values("n", kind="stable")
            ids, sizes, comp, side = (part[c].to_numpy() for c in ("id", "n", "component", "side"))
            maps = [np.frombuffer(b, "u1") for b in part["bitmap"]]
            for i in range(len(ids)):
                top = np.searchsorted(sizes, 100 * sizes[i] // percent, "right")
                others = np.arange(i + 1, top)
                others = others[comp[others] != comp[i]]
                if left != right:
                    others = others[side[others] != side[i]]
                out += [(min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))) for j in others
                        if _distance(maps[i], maps[j]) <= _most(sizes[i] + sizes[j], percent)]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64").drop_duplicates()
    return run


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90, block: int = 500,
                    rows: int = 4_000) -> DataFrame:
    """key, n_shingles and component_id (smallest key reachable by links) of every row."""
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    texts = docs.where("id is not null").groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select("id")
    texts = docs.join(texts, "id").groupBy("id").agg(F.countDistinct(F.md5(F.coalesce("text", F.lit("")))).alias("k")).where("k > 1")
    if not texts.head(1):
        found = _near_duplicates(docs, n, percent, block, rows)
        return found.select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"))
    # An id has several texts: rows are joined by a key of their own, and rows with one id and words are linked besides.
    spark = df.sparkSession
    own = stored(docs.withColumn("row", F.monotonically_increasing_id()), "jaccard-rows")
    found = stored(_near_duplicates(own.select(F.when(F.col("id").isNotNull(), F.col("row")).alias("id"), "text"), n, percent, block, rows)
                   .where("id is not null").withColumnRenamed("id", "row"), "jaccard-by-row")
    placed = own.where("id is not null").select("id", "row").join(found, "row")
    live = placed.where("n_shingles > 0")
    same = live.join(live.groupBy("id").agg(F.min("row").alias("a")), "id").select("a", F.col("row").alias("b"))
    comp = components(spark, live.select(F.col("component").alias("a"), F.col("row").alias("b")).unionByName(same))
    live = live.join(comp.toDF("row", "c"), "row", "left").withColumn("c", F.coalesce("c", "row"))
    low = live.join(live.groupBy("c").agg(F.min("id").alias("low")), "c").select("row", "low")
    out = placed.join(low, "row", "left").select("id", "n_shingles", F.coalesce("low", "id").alias("component"))
    none = _near_duplicates(own.where("id is null").select("id", "text"), n, percent, block, rows)
    return out.unionByName(none).select(F.col("id").alias(key), "n_shingles", F.col("component").alias("component_id"))


def _near_duplicates(docs: DataFrame, n: int, percent: int, block: int, rows: int) -> DataFrame:
    """id, n_shingles and component of every row of (id, text); every id has one text."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(element_counts(docs.select("text"), n))
    every = stored(docs.mapInArrow(_paths(n, percent, counts), "id long, n long, class long, digest binary, bitmap binary, paths array<bigint>"), "jaccard-paths")
    live = every.where("n > 0 and id is not null")
    # One representative per distinct set; its size, bitmap and paths are those of every row of the set.
    of_set = live.groupBy("digest").agg(F.min("id").alias("rep"))
    reps = stored(live.join(of_set.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & (F.col("id") == F.col("rep")))
                  .dropDuplicates(["digest"]).select("rep", "n", "class", "bitmap", "paths"), "jaccard-reps")
    # Elements that one path has alone go first; what stays enters the nodes of the first level. A node is an
    # element and two adjacent size classes; linked sets share one of their nodes.
    every_path = reps.select(F.explode("paths").alias("e"), F.col("rep").alias("id"), "class")
    shared = every_path.groupBy("e").agg(F.count("*").alias("k")).where("k > 1").select("e")
    some = stored(every_path.join(shared, "e"), "jaccard-shared")
    flat = some.select(F.explode(F.array(F.xxhash64("e", "class"), F.xxhash64("e", F.col("class") + 1))).alias("element"), "id")
    groups = flat.groupBy("element").agg(F.count("*").alias("k"), F.min("id").alias("pivot")).where("k > 1")
    met = stored(flat.join(groups, "element"), "jaccard-met")
    # Near copies meet on most of their elements: of elements with the same members one is enough.
    prints = met.groupBy("element", "k", "pivot").agg(F.bit_xor(F.xxhash64("id")).alias("p"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("q"))
    kept = prints.groupBy("k", "pivot", "p", "q").agg(F.min("element").alias("element")).select("element")
    met = stored(met.join(kept, "element"), "jaccard-groups")

    sizes = reps.select("rep", "n")
    stars = met.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    stars = stars.join(sizes.toDF("a", "n"), "a").join(sizes.toDF("b", "other_n"), "b")
    stars = stars.where(F.least("n", "other_n") * 100 >= F.greatest("n", "other_n") * percent)
    maps = reps.select("rep", "bitmap")
    pairs = stored(stars.join(maps.toDF("a", "bitmap"), "a").join(maps.toDF("b", "other_bitmap"), "b")
                   .mapInPandas(_may_link(percent), "a long, b long"), "jaccard-pairs")
    links = stored(_linked(docs, pairs, n, percent), "jaccard-links")
    comp = stored(components(spark, links), "jaccard-components")

    # Groups that hold members of several components and more than the pivot's pairs.
    where = met.where("k > 2").join(sizes.withColumnRenamed("rep", "id"), "id").join(comp, "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = where.groupBy("element").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo != hi").select("element")
    open_ = where.join(mixed, "element").where("id != pivot").select("element", "id", "n", "k", "component")
    open_ = stored(open_.join(maps.withColumnRenamed("rep", "id"), "id"), "jaccard-open")
    blocks = F.ceil(F.col("k") / block).cast("long")
    placed = open_.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("element", "id", "n", "component", "bitmap", F.least("own", "other").alias("left"), F.greatest("own", "other").alias("right"),
                           (F.col("own") > F.col("other")).cast("int").alias("side"))
    tasks = slices(open_.count(), rows)
    more = (paired.withColumn("task", F.pmod(F.xxhash64("element", "left", "right"), F.lit(tasks)))
            .groupBy("task").applyInPandas(_cross_pairs(percent), "a long, b long").distinct())
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "jaccard-more")
    found = stored(_linked(docs, more, n, percent), "jaccard-links")
    if found.head(1):
        comp = components(spark, links.unionByName(found))
    nodes = live.join(of_set, "digest").select("id", "rep").distinct()
    reached = nodes.join(comp.toDF("rep", "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    out = every.select("id", "n").join(reached.toDF("_id", "component"), F.col("id") == F.col("_id"), "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))

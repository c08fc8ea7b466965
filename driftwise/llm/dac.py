"""Token-id files as directly addressable codes.

An id is cut into 8-bit chunks, lowest first. Level 0 holds the lowest chunk of every id; a continuation bitmap says
which ids go on, and the next level holds the next chunk of those only. A rank directory with the number of set bits
before every 512th position turns a position on one level into its position on the next, so any id, or any run of
ids, is read with one short hop per level and without decoding its neighbours.

File format: a Parquet table with a row per segment of whole documents, in ascending document order over (part, seq):
``doc_ids`` and ``lengths`` (ids of each document), ``start`` (ids before the segment in its part), ``n_ids``, and
per level ``chunks``, ``marks`` (bitmap, lowest bit first) and ``ranks`` (little-endian unsigned 32-bit).

Defined results: a null text is an empty one and has the end id only; null document ids come first; repeated ids
are ordered by their text. The longest document and ``segment_ids`` ids bound a task's memory. Documents are dealt
by ranges of ids, so the rows of one repeated id are written by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwise.llm.common import strings
from driftwise.llm.tokens import encoder

CHUNK, STEP = 8, 512
SEGMENT = pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("start", pa.int64()), ("n_ids", pa.int64()),
                     ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary())),
                     ("marks", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))])
SEGMENT_DDL = ("part long, seq long, start long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, "
               "chunks array<binary>, marks array<binary>, ranks array<binary>")


class Codes:
    """Levels of one segment."""

    def __init__(self, chunks: list[bytes], marks: list[bytes], ranks: list[bytes]):
        self.chunks = [np.frombuffer(c, "u1") for c in chunks]
        self.marks = [np.frombuffer(m, "u1") for m in marks]
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @classmethod
    def of(cls, ids: np.ndarray) -> Codes:
        chunks, marks, ranks = [], [], []
        rest = ids.astype("<u4")
        while len(rest) or not chunks:
            chunks.append((rest & 0xFF).astype("u1").tobytes())
            high = rest >> CHUNK
            more = high > 0
            ends = np.add.reduceat(more, np.arange(0, len(more), STEP)) if len(more) else np.zeros(0, "u4")
            marks.append(np.packbits(more, bitorder="little").tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(ends)]).astype("<u4").tobytes())
            rest = high[more]
        return cls(chunks, marks, ranks)

    def rank(self, level: int, at: int) -> int:
        """Set bits before ``at``: the directory's entry and at most 511 bits of the bitmap."""
        block = at // STEP
        bits = np.unpackbits(self.marks[level][block * STEP // 8:(at + 7) // 8], bitorder="little")[:at - block * STEP]
        return int(self.ranks[level][block]) + int(bits.sum())

    def read(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b (exclusive)."""
        out = self.chunks[level][a:b].astype("<u4")
        first = a // 8
        more = np.unpackbits(self.marks[level][first:(b + 7) // 8], bitorder="little")[a - 8 * first:b - 8 * first].astype(bool)
        if more.any():
            start = self.rank(level, a)
            out[more] |= self.read(start, start + int(more.sum()), level + 1) << np.uint32(CHUNK)
        return out

    def at(self, i: int) -> int:
        return int(self.read(i, i + 1)[0])


def _writer(tokenizer_path: str, end_id: int, segment_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, start = TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            codes = Codes.of(np.frombuffer(b"".join(held), "<u4"))
            row = [part, seq, start, size, docs, [len(h) // 4 for h in held], [c.tobytes() for c in codes.chunks],
                   [m.tobytes() for m in codes.marks], [r.tobytes() for r in codes.ranks]]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENT, strict=True)], schema=SEGMENT)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), strings(batch.column(1))
            for at in range(0, len(texts), 256):
                for doc, ids in zip(doc_ids[at:at + 256], encoder(tokenizer_path).encode(texts[at:at + 256]), strict=True):
                    docs.append(doc)
                    held.append(ids + end)
                    size += len(held[-1]) // 4
                    if size >= segment_ids:
                        yield segment()
                        seq, start, docs, held, size = seq + 1, start + size, [], [], 0
        if held:
            yield segment()
    return run


def write(df: DataFrame, path: str, tokenizer_path: str, end_id: int, segment_ids: int = 1 << 18) -> None:
    """Encode (doc_id, text) and write the segments in ascending order of doc_id."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    # The sampling for the ranges reads ids only; ties are broken inside the task.
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(_writer(tokenizer_path, end_id, segment_ids), SEGMENT_DDL)
     .write.option("compression", "zstd").parquet(path))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes = Codes(row["chunks"], row["marks"], row["ranks"])
            ends = np.cumsum(row["lengths"])
            starts = ends - np.array(row["lengths"])
            ids = memoryview(codes.read(0, int(ends[-1])).astype("<u4").tobytes())        # a whole segment is wanted: one run
            crc = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([row["part"]] * len(crc), pa.int64()), "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "own": pa.array(starts + row["start"], pa.int64()), "n_tokens": pa.array(row["lengths"], pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64())})


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT_DDL).parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, its ids read through the codes."""
    files = read(spark, path)
    # A row per written part: as many as the writer had tasks, not rows of the corpus.
    parts = files.groupBy("part").agg(F.max(F.col("start") + F.col("n_ids")).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    docs = files.drop("seq", "n_ids").mapInArrow(_reader, "part long, doc_id long, own long, n_tokens long, ids_crc32 long")
    return docs.join(bases, "part").select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")

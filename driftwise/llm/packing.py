"""Bounded-space online packing of token ids into windows.

Each task keeps at most ``open_windows`` windows. A document is encoded and closed with the end id; its full windows
leave at once, the remainder goes where it leaves least room (best fit). When it fits nowhere, the fullest window
is emitted and a new one opened. The windows that are open when a task ends are merged in a tree: a node takes the
windows of ``fan_in`` nodes, packs them whole into each other (best fit, largest first), passes on the
``open_windows`` emptiest and closes the others. No node sees more than fan_in * open_windows windows.

Defined results: a null text is an empty one and has the end id only; an empty table gives no pieces; null and
repeated document ids are documents like any other. A sequence's pieces lie one after another from offset 0.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import stored, strings
from driftwise.llm.tokens import encoder

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, node long, "
         "left boolean")


def _packer(tokenizer_path: str, end_id: int, size: int, open_windows: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        node = TaskContext.get().partitionId()
        made = node << 32                            # numbers of this task's windows
        rooms: list[tuple[int, int]] = []            # (room, window), ascending
        inside: dict[int, list[tuple]] = {}          # pieces of the open windows

        def table(pieces: list[tuple], left: bool) -> pa.RecordBatch:
            cols = list(zip(*pieces, strict=True)) if pieces else [[]] * 7
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset")
            return pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64()) for n, c in zip(names, cols, strict=True)}
                                              | {"node": pa.array([node] * len(pieces), pa.int64()),
                                                 "left": pa.array([left] * len(pieces), pa.bool_())})

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                doc_ids, texts = batch.column(0).slice(at, 256).to_pylist(), strings(batch.column(1).slice(at, 256))
                out: list[tuple] = []
                for doc, ids in zip(doc_ids, encoder(tokenizer_path).encode(texts), strict=True):
                    ids += end
                    total = len(ids) // 4
                    full = total // size * size
                    for start in range(0, full, size):
                        out.append((doc, start, size, zlib.crc32(ids[4 * start:4 * (start + size)]), total, made, 0))
                        made += 1
                    rest = total - full
                    if not rest:
                        continue
                    i = bisect_left(rooms, (rest, -1))
                    if i < len(rooms):
                        room, window = rooms.pop(i)
                    else:
                        if len(rooms) >= open_windows:
                            out.extend(inside.pop(rooms.pop(0)[1]))
                        room, window, made = size, made, made + 1
                        inside[window] = []
                    inside[window].append((doc, full, rest, zlib.crc32(ids[4 * full:]), total, window, size - room))
                    if room > rest:
                        insort(rooms, (room - rest, window))
                    else:
                        out.extend(inside.pop(window))
                yield table(out, False)
        yield table([p for pieces in inside.values() for p in pieces], True)
    return run


def _merge(size: int, keep: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        node = int(frame["node"].iloc[0])
        rooms: list[tuple[int, int]] = []
        rows = []
        for w in frame.sort_values(["used", "window"], ascending=[False, True]).itertuples(index=False):
            i = bisect_left(rooms, (w.used, -1))
            room, target = rooms.pop(i) if i < len(rooms) else (size, w.window)
            rows.append((w.window, target, size - room))
            insort(rooms, (room - w.used, target))
        going_on = {t for _, t in rooms[len(rooms) - keep:]} if len(rooms) > keep else {t for _, t in rooms}
        used = {t: size - room for room, t in rooms}
        return pd.DataFrame([(w, t, shift, used[t], node, t in going_on) for w, t, shift in rows],
                            columns=["window", "target", "shift", "used", "node", "open"])
    return run


def pack(df: DataFrame, tokenizer_path: str, end_id: int = 0, size: int = 1024, open_windows: int = 128,
         fan_in: int = 64) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all rows of (doc_id, text)."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    pieces = stored(docs.mapInArrow(_packer(tokenizer_path, end_id, size, open_windows), PIECE), "packing")
    left = pieces.where("left").groupBy("window").agg(F.sum("length").alias("used"), F.max("node").alias("node"))
    width = (left.agg(F.max("node")).first()[0] or 0) + 1
    schema = "window long, target long, shift long, used long, node long, open boolean"
    moves = left.select("window", F.col("window").alias("target"), F.lit(0).cast("long").alias("shift"))
    while True:
        width = -(-width // fan_in)
        level = left.withColumn("node", F.floor(F.col("node") / fan_in).cast("long"))
        level = stored(level.groupBy("node").applyInPandas(_merge(size, open_windows), schema), "packing-level")
        step = level.select(F.col("window").alias("_from"), F.col("target").alias("_to"), F.col("shift").alias("_by"))
        moves = (moves.join(step, F.col("target") == F.col("_from"), "left")
                 .select("window", F.coalesce("_to", "target").alias("target"),
                         (F.col("shift") + F.coalesce("_by", F.lit(0))).alias("shift")))
        if width <= 1:
            break
        left = level.where("open").select(F.col("target").alias("window"), "used", "node").distinct()
    return (pieces.join(moves, "window", "left")
            .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.coalesce("target", "window").alias("sequence_id"),
                    (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset")))

"""Benchmark decontamination by templates, to catch re-parameterised questions as well as literal ones.

A text becomes a sequence of template words: numbers, units after a number and names (capitalised words inside a
sentence) turn into typed placeholders, every other word into its lower-case form without outer punctuation. Each
window of ``window`` template words has a 64-bit hash; items shorter than that have one window of their whole
length. A second family of windows leaves names as words, so that passages whose case was changed still match; in a
third one a capitalised word at a sentence start is a name too, so that a renamed person may open the sentences. The
last family is exact: numbers, units and names are words there, so that items made mostly of numbers have windows.

Windows of documents and items meet in a hash join. Documents only send windows whose hash some item has: the tasks
test against the items' hashes, broadcast while there are at most ``broadcast_windows`` of them; beyond that all
windows go to a shuffle join. A match of windows is evidence if all its slots have the same values, or if its slots are
consistent: on the diagonal of a document and an item (equal distance of positions), each of the item's slot values in
the window must have one value of the document. A window with an item value that has several is dropped, the others
stay. A document leaks an item when such windows cover at least ``coverage`` of the item's windows, or when ``quote``
words in a row are covered on one diagonal, whatever the item's length.

Defined results: null or empty texts leak nothing; windows with fewer than half literal words are no evidence, except in
the exact family; items of fewer than ``least`` words are found only as their whole exact word sequence, wherever it
stands; rows with one key count as one document, and a null key is a key. Repeated benchmark rows with one item_id count once; null item_ids are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import stored, strings

#: Unit words that follow a number. Fixed values.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t oz lb lbs ml l s sec min h hr hrs hours days weeks months years % "
                  "usd eur gbp dollars euros cents pounds meters metres miles kilometers kilometres degrees percent".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
NUMBER_UNIT = re.compile(r"([+-]?[$€£]?\d[\d.,:/]*)([a-zµ%°]{1,3})")
DIGIT = re.compile(r"\d")
WORD, NUM, UNIT, NAME, OPENING = 0, 1, 2, 3, 4       # OPENING: a capitalised word at a sentence start
EXACT = 3                                    # place of the exact family
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MARKS = np.array([0, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93], dtype="u8")


def _mix(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode())


def _apart(raw: str) -> tuple[str, ...]:
    """``5km`` as a number and its unit, any other word whole."""
    m = NUMBER_UNIT.match(raw.lower()) if raw[:1] in "+-$€£0123456789" else None
    whole = m and (m[2] in UNITS) and not raw[m.end():].strip(".,;:!?\"')]}")
    return (m[1], m[2] + raw[m.end():]) if whole else (raw,)


class Templates:
    """Words seen so far with their hash, kind and whether they end a sentence; emptied when there are ``most``."""

    def __init__(self, most: int = 300_000):
        self.most, self.codes, self.words = most, {}, []
        self.hashes, self.kinds, self.ends = np.zeros(1024, "u8"), np.zeros(1024, "i1"), np.zeros(1024, "?")

    def _add(self, raw: str) -> None:
        plain = raw.strip(".,;:!?\"'()[]{}<>|*#&-_=…“”‘’«»¿¡")
        word, at = plain.lower(), len(self.words)
        kind = NUM if NUMBER.fullmatch(word) else UNIT if word in UNITS else NAME if plain[:1].isupper() and not plain.isupper() else WORD
        if at == len(self.hashes):
            self.hashes, self.kinds, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.hashes, self.kinds, self.ends))
        self.hashes[at], self.kinds[at] = _mix(word), kind if word else -1
        self.ends[at] = raw[-1:] in ".!?:" or raw[-2:] in ('."', ".)", '!"', '?"')
        self.words.append(word)
        self.codes[raw] = at

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: hash of its text, kind, code."""
        parts = text.split()
        if DIGIT.search(text):
            parts = [p for raw in parts for p in _apart(raw)]
        try:
            codes = list(map(self.codes.__getitem__, parts))
        except KeyError:
            if len(self.words) > self.most:
                self.codes.clear()
                self.words.clear()
            for p in parts:
                if p not in self.codes:
                    self._add(p)
            codes = list(map(self.codes.__getitem__, parts))
        codes = np.array(codes, "i8")
        if not len(codes):
            return np.zeros(0, "u8"), np.zeros(0, "i1"), codes
        starts = np.concatenate([[True], self.ends[codes[:-1]]])
        kind = self.kinds[codes]
        real = kind >= 0                         # punctuation between words is no word
        kind[(kind == NAME) & starts] = OPENING
        codes, kind = codes[real], kind[real]
        after_number = np.concatenate([[False], kind[:-1] == NUM])[:len(kind)]
        kind[(kind == UNIT) & ~after_number] = WORD
        return self.hashes[codes], kind, codes


def _windows(hashes: np.ndarray, kind: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` template words, put together from runs of 1, 2, 4 ... words."""
    n = len(hashes) - size + 1
    if n < 1:
        return np.zeros(0, "u8")
    words = np.where(kind == WORD, hashes, _MARKS[kind])
    run = (words ^ (words >> np.uint64(29))) * _ODD
    out, at, span = np.full(n, np.uint64(size)), 0, 1
    while span <= size:
        if size & span:
            out = _joined(out, run[at:at + n])
            at += span
        span *= 2
        if span <= size:
            run = _joined(run[:-(span // 2)], run[span // 2:])
    return out


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a * _ODD + b
    return out ^ (out >> np.uint64(32))


def _families(kind: np.ndarray) -> list[np.ndarray]:
    """Kinds with names inside a sentence as placeholders, with names as words, with all names as placeholders, and with
    words only."""
    return [np.where(kind == OPENING, WORD, kind), np.where(kind >= NAME, WORD, kind), np.where(kind == OPENING, NAME, kind),
            np.zeros_like(kind)]


def _slots(t: Templates, kind: np.ndarray, codes: np.ndarray, at: int, size: int) -> list[str]:
    return [t.words[c] for c, k in zip(codes[at:at + size].tolist(), kind[at:at + size].tolist(), strict=True) if k != WORD]


def _item_windows(window: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        for batch in batches:
            out = []
            for item, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                hashes, kind, codes = t.of(text)
                size = min(window, len(hashes))
                if not size:
                    continue
                for family, own in enumerate(_families(kind)):
                    if size < least and family != EXACT:
                        continue
                    w = _windows(hashes, own, size)
                    literal = np.convolve(own == WORD, np.ones(size, "i8"), "valid")
                    good = np.flatnonzero(2 * literal >= size)
                    out += [(item, int(a), size, len(good), family, int(w[a].astype("i8")), _slots(t, own, codes, int(a), size))
                            for a in good]
            names = ("item_id", "item_at", "size", "n_windows", "family", "hash", "item_slots")
            cols = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})
    return run


def _document_windows(sizes: list[int], least: int, held):
    """Windows of documents, only those some item has if the items' hashes are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Templates()
        bits = None
        if held is not None:
            wanted = np.frombuffer(held.value, "<i8").astype("u8")        # sorted as unsigned below
            wanted.sort()
            bits = np.zeros(1 << 22, "?")
            bits[(wanted >> np.uint64(42)).astype("i8")] = True
        for batch in batches:
            rows, at, families, found, slots = [], [], [], [], []
            for row, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                hashes, kind, codes = t.of(text)
                seen: list[tuple[np.ndarray, dict[int, np.ndarray]]] = []
                for family, own in enumerate(_families(kind)):
                    windows = next((w for other, w in seen if np.array_equal(own, other)), None)
                    if windows is None:
                        windows = {size: _windows(hashes, own, size) for size in sizes if size >= least}
                        seen.append((own, windows))
                    short = {size: _windows(hashes, own, size) for size in sizes if size < least} if family == EXACT else {}
                    for size, w in (windows | short).items():
                        if bits is None:
                            hits = np.arange(len(w))
                        else:
                            hits = np.flatnonzero(bits[(w >> np.uint64(42)).astype("i8")])
                            if len(hits):
                                near = np.minimum(np.searchsorted(wanted, w[hits]), len(wanted) - 1)
                                hits = hits[wanted[near] == w[hits]]
                        if size == 1 and len(hashes) > 1:    # a single word is no evidence but as the whole document
                            hits = hits[:0]
                        if size < least:                     # one place of a short item is enough
                            hits = hits[np.unique(w[hits], return_index=True)[1]]
                        rows += [row] * len(hits)
                        at += hits.tolist()
                        families += [family] * len(hits)
                        found += w[hits].astype("i8").tolist()
                        slots += [_slots(t, own, codes, a, size) for a in hits.tolist()]
                if len(rows) > 50_000:
                    yield _batch(rows, at, families, found, slots)
                    rows, at, families, found, slots = [], [], [], [], []
            yield _batch(rows, at, families, found, slots)

    def _batch(rows, at, families, found, slots) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "key": pa.array(rows, pa.string()), "at": pa.array(at, pa.int64()), "family": pa.array(families, pa.int32()),
            "hash": pa.array(found, pa.int64()), "slots": pa.array(slots, pa.list_(pa.string()))})
    return run


def leaks(docs: DataFrame, key: str, benchmark: DataFrame, text: str = "text", window: int = 8, least: int = 5, coverage: float = 0.5,
          broadcast_windows: int = 2_000_000, quote: int = 13, broadcast_rows: int = 100_000) -> DataFrame:
    """(key as string, item_id, n_windows, n_matched, coverage) of every leaked item of every document of ``docs``."""
    spark = docs.sparkSession
    # Every text of an item is searched, also of items without an id: a text and its item are one key.
    items = benchmark.select(F.col("item_id").cast("long").alias("item"), F.col("text")).distinct()
    items = items.withColumn("item_id", F.xxhash64("item", F.md5(F.coalesce("text", F.lit("")))))
    asked = stored(items.select("item_id", "text").mapInArrow(_item_windows(window, least), "item_id long, item_at long, size int, n_windows long, "
                   "family int, hash long, item_slots array<string>"), "item-windows")
    sizes = [r["size"] for r in asked.select("size").distinct().collect()]       # at most `window` values
    hashes = asked.select("hash").distinct()
    small = hashes.count() <= broadcast_windows
    held = spark.sparkContext.broadcast(np.array([r["hash"] for r in hashes.collect()], "<i8").tobytes()) if small else None
    found = (docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
             .mapInArrow(_document_windows(sorted(sizes), least, held), "key string, at long, family int, hash long, slots array<string>"))
    met = found.join(F.broadcast(asked) if asked.count() <= min(broadcast_rows, broadcast_windows) else asked, ["hash", "family"])
    met = met.withColumn("diagonal", F.col("at") - F.col("item_at"))
    # One diagonal of a document and an item has each item position once: bounded by the item's length.
    line = met.groupBy("key", "item_id", "family", "diagonal").agg(
        F.max("n_windows").alias("n_windows"), F.max("size").alias("size"),
        F.collect_set(F.struct("item_at", F.arrays_zip("item_slots", "slots").alias("pairs"))).alias("windows"))
    asked_for = F.transform(F.array_distinct(F.flatten(F.col("windows.pairs"))), lambda p: p["item_slots"])
    line = line.withColumn("split", F.filter(asked_for, lambda x, i: F.array_position(asked_for, x) <= i))      # values seen before
    kept = F.filter("windows", lambda w: ~F.exists(w["pairs"], lambda p: p["item_slots"] != p["slots"])
                    | ~F.exists(w["pairs"], lambda p: F.array_contains(F.col("split"), p["item_slots"])))
    consistent = line.withColumn("positions", F.array_sort(F.transform(kept, lambda w: w["item_at"])))
    n, many = F.size("positions"), F.greatest(F.lit(quote + 1) - F.col("size"), F.lit(1))       # windows in `quote` words
    in_a_row = F.exists(F.sequence(many, n), lambda i: F.get("positions", i - 1) - F.get("positions", i - many) == many - 1)
    consistent = consistent.withColumn("quoted", F.when(n >= many, in_a_row).otherwise(False))
    whole = (consistent.select("key", "item_id", "family", "n_windows", "quoted", F.explode("positions").alias("position"))
             .groupBy("key", "item_id", "family", "position").agg(F.max("n_windows").alias("n_windows"), F.max("quoted").alias("quoted"))
             .groupBy("key", "item_id", "family")
             .agg(F.max("n_windows").alias("n_windows"), F.count("*").alias("n_matched"), F.max("quoted").alias("quoted")))
    best = whole.groupBy("key", "item_id").agg(
        F.max(F.struct((F.col("n_matched") / F.col("n_windows")).alias("coverage"), "n_matched", "n_windows")).alias("b"),
        F.max("quoted").alias("quoted"))
    leaked = best.where((F.col("b.coverage") >= coverage) | F.col("quoted"))
    # The best of an item's texts speaks for it.
    named = leaked.join(items.select("item_id", "item"), "item_id").groupBy("key", "item").agg(F.max("b").alias("b"))
    return named.select("key", F.col("item").alias("item_id"), "b.n_windows", "b.n_matched", "b.coverage")

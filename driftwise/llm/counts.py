"""Token counts without token ids: pieces are counted once per distinct pre-token.

A pre-token here is what lies between two safe cuts (see ``tokens``): the ids of a text are those of its
pre-tokens, so its token count is the sum of their counts. One that is a word and a tail (``tokens.WORD``) counts as
these two, the tail like the start of a text: few distinct words and tails make many combinations.

1. Every task counts its pre-tokens (flushed at ``task_entries`` distinct ones); one aggregation gives the corpus
   frequency of each, and the tokenizer gives its number of pieces, once.
2. Per document, the pre-token frequencies are joined to these numbers and summed. The frequent pre-tokens (at most
   ``heavy`` of them, so their table has a fixed bound) are joined in the task from a broadcast; all others
   by a shuffle join on the pre-token. The split is by corpus frequency, so no key of the shuffle is hot; both
   ways are exact.

Special-token strings are one token each, as the library has them by default.

Defined results: a null text has 0 bytes and 0 tokens; null and repeated ids are rows like any other; an empty
table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import stored, strings
from driftwise.llm.tokens import LONGEST, WORD, encoder, pieces

MOST_JOINED = 200_000       # entries of a task's table of joined pieces
COUNTED = pa.schema([("lead", pa.bool_()), ("piece", pa.string()), ("n", pa.int64())])
LIGHT = pa.list_(pa.struct([("lead", pa.bool_()), ("piece", pa.string()), ("f", pa.int64())]))


def _pre_tokens(path: str, text: str) -> tuple[list[str], list[str], int]:
    """First pre-tokens of the segments, those with a space before them (left out), and the special tokens."""
    cut = encoder(path).cut
    if not (cut and cut.search(text)):
        parts = pieces(text)
        return parts[:1] if parts[0] else [], parts[1:], 0
    first, rest = [], []
    segments = cut.split(text)
    for seg in segments[::2]:
        parts = pieces(seg)
        first += parts[:1] if parts[0] else []
        rest += parts[1:]
    return first, rest, len(segments) // 2


def _vocabulary(path: str, task_entries: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts: Counter[str] = Counter()
        rests: Counter[str] = Counter()

        def flush() -> Iterator[pa.RecordBatch]:
            for piece, n in list(rests.items()):
                if m := WORD.fullmatch(piece):
                    del rests[piece]
                    rests[m[1]] += n
                    firsts[m[2]] += n
            for lead, counter in ((True, firsts), (False, rests)):
                keys, ns = list(counter.keys()), list(counter.values())
                for at in range(0, len(keys), 20_000):
                    part = keys[at:at + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array([lead] * len(part)), pa.array(part, pa.string()),
                                                      pa.array(ns[at:at + 20_000], pa.int64())], schema=COUNTED)
                counter.clear()

        for batch in batches:
            for text in strings(batch.column(0)):
                first, rest, _ = _pre_tokens(path, text)
                firsts.update(first)
                rests.update(rest)
                if len(firsts) + len(rests) >= task_entries:
                    yield from flush()
        yield from flush()
    return run


def _counted(path: str):
    """Number of pieces of each distinct pre-token."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = encoder(path)
        for batch in batches:
            leads, words = batch.column("lead").to_pylist(), batch.column("piece").to_pylist()
            short = [w for w, lead in zip(words, leads, strict=True)
                     if not lead and 0 < len(w) <= LONGEST and not w[0].isspace() and not w[-1].isspace()]
            known = library.learn([" " + w for w in short])
            n = [len(known[" " + w] if not lead and " " + w in known else library.plain(w if lead else " " + w)) // 4
                 for w, lead in zip(words, leads, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "tokens"])
    return run


def _documents(path: str, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, rests = heavy.value
        joined: dict[str, int] = {}         # tokens of pieces whose word and tail are both frequent

        def apart(piece: str, rare: Counter) -> int:
            """Tokens of a piece as far as they are known; what is not goes to ``rare``."""
            m = WORD.fullmatch(piece)
            parts = [(False, m[1]), (True, m[2])] if m else [(False, piece)]
            found = [(firsts if lead else rests).get(w) for lead, w in parts]
            if None in found:
                rare.update(p for p, n in zip(parts, found, strict=True) if n is None)
            elif len(piece) <= LONGEST and len(joined) < MOST_JOINED:
                joined[piece] = sum(found)
            return sum(n for n in found if n is not None)

        for batch in batches:
            n_bytes, known, light = [], [], []
            for text in strings(batch.column("text")):
                first, rest, total = _pre_tokens(path, text)
                rare: Counter[tuple[bool, str]] = Counter()
                for w in first:
                    n = firsts.get(w)
                    if n is None:
                        rare[True, w] += 1
                    total += n or 0
                found = list(map(rests.get, rest))
                if None in found:
                    missed = [w for w, n in zip(rest, found, strict=True) if n is None]
                    found = [n for n in found if n is not None]
                    found += [joined[w] if w in joined else apart(w, rare) for w in missed]
                total += sum(found)
                n_bytes.append(len(text.encode()))
                known.append(total)
                light.append([{"lead": k, "piece": w, "f": f} for (k, w), f in rare.items()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(known, pa.int64()),
                                              pa.array(light, LIGHT)], names=["doc_id", "n_bytes", "known", "light"])
    return run


def token_counts(df: DataFrame, tokenizer_path: str, limit: int = 1024, heavy: int = 400_000,
                 task_entries: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of (doc_id, text)."""
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    counted = docs.select("text").mapInArrow(_vocabulary(tokenizer_path, task_entries), "lead boolean, piece string, n long")
    vocabulary = stored(counted.groupBy("lead", "piece").agg(F.sum("n").alias("n"))
                        .mapInArrow(_counted(tokenizer_path), "lead boolean, piece string, n long, tokens long"), "pre-tokens")
    # The least frequency from which at most `heavy` pre-tokens remain, to a power of two.
    sizes = {r["b"]: r["c"] for r in vocabulary.where(F.length("piece") <= LONGEST)
             .groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count("*").alias("c")).collect()}
    least, room = 64, heavy
    while least > 0 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    is_heavy = (F.length("piece") <= LONGEST) & (F.floor(F.log2("n")).cast("int") >= least)
    tables: tuple[dict, dict] = ({}, {})
    for r in vocabulary.where(is_heavy).select("lead", "piece", "tokens").toLocalIterator():
        tables[0 if r["lead"] else 1][r["piece"]] = r["tokens"]
    known = spark.sparkContext.broadcast(tables)
    per_doc = docs.mapInArrow(_documents(tokenizer_path, known),
                              "doc_id long, n_bytes long, known long, light array<struct<lead:boolean,piece:string,f:bigint>>")
    per_doc = stored(per_doc.withColumn("row", F.monotonically_increasing_id()), "pre-token-frequencies")
    light = per_doc.select("row", F.inline("light"))
    rare = vocabulary.where(~is_heavy).select("lead", "piece", "tokens")
    sums = (light.join(rare, ["lead", "piece"]).groupBy("row").agg(F.sum(F.col("f") * F.col("tokens")).alias("more")))
    total = (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")
    return (per_doc.select("row", "doc_id", "n_bytes", "known").join(sums, "row", "left")
            .select("doc_id", "n_bytes", total).withColumn("over_limit", F.col("n_tokens") > limit))

"""Personal data: fixed base patterns, and identifiers found by bootstrapped contextual extraction.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. Their matches are the first seeds of the
method: every token with a digit or an at sign is a candidate instance (groups of digits that follow it after single
spaces belong to it), the words around it are its patterns (the two words before it; the word before and the word after).
Patterns and instances form a graph that is scored in rounds: a pattern's confidence is the mean score of its distinct
instances, an instance that is no seed scores ``1 - prod(1 - confidence)`` over its patterns. Patterns above ``confidence``
with enough distinct instances and seeds extract the instances the base patterns missed, if they look like an identifier
(at least ``digits`` digits, or an at sign). What is extracted in one round is a seed of the next, so identifiers known from
one context induce further contexts; the patterns of the last round give the spans of kind ``id``.

Only DataFrame functions. A match's position is the length of the text's pieces and matches before it, so
positions are code points. The patterns start at the first character of a run (or where the last match ended) and
give nothing back, which finds the same matches as the plain patterns in time linear in the text.

The graph is a table of distinct (pattern, instance) edges; all its steps are aggregations and joins on a key, with
partial sums before the shuffle. Spans found by the method are keyed by the text's digest, so copies share them.

Defined results: a null text is an empty one, without spans; null and repeated ids are rows like any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import carried, stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: A token with a digit or an at sign, and the groups of digits behind it while each token ends in a digit or a bracket.
CANDIDATE = r"(?:\G|(?<!\S))[^\s0-9@]*+[0-9@]\S*+(?:(?<=[0-9)])\x20\(?[0-9][0-9()-]*+[\"')\]>},;:.!?]*+(?!\S))*+"
SPAN = "array<struct<start:int,end:int>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"\A{_PART}(?:\.{_PART}){{3}}\z")
    if kind == "card":
        return F.length(_digits(match)).between(16, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str) -> Column:
    """All matches as array<struct<start, end, text, before>>; ``before`` is the piece of text since the last match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("before"), found.alias("text"))
    first = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,text:string,before:string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.coalesce(F.length(x["text"]), F.lit(0))
        span = F.struct(start.alias("start"), end.alias("end"), x["text"].alias("text"), x["before"].alias("before"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    # the last element has no match; it carries the rest of the text as `before`
    return F.when(F.size(found) > 0, F.aggregate(both, first, step)["out"]).otherwise(first["out"])


def base_spans(text: Column, kind: str) -> Column:
    ok = F.filter(located(text, PATTERNS[kind]), lambda s: s["text"].isNotNull() & _valid(kind, s["text"]))
    return F.transform(ok, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def candidates(text: Column) -> Column:
    """Candidate instances with trimmed bounds, value and the words around: array<struct<start, end, value, l1, l2, r1>>."""
    hits = located(text, CANDIDATE)
    word = lambda c: F.lower(F.regexp_replace(c, r"^[\p{Punct}&&[^=:#]]+|[\p{Punct}&&[^=:#]]+$", ""))
    last = lambda c: F.regexp_extract(c, r"(\S+)\s*\z", 1)

    def one(s: Column, i: Column) -> Column:
        lead = F.length(F.regexp_extract(s["text"], r"\A[\"'(\[<{=:,;]*", 0))
        tail = F.length(F.regexp_extract(s["text"], r"[\"')\]>},;:.!?]*\z", 0))
        end = F.greatest(s["end"] - tail, s["start"] + lead)
        near = F.substring(s["before"], -200, 200)       # two words of the gap; a longer word is no pattern
        l1 = last(near)
        l2 = last(F.regexp_replace(near, r"\S+\s*\z", ""))
        after = F.substring(F.try_element_at(hits, i + 2)["before"], 1, 200)
        value = F.translate(F.lower(F.substring(s["text"], lead + 1, end - s["start"] - lead)), " ", "")     # grouped or not, one value
        return F.struct((s["start"] + lead).alias("start"), end.alias("end"), value.alias("value"), word(l1).alias("l1"),
                        word(l2).alias("l2"), word(F.regexp_extract(after, r"\A\s*(\S+)", 1)).alias("r1"))

    return F.filter(F.transform(hits, one), lambda s: (s["end"] > s["start"]) & s["value"].isNotNull())


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` (without the text) with the text's digest, its base spans per kind and its candidates."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    found = docs.withColumn("text_key", F.md5(t)).withColumns({k: base_spans(t, k) for k in KINDS})
    return found.withColumn("candidates", candidates(t)).drop(text)


def _edges(scanned: DataFrame) -> DataFrame:
    """Candidates of distinct texts: text_key, start, end, value, seed and the pattern, one row per pattern."""
    known = F.concat(*[F.col(k) for k in KINDS])
    rows = scanned.where(F.size("candidates") > 0).select("text_key", known.alias("known"), F.explode("candidates").alias("c"))
    seed = F.exists("known", lambda k: (k["start"] < F.col("c.end")) & (k["end"] > F.col("c.start")))
    rows = rows.select("text_key", "c.*", seed.alias("seed"))
    both = F.array(F.when((F.col("l1") != "") & (F.col("l2") != ""), F.concat_ws(" ", F.lit("L"), "l2", "l1")),
                   F.when((F.col("l1") != "") & (F.col("r1") != ""), F.concat_ws(" ", F.lit("B"), "l1", "r1")))
    return (rows.select("text_key", "start", "end", "value", "seed", F.explode(F.array_compact(both)).alias("pattern"))
            .distinct())


def _shaped(value: Column, digits: int) -> Column:
    """Whether a value looks like an identifier."""
    return (F.length(_digits(value)) >= digits) | value.contains("@")


def confident_patterns(edges: DataFrame, rounds: int = 3, confidence: float = 0.9, instances: int = 5, seeds: int = 3, digits: int = 6) -> DataFrame:
    """Patterns above ``confidence`` after ``rounds`` of scoring the graph of distinct (pattern, instance) edges."""
    graph = stored(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed")), "pii-graph")
    value_seed = graph.groupBy("value").agg(F.max("seed").alias("seed"))
    scores = stored(value_seed.select("value", "seed", F.when(F.col("seed"), 1.0).otherwise(0.0).alias("score")), "pii-scores")
    for left in range(rounds, 0, -1):
        patterns = (graph.select("pattern", "value").join(scores, "value").groupBy("pattern")
                    .agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("int")).alias("n_seeds"), F.avg("score").alias("sure"))
                    .where((F.col("n") >= instances) & (F.col("n_seeds") >= seeds) & (F.col("sure") >= confidence / 2)))
        if left == 1:
            return patterns.where(F.col("sure") >= confidence).select("pattern", "sure")
        doubt = F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-6))))
        told = (graph.select("pattern", "value").join(patterns.select("pattern", "sure"), "pattern")
                .groupBy("value").agg((1 - F.exp(doubt)).alias("told"), F.max("sure").alias("best")))
        extracted = F.coalesce((F.col("best") >= confidence) & _shaped(F.col("value"), digits), F.lit(False))
        scores = stored(value_seed.join(told, "value", "left")
                        .select("value", (F.col("seed") | extracted).alias("seed"), F.when(F.col("seed"), 1.0).otherwise(F.coalesce("told", F.lit(0.0))).alias("score")),
                        "pii-scores")
    raise ValueError("rounds must be at least 1")


def discovered(scanned: DataFrame, rounds: int = 3, confidence: float = 0.9, instances: int = 5, seeds: int = 3, digits: int = 6) -> DataFrame:
    """text_key and ``id`` spans: what confident patterns extract beyond the seeds."""
    edges = _edges(scanned)
    sure = confident_patterns(edges, rounds, confidence, instances, seeds, digits)
    new = edges.where(~F.col("seed") & _shaped(F.col("value"), digits)).join(sure, "pattern", "left_semi").select("text_key", "start", "end").distinct()
    return new.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("id"))


def find(docs: DataFrame, text: str = "text", **method) -> DataFrame:
    """``docs`` (without the text) with spans per kind: the base kinds and ``id``. A column of ``docs`` that is called like
    one of these gives way to it; other names may be anything."""
    row, names = carried(docs, [text, *KINDS, "id"])
    scanned = stored(scan(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text")), "text"), "pii-scan")
    new = discovered(scanned, **method)
    return scanned.join(new, "text_key", "left").select(
        *[F.col("row")[n].alias(n) for n in names], *KINDS, F.coalesce("id", F.expr(f"cast(array() as {SPAN})")).alias("id"))


def listing(kinds: tuple[str, ...]) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    def said(kind: str) -> Column:
        return F.transform(F.col(kind), lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    return F.array_join(F.concat(*[said(k) for k in kinds]), ",")


def redact(docs: DataFrame, text: str = "text", **method) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; overlapping spans become one. Other columns stay,
    whatever their names."""
    row, names = carried(docs, [text])
    docs_columns, docs = docs.columns, docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    t = F.col("text")
    new = discovered(stored(scan(docs.select("text")), "pii-scan"), **method).withColumnsRenamed({"text_key": "_key", "id": "_id"})
    keyed = docs.withColumn("_md5", F.md5(F.coalesce(t, F.lit(""))))
    joined = keyed.join(new, F.col("_md5") == F.col("_key"), "left")
    tag = lambda spans, k: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
    every = F.concat(*[tag(base_spans(F.coalesce(t, F.lit("")), k), k) for k in KINDS],
                     tag(F.coalesce(F.col("_id"), F.expr(f"cast(array() as {SPAN})")), "id"))
    out = joined.withColumn("_spans", F.array_sort(every))

    def step(acc: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        said = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), label))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.coalesce(said, acc["out"]).alias("out"))

    done = F.aggregate("_spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    rest = F.concat(done["out"], F.substring(t, done["at"] + 1, F.length(t)))
    new_text = F.when(F.size("_spans") > 0, rest).otherwise(t)
    return out.select(*[(F.col("row")[c] if c in names else new_text).alias(c) for c in docs_columns])

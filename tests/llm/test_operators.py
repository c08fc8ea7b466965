"""Each operator against its plain version: on the smallest tables and on one table of odd cases."""

import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwise.llm import counts, dac, decontaminate, fm, jaccard, packing, pii, queries, sharding, topk, urlfilter
from driftwise.session import scratch_path
from tests.conftest import SF_SMALL
from tests.llm import brute

TOKENS = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(brute.documents(), brute.DOCUMENTS).repartition(5)


@pytest.fixture(scope="module")
def small():
    return duckdb.sql(f"select doc_id, text from '{SF_SMALL}/documents.parquet' order by doc_id").fetchall()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENS)


def none_of(df):
    return df.where("1 = 0")


# -- 1 -----------------------------------------------------------------------------------------------------------------
URLS = [None, "", "no scheme", "http://", "https://WWW.Spam.com/a/?b=2&a=1#x", "http://spam.com/a?a=1&utm_source=z&b=2&ref=q", "http://spam.com/a/b",
        "http://x.example.org/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://example.org", "http://badexample.org/es/", "HTTP://A.COM/fr/",
        "http://a.com/fr", "http://a.com/de/x", "http://ÄB.com/de/x", "http://a.com?x=/fr/", "a://b://c.com/fr/", "http://net/x", "http://other.net/p//", "http://a.b\nc.net/q"]


@pytest.mark.parametrize("blocks", [1 << 18, 0])
def test_url_filter(spark, blocks):
    rows = [(i, u, "x") for i, u in enumerate(URLS + URLS[4:8])]
    pages = spark.createDataFrame(rows, "page_id long, url string, block string").drop("block")
    listed = spark.createDataFrame([("spam.com/a?a=1&b=2",), (None,), ("spam.com/a?a=1&b=2",), ("other.net/p",)], "u string")
    got = {tuple(r) for r in urlfilter.judge(pages, "url", listed, brute.RULES, broadcast_blocks=blocks).select("page_id", "host", "path", "rule", "verdict").collect()}
    want = {(i, *brute.judged(u, {"spam.com/a?a=1&b=2", "other.net/p"})) for i, u, _ in rows}
    assert got == want
    assert urlfilter.judge(none_of(pages), "url", none_of(listed), brute.RULES).count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    listed = spark.range(3000).select(F.concat(F.lit("u"), "id").alias("url"))
    n = 3000 * 12 // 512 + 1
    bloom = urlfilter.blocked_bloom(listed, n)
    asked = spark.range(6000).select(F.col("id"), F.concat(F.lit("u"), "id").alias("url"))
    block, bits = urlfilter._places(F.col("url"), n)
    hit = asked.withColumn("block", block).withColumn("bits", bits).join(bloom, "block", "left").where(urlfilter._hit(F.col("words"), F.col("bits")))
    ids = {r["id"] for r in hit.select("id").collect()}
    assert set(range(3000)) <= ids
    assert len(ids) < 3000 + 150


# -- 2 -----------------------------------------------------------------------------------------------------------------
ITEM = "Every morning Tom buys 12 apples at the market for 3 usd and gives Tom 's sister exactly 4 of the 12 apples before noon."


def test_decontamination(spark):
    changed = ITEM.replace("Tom", "Anna").replace("12", "31").replace(" 4 ", " 9 ")
    wrong = ITEM.replace("buys 12", "buys 31").replace("the 12", "the 45")       # 12 is both 31 and 45: the slots disagree
    docs = [(0, "Well. " + ITEM + " And so on."), (1, changed), (2, ITEM.upper()), (3, "Nothing of the kind is in this text at all, only words of its own."), (4, None),
            (5, ""), (6, "1 2 3 4 5 6 7 8 9 10 11 12"), (7, "and so on " * 3000 + ITEM), (None, ITEM), (8, wrong), (9, "five short words in here")]
    rows = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id long, text string, item_id string").repartition(3)
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (None, ITEM), (4, "1 2 3 4 5 6 7 8 9"), (5, "five short words in here"), (6, "too short")],
                                  "item_id long, text string")
    for limit in (2_000_000, 0):
        got = {(r["key"], r["item_id"]) for r in decontaminate.leaks(rows, "doc_id", bench, broadcast_windows=limit).collect()}
        # Document 6 holds item 4 word for word. Document 8 has one slot changed against itself, but half of its windows are
        # the item's own words, which is evidence whatever the rest. The item without an id has the text of item 1.
        copies = {(key, item) for key in ("0", "1", "2", "7", None, "8") for item in (1, None)}
        assert got == copies | {("6", 4), ("9", 5)}
    assert decontaminate.leaks(none_of(rows), "doc_id", bench).count() == 0
    assert decontaminate.leaks(rows, "doc_id", none_of(bench)).count() == 0


def leaked(spark, docs, items):
    """(document, item) of every leak, by both joins; documents and items are numbered."""
    found = [{(int(r["key"]), r["item_id"]) for r in decontaminate.leaks(
        spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), "doc_id",
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), broadcast_windows=limit).collect()} for limit in (2_000_000, 0)]
    assert found[0] == found[1]
    return found[0]


def test_decontamination_finds_renamed_persons_that_open_sentences(spark):
    item = "Natalia sold 48 clips to her friends. Natalia then sold half as many clips in May."
    docs = ["Maria sold 52 clips to her friends. Maria then sold half as many clips in June.",
            "So it goes on. Maria sold 52 clips to her friends. Maria then sold half as many clips in June. The end.",
            "Maria lost 52 coins on the way home. Maria then found half of the coins again in June."]
    assert leaked(spark, docs, [item]) == {(0, 0), (1, 0)}


LONG = ("Every spring the farmer drives 2 carts of hay to the old mill by the river and comes back home before dark with "
        "flour for all the bakers in town while the miller keeps some of it for the long winter and then gives 2 sacks to "
        "the poor people who wait at the gate of the church on the hill every sunday morning")


def test_decontamination_drops_only_windows_with_conflicting_slots(spark):
    swap = "The red box holds 3 green apples for the boys and the blue box holds 5 green pears for the girls of the school."
    docs = [LONG.replace("gives 2", "gives 7"), swap.replace("3", "4").replace("5", "4"),
            "Every spring the farmer drives 3 carts of hay and says that he gives 2 sacks to the king."]
    assert leaked(spark, docs, [LONG, swap]) == {(0, 0), (1, 1)}


def test_decontamination_finds_quotes_of_long_items(spark):
    words = LONG.split()
    docs = ["He wrote: " + " ".join(words[a:b]) + ", and more of that kind." for a, b in ((10, 35), (10, 23), (10, 22))]
    docs += ["He wrote " + " ".join(words[10:20]) + " and then he wrote " + " ".join(words[25:35]) + " and no more."]
    assert leaked(spark, docs, [LONG]) == {(0, 0), (1, 0)}


def test_decontamination_finds_items_of_numbers_and_short_items(spark):
    items = ["1 2 3 4 5 6 7 8 9", "3 4 5 km 6 7 8 km 9 10 Tom", "Too Short", "", "...", "Yes"]
    docs = ["1 2 3 4 5 6 7 8 9 10 11 12", "11 12 13 14 15 16 17 18 19", "It is 3 4 5 km 6 7 8 km 9 10 Tom at last.",
            "It is 4 4 5 km 6 7 9 km 9 10 Ann at most.", "This text is too short, far too short for it.", "too. long, Short", ""]
    assert leaked(spark, docs, items) == {(0, 0), (2, 1), (4, 2)}


def test_decontamination_finds_literal_passages(spark, small):
    """All documents that hold a whole benchmark item, and no others."""
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [(i, words(t)) for i, t in duckdb.sql(f"select item_id, text from '{SF_SMALL}/benchmark.parquet'").fetchall()]
    want = {(d, i) for d, t in small for i, w in items if f" {w} " in f" {words(t)} "}
    got = {(r["doc_id"], r["item_id"]) for r in queries.op2_decontamination(spark, SF_SMALL).collect()}
    assert want and got == want


def test_decontamination_reads_every_text_of_an_item_and_needs_more_than_a_word(spark):
    second = "A quiet river runs past the old brewery and turns the wheel of the mill all through the night."
    docs = [(0, "He said. " + ITEM), (1, "So: " + second), (2, "Yes, I went home."), (3, "yes!"), (4, second.replace("river", "brook"))]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, ITEM), (1, second), (None, second), (2, "Yes")], "item_id long, text string")
    for limit in (2_000_000, 0):
        got = {(r["key"], r["item_id"]) for r in decontaminate.leaks(rows, "doc_id", bench, broadcast_windows=limit).collect()}
        assert got == {("0", 1), ("1", 1), ("1", None), ("3", 2), ("4", 1), ("4", None)}


def test_word_hashes_have_64_bits():
    import numpy as np

    words = [f"w{i:05d}" for i in range(3000)]
    halves = {(h := decontaminate._mix(w)) >> 32 ^ h & 0xFFFFFFFF for w in words}
    assert len(halves) > 2990 and len(np.unique([decontaminate._mix(w) for w in words])) == 3000


# -- 3 -----------------------------------------------------------------------------------------------------------------
def test_top_k_small_table(spark):
    rows = duckdb.sql(f"select vec_id, embedding from '{SF_SMALL}/embeddings.parquet'").fetchall()
    got = {tuple(r) for r in queries.op3_exact_topk(spark, SF_SMALL).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute.top_k(rows, lambda i: i % 50 == 0, 5)


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_top_k_odd_vectors(spark, limit):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)]) for i in range(120)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [float("nan"), 0.0, 0.0]), (203, [float("inf"), 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (204, [1.0, 1.0]), (250, [1.0, 2.0]),
             (300, []), (350, []), (5, [1.0, 1.0, 1.0]), (5, [1.0, 1.0, 1.0]), (400, [3e30, 3e30, 1.0]), (401, [-3e30, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, dim int, shard int").repartition(7)
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, k=5, block_rows=2, shard_rows=9, fan_in=2, broadcast_bytes=limit)
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert {tuple(r) for r in got.collect()} == brute.top_k(f32, lambda i: i % 50 == 0, 5)
    assert topk.exact_top_k(none_of(df), F.col("vec_id") % 50 == 0).count() == 0


# -- 4, 7, 10 ------------------------------------------------------------------------------------------------------------
def ids_of(library, text, end=None):
    return library.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])


def test_codes_give_every_id():
    rng = np.random.default_rng(1)
    for ids in (np.array([], "u4"), np.array([0], "u4"), np.array([255, 256, 65_535, 65_536, 2 ** 32 - 1, 0], "u4"), rng.integers(0, 50_000, 5000).astype("u4")):
        codes = dac.Codes.of(ids)
        assert codes.read(0, len(ids)).tolist() == ids.tolist()
        for i in range(0, len(ids), 7):
            assert codes.at(i) == ids[i]
            assert codes.read(i, min(len(ids), i + 600)).tolist() == ids[i:i + 600].tolist()


def test_token_files(spark, odd, library, small):
    for df, rows in ((odd, [(r[0], r[1]) for r in brute.documents()]), (spark.read.parquet(f"{SF_SMALL}/documents.parquet"), small)):
        path = scratch_path(spark, "test-ids")
        dac.write(df, path, TOKENS, end_id=2, segment_ids=3000)
        got = sorted((tuple(r) for r in dac.documents(spark, path).collect()), key=lambda r: r[1])
        want = sorted((-1 if i is None else i, len(x), brute.crc(x)) for i, t in rows for x in [ids_of(library, t, 2)])
        assert sorted((-1 if i is None else i, n, c) for i, _, n, c in got) == want
        assert [-1 if r[0] is None else r[0] for r in got] == sorted(-1 if i is None else i for i, _ in rows)
        ends = [0]
        for _, start, n, _ in got:
            assert start == ends[-1]
            ends.append(start + n)
    path = scratch_path(spark, "test-ids")
    dac.write(none_of(odd), path, TOKENS, end_id=2)
    assert dac.documents(spark, path).count() == 0


@pytest.mark.parametrize("heavy", [400_000, 20, 0])
def test_token_counts(spark, odd, library, heavy):
    got = sorted(tuple(-1 if x is None else x for x in r) for r in counts.token_counts(odd, TOKENS, heavy=heavy, task_entries=50).collect())
    want = sorted((-1 if i is None else i, len((t or "").encode()), n, n > 1024) for i, t, *_ in brute.documents() for n in [len(ids_of(library, t))])
    assert got == want
    assert counts.token_counts(none_of(odd), TOKENS).count() == 0


def check_pieces(rows, pieces, library, size):
    windows, per_doc = {}, {}
    for doc, start, length, crc, total, window, offset in pieces:
        windows.setdefault(window, []).append((offset, length))
        per_doc.setdefault(-1 if doc is None else doc, []).append((start, length, crc, total))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= size
    want = {}
    for i, t in rows:
        want.setdefault(-1 if i is None else i, []).append(ids_of(library, t, 0))
    for doc, texts in want.items():
        cut = [(s, min(size, len(x) - s), brute.crc(x[s:s + size]), len(x)) for x in texts for s in range(0, len(x), size)]
        assert sorted(per_doc.pop(doc)) == sorted(cut)
    assert not per_doc
    return sum(n for parts in windows.values() for _, n in parts) / (size * len(windows))


def test_packing(spark, odd, library, small):
    rows = [(r[0], r[1]) for r in brute.documents()]
    for size, keep, fan in ((1024, 128, 64), (16, 2, 2)):
        got = [tuple(r) for r in packing.pack(odd, TOKENS, size=size, open_windows=keep, fan_in=fan).collect()]
        check_pieces(rows, got, library, size)
    got = [tuple(r) for r in packing.pack(spark.read.parquet(f"{SF_SMALL}/documents.parquet").repartition(6), TOKENS, open_windows=16, fan_in=2).collect()]
    assert check_pieces(small, got, library, 1024) > 0.93
    assert packing.pack(none_of(odd), TOKENS).count() == 0


# -- 5 -----------------------------------------------------------------------------------------------------------------
def test_base_spans(spark, odd, small):
    rng = random.Random(5)
    noise = [(100 + i, "".join(rng.choice("ab1.@ +-(9)é_%2\n") for _ in range(rng.randrange(80)))) for i in range(300)]
    more = spark.createDataFrame([(*r, "en", "s", 1, "k") for r in noise], brute.DOCUMENTS)
    whole = odd.unionByName(more).unionByName(spark.createDataFrame([(*r, "en", "s", 1, "k") for r in small], brute.DOCUMENTS))
    rows = [(r[0], r[1]) for r in brute.documents()] + noise + small
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], [[tuple(s) for s in r[k]] for k in pii.KINDS]) for r in pii.find(whole.select("doc_id", "text", "key")).collect())
    want = sorted((-1 if i is None else i, [brute.base_spans(t)[k] for k in pii.KINDS]) for i, t in rows)
    assert got == want
    query = {r["doc_id"]: r for r in queries.op5_personal_data(spark, SF_SMALL).collect()}
    for i, t in small:
        spans = brute.base_spans(t)
        assert query[i]["base_sha256"] == brute.base_digest(spans)
        assert [query[i][f"n_{k}"] for k in pii.KINDS] == [len(spans[k]) for k in pii.KINDS]
        assert set(query[i]["spans"].split(",")) >= {f"{k}:{a}:{b}" for k in pii.KINDS for a, b in spans[k]}


def test_contexts_find_identifiers_that_no_pattern_has(spark):
    seeds = [(i, f"Please write to account holder user{i}@mail.example.com before friday. Nothing else here.") for i in range(20)]
    hidden = [(100, "Please write to account holder ZX-778812-Q before friday."), (101, "A number 778812 of no account."), (102, None), (103, "")]
    docs = spark.createDataFrame([(i, t, 1, "v") for i, t in seeds + hidden * 2], "doc_id long, text string, n_chars long, value string").repartition(4)
    got = {(r["doc_id"], tuple(tuple(s) for s in r["id"])) for r in pii.find(docs.select("doc_id", "text")).collect()}
    want = {(i, ()) for i, _ in seeds} | {(100, ((31, 42),)), (101, ()), (102, ()), (103, ())}
    assert got == want
    text = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert text[100] == "Please write to account holder [ID] before friday."
    assert text[3] == "Please write to account holder [EMAIL] before friday. Nothing else here."
    assert text[102] is None and text[101] == hidden[1][1]
    assert pii.find(none_of(docs)).count() == 0 and pii.redact(none_of(docs)).count() == 0


def test_found_identifiers_lead_to_further_contexts(spark):
    mail = [f"The account holder user{i}@mail.example.com wrote." for i in range(60)]
    both = [f"The account holder ZX-77{i:04}-Q wrote." for i in range(4)] + [f"See customer ref ZX-77{i:04}-Q today." for i in range(4)]
    more = [f"See customer ref QQ 55{i} 12{i} today." for i in range(2)] + ["See customer ref (55 1234 9) today.", "Then came the year 2024 2025 2026 and went."]
    texts = mail + both * 3 + more
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {texts[r["doc_id"]]: [tuple(s) for s in r["id"]] for r in pii.find(docs).collect()}
    assert got == brute.identifiers(texts)
    assert [t[a:b] for t in more for a, b in got[t]] == ["55 1234 9"]         # a letter group between the words and the digits is another context
    assert all(got[t] for t in both) and not any(got[t] for t in mail)
    assert not any(s["id"] for s in pii.find(docs, rounds=1).collect() if "customer" in texts[s["doc_id"]])


def test_contexts_against_a_plain_graph(spark, small):
    rng, texts = random.Random(6), [t or "" for _, t in small]
    heads = ["call me at", "ref no.", "the id =", "see (page", "mr. x's"]
    for _ in range(400):
        kind = rng.choice(["a%d@b.example.org", "+1 (017) 55%04d", "K-%06d", "%04d 11 22", "12%d, 7", "%d) 44 5.", "[%d 3] 4"])
        texts.append(" ".join(f"{rng.choice(heads)} {kind % rng.randrange(60)}{rng.choice(['', '.', ' now', ', then', ' or 12 9'])}" for _ in range(rng.randrange(1, 4))))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    for method in ({}, {"confidence": 0.6, "instances": 2, "seeds": 1, "digits": 2}):
        got = {texts[r["doc_id"]]: [tuple(s) for s in r["id"]] for r in pii.find(docs, **method).collect()}
        want = brute.identifiers(texts, **{("least" if k == "seeds" else k): v for k, v in method.items()})
        assert {t: (got[t], want[t]) for t in got if got[t] != want[t]} == {}
    assert any(got.values())


# -- 6 -----------------------------------------------------------------------------------------------------------------
def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(2)
    m = fm.Machine(0.3, rng.normal(size=fm.SPACE), rng.normal(size=(fm.SPACE, 4)))
    at, x = np.array([3, 9, 40_00, 11]), np.array([0.5, 1.0, -2.0, 0.25])
    want = 0.3 + (m.w[at] * x).sum() + sum((m.v[at[i]] @ m.v[at[j]]) * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.margin(np.array([0]), at, x)[0][0] == pytest.approx(want)


def test_quality_on_held_out_labels(spark):
    sf = SF_SMALL.replace("0.001", "0.01")
    truth = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    rows = queries.op6_quality(spark, sf).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.97


def test_quality_of_odd_texts(spark, odd):
    labels = spark.createDataFrame([(0, 1), (1, None), (5, 0), (5, 0), (None, 1), (999, 1), (6, 7)], "doc_id long, y int")
    for own in (labels, none_of(labels)):
        scored = fm.score(odd, fm.train(odd.select("doc_id", "text", "n_chars"), own))
        got = [r["quality_score"] for r in scored.collect()]
        assert len(got) == len(brute.documents()) and all(0 <= s <= 1 for s in got) and scored.columns[:-1] == odd.columns
    assert set(got) == {0.5}
    assert fm.score(none_of(odd), fm.train(none_of(odd), labels)).count() == 0


# -- 8 -----------------------------------------------------------------------------------------------------------------
def test_sharding(spark, odd):
    even = {s: 1.0 for s in range(16)}
    df = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = sharding.assign(df.repartition(5), "doc_id", "text", even, even | {16: 1.0}, chunk_rows=7).collect()
    assert len(rows) == 1000 + len(brute.documents())
    for s in range(16):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
        assert 30 < len(slots) < 100
    assert all(r["grown_shard"] in (r["shard"], 16) for r in rows) and 20 < sum(r["grown_shard"] == 16 for r in rows) < 110
    texts = sorted((t or "", -1 if i is None else i) for i, t in [(r["doc_id"], r["text"]) for r in df.collect()])
    assert sorted((r["size"], r["text_crc32"]) for r in rows) == sorted((len(t.encode()) + 1, zlib.crc32(t.encode())) for t, _ in texts)
    by_key = {}
    for r in rows:
        assert by_key.setdefault(r["doc_id"], r["shard"]) == r["shard"]
    assert sharding.assign(none_of(df), "doc_id", "text", even).count() == 0


def test_weights_share_out_rows(spark):
    key = spark.range(20_000).select(sharding.rendezvous(F.col("id"), {0: 1.0, 1: 3.0, 2: 0.0}).alias("s"))
    n = {r["s"]: r["count"] for r in key.groupBy("s").count().collect()}
    assert set(n) == {0, 1} and 2.8 < n[1] / n[0] < 3.2


# -- 9 -----------------------------------------------------------------------------------------------------------------
def near_copies(seed: int) -> list[tuple[int, str]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = [rng.choice(words) for _ in range(30)]
    out, at = [], 1000
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([8, 30, 60, 120]))] + (shared if rng.random() < 0.5 else [])
        for _ in range(rng.randrange(1, 12)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            base = copy if rng.random() < 0.5 else base         # chains: links that hang together step by step
            out.append((at, " ".join(copy)))
            at += 1
    rng.shuffle(out)
    return out


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 500), (5, 80, 3), (2, 60, 2)])
def test_jaccard_components(spark, odd, n, percent, block):
    extra = near_copies(n)
    rows = [(i, t) for i, t, *_ in brute.documents(extra) if i is not None]
    df = spark.createDataFrame(brute.documents(extra), brute.DOCUMENTS).repartition(4)
    got = jaccard.near_duplicates(df, n=n, percent=percent, block=block, rows=50).collect()
    want = brute.components(rows, n, percent)
    assert len(got) == len(rows) + 1
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((i, len(brute.shingles(t, n))) for i, t in rows)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    assert jaccard.near_duplicates(none_of(df)).count() == 0


def test_jaccard_links_every_text_of_a_repeated_id(spark):
    words = [f"w{i}" for i in range(82)]
    rows = [(5, "a b c d e f"), (5, " ".join(words)), (9, " ".join(words[:-1])), (7, "A B c d e f"), (9, None), (11, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {tuple(r) for r in jaccard.near_duplicates(df, n=3, percent=90).collect()}
    assert got == {(5, 4, 5), (5, 80, 5), (9, 79, 5), (7, 4, 5), (9, 0, 9), (11, 0, 11)}


def test_tree_finds_what_pairs_find():
    rng = np.random.default_rng(4)
    for percent in (60, 80, 90):
        base = np.unique(rng.integers(0, 10 ** 6, 150).astype("u8"))
        sets = []
        for _ in range(60):
            own = base[rng.random(len(base)) < rng.choice([0.7, 0.9, 0.97, 1.0])]
            sets.append(np.unique(np.concatenate([own, rng.integers(0, 10 ** 6, rng.integers(0, 30)).astype("u8")])))
        got = sorted(jaccard.tree_overlaps(base, sets, percent))
        both = [len(np.intersect1d(base, s)) for s in sets]
        assert got == [i for i, s in enumerate(sets) if 100 * both[i] >= percent * (len(base) + len(s) - both[i])]


def test_components_of_long_chains(spark):
    links = spark.range(1, 300).select((F.col("id") * 7 % 300).alias("a"), ((F.col("id") - 1) * 7 % 300).alias("b"))
    got = {r["id"]: r["component"] for r in jaccard.components(spark, links).collect()}
    assert got == {i: 0 for i in range(300)}


def test_minhash_postings_carry_no_weight(spark, monkeypatch):
    from driftwise.llm import minhash

    kept, real = {}, minhash.stored
    monkeypatch.setattr(minhash, "stored", lambda df, name, *a: kept.setdefault(name, df.columns) and real(df, name, *a))
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[:-1])), (4, "some other text")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=85)
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (4, 4)]
    assert kept["minhash-posted"] == ["r", "weight", "prefix"] and kept["minhash-lists"] == ["list", "r", "k"]


def test_token_cache_of_a_worker_stays_small():
    from driftwise.llm import tokens

    assert tokens.MOST * 160 <= 100e6       # about 160 bytes a unit, kept between the stages of a pipeline by every worker


def test_minhash_signatures_travel_for_pairs_that_may_agree_only(spark, monkeypatch):
    from driftwise.llm import minhash
    from driftwise.llm.common import stored

    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, 2 ** 32, (300, 64), "u8").astype("<u4") for _ in range(2))
    a[:100, :40] = b[:100, :40]
    whole, low = (set(minhash.collisions(*m, 30)) for m in ((a, b), (minhash.short(a), minhash.short(b))))
    assert whole == set(range(100)) and whole <= low        # no pair is lost by the bytes

    # 30 sets with the same size; only 0 and 1 are alike
    words = [[f"w{i}x{j}" for j in range(60)] for i in range(30)]
    words[1] = ["other", *words[0][1:]]
    sets, by = minhash.Shingles(3), minhash.multipliers(64)
    elements = [sets.of(" ".join(w).encode()) for w in words]
    rows = [(i, len(e), bytearray(minhash.signature(e, by).tobytes()), bytearray(minhash._bitmap(e).tobytes())) for i, e in enumerate(elements)]
    reps = stored(spark.createDataFrame(rows, "r long, n long, signature binary, bitmap binary"), "test-reps")
    asked, real = [], minhash._Join.only
    monkeypatch.setattr(minhash._Join, "only", lambda self, ids: asked.append(sorted({r["r"] for r in ids.collect()})) or real(self, ids))
    pairs = spark.createDataFrame([(0, i) for i in range(1, 30)], "a long, b long")
    for limit in (1_000, 0):                                # named rows broadcast, or joined
        join = minhash._Join(None, reps, 3, 85, 64, minhash.threshold(64, 85, 1e-9), 256, limit)
        assert [tuple(r) for r in join.agreeing(pairs).collect()] == [(0, 1)]
        assert [tuple(r) for r in join.agreeing(pairs.where("b > 1")).collect()] == []
    assert asked == [[0, 1], []] * 2

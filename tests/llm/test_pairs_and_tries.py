"""Hard negatives, MinHash near duplicates and the conversation trie against their plain versions."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwise.llm import bond, minhash, trie
from tests.conftest import SF_SMALL
from tests.llm import brute


def none_of(df):
    return df.where("1 = 0")


# -- hard negatives ----------------------------------------------------------------------------------------------------
VECTORS = "vec_id long, embedding array<double>, label int, score long, block string"


def vectors(n: int, dim: int = 12, labels: int = 4, seed: int = 3) -> list[tuple]:
    r = random.Random(seed)
    centres = [[r.gauss(0, 0.2) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0.05, 0.1) for x in r.choice(centres)], r.randrange(labels)) for i in range(n)]
    rows += [(n + i, list(rows[0][1]), i % labels) for i in range(40)]           # a common vector: ties by id
    return rows


ODD = [(None, [0.1] * 12, 1), (1000, None, 1), (1001, [0.1] * 12, None), (1002, [0.1] * 11 + [None], 1), (1003, [float("nan")] * 12, 1),
       (1004, [float("inf")] * 12, 1), (1005, [], 1), (1006, [], 2), (1010, [0.5, 0.5], 1), (1011, [0.5, 0.25], 1), (1012, [0.25, 0.25], 2),
       (1013, [1e306] * 12, 1), (1020, [0.2] * 12, 3), (1020, [0.1] * 12, 2), (1020, [0.1] * 12, 2), (1030, [0.0] * 12, 0), (1040, [-0.2] * 12, 0)]


def mined(spark, rows, anchors, **options):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], VECTORS).repartition(5)
    out = bond.hard_negatives(df, anchors, F.col("label"), positives=3, negatives=4, **options)
    found = [tuple(r) for r in out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("options", [{}, {"broadcast_bytes": 0, "block_rows": 7, "shard_bytes": 4096}])
def test_hard_negatives(spark, options):
    rows = vectors(500) + ODD
    want = brute.hard_negatives(rows, lambda i: i % 10 == 0, 3, 4, 30, 90)
    assert len(want) > 100
    assert mined(spark, rows, F.col("vec_id") % 10 == 0, **options) == want


@pytest.mark.parametrize("scale", [2.0 ** 12, 2.0 ** 40])
def test_hard_negatives_of_large_numbers(spark, scale):
    rows = [(i, [float(round(x * scale)) for x in v], label) for i, v, label in vectors(120)]
    assert mined(spark, rows, F.col("vec_id") % 10 == 0) == brute.hard_negatives(rows, lambda i: i % 10 == 0, 3, 4, 30, 90)


def test_hard_negatives_of_nothing(spark):
    df = spark.createDataFrame([(1, [0.5], 1, 0, "x")], VECTORS)
    for rows, anchors in ((none_of(df), F.lit(True)), (df, F.lit(False)), (df, F.lit(True)), (df.withColumn("label", F.lit(None).cast("int")), F.lit(True))):
        assert bond.hard_negatives(rows, anchors, F.col("label")).count() == 0


def test_vertical_scan_prunes_and_keeps_every_answer():
    r = np.random.default_rng(5)
    columns = np.floor(256 * r.normal(0, 0.2, (32, 3000))).astype("f8")
    q = np.floor(256 * r.normal(0, 0.2, 32) * np.linspace(4, 0.01, 32))
    exact = q @ columns
    windows = [(float(np.quantile(exact, 0.9)), float(np.quantile(exact, 0.99))), (0.0, float(np.quantile(exact, 0.7)))]
    at, scores = bond.survivors(q, columns, columns.min(axis=1), columns.max(axis=1), np.ones(3000, bool), windows, 5)
    assert (scores == exact[at]).all() and len(at) < 1500
    for low, high in windows:
        fit = np.flatnonzero((exact >= low) & (exact <= high))
        assert set(fit[np.argsort(-exact[fit])][:5]) <= set(at)


# -- near duplicates ---------------------------------------------------------------------------------------------------
def texts(seed: int = 2) -> list[str | None]:
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    out: list[str | None] = []
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.randrange(40, 200))]
        out.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(r.randrange(0, 5)):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(" ".join(copy))
    out += [" ".join(passage + [r.choice(words) for _ in range(r.randrange(3, 30))]) for _ in range(40)]
    out += ["a b c", "A B  c", "a b", "a b", "a", "", None, " \n", "a b c d", "x y z " * 400, "x y z " * 401]
    return out


@pytest.mark.parametrize(("n", "percent", "options"), [(3, 85, {}), (3, 85, {"rounds": 1, "block": 4, "rows": 10, "partners": 2, "broadcast_ids": 0}), (5, 80, {"coordinates": 64}),
                                                       (2, 30, {"rounds": 1, "block": 3})])
def test_minhash_components(spark, n, percent, options):
    rows = list(enumerate(texts())) + [(3, None), (900, "w1 w2 w3 w4 w5 w6 w7"), (900, texts()[0]), (901, "w1 w2 w3 w4 w5 w6 w7"), (0, texts()[0])]
    df = spark.createDataFrame([(i, t, "c", "d") for i, t in rows + [(None, texts()[0])]], "doc_id long, text string, digest string, r string").repartition(4)
    got = minhash.near_duplicates(df, n=n, percent=percent, **options).collect()
    assert len(got) == len(rows) + 1
    want = brute.components(rows, n, percent)
    want = {(i, c, i == c) for i, t in rows for c in [want[i] if brute.shingles(t, n) else i]}
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == want
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((i, len(brute.shingles(t, n))) for i, t in rows)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]


def test_minhash_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert minhash.near_duplicates(none_of(df)).count() == 0
    assert [tuple(r) for r in minhash.near_duplicates(df).collect()] == [(1, 1, 1, True)]


def test_replaced_tables_are_deleted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("driftwise.llm.common.scratch_path", lambda _, name: str(tmp_path / f"{name}-{len(list(tmp_path.iterdir()))}"))
    df = spark.createDataFrame([(i, "one two three four five six " + "seven" * (i % 2)) for i in range(9)], "doc_id long, text string")
    assert {r["component_id"] for r in minhash.near_duplicates(df).collect()} == {0, 1}
    left = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "llm-minhash-reps" in left and not left & {"llm-minhash-signatures", "llm-minhash-posted", "llm-minhash-lists"}


def test_collisions_and_threshold():
    r = np.random.default_rng(1)
    a = r.integers(0, 4, (500, 128)).astype("<u4")
    b = np.where(r.random((500, 128)) < r.random((500, 1)), a, r.integers(0, 4, (500, 128))).astype("<u4")
    assert list(minhash.collisions(a, b, 80)) == list(np.flatnonzero((a == b).sum(axis=1) >= 80))
    t = minhash.threshold(128, 85, 1e-9)
    assert 75 < t < 90 and minhash.threshold(128, 100, 1e-9) == 128


def test_signatures_agree_like_jaccard():
    r = np.random.default_rng(4)
    by = minhash.multipliers(2048)
    pool = r.integers(0, 2 ** 64, 3000, "u8")
    for shared in (200, 1000, 1800):
        a, b = pool[:2000], pool[2000 - shared:4000 - shared]
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((minhash.signature(a, by) == minhash.signature(b, by)).mean() - truth) < 0.05


# -- conversation trie -------------------------------------------------------------------------------------------------
CONVERSATIONS = "conv_id long, turn int, role string, text string, pos string, conv string"


def conversations(seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    said = ["", "hi", "hé", "why", "ok then"]
    rows = [(c, t, r.choice(["user", "bot"]) if c % 3 else "user", r.choice(said[:2 + c % 4])) for c in range(-12, 150) if c % 7 for t in range(r.randrange(0, 12))]
    rows += [(c, None, None, None) for c in range(0, 60, 4)] + [(200, 1, "user", "hi")] * 3 + [(None, 1, "user", "hi"), (2 ** 63 - 1, 1, "a", "b"), (-2 ** 63, 1, "a", "b")]
    rows += [(300, t, "user", f"t{t}") for t in range(400)] + [(301, t, "user", f"t{t}") for t in range(300)]
    rows += [(c, t, "user", "same") for c in range(1000, 1200) for t in range(3)]
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_convs": 3}, {"shard_turns": 20}])
def test_prefix_trie(spark, options):
    rows = conversations()
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], CONVERSATIONS).repartition(6)
    got = trie.prefix_trie(df, **options)
    assert got.select("node").distinct().count() == got.count()
    assert sorted((tuple(r) for r in got.drop("node").collect()), key=str) == brute.trie(rows)


def test_prefix_trie_of_nothing(spark):
    df = spark.createDataFrame([(None, 1, "a", "b")], "conv_id long, turn int, role string, text string")
    assert trie.prefix_trie(df).count() == 0
    assert trie.prefix_trie(none_of(df)).count() == 0


def test_prefix_trie_of_the_smallest_table(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF_SMALL}/conversations.parquet'").fetchall()
    got = trie.prefix_trie(spark.read.parquet(f"{SF_SMALL}/conversations.parquet")).drop("node").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute.trie(rows)

"""The pipeline's stages against plain versions of what each may keep, each on its own input."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import SF_SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and result of every stage, written and read again."""
    docs, out = spark.read.parquet(f"{SF_SMALL}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, SF_SMALL).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_keep_the_columns(steps):
    assert [s[0] for s in steps] == [s[0] for s in corpus_pipeline.STAGES] and len(steps) == 5
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns and after.dtypes == before.dtypes


def test_quality_rejects_labelled_junk_and_keeps_the_rest(steps):
    _, before, after = steps[0]
    truth = duckdb.sql(f"select doc_id, quality from '{SF_SMALL}/labels.parquet'").fetchall()
    kept = rows(after)
    right = [(i in kept) == bool(q) for i, q in truth]
    assert sum(right) / len(right) > 0.95


def test_one_document_of_each_group_stays(steps):
    _, before, after = steps[1]
    comp = brute.components([(i, r["text"]) for i, r in rows(before).items()], 5, 80)
    assert set(rows(after)) == {i for i, c in comp.items() if i == c}


def test_repeated_ids_and_rows_without_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    docs = [(5, a, "x"), (5, a, "x"), (5, b, "y"), (5, b, "x"),      # one id: one group, the smallest text stays
            (9, b + " more", "z"),                                   # near a text of 5
            (None, a, "n"), (None, c, "n"), (None, c, "n"), (None, c + " more", "n"),
            (7, "", "e"), (7, "", "e"), (None, None, "e"), (5, " ", "e"), (3, "few words", "f"), (3, "few words", "f"), (None, "few words", "f")]
    df = spark.createDataFrame([(i, t, {"m": m}) for i, t, m in docs], "doc_id long, text string, extra map<string,string>").repartition(4)
    got = corpus_pipeline.near_duplicates(spark, df, SF_SMALL)
    assert got.columns == df.columns
    rows = [(r["doc_id"], r["text"], r["extra"]["m"]) for r in got.collect()]
    nulls = [r for r in rows if r[0] is None and r[1]]
    assert len(nulls) == 1 and nulls[0][1] in (c, c + " more")
    rest = sorted((r for r in rows if r not in nulls), key=str)
    assert rest == sorted([(5, a, "x"), (7, "", "e"), (7, "", "e"), (None, None, "e"), (5, " ", "e"), (3, "few words", "f")], key=str)


def test_leaking_documents_go(steps):
    _, before, after = steps[2]
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = [words(t) for (t,) in duckdb.sql(f"select text from '{SF_SMALL}/benchmark.parquet'").fetchall()]
    want = {i for i, r in rows(before).items() if not any(f" {w} " in f" {words(r['text'])} " for w in items)}
    assert set(rows(after)) == want


def test_personal_data_is_replaced(steps):
    _, before, after = steps[3]
    old, new = rows(before), rows(after)
    assert set(old) == set(new)
    for i, r in old.items():
        spans = sorted((a, b, k) for k, found in brute.base_spans(r["text"]).items() for a, b in found)
        want, at = "", 0
        for a, b, k in spans:
            if a >= at:
                want += r["text"][at:a] + f"[{k.upper()}]"
            at = max(at, b)
        assert new[i]["text"] == want + r["text"][at:]
        assert new[i]["n_chars"] == len(new[i]["text"])


def test_packing_takes_every_document(steps):
    _, before, after = steps[4]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == set(rows(before))
    total = after.agg(F.sum("length")).first()[0]
    assert total == sum(r["doc_tokens"] for r in after.select("doc_id", "doc_tokens").distinct().collect())


def test_run_is_the_stages(spark, steps):
    assert corpus_pipeline.run(spark, SF_SMALL).count() == steps[-1][2].count()


def test_odd_documents_go_through(spark):
    docs = spark.createDataFrame(brute.documents(), brute.DOCUMENTS)
    for some in (docs, docs.where("1 = 0")):
        df = some
        for _, stage in corpus_pipeline.STAGES[1:]:
            df = stage(spark, df, SF_SMALL)
        assert (df.count() > 0) == (some is docs)

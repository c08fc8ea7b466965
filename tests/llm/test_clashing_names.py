"""Extra columns may be called like anything an operator uses inside: they neither break it nor are they changed."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftwise.llm import fm, pii, urlfilter
from tests.conftest import SF_SMALL
from tests.llm import brute

INNER = ["id", "candidates", "text_key", "_text_key", "_key", "_md5", "_spans", "_new", "_id", "_text", "row", "known", "c", "pattern", "value", "start", "seed", "out",
         "email", "_listed", "_block", "_bits", "_at", "_words", "_canonical", "host", "path", "rule", "verdict", "url2", "quality_score", "Text_Key_", "y", "a.b"]
TEXT = "Mail a.b+c@mail.example.com, or call +1 (017) 555-7713 now."


def _with(df, names):
    return df.select("*", *[F.lit(f"kept {n}").alias(n) for n in names])


def _kept(rows, names):
    return all(r[n] == f"kept {n}" for r in rows for n in names)


def test_personal_data(spark):
    plain = spark.createDataFrame([(1, TEXT), (2, None), (2, "none")], "doc_id long, text string")
    docs = _with(plain, INNER)
    redacted = pii.redact(docs)
    rows = redacted.collect()
    assert redacted.columns == docs.columns and _kept(rows, INNER)
    assert sorted((r["doc_id"], r["text"] or "") for r in rows) == [(1, "Mail [EMAIL], or call [PHONE] now."), (2, ""), (2, "none")]
    found = pii.find(docs).collect()
    others = [n for n in INNER if n not in ("id", "email")]                 # these two are results
    assert _kept(found, others) and sorted(len(r["email"]) for r in found) == [0, 0, 1]
    assert sorted(map(str, pii.find(plain).select("doc_id", *pii.KINDS, "id").collect())) == sorted(str(r) for r in pii.find(docs).select("doc_id", *pii.KINDS, "id").collect())
    assert pii.find(plain.select("text")).columns == [*pii.KINDS, "id"]


@pytest.mark.parametrize("blocks", [1 << 18, 0])
def test_url_filter(spark, blocks):
    plain = spark.createDataFrame([(1, "http://spam.com/a"), (2, "http://a.com/de/x"), (3, None), (4, "http://ok.net/")], "page_id long, url string")
    listed = spark.createDataFrame([("spam.com/a",)], "u string")
    rows = urlfilter.judge(_with(plain, INNER), "url", listed, brute.RULES, broadcast_blocks=blocks).collect()
    assert _kept(rows, [n for n in INNER if n not in ("host", "path", "rule", "verdict")])
    assert {(r["page_id"], r["host"], r["rule"], r["verdict"]) for r in rows} == {
        (1, "spam.com", None, "block"), (2, "a.com", "com/de/", "block"), (3, "", None, "allow"), (4, "ok.net", None, "allow")}
    named = plain.withColumnRenamed("url", "host")
    assert {(r["page_id"], r["verdict"]) for r in urlfilter.judge(named, "host", listed, brute.RULES, broadcast_blocks=blocks).collect()} == {
        (r["page_id"], r["verdict"]) for r in rows}


def test_quality_and_stages(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    wide = _with(docs, INNER)
    for name, stage in corpus_pipeline.STAGES[:1] + corpus_pipeline.STAGES[2:4]:
        got = stage(spark, wide, SF_SMALL)
        rows = got.collect()
        assert got.columns == wide.columns and _kept(rows, INNER), name
        assert {(r["doc_id"], r["text"]) for r in rows} == {(r["doc_id"], r["text"]) for r in stage(spark, docs, SF_SMALL).collect()}, name
    odd = spark.createDataFrame(brute.documents(), brute.DOCUMENTS)
    assert corpus_pipeline.quality(spark, odd, SF_SMALL).columns == odd.columns
    assert corpus_pipeline.quality(spark, odd.where("1 = 0"), SF_SMALL).count() == 0


def test_the_model_does_not_depend_on_the_partitioning(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet").select("doc_id", F.col("quality").alias("y"))
    first, again = fm.train(docs.repartition(3), labels, epochs=1), fm.train(docs.repartition(7).orderBy(F.desc("doc_id")), labels, epochs=1)
    assert first == again

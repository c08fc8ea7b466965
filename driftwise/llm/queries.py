"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwise.llm import bond, counts, dac, decontaminate, fm, jaccard, minhash, packing, pii, sharding, sql, topk, trie, urlfilter
from driftwise.llm.common import table
from driftwise.session import scratch_path

#: Fixed by the query's contract.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
#: First labels (after www., blog. and m.) of the hosts whose pages are listed one by one.
LISTED_LABELS = ["adult-x", "spam-farm", "cheap-pills", "ads-track", "casino-win", "free-bets"]
TOKENIZER = "byte_bpe_50k.json"
SHARDS = 16


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, then the list of the canonical URLs of all pages on the listed hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    label = F.regexp_extract(urlfilter.host(F.col("url")), r"^(?:www\.|blog\.|m\.)?([^.]*)", 1)
    listed = pages.where(label.isin(LISTED_LABELS)).select(urlfilter.canonical(F.col("url")).alias("url"))
    return urlfilter.judge(pages, "url", listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaked benchmark items of every document that leaks one."""
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), "doc_id", table(spark, sf_dir, "benchmark"))
    return found.select(F.col("key").cast("long").alias("doc_id"), "item_id", "n_windows", "n_matched", "coverage")


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm-token-ids")
    dac.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end_id=2)
    return dac.documents(spark, path)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counted = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counted, F.sha2(pii.listing(pii.KINDS), 256).alias("base_sha256"),
                        pii.listing((*pii.KINDS, "id")).alias("spans"))


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def quality_model(documents: DataFrame, labels: DataFrame) -> bytes:
    learned = labels.where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("y"))
    return fm.train(documents, learned)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    scored = fm.score(documents, quality_model(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
                         (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=1024)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = {s: 1.0 for s in range(SHARDS)}
    out = sharding.assign(table(spark, sf_dir, "documents"), "doc_id", "text", even, even | {SHARDS: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=90)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), end_id=0, size=1024)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return bond.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label, positives=5, negatives=10, low=30, high=90)


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), n=3, percent=85)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations")).drop("node")


LLM_QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_decontamination, op3_exact_topk, op4_token_id_output, op5_personal_data, op6_quality, op7_token_counts,
    op8_sharding, op9_jaccard_join, op10_packing, op11_hard_negatives, op12_minhash, op13_prefix_trie)}
LLM_ORACLE: dict[str, str] = {"op1_url_filter": sql.URL_FILTER, "op3_exact_topk": sql.EXACT_TOPK, "op9_jaccard_join": sql.JACCARD_JOIN,
                              "op11_hard_negatives": sql.HARD_NEGATIVES, "op12_minhash": sql.MINHASH, "op13_prefix_trie": sql.PREFIX_TRIE}

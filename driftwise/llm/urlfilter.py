"""URL filter: path rules first, then a list of canonical URLs behind a blocked Bloom filter.

The list becomes a blocked Bloom filter: a URL's hash picks one block of 512 bits (eight longs) and six bits in
it, so a probe touches one block. Pages that miss the filter are certainly not listed; the few that hit go to an
exact hash join on the canonical URL, which removes false positives. Everything is built-in expressions.

The filter has a row per block and about ``bits_per_url`` bits per listed URL. It is broadcast while it is at most
``broadcast_blocks`` blocks (64 bytes of bits each), and joined by a shuffle on the block number beyond that.

Defined results: a null URL, or one without ``://``, has empty host and path, no canonical form, fits no rule and is
never listed. A rule ``host/path`` fits its host and all subdomains when the URL's path starts with the rule's;
the longest fitting rule wins and the list is not asked. Null and repeated list entries do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwise.llm.common import ascii_lower, carried

WORDS, BITS = 8, 6          # longs per block, bits set per URL
ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0,
                  ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))).otherwise(F.lit(""))


def path(url: Column) -> Column:
    return F.when(F.coalesce(F.instr(url, "://"), F.lit(0)) > 0,
                  F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without trailing slashes, and the query's parts sorted, without ``utm_*`` and ``ref``;
    scheme and fragment do not count. Null without a host part."""
    parts = F.split(F.regexp_extract(url, r"(?s)^.*?://[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(parts, lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    plain = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), r"/+$", ""), query)
    return F.when(F.instr(url, "://") > 0, plain)


def matching_rule(host_: Column, path_: Column, rules: Mapping[str, str]) -> Column:
    """The longest rule that fits, else null."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):       # later ones are longer and win
        at, start = rule.split("/", 1)
        fits = ((host_ == at) | host_.endswith(f".{at}")) & path_.startswith(f"/{start}")
        chosen = F.when(fits, F.lit(rule)).otherwise(chosen)
    return chosen


def _places(url: Column, n_blocks: int) -> tuple[Column, Column]:
    """Block number, and six bit numbers below 512 from nine bits of a second hash each."""
    bits = F.xxhash64(url, F.lit("bits"))
    return (F.pmod(F.xxhash64(url), F.lit(n_blocks)),
            F.array(*[F.shiftrightunsigned(bits, 9 * i).bitwiseAND(F.lit(511)).cast("int") for i in range(BITS)]))


def blocked_bloom(listed: DataFrame, n_blocks: int) -> DataFrame:
    """Filter rows (block, words): the non-empty ones of a block's eight longs, by number. ``listed``: column ``url``."""
    block, bits = _places(F.col("url"), n_blocks)
    ones = (listed.select(block.alias("block"), F.explode(bits).alias("bit"))
            .select("block", F.shiftright("bit", 6).alias("word"),
                    F.expr("shiftleft(1L, bit & 63)").alias("mask")))
    words = ones.groupBy("block", "word").agg(F.bit_or("mask").alias("mask"))       # at most 8 rows per block
    return words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "mask"))).alias("words"))


def _hit(words: Column, bits: Column) -> Column:
    one = lambda p: F.getbit(F.coalesce(F.try_element_at(words, F.shiftright(p, 6)), F.lit(0).cast("long")), p.bitwiseAND(F.lit(63))) == 1
    return F.coalesce(words.isNotNull() & F.forall(bits, one), F.lit(False))


def judge(pages: DataFrame, url: str, listed: DataFrame, rules: Mapping[str, str], bits_per_url: int = 12,
          broadcast_blocks: int = 1 << 18) -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``listed``: canonical URLs to block, in its first column. A column of
    ``pages`` that is called like one of the four gives way to it; other names may be anything."""
    row, kept = carried(pages, ["host", "path", "rule", "verdict"])
    pages = pages.select(row.alias("row"), F.col(f"`{url}`").alias("url"))
    names = listed.select(F.col(listed.columns[0]).alias("url")).where("url is not null").distinct()
    n_blocks = max(1, math.ceil(names.count() * bits_per_url / (64 * WORDS)))
    bloom = blocked_bloom(names, n_blocks)
    u = F.col("url")
    probed = (pages.withColumn("host", host(u)).withColumn("path", path(u))
              .withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
              .withColumn("_canonical", F.when(F.col("rule").isNull(), canonical(u))))
    block, bits = _places(F.col("_canonical"), n_blocks)
    probed = (probed.withColumn("_block", F.when(F.col("_canonical").isNotNull(), block))
              .withColumn("_bits", F.when(F.col("_canonical").isNotNull(), bits)))
    bloom = bloom.withColumnsRenamed({"block": "_at", "words": "_words"})
    meets = F.col("_block") == F.col("_at")
    if n_blocks <= broadcast_blocks:
        asked, rest = probed.join(F.broadcast(bloom), meets, "left"), None
    else:       # rows without a canonical URL stay out of the shuffle, their null block would meet in one task
        asked, rest = probed.where("_block is not null").join(bloom, meets, "left"), probed.where("_block is null")
    hit = _hit(F.col("_words"), F.col("_bits"))
    maybe, clear = asked.where(hit).drop("_at", "_words"), asked.where(~hit).drop("_at", "_words")
    clear = clear if rest is None else clear.unionByName(rest)
    exact = maybe.join(names.select(F.col("url").alias("_listed")), F.col("_canonical") == F.col("_listed"), "left")
    every = exact.unionByName(clear.withColumn("_listed", F.lit(None).cast("string")))
    by_rule = F.element_at(F.create_map(*[F.lit(x) for pair in rules.items() for x in pair]), F.col("rule")) if rules else F.lit(None)
    verdict = F.coalesce(by_rule, F.when(F.col("_listed").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW)))
    return every.select(*[F.col("row")[c].alias(c) for c in kept], "host", "path", "rule", verdict.alias("verdict"))

"""URL filters: policy rules, then a blocked Bloom filter with an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import table

#: (verdict, host, path): the rule holds for the host and its subdomains, for paths that begin with `path`.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Hosts whose pages make up the list of blocked URLs.
LISTED_LABELS = ["spam-farm", "cheap-pills"]
#: One 256-bit block of eight 32-bit words per this many listed URLs; at 16 URLs a block about one URL in a thousand passes wrongly.
URLS_PER_BLOCK = 16
#: The filter is broadcast up to this many blocks (72 bytes each, 18 MB), else joined by block number.
BROADCAST_BLOCKS = 250_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Odd multipliers below 2^31, so that products of 31-bit numbers fit a long.
_SALTS = [0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? or #."""
    whole = r"(?s)^.*?://([^/?#]*)([^?#]*).*$"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, whole, 1), _UPPER, _LOWER), F.regexp_extract(url, whole, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., path without .html and trailing slashes."""
    bare = F.rtrim(path, F.lit("/"))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.when(bare.endswith(".html"), bare.substr(F.lit(1), F.length(bare) - 5)).otherwise(bare))


def _rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _masks(key: str) -> list[Column]:
    """A bit in each word of the key's block."""
    word = "cast(shiftright(({k} & 2147483647L) * {s}L & 2147483647L, 26) as int)"
    return [F.expr("shiftleft(1L, " + word.format(k=key, s=s) + ")") for s in _SALTS]


def bloom_filter(listed: DataFrame, url: str = "canonical") -> tuple[DataFrame, int]:
    """The filter's non-empty blocks as rows (block, w0 .. w7), and the number of blocks.

    `listed` holds distinct canonical URLs. Each URL sets eight bits, all in one block."""
    n = listed.count()
    blocks = max(1, -(-n // URLS_PER_BLOCK))
    keyed = listed.select(F.xxhash64(url).alias("h"))
    keyed = keyed.select(F.pmod(F.shiftrightunsigned("h", 32), F.lit(blocks)).alias("block"), *[m.alias(f"m{i}") for i, m in enumerate(_masks("h"))])
    return keyed.groupBy("block").agg(*[F.bit_or(f"m{i}").alias(f"w{i}") for i in range(8)]), blocks


def url_verdicts(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Judge every url of `pages`: the longest rule that fits, else block if its canonical
    URL is in `listed` (column canonical), else allow.

    Only URLs without a rule are looked up; those that the blocked Bloom filter lets pass
    meet the list in a hash join, which removes its false positives. The filter is broadcast
    when small and joined by block number when not. A URL that a third of the pages share is
    one row of the list, so adaptive execution splits its pages.

    A null url, or one without ://, has an empty host and path and is allowed. Of rules that
    tie in length the one listed later wins. Repeated page_ids are judged row by row; urls may have any
    length; other columns are ignored, whatever their names; empty tables are fine."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = judged.withColumn("r", _rule(F.col("host"), F.col("path"), rules)).withColumn("canonical", canonical(F.col("host"), F.col("path")))
    ruled = judged.filter("r is not null").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))

    listed = table(listed.select("canonical").filter("canonical is not null").distinct(), "listed")
    bits, blocks = bloom_filter(listed)
    if blocks <= BROADCAST_BLOCKS:
        bits = F.broadcast(bits)
    open_ = judged.filter("r is null").withColumn("h", F.xxhash64("canonical")).withColumn("block", F.pmod(F.shiftrightunsigned("h", 32), F.lit(blocks)))
    set_ = F.lit(True)
    for i, m in enumerate(_masks("h")):
        set_ = set_ & F.coalesce(F.col(f"w{i}").bitwiseAND(m) != 0, F.lit(False))
    probed = open_.join(bits, "block", "left").withColumn("maybe", set_)
    none = F.lit(None).cast("string").alias("rule")
    passed = probed.filter("not maybe").select("page_id", "host", "path", none, F.lit("allow").alias("verdict"))
    known = listed.withColumn("known", F.lit(True)).hint("shuffle_hash")
    hits = probed.filter("maybe").join(known, "canonical", "left").select("page_id", "host", "path", none, F.when(F.col("known"), "block").otherwise("allow").alias("verdict"))
    return ruled.unionAll(passed).unionAll(hits)


def listed_urls(pages: DataFrame, labels: list[str] = LISTED_LABELS) -> DataFrame:
    """The list of blocked canonical URLs: those of pages with a listed label in their host."""
    host, path = host_and_path(F.col("url"))
    named = pages.select(host.alias("host"), path.alias("path")).filter(F.arrays_overlap(F.split("host", r"\."), F.array(*map(F.lit, labels))))
    return named.select(canonical(F.col("host"), F.col("path")).alias("canonical")).distinct()

"""URL filters: path rules first, then a blocked Bloom filter and an exact hash join.

Every url gives a few lookup keys: its canonical url and the roots of its host
and parent hosts. A Bloom filter of the listed canonical urls, whose size is
bounded, passes the keys that may be listed; only those few go to an exact join
with the list, which removes false positives.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule, and verdict allow. Repeated page ids are judged row by row. Rules that fit
equally are told apart by their length; an empty list allows all; urls of any length
are read whole; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

# Hosts that the default list blocks, under each of the three suffixes; how many numbered mirrors and redirects each has.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_SUFFIXES = ("example.com", "example.net", "example.org")
NUMBERED = 500


def default_list(spark) -> DataFrame:
    """Canonical urls that block: roots of known advertising, betting and spam hosts and of their mirrors, and single pages that lead to them.

    18,018 rows, so the filter has several blocks, and half of the keys have paths.
    """
    names, suffixes = (F.explode(F.array(*map(F.lit, x))) for x in (LISTED_NAMES, LISTED_SUFFIXES))
    roots = spark.range(1).select(names.alias("name")).select("name", suffixes.alias("suffix"))
    numbered = roots.select("*", F.explode(F.sequence(F.lit(1), F.lit(NUMBERED))).alias("k"))
    mirror = F.concat("name", "k", F.lit("."), "suffix", F.lit("/"))
    redirect = F.concat(F.lit("redirect."), "suffix", F.lit("/"), "name", F.lit("/"), "k", F.lit("/"))
    both = numbered.select(F.explode(F.array(mirror, redirect)).alias("listed"))
    return roots.select(F.concat("name", F.lit("."), "suffix", F.lit("/")).alias("listed")).unionByName(both)


def _host(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, UPPER, LOWER), F.lit(""))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_keys(host: Column, path: Column) -> Column:
    """What the list may name: host and path without a trailing slash, and the root of each host suffix.

    A port, a leading ``www.`` and a trailing dot don't count.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r":[0-9]*$|\.$", ""), r"^www\.", "")
    parts = F.split(bare, r"\.")
    roots = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, i, F.size(parts)), "."), F.lit("/")))
    page = F.concat(bare, F.regexp_replace(path, r"/+$", ""), F.lit("/"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(page), roots)))


def _rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    listed: one column of canonical urls, of any size.
    """
    listed = listed.toDF("listed").where("listed IS NOT NULL").distinct()
    bits = bloom.filter_bits(listed.count())
    filt = bloom.build(listed.select(F.xxhash64("listed")), bits)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.withColumn("host", _host(F.col("url"))).withColumn("path", _path(F.col("url")))
    rows = rows.withColumn("found", _rule(F.col("host"), F.col("path"), rules))
    ruled = rows.where("found IS NOT NULL").select("page_id", "host", "path", "found.rule", "found.verdict")
    open_ = rows.where("found IS NULL").select("page_id", "host", "path")
    keys = open_.select("host", "path", F.explode(canonical_keys(F.col("host"), F.col("path"))).alias("key"))
    possible = bloom.probe(keys, F.xxhash64("key"), filt, bits, "maybe").where("maybe")
    hits = possible.join(listed, F.col("key") == F.col("listed"), "left_semi").select("host", "path").distinct()
    hits = write_table(hits, "listed-urls")

    # Pages that can't be among the hits pass straight through; the rest meet them by an exact join.
    address = F.xxhash64("host", "path")
    hit_bits = bloom.filter_bits(hits.count())
    marked = bloom.probe(open_, address, bloom.build(hits.select(address), hit_bits), hit_bits, "maybe")
    alone = marked.where("NOT maybe").withColumn("verdict", F.lit("allow"))
    met = marked.where("maybe").join(hits.withColumn("hit", F.lit(True)), ["host", "path"], "left")
    met = met.withColumn("verdict", F.when(F.col("hit"), "block").otherwise("allow"))
    judged = alone.select("page_id", "host", "path", "verdict").unionByName(met.select("page_id", "host", "path", "verdict"))
    judged = judged.withColumn("rule", F.lit(None).cast("string"))
    return ruled.unionByName(judged.select(*ruled.columns))

"""Blocked Bloom filters as DataFrames.

A filter is a table of (block, bits): each block is one 4 KB bitmap made by
``bitmap_construct_agg``, and all bits of one key lie in the same block, so a
probe is one lookup. Its number of bits is fixed before it is built and never
exceeds ``MAX_BITS`` (32 MB), so broadcasting it is always bounded. Beyond that
bound a filter lets more false positives pass; it never loses a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, pow2_at_least

BLOCK_BITS = 32768
MAX_BITS = 1 << 28
BITS_PER_KEY = 16


def filter_bits(n_keys: int, bits_per_key: int = BITS_PER_KEY) -> int:
    """Bits of a filter for n_keys, a power of two from one block to MAX_BITS."""
    return min(MAX_BITS, max(BLOCK_BITS, pow2_at_least(n_keys * bits_per_key)))


def block_of(h: Column, bits: int) -> Column:
    return F.pmod(h, F.lit(bits // BLOCK_BITS)).cast("int")


def positions(h: Column) -> list[Column]:
    """The two bits of a key inside its block, from hash bits that choose no block."""
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for s in (49, 34)]


def _bitmaps(slots: DataFrame) -> DataFrame:
    return slots.groupBy("block").agg(F.bitmap_construct_agg(F.col("pos").cast("long")).alias("bits"))


def _slots(hashes: DataFrame, bits: int) -> DataFrame:
    """(block, pos) of every bit that every key of hashes(h) sets."""
    h = F.col("h")
    return hashes.select(block_of(h, bits).alias("block"), F.explode(F.array(*positions(h))).alias("pos"))


def build(hashes: DataFrame, bits: int) -> DataFrame:
    """Filter of the keys in the single long column of hashes."""
    return _bitmaps(_slots(hashes.toDF("h"), bits).distinct())


def build_repeated(hashes: DataFrame, bits: int) -> DataFrame:
    """Filter of the bits that were set twice or more: keys seen twice all pass it.

    Counts are combined before the shuffle, so a key held by a third of all
    rows costs one row for each task.
    """
    seen = _slots(hashes.toDF("h"), bits).groupBy("block", "pos").count()
    return _bitmaps(seen.where("count >= 2").select("block", "pos"))


def _bit(bits: Column, pos: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(pos, 3) + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(pos, F.lit(8))) == 1, F.lit(False))


def probe(df: DataFrame, h: Column, filt: DataFrame, bits: int, out: str) -> DataFrame:
    """df with boolean column `out`: may h be among the filter's keys? Rows stay where they are."""
    key, block, words = fresh(df, "bloom_h", "bloom_block", "bloom_bits")
    small = F.broadcast(filt.select(F.col("block").alias(block), F.col("bits").alias(words)))
    joined = df.withColumn(key, h).withColumn(block, block_of(F.col(key), bits)).join(small, block, "left")
    hit = F.col(key).isNotNull()
    for pos in positions(F.col(key)):
        hit = hit & _bit(F.col(words), pos)
    return joined.withColumn(out, hit).drop(key, block, words)


def anti_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on` is not in keys (one column, no nulls); only rows that may match are shuffled."""
    maybe, = fresh(df, "maybe")
    n = keys.count()
    if n == 0:
        return df
    bits = filter_bits(n)
    filt = build(keys.select(F.xxhash64(F.col(keys.columns[0]))), bits)
    marked = probe(df, F.xxhash64(F.col(on)), filt, bits, maybe)
    rest = marked.where(F.col(maybe)).join(keys.toDF(on).distinct(), on, "left_anti").select(*marked.columns)
    return marked.where(~F.col(maybe)).unionByName(rest).drop(maybe)


def semi_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df that may have their `on` in keys: a superset, made without a shuffle of df."""
    maybe, = fresh(df, "maybe")
    bits = filter_bits(keys.count())
    filt = build(keys.select(F.xxhash64(F.col(keys.columns[0]))), bits)
    return probe(df, F.xxhash64(F.col(on)), filt, bits, maybe).where(F.col(maybe)).drop(maybe)

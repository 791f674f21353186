"""Exact dedup: two-pass Bloom filtering, native DataFrame functions only.

Pass one hashes every whole text and keeps a filter of the bits that were hit
twice. Pass two probes it: rows that miss cannot have a copy and pass straight
through; the others, true copies and a few false positives, meet by SHA-256. Texts
are read and hashed once; what follows works on ids and hashes. Texts with so many
copies that one task would feel it meet their rows by broadcast; there are few.

Defined results: null text equals the empty text; a null id is smaller than any
other; rows that repeat an id together with its text share one verdict, and of these
drop_exact_duplicates keeps the one whose JSON form has the least digest; texts of any
length are hashed whole; an empty table gives an empty result; further columns are
ignored or kept unread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import fresh, join_groups, write_table

RESULT = "doc_id, keep_id, group_size, kept, text_sha256".split(", ")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = write_table(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("text_sha256")), "hashed")
    n = hashed.count()
    bits = bloom.filter_bits(n)
    rows = bloom.probe(hashed, F.col("h"), bloom.build_repeated(hashed.select("h"), bits), bits, "maybe").drop("h")
    alone = rows.where(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    some = rows.where("maybe").drop("maybe")
    groups = write_table(some.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    met = join_groups(some, groups, "text_sha256", "group_size", n).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return alone.select(RESULT).unionByName(met.select(RESULT))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, the one with the largest id, all columns as they were."""
    maybe, sha, top, row, size = fresh(docs, "maybe", "sha", "top", "row", "size")
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    n = docs.count()
    bits = bloom.filter_bits(n)
    marked = bloom.probe(docs, h, bloom.build_repeated(docs.select(h), bits), bits, maybe)
    alone = marked.where(~F.col(maybe)).select(*docs.columns)
    some = marked.where(F.col(maybe)).drop(maybe).withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    best = write_table(some.groupBy(sha).agg(F.max(id_col).alias(top), F.count(F.lit(1)).alias(size)), "groups")
    kept = join_groups(some, best, sha, size, n).where(F.col(id_col).eqNullSafe(F.col(top)))
    # Rows that repeat both id and text: the one with the least digest, by a combining aggregate.
    whole = F.struct(*[F.col(c) for c in docs.columns])
    one = kept.groupBy(sha).agg(F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias(row))
    return alone.unionByName(one.select(f"{row}.*"))

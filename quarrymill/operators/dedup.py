"""First-seen distinct, dense ids, first rows, collisions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .numbering import numbered


def first_rows(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by order; combined in each task before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return best.select(*key, "__row.*").select(*df.columns)


def first_seen_ids(df: DataFrame, key: Sequence[str], order: Sequence[str], id_name: str = "id") -> DataFrame:
    """Distinct keys numbered 0, 1, ... in the order in which they first occur; keys that begin together go by key."""
    seen = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("__first"))
    return numbered(seen, ["__first", *key], place=id_name).select(id_name, *key)


def collisions(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Every row after the first of its key."""
    return df.withColumn("occurrence", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("occurrence > 1")


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def merge_shards(shards: Sequence[DataFrame], key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Union of shards; of equal keys the row of the first shard, then the first by order, stays."""
    out = None
    for i, shard in enumerate(shards):
        tagged = shard.withColumn("shard", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged)
    return first_rows(out, key, ["shard", *order])


def weighted_vote(df: DataFrame, key: str, answer: str, weight: str, order: str, ignored: Sequence[str] = ("unanswerable",)) -> DataFrame:
    """The answer of each key with the most weight; ties go to the one seen first; its first spelling is returned.

    Blank answers, those in `ignored` and those without weight don't vote.
    """
    form = F.lower(F.trim(F.regexp_replace(answer, r"\s+", " ")))
    heard = df.where((form != "") & ~form.isin(*ignored) & (F.col(weight) > 0))
    totals = heard.groupBy(key, form.alias("form")).agg(F.sum(weight).alias("total"), F.min(order).alias("seen"), F.min_by(F.trim(answer), order).alias("answer"))
    return totals.groupBy(key).agg(F.max_by(F.struct("answer", "total"), F.struct("total", -F.col("seen"))).alias("b")).select(key, "b.answer", "b.total")


# What a confidence weighs.
CONFIDENCE = {"yes": 3, "maybe": 1, "no": 0}


def confidence(x: Column) -> Column:
    known = F.create_map(*[F.lit(v) for kv in CONFIDENCE.items() for v in kv])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(x))), F.lit(0))


def sorted_distinct(df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
    """Each key once, in order, with the least of the other columns."""
    return df.groupBy(key).agg(*[F.min(c).alias(c) for c in keep]).orderBy(key)


def nested_first_seen(df: DataFrame, parent: str, child: str, order: Sequence[str], value: Sequence[str]) -> DataFrame:
    """For each parent the array of its distinct children, each where it is first seen, in order."""
    first = df.groupBy(parent, child).agg(F.min(F.struct(*dict.fromkeys([*order, *value]))).alias("__first"))
    packed = F.array_sort(F.collect_list(F.struct("__first", child)))
    return first.groupBy(parent).agg(F.transform(packed, lambda x: F.struct(x[child].alias(child), *[x["__first"][v].alias(v) for v in value])).alias("children"))

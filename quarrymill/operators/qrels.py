"""Relevance tables: grouping, modes, private candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedup import first_rows
from .numbering import numbered

#: Pairs of a query that are ordered at once; queries with more are ordered by Spark.
RUN = 1 << 14


def group_pairs(pairs: DataFrame, query: str, candidate: str, score: str, order: Sequence[str], extras: Sequence[str] = ()) -> DataFrame:
    """query_id, candidate_ids, candidate_scores and extras as aligned arrays in order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).alias(f"v{i}") for i, c in enumerate([candidate, score, *extras])])))
    names = ["candidate_ids", "candidate_scores", *extras]
    grouped = pairs.groupBy(F.col(query).alias("query_id")).agg(packed.alias("p"))
    # A field of an array of structs is the array of that field.
    return grouped.select("query_id", *[F.col(f"p.v{i}").alias(n) for i, n in enumerate(names)])


def group_large(pairs: DataFrame, query: str, candidate: str, score: str, order: Sequence[str], extras: Sequence[str] = ()) -> DataFrame:
    """The rows of group_pairs for queries with any number of pairs: Spark orders them by ranges, and arrays are put together from runs of RUN.

    An array is held once as it is made and once in its row, in its own type; what isn't read of it isn't made.
    """
    values = [candidate, score, *extras]
    rows = pairs.select(F.col(query).alias("query_id"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)])
    keys = ["query_id", *[f"o{i}" for i in range(len(order))], *[f"v{i}" for i in range(len(values))]]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__id", F.monotonically_increasing_id())
    run, both = F.expr(f"__id DIV {RUN}"), lambda i: F.array_sort(F.collect_list(F.struct("__id", f"v{i}")))
    runs = placed.groupBy("query_id", run.alias("__run")).agg(*[both(i)[f"v{i}"].alias(f"v{i}") for i in range(len(values))])
    whole = lambda i: F.flatten(F.array_sort(F.collect_list(F.struct("__run", f"v{i}")))[f"v{i}"])
    return runs.groupBy("query_id").agg(*[whole(i).alias(n) for i, n in enumerate(["candidate_ids", "candidate_scores", *extras])])


def sparse(local: DataFrame, ids: str = "candidate_ids") -> DataFrame:
    """The first of a query's candidates is its positive."""
    return local.select("query_id", F.lit("sparse").alias("mode"), F.slice(ids, 1, 1).alias("candidate_ids"), F.array(F.lit(1.0)).alias("candidate_scores"))


def conditional(local: DataFrame, everything: DataFrame, ids: str = "candidate_ids") -> DataFrame:
    """sparse with the first candidate where a query's candidates are all there are, as a set; else exhaustive, the first one positive.

    everything: one column, the ids of all candidates. Only queries with as many
    distinct candidates as there are meet them.
    """
    known = everything.toDF("id").distinct()
    n = known.agg(F.count(F.lit(1)).alias("__n"))
    sized = local.join(F.broadcast(n))  # one row
    large = sized.where(F.size(F.array_distinct(ids)) == F.col("__n")).select("query_id", F.explode(F.array_distinct(ids)).alias("id"))
    whole = large.join(known, "id").groupBy("query_id").agg(F.count(F.lit(1)).alias("__met"))
    marked = sized.join(whole, "query_id", "left")
    all_there = F.coalesce(F.col("__met") == F.col("__n"), F.lit(False))
    scores = F.transform(ids, lambda x, i: F.when(i == 0, 1.0).otherwise(0.0))
    return marked.select(
        "query_id", F.when(all_there, "sparse").otherwise("exhaustive").alias("mode"),
        F.when(all_there, F.slice(ids, 1, 1)).otherwise(F.col(ids)).alias("candidate_ids"),
        F.when(all_there, F.array(F.lit(1.0))).otherwise(scores).alias("candidate_scores"),
    )


def merge_extras(queries: DataFrame, grouped: DataFrame, key: str, extras: Sequence[str]) -> DataFrame:
    """Queries with the extra arrays of their judgments; a name that both have raises."""
    clash = sorted(set(extras) & set(queries.columns))
    if clash:
        raise ValueError(f"column names collide: {clash}")
    return queries.join(grouped.select(F.col("query_id").alias(key), *extras), key)


def aligned(qrels: DataFrame, queries: DataFrame, position: str = "pos", query: str = "query_id", key: str = "id") -> DataFrame:
    """qrels, once each place holds the query's id of the same place; a place without a partner or with another id raises."""
    both = qrels.withColumn("__here", F.lit(True)).join(queries.select(F.col(position).alias(position), F.col(key).cast("string").alias("__id")), position, "full")
    same = F.coalesce(F.col("__here") & (F.col(query).cast("string") == F.col("__id")), F.lit(False))
    said = F.raise_error(F.concat(F.lit("qrels and queries differ at "), F.col(position).cast("string"))).cast("boolean")
    return both.where(F.when(same, F.lit(True)).otherwise(said)).select(*qrels.columns)


def global_pool(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key by order, with its place among them as id."""
    return numbered(first_rows(rows, [key], order), [*order, key], place="id")


def private_candidates(queries: DataFrame, candidates: str, order: Sequence[str]) -> DataFrame:
    """Candidates of each query with running numbers over all queries."""
    flat = queries.select(*order, F.posexplode(candidates).alias("__at", "text"))
    return numbered(flat, [*order, "__at"], place="candidate_id").select(*order, "candidate_id", "text")

"""Offline analytics: step windows, running bests, rollups, losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import dot


def step_windows(steps: DataFrame, step: str, value: str, width: int) -> DataFrame:
    """Sum, mean, maximum and count of each `width` steps (numbered from 1); a short last window stays."""
    return steps.groupBy(F.floor((F.col(step) - 1) / width).cast("long").alias("window")).agg(F.sum(value).alias("total"), F.avg(value).alias("mean"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))


def running_best(df: DataFrame, key: str, step: str, value: str, threshold: float = 0.0, lower: bool = False) -> DataFrame:
    """The best value so far of each key, and how many steps ago it last got better by more than threshold."""
    w = W.partitionBy(key).orderBy(step)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    best, over = (F.min, past) if lower else (F.max, past)
    before = best(value).over(over)
    better = (before - F.col(value) if lower else F.col(value) - before) > threshold
    out = df.withColumn("best", best(value).over(w)).withColumn("__n", F.row_number().over(w)).withColumn("__better", before.isNull() | better)
    last = F.max(F.when(F.col("__better"), F.col("__n"))).over(w)
    return out.withColumn("patience", (F.col("__n") - last).cast("long")).drop("__n", "__better")


def totals(steps: DataFrame, values: Sequence[str], scale: float = 1e12) -> DataFrame:
    """Sums of columns in units of scale; without a row they are NaN."""
    nan = F.lit(float("nan"))
    return steps.agg(F.count(F.lit(1)).alias("n"), *[F.when(F.count(F.lit(1)) > 0, F.sum(v) / scale).otherwise(nan).alias(v) for v in values])


def side_shape(samples: DataFrame, batch: str, length: str, vision: str, extra: int = 0) -> DataFrame:
    """Of each batch: the longest text with extra tokens, the tokens of all, the vision tokens of all, the padded size."""
    n = F.col(length) + extra
    out = samples.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("longest"), F.sum(n).alias("tokens"), F.sum(vision).alias("vision"))
    return out.withColumn("padded", F.col("n") * F.col("longest"))


def source_mix(rows: DataFrame, batch: str, source: str, length: str, tokens: str, pixels: str) -> DataFrame:
    """Of each batch and source: rows, lengths, and rows that have visual tokens without pixels or pixels without tokens."""
    has_token, has_pixel = F.coalesce(F.col(tokens) > 0, F.lit(False)), F.coalesce(F.col(pixels) > 0, F.lit(False))
    return rows.groupBy(batch, source).agg(
        F.count(F.lit(1)).alias("n"), F.min(length).alias("shortest"), F.max(length).alias("longest"), F.avg(length).alias("mean"),
        F.count_if(has_token & ~has_pixel).alias("token_only"), F.count_if(has_pixel & ~has_token).alias("pixel_only"),
    )


def throughput(steps: DataFrame, group: str, loss: str, seconds: str, batch: int) -> DataFrame:
    """Mean loss and samples a second of each group of steps; no time at all gives no rate."""
    rate = F.when(F.sum(seconds) > 0, F.count(F.lit(1)) * batch / F.sum(seconds))
    return steps.groupBy(group).agg(F.avg(loss).alias("loss"), rate.alias("samples_per_second"))


def most_of_ranks(df: DataFrame, step: str, value: str) -> DataFrame:
    """The largest value of all ranks at each step."""
    return df.groupBy(step).agg(F.max(value).alias(value))


def keep_last(df: DataFrame, key: str, step: str, n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(step)))).where(F.col("__n") <= n).drop("__n")


def summary(metrics: DataFrame, modality: str, task: str, value: str) -> DataFrame:
    """Mean by task, by modality and over all, in one pass of grouping sets."""
    out = metrics.groupingSets([[modality, task], [modality], []], modality, task).agg(F.round(F.avg(value), 4).alias("mean"), F.count(F.lit(1)).alias("n"))
    return out.select(F.coalesce(modality, F.lit("all")).alias("modality"), F.coalesce(task, F.lit("all")).alias("task"), "mean", "n")


def contrastive_loss(scores: DataFrame, query: str, candidate: str, score: str, positive: str, temperature: float = 0.05, reduction: str = "none") -> DataFrame:
    """-log softmax of each query's positive among its candidates; reduction: none, mean or sum of all queries."""
    s = F.col(score) / temperature
    top = F.max(s).over(W.partitionBy(query))
    out = scores.withColumn("__s", s).withColumn("__m", top)
    each = out.groupBy(query).agg((F.log(F.sum(F.exp(F.col("__s") - F.col("__m")))) + F.max("__m") - F.max(F.when(F.col(candidate) == F.col(positive), F.col("__s")))).alias("loss"))
    return _reduced(each, reduction)


def _reduced(each: DataFrame, reduction: str) -> DataFrame:
    if reduction == "none":
        return each
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction {reduction!r}")
    return each.agg((F.avg if reduction == "mean" else F.sum)("loss").alias("loss"))


def in_batch_scores(queries: DataFrame, keys: DataFrame, batch: str, position: str, vector: str, per_query: int = 1) -> DataFrame:
    """Scores of each query of a batch with all keys of the batch; the positive of query i is key i * per_query.

    A batch is a bounded number of rows, so its pairs are the feature.
    """
    q = queries.select(batch, F.col(position).alias("query"), F.col(vector).alias("__q"))
    k = keys.select(batch, F.col(position).alias("candidate"), F.col(vector).alias("__k"))
    return q.join(k, batch).select(batch, "query", "candidate", dot(F.col("__q"), F.col("__k")).alias("score"), (F.col("query") * per_query).alias("positive"))


def choice_loss(scores: DataFrame, query: str, place: str, score: str, scale: float = 1.0) -> DataFrame:
    """Each query's loss among its own candidates, the first of which is right, its pick and whether that is right."""
    s = F.col(score) * scale
    out = scores.withColumn("__s", s).withColumn("__m", F.max(s).over(W.partitionBy(query)))
    pick = F.max_by(place, F.struct("__s", -F.col(place)))
    return out.groupBy(query).agg((F.log(F.sum(F.exp(F.col("__s") - F.col("__m")))) + F.max("__m") - F.max(F.when(F.col(place) == 0, F.col("__s")))).alias("loss"), pick.alias("pick")).withColumn("correct", F.col("pick") == 0)


def masked_mean(vectors: DataFrame, key: str, position: str, vector: str, mask: str) -> DataFrame:
    """Mean of each key's token vectors where the mask is set."""
    flat = vectors.select(key, mask, F.posexplode(vector).alias("dim", "x"))
    dims = flat.groupBy(key, "dim").agg((F.sum(F.col("x") * F.col(mask)) / F.greatest(F.sum(mask), F.lit(1e-9))).alias("x"))
    return dims.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda v: v["x"]).alias("mean"))

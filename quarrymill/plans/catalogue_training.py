"""Queries that read each training source, on stand-ins made of the part table, and the benchmark's index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import benchmarks, documents, training
from .registry import Tables, query


def _stand_in(t: Tables, source: training.Source) -> tuple[DataFrame, list[DataFrame]]:
    """A row for each part with all columns of a source; side tables, which lack every second key where keys may be missing."""
    sides = (source.query, source.positive, source.negative)
    captions = {s.body for s in sides if s.pick}
    media = [s.media for s in (source.query, source.positive) if s.media]
    columns = sorted({s.body for s in sides if s.body} | {key for key, *_ in source.lookups} | set(source.metadata))
    said = lambda c: F.concat(F.lit(f"{c} "), F.col("p_partkey").cast("string"))
    rows = t.part.select(*[(F.array(F.lit(" "), said(c)) if c in captions else said(c)).alias(c) for c in columns])
    tables = []
    for k, (key, side_key, missing) in enumerate(source.lookups):
        held = [media[k]] if len(source.lookups) > 1 else list(dict.fromkeys(media))
        there = t.part.where("p_partkey % 2 = 0") if missing == "skip" else t.part
        tables.append(there.select(said(key).alias(side_key), *[F.encode(F.lit("x"), "UTF-8").alias(m) for m in held]))
    return rows, tables


def _sql(name: str, source: training.Source) -> str:
    optional = any(m == "skip" for *_, m in source.lookups)

    def side(s: training.Side) -> str:
        quoted = s.instruction.strip().replace("'", "''")
        parts = [f"'{quoted}'"] if s.instruction else []
        body = f"'{s.body} ' || p_partkey::VARCHAR" if s.body else ""
        text = " || ' ' || ".join([*parts, *([body] if body else [])]) or "''"
        if s.token:
            shown = f"'{s.token}' || chr(10) || {text}"
            text = f"CASE WHEN p_partkey % 2 = 0 THEN {shown} ELSE {text} END" if optional else shown
        return f"({text})" + (" || chr(10)" if s.end == "ensure_single" and (s.body or s.instruction or s.token) else "")

    seen = "p_partkey % 2 = 0" if optional else "true"
    return f"SELECT {side(source.query)} AS query, {seen if source.query.media else 'false'} AS query_media, {side(source.positive)} AS positive, {seen if source.positive.media else 'false'} AS positive_media, {side(source.negative)} AS negative FROM part"


def _register(name: str) -> None:
    def read(t: Tables) -> DataFrame:
        source = training.get(name)
        out = training.aligned_media(training.samples(*_stand_in(t, source), source, name))
        return out.select(F.col("query.text").alias("query"), F.col("query.has_media").alias("query_media"), F.col("positive.text").alias("positive"), F.col("positive.has_media").alias("positive_media"), F.col("negative.text").alias("negative"))

    read.__name__ = f"source_{name}"
    query(_sql(name, training.get(name)))(read)


for _name in training.SOURCES:
    _register(_name)


INDEX = "b AS (SELECT *, row_number() OVER (ORDER BY dataset) - 1 AS k FROM (VALUES " + ", ".join(map(str, benchmarks.rows())) + ") b(dataset, folder, modality, task_type))"


def _numbered(t: Tables) -> DataFrame:
    """The benchmark's datasets by number, in the order of their names."""
    names = sorted(r[0] for r in benchmarks.rows())
    return benchmarks.index(t.spark).withColumn("k", F.array_position(F.array(*map(F.lit, names)), F.col("dataset")) - 1)


@query(f"WITH {INDEX} SELECT dataset, folder, modality, task_type, count(event_id) AS n_results FROM b LEFT JOIN events ON event_id % 80 = k GROUP BY ALL")
def benchmark_index(t: Tables) -> DataFrame:
    """The index, with how many results each dataset has; events stand in for results, some of datasets that the index lacks."""
    n = t.events.groupBy((F.col("event_id") % 80).alias("k")).agg(F.count("event_id").alias("n_results"))
    return _numbered(t).join(n, "k", "left").select("dataset", "folder", "modality", "task_type", F.coalesce("n_results", F.lit(0)).alias("n_results"))


@query(f"""WITH {INDEX}, r AS (SELECT modality, task_type, CASE modality WHEN 'visdoc' THEN max(value) ELSE avg(value) END AS value FROM b JOIN events ON event_id % 78 = k GROUP BY dataset, modality, task_type)
SELECT coalesce(modality, 'all') AS modality, coalesce(task_type, 'all') AS task_type, round(avg(value), 4) AS mean, count(*) AS n FROM r GROUP BY GROUPING SETS ((modality, task_type), (modality), ())""")
def benchmark_rollup(t: Tables) -> DataFrame:
    """Results of all datasets, here averages and maxima of events, by the metric that each modality counts."""
    per = t.events.groupBy((F.col("event_id") % 78).alias("k")).agg(F.avg("value").alias("hit_1"), F.max("value").alias("ndcg_5")).join(_numbered(t), "k")
    results = per.select("dataset", F.explode(F.create_map(F.lit("hit_1"), "hit_1", F.lit("ndcg_5"), "ndcg_5")).alias("metric", "value"))
    out = benchmarks.rollup(results, benchmarks.index(t.spark), {"image": "hit_1", "video": "hit_1", "visdoc": "ndcg_5"})
    return out.select("modality", F.col("task").alias("task_type"), "mean", "n")


OPTIONS = "'[''A. ' || p_brand || ''', ''B) ' || p_type || ''']'"


@query(f"""SELECT p_partkey, '<|image_pad|>' || chr(10) || p_name || CASE WHEN p_size % 2 = 0 THEN '   Options: ' || {OPTIONS} ELSE '' END AS query,
  CASE WHEN p_size % 2 = 1 THEN CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE p_name END WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type ELSE p_name END AS positive, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS source FROM part""")
def source_vidore_train(t: Tables) -> DataFrame:
    listed = F.concat(F.lit("['A. "), F.col("p_brand"), F.lit("', 'B) "), F.col("p_type"), F.lit("']"))
    n = F.col("p_size")
    rows = t.part.select(
        F.col("p_partkey").alias("page"), F.concat("p_name", F.lit("  ")).alias("query"), F.when(n % 2 == 0, listed).when(n % 4 == 1, "none").alias("options"),
        F.when(n % 3 == 0, "A").when(n % 3 == 1, "B").otherwise(F.col("p_name")).alias("answer"), F.when(n % 5 > 0, F.col("p_brand")).alias("source"), F.expr("CAST('x' AS binary)").alias("image"),
    )
    out = documents.question_samples(rows)
    return out.select(F.try_element_at("metadata", F.lit("page")).cast("long").alias("p_partkey"), F.col("query.text").alias("query"), F.col("positive.text").alias("positive"), F.coalesce(F.try_element_at("metadata", F.lit("source")), F.lit("")).alias("source"))


KINDS = list(documents.PAGE_PROMPTS)
PROMPTS = "(VALUES " + ", ".join(f"({k}, '{documents.QUERY_PROMPTS[n]}', '{documents.PAGE_PROMPTS[n]}')" for k, n in enumerate(KINDS)) + ") s(k, q, p)"


@query(f"SELECT coalesce(q, '') || p_name || chr(10) AS query, '<|image_pad|>' || chr(10) || coalesce(p || chr(10), '') AS positive FROM part LEFT JOIN {PROMPTS} ON k = p_partkey % 11")
def source_visrag_train(t: Tables) -> DataFrame:
    source = F.get(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 11).cast("int"))  # the eleventh has no instructions
    out = documents.source_samples(t.part.select(F.concat("p_name", F.lit(" ")).alias("query"), source.alias("source"), F.expr("CAST('x' AS binary)").alias("image")))
    return out.select(F.col("query.text").alias("query"), F.col("positive.text").alias("positive"))

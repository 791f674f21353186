"""Queries of the benchmark parsers, one or more for each text form, on stand-ins of the datasets' tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import parsers
from .registry import Tables, query

PICTURE = "CAST('x' AS binary)"


def _frames(n: str) -> str:
    return f"array_repeat({PICTURE}, {n})"


def _both_modes(rows: DataFrame, dataset: str, role: str, *columns: str | Column) -> DataFrame:
    out = None
    for mode in parsers.MODES:
        some = parsers.items(rows, dataset, role, mode).select("id", F.lit(mode).alias("mode"), "text", *columns)
        out = some if out is None else out.unionByName(some)
    return out


@query("""SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 5 = 0 THEN '<|image_pad|> ' || p_name
  ELSE '<|image_pad|>' || chr(10) || 'Answer it: ' || p_name || chr(10) END AS text, CASE WHEN p_partkey % 3 > 0 THEN 'image' END AS kind FROM part""")
def parsed_image_prompts(t: Tables) -> DataFrame:
    """With and without instruction and picture; older tokens become the one that is meant, or go."""
    rows = t.part.selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 5 > 0 THEN ' <|image_1|>Answer it: ' END AS qry_inst", "CASE WHEN p_partkey % 5 = 0 THEN concat('<image> ', p_name) ELSE p_name END AS qry_text",
        f"CASE WHEN p_partkey % 3 > 0 THEN {PICTURE} END AS image",
    )
    return parsers.items(rows, "A-OKVQA", "query").select("id", "text", F.col("media.kind").alias("kind"))


@query("SELECT page_id::VARCHAR AS id, url AS text, CASE WHEN page_id % 2 = 1 THEN 'visual_token_alignment_strip_without_media' ELSE '' END AS repairs FROM pages")
def parsed_text_queries(t: Tables) -> DataFrame:
    rows = t.pages.selectExpr("page_id AS id", "CASE WHEN page_id % 2 = 1 THEN concat('<image> ', url, '  ') ELSE url END AS qry_text")
    return parsers.items(rows, "WebQA", "query").select("id", "text", F.array_join("repairs", ",").alias("repairs"))


@query("""WITH said AS (SELECT conv_id, coalesce(string_agg(CASE role WHEN 'user' THEN 'Q: ' ELSE 'A: ' END || trim(text) || chr(10), '' ORDER BY turn) FILTER (trim(text, chr(9) || chr(10) || chr(13) || ' ') <> ''), '') AS folded FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS id, mode, 'Represent the given dialogue:' || CASE WHEN mode = 'canonical' AND (starts_with(folded, 'Q:') OR contains(folded, chr(10) || 'Q:') OR contains(folded, chr(10) || 'A:')) THEN chr(10) ELSE ' ' END || folded AS text FROM said, (VALUES ('canonical'), ('origin')) m(mode)""")
def parsed_dialogues(t: Tables) -> DataFrame:
    """Turns folded into lines; canonical mode puts the instruction on a line of its own."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    rows = t.conversations.groupBy(F.col("conv_id").alias("id")).agg(turns.alias("turns")).withColumn("qry_text", F.lit("Represent the given dialogue: ")).withColumn("qry_inst", F.lit(None).cast("string"))
    return _both_modes(rows, "VisDial", "query")


@query("""SELECT p_partkey::VARCHAR AS id, mode, '<|image_pad|>' || CASE mode WHEN 'canonical' THEN chr(10) ELSE ' ' END || CASE WHEN p_partkey % 3 = 0 THEN p_name
  WHEN p_partkey % 2 = 0 THEN 'Represent the image ' || p_name || chr(10) ELSE 'Represent the image' || chr(10) END AS text, CASE mode WHEN 'canonical' THEN 1 ELSE 0 END AS n_repairs FROM part, (VALUES ('canonical'), ('origin')) m(mode)""")
def parsed_image_targets(t: Tables) -> DataFrame:
    rows = t.part.selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 3 > 0 THEN '<|image_1|> Represent the image' END AS tgt_inst", "CASE WHEN p_partkey % 3 = 0 THEN concat('<image> ', p_name) WHEN p_partkey % 2 = 0 THEN p_name END AS tgt_text",
        "concat(p_name, '.jpg') AS tgt_img_path", f"{PICTURE} AS image",
    )
    return _both_modes(rows, "VisDial", "candidate", F.size("repairs").alias("n_repairs"))


@query("""WITH o AS (SELECT o_orderkey, 1 + o_orderkey % 12 AS n FROM orders)
SELECT o_orderkey::VARCHAR AS id, mode, CASE mode WHEN 'canonical' THEN '<|video_pad|>' || chr(10) || 'Recognize the breakfast type that the person is cooking in the video.' || chr(10) ELSE '<|video_pad|> Recognize the breakfast type that the person is cooking in the video. ' END AS text,
  n::INT AS total, CASE WHEN n > 8 THEN list_transform(range(0, 8), lambda i: CASE WHEN i = 7 THEN n - 1 ELSE floor(i * ((n - 1)::DOUBLE / 7::DOUBLE))::BIGINT END) ELSE range(0, n) END AS taken, CASE WHEN o_orderkey % 2 = 0 THEN 'v' || o_orderkey ELSE '' END AS video_id FROM o, (VALUES ('canonical'), ('origin')) m(mode)""")
def parsed_video_prompts(t: Tables) -> DataFrame:
    """Frames are sampled evenly; what is declared and not used up stays as metadata, unless it is null."""
    rows = t.orders.selectExpr("o_orderkey AS id", "'' AS qry_instruction", "'' AS qry_text", f"{_frames('CAST(1 + o_orderkey % 12 AS int)')} AS video", "CASE WHEN o_orderkey % 2 = 0 THEN concat('v', o_orderkey) END AS video_id", "CAST(NULL AS string) AS video_path")
    return _both_modes(rows, "Breakfast", "query", F.col("media.total").alias("total"), F.col("media.taken").alias("taken"), F.coalesce(F.try_element_at("metadata", F.lit("video_id")), F.lit("")).alias("video_id"))


@query("""SELECT p_partkey::VARCHAR AS id, mode, 'Find a video that contains the following visual content:' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE ' ' || p_name END || CASE WHEN mode = 'canonical' THEN chr(10) WHEN p_partkey % 4 > 0 THEN '  ' ELSE '' END AS text
FROM part, (VALUES ('canonical'), ('origin')) m(mode)""")
def parsed_captions(t: Tables) -> DataFrame:
    rows = t.part.selectExpr("p_partkey AS id", "CASE WHEN p_partkey % 4 = 0 THEN array('', NULL) ELSE array('', ' ', concat(p_name, '  '), p_brand) END AS caption")
    return _both_modes(rows, "MSR-VTT", "query")


ASKED = f"'<|video_pad|>' || chr(10) || '{parsers.QUESTION} ' || p_name || '?'"


@query(f"""SELECT p_partkey::VARCHAR AS id, 'NExTQA' AS dataset, {ASKED} || chr(10) || 'Options:' || chr(10) || '(A) ' || p_brand || chr(10) || '(B) ' || p_type || chr(10) || '(C) ' || p_size || chr(10) || '(D) no' || chr(10) || '(E) yes' || chr(10) AS text FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'MVBench', {ASKED} || chr(10) || 'Options:' || CASE WHEN p_size % 2 = 0 THEN '' ELSE chr(10) || '(A) ' || p_brand END || chr(10) AS text FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'Video-MME', {ASKED} || chr(10) || CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand || chr(10) || p_type END || chr(10) FROM part
UNION ALL SELECT p_partkey::VARCHAR, 'EgoSchema', {ASKED} || p_brand || ' ' || p_type || chr(10) FROM part UNION ALL SELECT p_partkey::VARCHAR, 'ActivityNetQA', {ASKED} || '? (A) yes; (B) no.' || chr(10) FROM part""")
def parsed_choices(t: Tables) -> DataFrame:
    """Questions with lettered options, options on lines, run on, and none."""
    rows = t.part.selectExpr(
        "p_partkey AS id", "concat(' ', p_name, '?  ') AS question", "concat(p_brand, ' ') AS a0", "p_type AS a1", "CAST(p_size AS string) AS a2", "'no' AS a3", "'yes' AS a4", f"{_frames('3')} AS video",
        "CASE WHEN p_size % 2 = 0 THEN array() ELSE array(p_brand, NULL) END AS candidates", "CASE WHEN p_size % 2 = 0 THEN NULL ELSE array(p_brand, p_type) END AS options", "array(p_brand, p_type) AS option",
    )
    out = None
    for dataset in ("NExTQA", "MVBench", "Video-MME", "EgoSchema", "ActivityNetQA"):
        some = parsers.items(rows, dataset, "query").select("id", F.lit(dataset).alias("dataset"), "text")
        out = some if out is None else out.unionByName(some)
    return out


@query("""SELECT c_custkey::VARCHAR AS id, CASE c_custkey % 3 WHEN 1 THEN '<|image_pad|>' || chr(10) || 'Select the video clip that aligns with the given text and image: ' WHEN 2 THEN '<|video_pad|>' || chr(10) || 'Find the clip that corresponds to the given sentence and video segment: '
  ELSE 'Find the clip that corresponds to the given text: ' END || c_name || chr(10) AS text, CASE c_custkey % 3 WHEN 1 THEN 'image' WHEN 2 THEN 'video' ELSE '' END AS kind FROM customer""")
def parsed_moments(t: Tables) -> DataFrame:
    """By text alone, with a picture, with a video (which goes before a picture)."""
    rows = t.customer.selectExpr("c_custkey AS id", "concat(c_name, '\n') AS query", f"CASE WHEN c_custkey % 3 > 0 THEN {PICTURE} END AS image", f"CASE WHEN c_custkey % 3 = 2 THEN {_frames('2')} WHEN c_custkey % 3 = 1 THEN array() END AS video")
    return parsers.items(rows, "MomentSeeker", "query").select("id", "text", F.coalesce("media.kind", F.lit("")).alias("kind"))


LINES = r"regexp_replace(regexp_replace(replace(replace('Find a document image that matches the given query: ' || q || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '\n+$', '') || chr(10)"


@query(f"""WITH d AS (SELECT doc_id, lang, 'on' || chr(13) || chr(10) || '  ' || coalesce(text, '') || ' ' || chr(9) AS q FROM documents)
SELECT doc_id::VARCHAR AS id, 'query' AS role, {LINES} AS text, lang AS kept FROM d UNION ALL SELECT doc_id::VARCHAR, 'candidate', '<|image_pad|>' || chr(10) || 'Understand the content of the provided document image.' || chr(10), source || '/' || doc_id FROM documents""")
def parsed_documents(t: Tables) -> DataFrame:
    queries = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("on\r\n  "), F.coalesce("text", F.lit("")), F.lit(" \t")).alias("query"), F.col("lang").alias("corpus_range"))
    pages = t.documents.select(F.col("doc_id").alias("id"), F.expr(PICTURE).alias("image"), F.concat_ws("/", "source", "doc_id").alias("path"))
    kept = lambda df, name: df.select("id", F.lit("query" if name == "corpus_range" else "candidate").alias("role"), "text", F.try_element_at("metadata", F.lit(name)).alias("kept"))
    return kept(parsers.items(queries, "ViDoSeek-page", "query"), "corpus_range").unionByName(kept(parsers.items(pages, "ViDoSeek-page", "candidate"), "path"))

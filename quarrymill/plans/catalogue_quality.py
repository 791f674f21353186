"""Queries of the data-quality operators, on a retrieval bundle with planted faults."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import media, quality, video
from ..operators.staging import spread
from .registry import Tables, query

JPEG, TEXT = "unhex('FFD8FF00')", "encode('plain')"

#: The bundle as SQL: customers ask, parts are candidates, orders judge.
BUNDLE = f"""
WITH q AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 41 = 0 THEN (c_custkey - 1)::VARCHAR ELSE c_custkey::VARCHAR END AS id,
  CASE WHEN c_custkey % 29 = 0 THEN 'row_' ELSE 'sample_' END || c_custkey::VARCHAR AS sample_id, CASE WHEN c_custkey % 23 = 0 THEN '  ' ELSE c_name END AS text,
  CASE WHEN c_custkey % 31 = 0 THEN ['asset_' || c_custkey::VARCHAR, 'x' || c_custkey::VARCHAR] ELSE ['asset_' || c_custkey::VARCHAR] END AS asset_ids,
  CASE WHEN c_custkey % 46 = 0 THEN [{JPEG}] WHEN c_custkey % 19 = 0 THEN [{JPEG}, {TEXT}, NULL] ELSE [] END AS images FROM customer),
c AS (SELECT p_partkey AS k, p_partkey::VARCHAR AS id, 'sample_' || p_partkey::VARCHAR AS sample_id, p_name AS text, ['asset_' || p_partkey::VARCHAR] AS asset_ids,
  CASE WHEN p_partkey % 17 = 0 THEN [{TEXT}] ELSE [] END AS images FROM part),
r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 43 = 0 THEN 'rel' ELSE 'relation_' END || o_orderkey::VARCHAR AS relation_id, o_custkey::VARCHAR AS query_id,
  CASE WHEN o_orderkey % 17 = 0 THEN [] ELSE list_transform(items, lambda x: CASE WHEN x.l_partkey % 53 = 0 THEN 'gone_' || x.l_partkey::VARCHAR ELSE x.l_partkey::VARCHAR END) END AS candidate_ids,
  CASE WHEN o_orderkey % 17 = 0 THEN [] WHEN o_orderkey % 13 = 0 THEN list_transform(items, lambda x: 1.0)[2:] ELSE list_transform(items, lambda x: CASE WHEN x.l_quantity > 25 THEN 1.0 ELSE 0.0 END) END AS candidate_scores
  FROM orders JOIN (SELECT l_orderkey, list({{'l_linenumber': l_linenumber, 'l_partkey': l_partkey, 'l_quantity': l_quantity}} ORDER BY l_linenumber, l_partkey, l_quantity) AS items FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


def _message(kind: str, value: str) -> str:
    return f"'{kind}' || {value}"


def _prefixed(check: int, table: str, field: str, item: str, expected: str, relation: str = "NULL") -> str:
    return f"""SELECT {check} AS "check", 'invalid_identifier' AS reason_code, NULL::VARCHAR AS sample_id, {relation}::VARCHAR AS relation_id, NULL::VARCHAR AS asset_id,
  'Field ''{field}'' must start with ''{expected}'', got ''' || x || '''.' AS message FROM (SELECT *, {item} AS x FROM {table}) WHERE x <> '' AND NOT starts_with(x, '{expected}')"""


FOUND = BUNDLE + ", found AS (" + " UNION ALL ".join(
    [
        *[f"""SELECT {n} AS "check", 'schema_required_field_missing' AS reason_code, sample_id, NULL::VARCHAR AS relation_id, NULL::VARCHAR AS asset_id, 'Missing required field: id' AS message FROM {t} WHERE trim(coalesce(id, '')) = ''""" for n, t in enumerate("qc")],
        *[f"""SELECT {2 + n}, 'id_collision', sample_id, NULL, NULL, 'Duplicate identifier detected in id: ' || id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS rn FROM {t} WHERE coalesce(id, '') <> '') WHERE rn > 1""" for n, t in enumerate("qc")],
        *[_prefixed(4 + n, t, "sample_id", "sample_id", "sample_") for n, t in enumerate("qc")],
        *[_prefixed(6 + n, t, "asset_ids", "unnest(asset_ids)", "asset_") for n, t in enumerate("qc")],
        _prefixed(8, "r", "relation_id", "relation_id", "relation_", "relation_id"),
        """SELECT 9, 'relation_cardinality_mismatch', NULL, relation_id, NULL, 'Qrels row has mismatched candidate_ids and candidate_scores lengths: ' || len(candidate_ids)::VARCHAR || ' != ' || len(candidate_scores)::VARCHAR FROM r WHERE len(candidate_ids) <> len(candidate_scores)""",
        *[f"""SELECT {10 + n}, 'schema_modality_constraint_failed', sample_id, NULL, NULL, 'Row has neither usable text nor media payload.' FROM {t} WHERE trim(coalesce(text, '')) = '' AND len(images) = 0""" for n, t in enumerate("qc")],
        *[f"""SELECT {12 + n}, 'broken_media', sample_id, NULL, asset_ids[i], 'Unreadable media payload at index ' || (i - 1)::VARCHAR FROM (SELECT *, unnest(range(1, len(images) + 1)) AS i FROM {t}) WHERE NOT starts_with(hex(images[i]), 'FFD8FF')""" for n, t in enumerate("qc")],
        """SELECT 14, 'empty_qrels', NULL, NULL, NULL, 'Retrieval dataset has no qrels rows.' WHERE (SELECT count(*) FROM r) = 0""",
        """SELECT 14, 'missing_query_link', NULL, relation_id, NULL, 'Qrels references missing query: ' || query_id FROM r WHERE query_id NOT IN (SELECT id FROM q WHERE id IS NOT NULL)""",
        """SELECT 14, 'empty_qrels', NULL, relation_id, NULL, 'Qrels row contains no candidate ids.' FROM r WHERE len(candidate_ids) = 0""",
        """SELECT 14, 'missing_candidate_link', NULL, relation_id, NULL, 'Qrels references missing candidate: ' || x FROM (SELECT relation_id, unnest(candidate_ids) AS x FROM r) WHERE x NOT IN (SELECT id FROM c)""",
        """SELECT 14, 'invalid_positive', NULL, relation_id, NULL, 'Qrels row contains no positive candidate score.' FROM r WHERE len(candidate_ids) > 0 AND NOT list_bool_or(list_append(list_transform(candidate_scores, lambda s: s > 0), false))""",
    ]
) + "), hinted AS (SELECT *, CASE reason_code WHEN 'broken_media' THEN 'quarantine' ELSE 'block' END AS hint FROM found)"


def _bundle(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, text = F.col("c_custkey"), lambda c: c.cast("string")
    jpeg, plain, none = F.unhex(F.lit("FFD8FF00")), F.encode(F.lit("plain"), "UTF-8"), F.array().cast("array<binary>")
    q = t.customer.select(
        k.alias("k"), F.when(k % 37 == 0, None).when(k % 41 == 0, text(k - 1)).otherwise(text(k)).alias("id"),
        F.concat(F.when(k % 29 == 0, "row_").otherwise("sample_"), text(k)).alias("sample_id"), F.when(k % 23 == 0, "  ").otherwise(F.col("c_name")).alias("text"),
        F.when(k % 31 == 0, F.array(F.concat(F.lit("asset_"), text(k)), F.concat(F.lit("x"), text(k)))).otherwise(F.array(F.concat(F.lit("asset_"), text(k)))).alias("asset_ids"),
        F.when(k % 46 == 0, F.array(jpeg)).when(k % 19 == 0, F.array(jpeg, plain, F.lit(None).cast("binary"))).otherwise(none).alias("images"),
    )
    p = F.col("p_partkey")
    c = t.part.select(p.alias("k"), text(p).alias("id"), F.concat(F.lit("sample_"), text(p)).alias("sample_id"), F.col("p_name").alias("text"), F.array(F.concat(F.lit("asset_"), text(p))).alias("asset_ids"), F.when(p % 17 == 0, F.array(plain)).otherwise(none).alias("images"))
    items = t.lineitem.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))
    o = F.col("o_orderkey")
    ids = F.transform("items", lambda x: F.when(x["l_partkey"] % 53 == 0, F.concat(F.lit("gone_"), text(x["l_partkey"]))).otherwise(text(x["l_partkey"])))
    scores = F.transform("items", lambda x: F.when(x["l_quantity"] > 25, 1.0).otherwise(0.0))
    ones = F.transform("items", lambda x: F.lit(1.0))
    r = t.orders.join(items, o == F.col("l_orderkey")).select(
        o.alias("k"), F.concat(F.when(o % 43 == 0, "rel").otherwise("relation_"), text(o)).alias("relation_id"), text(F.col("o_custkey")).alias("query_id"),
        F.when(o % 17 == 0, F.array().cast("array<string>")).otherwise(ids).alias("candidate_ids"),
        F.when(o % 17 == 0, F.array().cast("array<double>")).when(o % 13 == 0, F.slice(ones, F.lit(2), F.size(ones))).otherwise(scores).alias("candidate_scores"),
    )
    return q, c, r


def _found(t: Tables) -> DataFrame:
    return quality.bundle(*_bundle(t), "orders", order=("k",))


@query(FOUND + ' SELECT "check"::INTEGER AS "check", reason_code, sample_id, relation_id, asset_id, message FROM found')
def quality_findings(t: Tables) -> DataFrame:
    return _found(t).select("check", "reason_code", "sample_id", "relation_id", "asset_id", "message")


@query(FOUND + " SELECT reason_code, count(*) AS n FROM found GROUP BY reason_code")
def findings_by_reason(t: Tables) -> DataFrame:
    return quality.by_reason(_found(t))


DECIDED = FOUND + """, decided AS (SELECT 'orders' AS dataset_name, CASE WHEN asset_id IS NOT NULL THEN 'asset' WHEN relation_id IS NOT NULL THEN 'relation' WHEN sample_id IS NOT NULL THEN 'sample' ELSE 'dataset' END AS target_type,
  coalesce(asset_id, relation_id, sample_id, 'orders') AS target_id, 'quarantine' AS action, list_sort(list(DISTINCT reason_code)) AS reasons, count(*) AS n_findings, list_sort(list(message)) AS messages FROM hinted GROUP BY ALL)"""


@query(DECIDED + " SELECT * FROM decided")
def quality_decisions(t: Tables) -> DataFrame:
    return quality.decisions(_found(t))


@query(DECIDED + """ SELECT a.action, b.target_type, count(d.target_id) AS n FROM (VALUES ('keep'), ('drop'), ('quarantine')) a(action) JOIN (VALUES ('dataset'), ('sample'), ('asset'), ('relation')) b(target_type) ON true
  LEFT JOIN decided d ON d.action = a.action AND d.target_type = b.target_type GROUP BY ALL""")
def decision_buckets(t: Tables) -> DataFrame:
    return quality.buckets(quality.decisions(_found(t)))


@query(FOUND + """ SELECT count(*) AS n_findings, count(*) > 0 AS blocking, count(*) = 0 AS ready, (SELECT string_agg(reason_code || '=' || n::VARCHAR, ',' ORDER BY reason_code) FROM (SELECT reason_code, count(*) AS n FROM found GROUP BY ALL)) AS reasons,
  (SELECT string_agg(message, '|' ORDER BY reason_code, message, sample_id NULLS FIRST, relation_id NULLS FIRST, asset_id NULLS FIRST) FROM (SELECT * FROM found ORDER BY reason_code, message, sample_id NULLS FIRST, relation_id NULLS FIRST, asset_id NULLS FIRST LIMIT 5)) AS first FROM found""")
def audit_rollup(t: Tables) -> DataFrame:
    """Counts, readiness and the first five findings (that limit is the feature)."""
    out = quality.audit(_found(t))
    reasons = F.array_join(F.transform("reason_counts", lambda x: F.concat(x["reason_code"], F.lit("="), x["n"].cast("string"))), ",")
    return out.select("n_findings", "blocking", "ready", reasons.alias("reasons"), F.array_join(F.transform("representative", lambda x: x["message"]), "|").alias("first"))


@query("SELECT page_id, 'Unreadable media payload at index 0' AS message FROM pages WHERE page_id % 3 <> 0")
def media_decode(t: Tables) -> DataFrame:
    """Two of three payloads are no pictures; null ones don't count."""
    magic = F.when(F.col("page_id") % 3 == 0, F.unhex(F.lit("89504E47"))).otherwise(F.unhex(F.lit("3C68")))
    rows = t.pages.select(F.col("page_id").cast("string").alias("sample_id"), F.concat(magic, F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("image"))
    return quality.broken_media(rows, "pages").select(F.col("sample_id").cast("long").alias("page_id"), "message")


@query("""SELECT 'empty_text' AS reason_code, 'sample_row_' || conv_id::VARCHAR || '_' || turn::VARCHAR AS sample_id FROM conversations WHERE trim(coalesce(CASE WHEN turn % 5 = 0 THEN ' ' ELSE role END, 'x')) = ''
  UNION ALL SELECT 'schema_required_field_missing', 'sample_row_' || conv_id::VARCHAR || '_' || turn::VARCHAR FROM conversations WHERE conv_id % 7 = 0
  UNION ALL SELECT CASE WHEN turn % 2 = 0 THEN 'broken_media' ELSE 'schema_required_field_missing' END, 'sample_row_' || conv_id::VARCHAR || '_' || turn::VARCHAR FROM (SELECT * FROM conversations ORDER BY conv_id, turn LIMIT 64) WHERE turn % 3 > 0""")
def train_document_findings(t: Tables) -> DataFrame:
    """Text fields of all rows, pictures of the first 64 (that limit is the validator)."""
    image = F.when(F.col("turn") % 3 == 0, F.unhex(F.lit("FFD8FF"))).when(F.col("turn") % 2 == 0, F.encode(F.lit("no"), "UTF-8"))
    rows = t.conversations.select("conv_id", "turn", F.when(F.col("turn") % 5 == 0, " ").otherwise(F.col("role")).alias("query"), F.when(F.col("conv_id") % 7 == 0, None).otherwise("s").alias("source"), image.alias("image"))
    return quality.train_documents(rows, "visrag_train", "talks", ("conv_id", "turn")).select("reason_code", "sample_id")


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'en')")
def dangling_references(t: Tables) -> DataFrame:
    found = quality.dangling(t.labels.select("doc_id", F.col("doc_id").cast("string").alias("relation_id")), "doc_id", t.documents.where("lang <> 'en'"), "doc_id", "labels")
    return found.select(F.col("relation_id").cast("long").alias("doc_id"))


@query("SELECT page_id FROM pages WHERE trim(coalesce(CASE WHEN page_id % 5 = 0 THEN chr(9) || ' ' ELSE url END, '')) IN ('', chr(9))")
def empty_texts(t: Tables) -> DataFrame:
    rows = t.pages.select(F.col("page_id").cast("string").alias("sample_id"), F.when(F.col("page_id") % 5 == 0, "\t ").otherwise(F.col("url")).alias("url"))
    return quality.empty_text(rows, "url", "pages").select(F.col("sample_id").cast("long").alias("page_id"))


@query(FOUND + " SELECT count(*) AS n, count(DISTINCT message) AS messages FROM found")
def findings_round_trip(t: Tables) -> DataFrame:
    """Findings written as JSON lines and read again."""
    return quality.from_json(quality.to_json(_found(t).drop("check"))).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("message").alias("messages"))


@query(FOUND + ", codes AS (SELECT * FROM (VALUES " + ", ".join(str((k, *v)) for k, v in quality.REASONS.items()) + """) r(reason_code, severity, scope, decision_hint))
SELECT c.*, count(f.reason_code) AS n FROM codes c LEFT JOIN found f USING (reason_code) GROUP BY ALL""")
def reason_codes(t: Tables) -> DataFrame:
    """What the codes mean, and how many findings of each the bundle has."""
    n = quality.by_reason(_found(t))
    return quality.reasons(t.spark).join(n, "reason_code", "left").withColumn("n", F.coalesce("n", F.lit(0)))


HINTS = "CASE WHEN doc_id % 7 = 0 THEN 'block' WHEN doc_id % 5 = 0 THEN 'quarantine' WHEN doc_id % 3 = 0 THEN 'drop' ELSE 'keep' END"


@query(f"""WITH f AS (SELECT source AS sample_id, 'r' || (doc_id % 4)::VARCHAR AS reason_code, {HINTS} AS hint FROM documents WHERE source <> 'src0' UNION ALL SELECT 'd' || doc_id::VARCHAR, 'r' || (doc_id % 4)::VARCHAR, {HINTS} FROM documents)
SELECT sample_id AS target_id, CASE max(CASE hint WHEN 'keep' THEN 1 WHEN 'drop' THEN 2 ELSE 3 END) WHEN 1 THEN 'keep' WHEN 2 THEN 'drop' ELSE 'quarantine' END AS action, list_sort(list(DISTINCT reason_code)) AS reasons, count(*) AS n_findings FROM f GROUP BY sample_id""")
def graded_decisions(t: Tables) -> DataFrame:
    """Targets with hints of all kinds: the gravest decides, so some are kept and some dropped."""
    text = lambda x: F.col(x).cast("string")
    rows = t.documents.select(F.explode(F.filter(F.array(F.when(F.col("source") != "src0", F.col("source")), F.concat(F.lit("d"), text("doc_id"))), lambda x: x.isNotNull())).alias("sample_id"), F.concat(F.lit("r"), F.col("doc_id") % 4).alias("reason_code"), F.expr(HINTS).alias("decision_hint"))
    found = rows.select("reason_code", F.lit("error").alias("severity"), F.lit("sample").alias("scope"), "decision_hint", F.lit("documents").alias("dataset_name"), F.lit("m").alias("message"), "sample_id", F.lit(None).cast("string").alias("relation_id"), F.lit(None).cast("string").alias("asset_id"))
    return quality.decisions(found).select("target_id", "action", "reasons", "n_findings")


def _pictures(text: pd.Series, which: pd.Series) -> pd.Series:
    """Two pictures of a text, the second whole, cut, with a byte changed or missing."""
    def made(t: str, k: int) -> list[bytes | None]:
        whole = media.png_of((t or "").encode(), 64)
        changed = whole[:-17] + bytes([whole[-17] ^ 1]) + whole[-16:]
        return [whole, (whole, whole[:-5], changed, None)[k % 4]]

    return pd.Series([made(t, k) for t, k in zip(text, which, strict=True)])


@query("SELECT doc_id::VARCHAR AS source_key, lang AS frame_unit_key, CASE doc_id % 4 WHEN 1 THEN 'truncated' WHEN 2 THEN 'checksum' ELSE 'missing_frame' END AS reason, 'frame 1' AS place, source AS source_path FROM documents WHERE doc_id % 4 > 0")
def bad_media_rows(t: Tables) -> DataFrame:
    """Pictures made of the texts, of which some are damaged: each is found, with its place and what is wrong."""
    rows = t.documents.select("doc_id", "lang", "source", F.pandas_udf(_pictures, "array<binary>")("text", "doc_id").alias("frames"))
    found = media.bad_media(rows, "frames", "documents", "train", "doc_id", "lang", "source")
    return found.select("source_key", "frame_unit_key", "reason", F.regexp_extract("error", r"^frame \d+", 0).alias("place"), "source_path")


def _videos(text: pd.Series, which: pd.Series) -> pd.Series:
    """A video of a text's words, of which every seventh is cut and every eleventh missing."""
    def made(t: str, k: int) -> bytes | None:
        whole = video.avi_of([w.encode() for w in (t or "").split()[:40]] or [b"-"], 10 + k % 15, 4)
        return None if k % 11 == 0 else whole[:-9] if k % 7 == 0 else whole

    return pd.Series([made(t, k) for t, k in zip(text, which, strict=True)])


@query("""WITH d AS (SELECT doc_id, greatest(1, least(40, len(list_filter(string_split_regex(coalesce(c_name, ''), '\\s+'), lambda x: x <> '')))) AS n FROM (SELECT c_custkey AS doc_id, c_name || ' ' || repeat('w ', (c_custkey % 60)::INT) AS c_name FROM customer))
SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN NULL ELSE n END::BIGINT AS frames, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL ELSE 10.0 + doc_id % 15 END::DOUBLE AS fps, CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL ELSE (n - 1) // 4 + 1 END::INT AS n_keyframes,
  CASE WHEN doc_id % 11 = 0 OR doc_id % 7 = 0 THEN NULL ELSE list_transform([0, (n - 1) // 2, n - 1], lambda i: (i - i % 4)::BIGINT) END AS begins, CASE WHEN doc_id % 11 > 0 AND doc_id % 7 = 0 THEN 'truncated' END AS reason FROM d""")
def video_probe(t: Tables) -> DataFrame:
    """Frames, rate and key frames of containers, and where decoding of three frames would begin."""
    words = F.concat(F.col("c_name"), F.lit(" "), F.repeat(F.lit("w "), (F.col("c_custkey") % 60).cast("int")))
    rows = spread(t.customer, "c_custkey").select(F.col("c_custkey").alias("doc_id"), F.pandas_udf(_videos, "binary")(words, "c_custkey").alias("video"))
    p = rows.select("doc_id", video.probe_video(F.col("video")).alias("p")).select("doc_id", "p.*")
    n = F.col("frames")
    begins = F.transform(video.seek_plan(F.array(F.lit(0).cast("long"), F.floor((n - 1) / 2), n - 1), F.col("keyframes")), lambda x: x["from"])
    return p.select("doc_id", "frames", "fps", F.when(n.isNotNull(), F.size("keyframes")).alias("n_keyframes"), F.when(n.isNotNull(), begins).alias("begins"), "reason")

"""Queries of scalar functions, row filters, aggregates and source conversions, on stand-ins of the sources' tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import analytics, collate, dedup, exclude, hook, lookup, qrels, scan
from ..operators.staging import shared_dir
from ..sources import archives, sinks
from . import converters
from .registry import Tables, query

# Scalars.


@query(r"""SELECT conv_id, turn, regexp_replace(regexp_replace(CASE WHEN starts_with(t, 'Query: ') THEN t[8:] ELSE t END, '\n+\z', ''), '\A ', '') AS text FROM (
  SELECT conv_id, turn, trim(replace(CASE WHEN turn % 2 = 0 THEN '<image>Query: ' ELSE '<image> ' END || text, '<image>', '')) AS t FROM conversations)""")
def recover_question(t: Tables) -> DataFrame:
    shown = F.concat(F.when(F.col("turn") % 2 == 0, "<image>Query: ").otherwise("<image> "), "text")
    return t.conversations.select("conv_id", "turn", text.recover_question(shown, ["<image>"], "Query: ").alias("text"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN p_type ELSE p_brand || ' ' || p_type END AS text FROM part")
def join_texts(t: Tables) -> DataFrame:
    k = F.col("p_partkey") % 3
    return t.part.select("p_partkey", text.join_texts(F.when(k == 1, "").otherwise(F.col("p_brand")), F.when(k == 0, None).otherwise(F.col("p_type")), "space").alias("text"))


@query("SELECT p_partkey, 'Name: ' || p_name || chr(10) || p_brand || ' (' || p_size::VARCHAR || ')' AS text FROM part")
def template_render(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.render("Name: {name}\n{brand} ({size})", name=F.col("p_name"), brand=F.col("p_brand"), size=F.col("p_size")).alias("text"))


@query("SELECT page_id, '<image> ' || url || chr(10) AS text FROM pages")
def compose_prompt(t: Tables) -> DataFrame:
    return t.pages.select("page_id", text.compose_prompt(F.col("url"), "<image>", extra_blank=True).alias("text"))


@query("SELECT page_id, regexp_extract(url, '[^/]*$') AS base, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)[.][^.]*$', '\\1') AS stem, CASE WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '.[.][^.]*$') THEN lower(regexp_extract(regexp_extract(url, '[^/]*$'), '[.][^.]*$')) ELSE '' END AS ext FROM (SELECT page_id, url || '/clip.' || page_id::VARCHAR || '.MP4' AS url FROM pages)")
def path_parts(t: Tables) -> DataFrame:
    path = F.concat("url", F.lit("/clip."), F.col("page_id").cast("string"), F.lit(".MP4"))
    return t.pages.select("page_id", text.basename(path).alias("base"), text.stem(path).alias("stem"), text.extension(path).alias("ext"))


@query("SELECT l_orderkey, l_linenumber, printf('v_%06d_%06d', l_orderkey, l_linenumber) AS id, 'v#row=' || l_orderkey::VARCHAR AS row_key, 'v#page=' || l_linenumber::VARCHAR AS page_key FROM lineitem")
def padded_keys(t: Tables) -> DataFrame:
    n = F.col("l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", text.padded_id(F.lit("v"), F.col("l_orderkey"), n).alias("id"), text.row_key(F.lit("v"), F.col("l_orderkey")).alias("row_key"), text.page_key(F.lit("v"), n).alias("page_key"))


@query("SELECT doc_id, list_transform(range(4), lambda i: i * n_chars // 4) AS indices, [least(greatest(floor(0.5 * n_chars / 100)::BIGINT, 0), n_chars), least(greatest(ceil(2.5 * n_chars / 100)::BIGINT, floor(0.5 * n_chars / 100)::BIGINT), n_chars)] AS frames FROM documents")
def frame_sampling(t: Tables) -> DataFrame:
    """Strided indices, and the frames of a segment from 0.5 to 2.5 seconds at n / 100 frames a second."""
    n = F.col("n_chars")
    frames = arrays.frame_range(F.lit(0.5), F.lit(2.5), n / 100, n)
    return t.documents.select("doc_id", arrays.stride_indices(n, 4).alias("indices"), F.array(frames["first"], frames["last"]).alias("frames"))


@query("SELECT p_partkey, [p_size / r, (p_size + 7) / r] AS at FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 5 = 0 THEN 1.0 ELSE p_partkey % 5 END::DOUBLE AS r FROM part)")
def frame_timestamps(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", arrays.timestamps(F.array("p_size", F.col("p_size") + 7), (F.col("p_partkey") % 5).cast("double")).alias("at"))


@query("SELECT p_partkey, [greatest(p_size - 10, 0), 0, least(p_size + 20, 50), 30] AS box FROM part")
def clipped_boxes(t: Tables) -> DataFrame:
    box = arrays.clip_box(F.col("p_size") - 10, F.lit(-5), F.lit(30), F.lit(35), F.lit(50), F.lit(40))
    return t.part.select("p_partkey", F.array(box["x0"], box["y0"], box["x1"], box["y1"]).alias("box"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS first, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand || '; ' || p_type END AS joined, coalesce(CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_type END, 'none') AS second FROM part")
def caption_pick(t: Tables) -> DataFrame:
    captions = F.array(F.when(F.col("p_partkey") % 2 == 0, "  ").otherwise(F.col("p_brand")), F.col("p_type"))
    shown = F.filter(captions, lambda c: F.trim(c) != "")
    return t.part.select("p_partkey", arrays.pick_caption(captions).alias("first"), arrays.pick_caption(captions, "all").alias("joined"), arrays.element(shown, 1, F.lit("none")).alias("second"))


@query("SELECT p_partkey, coalesce(nullif(regexp_extract(p_name, '([0-9]+)[^0-9]*$', 1), ''), NULL)::BIGINT AS number, p_partkey % 2 = 0 AS flag, CASE p_partkey % 3 WHEN 0 THEN 'query' WHEN 1 THEN 'positive' ELSE 'negative' END AS side FROM part")
def parsed_names(t: Tables) -> DataFrame:
    """The last number of a name, a flag and a side in words."""
    k = F.col("p_partkey")
    return t.part.select("p_partkey", text.last_number(F.col("p_name")).alias("number"), text.boolean(F.when(k % 2 == 0, " Yes").otherwise("OFF")).alias("flag"), text.side(F.when(k % 3 == 0, "QRY").when(k % 3 == 1, " tgt ").otherwise("neg")).alias("side"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 3 THEN NULL ELSE [p_brand, p_type, p_name][1 + p_partkey % 3] END AS answer FROM part")
def resolved_answers(t: Tables) -> DataFrame:
    """Answers given as a letter, a place or the option's own text."""
    k = F.col("p_partkey")
    place = (k % 3).cast("int")
    options = F.array("p_brand", "p_type", "p_name")
    letter = F.element_at(F.array(F.lit("(a)"), F.lit("B."), F.lit("c")), place + 1)
    own = F.upper(F.element_at(options, place + 1))
    said = F.when(k % 4 == 0, letter).when(k % 4 == 1, place.cast("string")).when(k % 4 == 2, own).otherwise("nothing of these")
    return t.part.select("p_partkey", text.resolve_answer(said, options).alias("answer"))


@query("SELECT l_orderkey, l_linenumber, round_even(l_orderkey % 100 / 8.0 + 3, 1)::DOUBLE AS duration FROM lineitem")
def segment_duration(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", text.duration(F.lit(1.0), 4.0 + F.col("l_orderkey") % 100 / 8.0).alias("duration"))


@query("SELECT p_partkey, '{\"brand\":\"' || p_brand || '\",\"type\":\"' || p_type || '\"}' AS answers FROM part")
def sorted_json(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.sorted_json(F.create_map(F.lit("type"), "p_type", F.lit("brand"), "p_brand")).alias("answers"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '<image>' || chr(10) || b WHEN page_id % 3 = 1 THEN b ELSE '<image>' END AS text FROM (SELECT page_id, 'See ' || url AS b FROM pages)")
def own_line_token(t: Tables) -> DataFrame:
    """The visual token on its own line with media, gone without; a text of the token alone keeps it."""
    k = F.col("page_id") % 3
    raw = F.when(k == 2, "<image>").otherwise(F.concat(F.lit("See <image>"), "url", F.lit(" \n")))
    return t.pages.select("page_id", text.own_line(raw, "<image>", k != 1).alias("text"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url || chr(10) || 'Answer: yes' ELSE 'Answer: yes' END AS text, url AS restored FROM pages")
def side_rules(t: Tables) -> DataFrame:
    k = F.col("page_id") % 2
    said = F.when(k == 0, F.concat("url", F.lit("  Answer: yes"))).otherwise("Answer: yes")
    return t.pages.select("page_id", text.newline_once(text.horizontal_tail(F.concat(said, F.lit(" \t"))), "Answer:").alias("text"), text.restore_if_empty(F.when(k == 0, " \n").otherwise(F.col("url")), F.col("url")).alias("restored"))


@query("SELECT n_nationkey, CASE n_name WHEN 'NATION_1' THEN 'first' ELSE n_name END AS name FROM nation")
def aliased_names(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", text.alias(F.col("n_name"), {"NATION_1": "first"}).alias("name"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norm(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", F.round(arrays.norm(F.col("embedding")), 6).alias("norm"))


@query("SELECT doc_id, 3 * (p * (8.0 * 32 * 32 + 4.0 * 32 * 64) + 4.0 * 32 * p * least(p, 49.0)) AS flops FROM (SELECT doc_id, n_chars::DOUBLE AS p FROM documents)")
def flops_vision(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", arrays.vision_flops(F.col("n_chars"), 3, 32, 64, 49).alias("flops"))


# Row filters and aggregates.


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def empty_sides_dropped(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    rows = t.orders.select("o_orderkey", F.when(k % 5 == 0, "").otherwise("q").alias("qry"), F.when(k % 10 == 0, "").alias("qry_image"), F.when(k % 7 == 0, None).otherwise("p").alias("pos"), F.lit("").alias("pos_image"))
    return converters.without_empty_sides(rows, ("qry", "qry_image"), ("pos", "pos_image")).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'no page' WHEN o_orderkey % 4 = 1 THEN 'several pages' WHEN o_orderkey % 6 = 2 THEN 'no document' END AS reason, CASE WHEN o_orderkey % 4 >= 2 THEN o_custkey END AS page FROM orders""")
def evidence_pages(t: Tables) -> DataFrame:
    """Rows with exactly one evidence page in a document that is there; all others with their reason."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    listed = F.when(k % 4 == 0, "[]").when(k % 4 == 1, F.concat(F.lit("[1, "), c, F.lit("]"))).otherwise(F.concat(F.lit("["), c, F.lit("]")))
    there = t.orders.where("o_orderkey % 6 <> 2").select(F.col("o_orderkey").alias("doc")).distinct()
    return converters.single_evidence(t.orders.select("o_orderkey", k.alias("doc"), listed.alias("pages")), "pages", "doc", there).select("o_orderkey", "reason", "page")


@query("""SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS keys, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity) AS scores FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) WHERE l_partkey % 3 <> 0 GROUP BY l_orderkey""")
def trimmed_elements(t: Tables) -> DataFrame:
    """Array elements that have a valid key, parallel arrays kept aligned; rows with none left go."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    packed = qrels.group_pairs(rows, "l_orderkey", "l_partkey", "l_quantity", ["l_linenumber"])
    valid = t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("key"))
    return converters.trim_elements(packed, "query_id", "candidate_ids", ["candidate_scores"], valid).select(F.col("query_id").alias("l_orderkey"), F.col("candidate_ids").alias("keys"), F.col("candidate_scores").alias("scores"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN [p_brand] ELSE [p_brand, p_type] END AS candidates FROM part")
def nonblank_candidates(t: Tables) -> DataFrame:
    second = F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_type"))
    return t.part.select("p_partkey", converters.real_candidates(F.array("p_brand", second), drop=True).alias("candidates"))


@query("SELECT page_id FROM pages WHERE page_id % 3 <> 2")
def video_files(t: Tables) -> DataFrame:
    ext = F.element_at(F.array(F.lit(".MP4"), F.lit(".webm"), F.lit(".txt")), (F.col("page_id") % 3 + 1).cast("int"))
    return converters.video_files(t.pages.select("page_id", F.concat(F.lit("a/clip"), ext).alias("path")), "path").select("page_id")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE (lower(o_orderpriority), lower(o_orderstatus)) NOT IN (SELECT (lower(o_orderpriority), lower(o_orderstatus)) FROM orders WHERE o_orderkey % 101 = 0)")
def exclude_normalized_pair(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", F.concat(F.lit(" "), F.upper("o_orderpriority")).alias("question"), F.lower("o_orderstatus").alias("answer"))
    keys = t.orders.where("o_orderkey % 101 = 0").select(F.col("o_orderpriority").alias("question"), F.concat("o_orderstatus", F.lit("\n")).alias("answer"))
    return exclude.exclude_normalized(rows, keys, "question", "answer").select("o_custkey", "o_orderkey")


@query("""WITH keys AS (SELECT DISTINCT l_orderkey % 50 AS q, l_returnflag AS a FROM lineitem WHERE l_quantity > 49)
SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING NOT bool_or((l_orderkey % 50, l_returnflag) IN (SELECT (q, a) FROM keys))""")
def exclude_any_pair(t: Tables) -> DataFrame:
    """A row goes if any of its (question, answer) pairs is one of the keys."""
    rows = t.lineitem.groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("answers")).withColumn("question", (F.col("l_orderkey") % 50).cast("string"))
    keys = t.lineitem.where("l_quantity > 49").select((F.col("l_orderkey") % 50).cast("string").alias("question"), F.col("l_returnflag").alias("answer"))
    return exclude.exclude_any_pair(rows, keys, "l_orderkey", "question", "answers").select("l_orderkey")


@query("SELECT DISTINCT regexp_extract(x, '[0-9]+$')::BIGINT AS key FROM (SELECT 'a/b_' || p_partkey::VARCHAR AS x FROM part WHERE p_size > 40 UNION ALL SELECT 'c/d_' || s_suppkey::VARCHAR FROM supplier)")
def keys_from_paths(t: Tables) -> DataFrame:
    paths = [t.part.where("p_size > 40").select(F.concat(F.lit("a/b_"), F.col("p_partkey").cast("string"))), t.supplier.select(F.concat(F.lit("c/d_"), F.col("s_suppkey").cast("string")))]
    return exclude.path_keys(paths, r"_([0-9]+)$").select(F.col("key").cast("long").alias("key"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dictionary_join(t: Tables) -> DataFrame:
    """Class numbers by their place in an ordered list of names; one out of range raises."""
    names = t.nation.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    return lookup.class_names(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", names, "n_name").select("c_custkey", "n_name")


@query("SELECT split_part(p_name, '_', 1) AS base, max_by(p_brand || '/' || p_name, p_partkey) AS key FROM part GROUP BY ALL")
def derived_keys(t: Tables) -> DataFrame:
    """Keys of files by base name; of repeated ones the last holds."""
    files = t.part.select("p_partkey", F.concat("p_brand", F.lit("/"), "p_name").alias("key"), F.split("p_name", "_")[0].alias("base"))
    return lookup.last_by_name(files, "base", "key", "p_partkey").select("base", "key")


@query("SELECT o_orderkey FROM orders")
def positional_alignment(t: Tables) -> DataFrame:
    rows = t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("query_id"))
    return qrels.aligned(rows, t.orders.select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("id"))).select(F.col("pos").alias("o_orderkey"))


@query("SELECT l_orderkey, list(l_suppkey ORDER BY first, l_suppkey) AS suppliers FROM (SELECT l_orderkey, l_suppkey, min(l_linenumber) AS first FROM lineitem GROUP BY ALL) GROUP BY l_orderkey")
def nested_first_seen(t: Tables) -> DataFrame:
    # Line numbers may repeat, so the key itself settles ties.
    return dedup.nested_first_seen(t.lineitem, "l_orderkey", "l_suppkey", ["l_linenumber"], ["l_linenumber"]).select("l_orderkey", F.transform("children", lambda x: x["l_suppkey"]).alias("suppliers"))


@query("SELECT c_nationkey, min(c_name) AS c_name FROM customer GROUP BY c_nationkey")
def sorted_distinct(t: Tables) -> DataFrame:
    return dedup.sorted_distinct(t.customer, "c_nationkey", ["c_name"])


@query("SELECT row_number() OVER (ORDER BY k) - 1 AS id, o_custkey, k AS o_orderkey FROM (SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey)")
def global_pool(t: Tables) -> DataFrame:
    return qrels.global_pool(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"]).select("id", "o_custkey", "o_orderkey")


@query("SELECT count(*) AS n, round(sum(value) / 1000, 4) AS value FROM events")
def grand_totals(t: Tables) -> DataFrame:
    return analytics.totals(t.events, ["value"], 1000.0).select("n", F.round("value", 4).alias("value"))


@query("SELECT doc_id // 32 AS batch, count(*) AS n, max(n_chars + 5)::BIGINT AS longest, sum(n_chars + 5)::BIGINT AS tokens, sum(doc_id % 3)::BIGINT AS vision, (count(*) * max(n_chars + 5))::BIGINT AS padded FROM documents GROUP BY ALL")
def batch_shapes(t: Tables) -> DataFrame:
    return analytics.side_shape(t.documents.select(F.expr("doc_id DIV 32").alias("batch"), "n_chars", (F.col("doc_id") % 3).alias("v")), "batch", "n_chars", "v", 5)


@query("SELECT doc_id // 32 AS batch, source, count(*) AS n, min(n_chars) AS shortest, max(n_chars) AS longest, avg(n_chars) AS mean, count(*) FILTER (doc_id % 2 = 1 AND doc_id % 3 = 0) AS token_only, count(*) FILTER (doc_id % 2 = 0 AND doc_id % 3 > 0) AS pixel_only FROM documents GROUP BY ALL")
def batch_sources(t: Tables) -> DataFrame:
    rows = t.documents.select(F.expr("doc_id DIV 32").alias("batch"), "source", "n_chars", (F.col("doc_id") % 2).alias("tokens"), (F.col("doc_id") % 3).alias("pixels"))
    return analytics.source_mix(rows, "batch", "source", "n_chars", "tokens", "pixels")


@query("SELECT user_id, round(avg(value), 6) AS loss, round(count(*) * 16 / sum(1 + event_id % 3), 6) AS samples_per_second FROM events GROUP BY user_id")
def throughput(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "value", (1 + F.col("event_id") % 3).alias("s"))
    return analytics.throughput(rows, "user_id", "value", "s", 16).select("user_id", F.round("loss", 6).alias("loss"), F.round("samples_per_second", 6).alias("samples_per_second"))


@query("SELECT event_id // 8 AS step, max(value) AS value FROM events GROUP BY ALL")
def most_of_ranks(t: Tables) -> DataFrame:
    return analytics.most_of_ranks(t.events.select(F.expr("event_id DIV 8").alias("step"), "value"), "step", "value")


# Conversions of sources.


@query("""SELECT o_orderkey::VARCHAR AS qid, p_partkey::VARCHAR AS did, p_name AS positive_txt, [p_partkey::VARCHAR] AS pos_cand_list FROM orders JOIN part ON p_partkey = o_custkey
  WHERE o_orderkey % 8 = 7 AND o_orderkey::VARCHAR NOT IN (SELECT o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 56 = 7)""")
def candidate_pool_source(t: Tables) -> DataFrame:
    """Queries of one task with the candidates they name first; evaluation queries of the task are left out."""
    k = F.col("o_orderkey")
    known = t.orders.join(t.part.select(F.col("p_partkey").alias("o_custkey")), "o_custkey", "left_semi")
    queries = known.select(k.alias("qid"), F.lit(None).cast("string").alias("query_txt"), (k % 8).alias("task_id"), F.array("o_custkey").alias("pos_cand_list"))
    pool = t.part.select(F.col("p_partkey").alias("did"), F.col("p_name").alias("txt"))
    kept, _, _ = converters.candidate_pool(queries, pool, 7, t.orders.where("o_orderkey % 56 = 7").select(k.alias("qid")))
    return kept.select("qid", "did", "positive_txt", "pos_cand_list")


@query("""WITH a AS (SELECT user_id, event_type AS answer, event_id, CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS w FROM events),
v AS (SELECT user_id, lower(answer) AS f, sum(w) AS total, min(event_id) AS seen, min_by(answer, event_id) AS answer FROM a WHERE w > 0 GROUP BY ALL),
p AS (SELECT user_id, answer FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, seen) AS rn FROM v) WHERE rn = 1)
SELECT user_id, answer AS selected_answer FROM p WHERE user_id % 4 <> 0 AND ('what does ' || user_id::VARCHAR, answer) NOT IN (SELECT ('what does ' || user_id::VARCHAR, answer) FROM p WHERE user_id % 9 = 0)""")
def voted_answers_source(t: Tables) -> DataFrame:
    """Answers chosen by votes with confidence; unanswerable questions and evaluation pairs are left out."""
    said = F.element_at(F.array(F.lit("yes"), F.lit("maybe"), F.lit("no")), (F.col("event_id") % 3 + 1).cast("int"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("event_id", F.col("event_type").alias("answer"), said.alias("answer_confidence")))), lambda x: F.struct(x["answer"].alias("answer"), x["answer_confidence"].alias("answer_confidence")))
    rows = t.events.groupBy("user_id").agg(packed.alias("answers")).withColumn("question", F.concat(F.lit("What  does "), F.col("user_id").cast("string"))).withColumn("answerable", F.col("user_id") % 4 != 0)
    voted = converters.voted_answers(rows.withColumn("answerable", F.lit(True)), "user_id").where("user_id % 9 = 0").select("question", F.col("selected_answer").alias("answer"))
    kept, _ = converters.voted_rows(rows, "user_id", voted)
    return kept.select("user_id", "selected_answer")


@query("SELECT conv_id, turn - turn % 2 AS segment, text AS sentence, 'v' || conv_id::VARCHAR || '#segment=' || printf('%.3f', turn::DOUBLE) || '-' || printf('%.3f', turn + 1.5) AS frame_unit_key FROM conversations WHERE turn % 2 = 0 AND conv_id % 6 <> 0")
def segments_source(t: Tables) -> DataFrame:
    """Segments from parallel arrays, those whose frame unit was decoded."""
    c = t.conversations.where("turn % 2 = 0")
    packed = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = c.groupBy("conv_id").agg(packed.alias("p")).select(
        "conv_id", F.concat(F.lit("v"), F.col("conv_id").cast("string")).alias("video"), F.transform("p", lambda x: x["turn"].cast("double")).alias("starts"),
        F.transform("p", lambda x: x["turn"] + 1.5).alias("ends"), F.transform("p", lambda x: x["text"]).alias("sentences"), F.transform("p", lambda x: x["turn"]).alias("turns"),
    )
    flat = converters.segments(rows, {"start": "starts", "end": "ends", "sentence": "sentences", "turn": "turns"})
    units = flat.where("conv_id % 6 <> 0").select("frame_unit_key")
    return converters.decoded_only(flat, "frame_unit_key", units).select("conv_id", (F.col("turn")).alias("segment"), "sentence", "frame_unit_key")


@query("""SELECT vid, query_frame_unit_key, keys FROM (SELECT o_custkey AS vid, 'c' || o_custkey::VARCHAR || '#full' AS query_frame_unit_key,
  list('c' || o_custkey::VARCHAR || '#segment=' || printf('%.3f', (o_orderkey % 100)::DOUBLE) || '-' || printf('%.3f', o_orderkey % 100 + 2.0) ORDER BY o_orderkey) AS keys FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_custkey)""")
def highlights_source(t: Tables) -> DataFrame:
    """Windows of a video with their keys; windows without a decoded unit are taken out of the arrays."""
    start = (F.col("o_orderkey") % 100).cast("float")
    packed = F.array_sort(F.collect_list(F.struct("o_orderkey", start.alias("s"))))
    rows = t.orders.groupBy("o_custkey").agg(packed.alias("p")).select(F.col("o_custkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("vid"), F.transform("p", lambda x: F.array(x["s"], x["s"] + F.lit(2.0).cast("float"))).alias("relevant_windows"), F.transform("p", lambda x: x["o_orderkey"]).alias("orders"))
    keyed = converters.highlight_keys(rows)
    # A unit is valid for one order; keys of several orders may be equal, so the order is part of the key here.
    marked = keyed.withColumn("positive_frame_unit_keys", F.zip_with("positive_frame_unit_keys", "orders", lambda k, o: F.concat(k, F.lit("@"), o.cast("string"))))
    valid = marked.select(F.explode("positive_frame_unit_keys").alias("key")).where("CAST(split(key, '@')[1] AS bigint) % 5 <> 0")
    kept = converters.trim_elements(marked, "id", "positive_frame_unit_keys", ["relevant_windows"], valid)
    return kept.select(F.col("id").alias("vid"), "query_frame_unit_key", F.transform("positive_frame_unit_keys", lambda k: F.split(k, "@")[0]).alias("keys"))


@query("""SELECT o_orderkey AS query_id, (i - 1)::INTEGER AS positive_rank, parts[i]::VARCHAR AS positive_docid FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM (
  SELECT o_orderkey, o_custkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey)) WHERE o_custkey % 10 <> 3""")
def passages_source(t: Tables) -> DataFrame:
    """A row for each positive passage with its rank; queries of the evaluation are left out."""
    packed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    passage = lambda x: F.struct(x["l_partkey"].cast("string").alias("docid"), F.lit(None).cast("string").alias("title"), F.lit("t").alias("text"))
    grouped = t.lineitem.groupBy("l_orderkey").agg(F.transform(packed, passage).alias("positive_passages"))
    rows = t.orders.join(grouped, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit(" of "), F.col("o_custkey").cast("string")).alias("query"), F.array(F.lit("a")).alias("answers"), "positive_passages", F.array(F.struct(F.lit("n").alias("docid"))).alias("negative_passages"))
    evals = t.orders.where("o_custkey % 10 = 3").select(F.concat(F.lit("Find: of "), F.col("o_custkey").cast("string")).alias("q"))
    kept, _ = converters.without_eval_queries(converters.positive_passages(rows), evals, "Find: ")
    return kept.select("query_id", "positive_rank", "positive_docid")


@query("SELECT n_nationkey AS id, list(l_partkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS candidate_ids FROM lineitem JOIN nation ON n_nationkey = l_orderkey % 25 GROUP BY n_nationkey")
def judged_bundle(t: Tables) -> DataFrame:
    """Queries, candidates and judgments of a benchmark put together; the judgments as arrays in order."""
    queries = t.nation.select(F.col("n_nationkey").cast("long").alias("query-id"), F.col("n_name").alias("query"))
    corpus = t.part.select(F.col("p_partkey").alias("corpus-id"), F.struct(F.unhex(F.lit("FFD8")).alias("bytes"), F.col("p_name").alias("path")).alias("image"))
    judged = t.lineitem.select((F.col("l_orderkey") % 25).alias("query-id"), F.col("l_partkey").alias("corpus-id"), F.col("l_quantity").alias("score"), "l_orderkey", "l_linenumber")
    asked, _, table = converters.beir_bundle(queries, corpus, judged.select("query-id", "corpus-id", "score", F.struct("l_orderkey", "l_linenumber").alias("at")), ("at",))
    return asked.select("id").join(table.withColumnRenamed("query_id", "id"), "id").select("id", "candidate_ids")


@query("SELECT p_brand AS class, replace(p_name, ' ', '_') AS file, CASE p_partkey % 3 WHEN 1 THEN 'train' ELSE 'test' END AS split FROM part WHERE p_partkey % 3 > 0")
def tagged_splits_source(t: Tables) -> DataFrame:
    """Official split lists: tag 1 trains, 2 tests, 0 is left out."""
    lines = t.part.select(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("  "), (F.col("p_partkey") % 3).cast("string")).alias("value"), F.col("p_brand"))
    return converters.tagged_splits(lines, F.col("p_brand")).select("class", "file", "split")


@query("SELECT conv_id, (turn // 2)::INTEGER AS qa_index, text AS q FROM conversations WHERE turn % 2 = 0")
def questions_source(t: Tables) -> DataFrame:
    """Questions and answers of a video, one row each."""
    packed = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.struct(x["text"].alias("q")))
    rows = t.conversations.where("turn % 2 = 0").groupBy("conv_id").agg(packed.alias("QA"))
    return converters.question_rows(rows).select("conv_id", "qa_index", "q")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'train' WHEN o_orderkey % 3 = 1 THEN 'test' ELSE 'excluded' END AS part FROM orders WHERE o_orderkey % 3 < 2 OR o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)
  EXCEPT SELECT o_orderkey, 'train' FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)
  EXCEPT SELECT o_orderkey, 'excluded' FROM orders WHERE o_orderkey % 3 = 2
  UNION ALL SELECT o_orderkey, 'excluded' FROM orders WHERE o_orderkey % 3 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 1)""")
def guarded_split(t: Tables) -> DataFrame:
    """A training split without what its test split holds, the test split, and the rows that were left out."""
    rows = t.orders.select("o_orderkey", "o_custkey")
    kept, gone = converters.guarded(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 3 = 1").select("o_custkey"), "o_custkey")
    test = rows.where("o_orderkey % 3 = 1")
    tag = lambda df, name: df.select("o_orderkey", F.lit(name).alias("part"))
    return tag(kept, "train").unionByName(tag(test, "test")).unionByName(tag(gone, "excluded"))


@query("""SELECT doc_id, source, CASE lang WHEN 'en' THEN 'Represent the text: ' ELSE 'Find the text: ' END || chr(10) || lang AS query, 'doc_' || doc_id::VARCHAR AS positive FROM documents""")
def training_samples(t: Tables) -> DataFrame:
    """Rows of a source as samples: the instruction of its kind with the body, and a looked-up positive."""
    side = t.documents.select(F.col("doc_id").alias("key"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("positive"))
    rows = t.documents.select("doc_id", "source", "lang", F.col("lang").alias("body"))
    spec = converters.Samples(query="body", instruction={"en": "Represent the text: "}, default="Find the text: ", kind="lang", lookups=(lookup.Lookup(side, "doc_id", "key", {"positive": "positive"}),))
    return converters.samples(rows, spec).select("doc_id", "source", "query", "positive")


# Archives and sinks.


@query("SELECT source || '-' || (doc_id % 3)::VARCHAR || '.tar' AS archive, doc_id::VARCHAR AS stem, (doc_id % 7)::INT AS label, sha256(coalesce(text, '')) AS text_sha256 FROM documents WHERE doc_id % 5 > 0")
def archive_samples(t: Tables) -> DataFrame:
    """Texts and classes written as tar members, then four of five samples found in the index, read by ranges and paired."""
    docs = t.documents.select(F.concat("source", F.lit("-"), (F.col("doc_id") % 3).cast("string"), F.lit(".tar")).alias("archive"), F.col("doc_id").cast("string").alias("stem"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = F.create_map(F.lit(".txt"), "text", F.lit(".cls"), (F.col("doc_id") % 7).cast("string"))
    rows = docs.select("archive", "stem", F.explode(both).alias("kind", "content")).select("archive", F.concat("stem", "kind").alias("member"), "content")
    written = archives.write_tars(rows, f"{shared_dir(t.spark)}/tars-{uuid.uuid4().hex}").select("path").collect()  # one for each archive
    index = archives.archive_index(t.spark, [r["path"] for r in written])
    wanted = t.documents.where("doc_id % 5 > 0").select(F.explode(F.array(*[F.concat(F.col("doc_id").cast("string"), F.lit(x)) for x in (".txt", ".cls")])).alias("member"))
    pairs = archives.paired_samples(archives.read_members(archives.selected(index, wanted)), 7, media=("txt",))
    return pairs.select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "stem", "label", F.sha2("image", 256).alias("text_sha256"))


@query("SELECT doc_id, source, sha256(coalesce(text, '')) AS text_sha256, true AS fits FROM documents")
def bounded_files(t: Tables) -> DataFrame:
    """Texts written once, a folder for each source, in files of 256 KiB at most, and read back."""
    path, cap = f"{shared_dir(t.spark)}/bounded-{uuid.uuid4().hex}", 1 << 18
    sinks.write_guarded(t.documents.select("doc_id", "source", "text"), path, "source", max_bytes=cap, order=["doc_id"])
    back = t.spark.read.parquet(path).select("doc_id", "source", "text", "_metadata.file_path", "_metadata.file_size")
    alone = back.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    fits = (F.col("file_size") <= cap) | (F.col("n") == 1)
    return back.join(alone, "file_path").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), fits.alias("fits"))


# Table functions, scans for patterns, batches.


def _sampled(rows: list) -> dict:
    """Three of a key's rows, spread evenly."""
    n = len(rows)
    taken = range(n) if n <= 3 else [0, (n - 1) // 2, n - 1]
    return {"total": n, "parts": [rows[k]["l_partkey"] for k in taken]}


@query("""WITH l AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS p FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, o_custkey, coalesce(len(p), 0)::INT AS total, CASE WHEN p IS NULL THEN [] WHEN len(p) <= 3 THEN p ELSE [p[1], p[(len(p) - 1) // 2 + 1], p[len(p)]] END AS parts FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def hooked_join(t: Tables) -> DataFrame:
    """Orders with a sample of their items, by a table function of the user's own."""
    items = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    return hook.join_hook(t.orders.select("o_orderkey", "o_custkey"), items, "o_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], _sampled, "total int, parts array<bigint>")


SEARCHED = (r"password\s*[:=]", r"api[_-]?key\s*[:=]", "lorem|ipsum", r"copy(right|left)", r"https?://[a-z.]*example", "[0-9]{3}-[0-9]{4}", "the (next|last) (day|week)", r"(?:licen[cs]e)")


@query("WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents) SELECT doc_id::VARCHAR AS path, line, pattern FROM lines, (VALUES " + ", ".join(f"('{p}')" for p in SEARCHED) + ") p(pattern) WHERE regexp_matches(x, pattern, 'i')")
def pattern_scan(t: Tables) -> DataFrame:
    """Lines of all texts that any of the patterns matches, found by one automaton."""
    return scan.find_patterns(t.documents, SEARCHED, "doc_id", "text")


@query("""WITH l AS (SELECT l_orderkey AS k, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity) AS ids, list(l_quantity::INT ORDER BY l_linenumber, l_partkey, l_quantity) AS f FROM lineitem GROUP BY l_orderkey),
w AS (SELECT *, k // 6 AS batch, max(len(ids)) OVER (PARTITION BY k // 6) AS width FROM l)
SELECT batch, count(*)::INT AS n, any_value(width)::INT AS width, list(list_concat(ids, list_transform(range(len(ids), width), lambda x: -1)) ORDER BY k) AS ids,
  list(list_concat(list_transform(ids, lambda x: 1), list_transform(range(len(ids), width), lambda x: 0)) ORDER BY k) AS mask,
  CASE WHEN count(*) FILTER (k % 3 = 0) > 0 THEN list(list_concat(list_transform(f, lambda x: CASE WHEN k % 3 = 0 THEN x ELSE 0 END), list_transform(range(len(ids), width), lambda x: 0)) ORDER BY k) END AS quantity,
  flatten(list([[1, len(ids)]] ORDER BY k) FILTER (k % 2 = 0)) AS grid, flatten(list(ids ORDER BY k)) AS "values",
  list_concat([0], list_transform(range(1, count(*) + 1), lambda i: list_sum(list(len(ids) ORDER BY k)[1:i])::INT)) AS offsets FROM w GROUP BY batch""")
def collated_batches(t: Tables) -> DataFrame:
    """Orders as rows of batches of six: items are the ids, their quantities an aligned field that some rows lack."""
    k = F.col("l_orderkey")
    packed = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    rows = t.lineitem.groupBy("l_orderkey").agg(packed.alias("x"))
    rows = rows.select(F.expr("l_orderkey DIV 6").alias("batch"), k.alias("slot"), F.col("x.l_partkey").alias("ids"), F.when(k % 3 == 0, F.col("x.l_quantity").cast("array<int>")).alias("quantity"), F.when(k % 2 == 0, F.array(F.array(F.lit(1), F.size("x")))).alias("grid"))
    return collate.collate(rows, "batch", "slot", "ids", ["quantity"], ["grid"], pad=-1)

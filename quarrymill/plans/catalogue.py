"""The query catalogue on the driver's tables: each query with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators import analytics, dedup, exclude, lookup, mixture, qrels
from . import benchmarks, retrieval
from .registry import QUERIES, SQL, Query, Tables, query

# Retrieval: every twentieth vector is a query against all others; equal labels are relevant.

RANKED = """
WITH scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, q.label AS ql, c.label AS cl,
         round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM scored) WHERE rank <= 10)"""


def _ranked(t: Tables) -> tuple[DataFrame, DataFrame]:
    vectors = t.embeddings.select("vec_id", "embedding")
    queries = vectors.where("vec_id % 20 = 0")
    return queries, retrieval.top_k(queries, vectors, 10, skip_self=True)


@query(RANKED + " SELECT query_id, candidate_id, rank::BIGINT AS rank FROM ranked")
def topk_neighbors(t: Tables) -> DataFrame:
    return _ranked(t)[1].select("query_id", "candidate_id", F.col("rank").cast("long"))


# Relevant are vectors of the query's label in its seat of forty; the gain is 1, 2 or 3.
GAINS = """,
rel AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, 1.0 + c.vec_id % 3 AS gain FROM embeddings q JOIN embeddings c
  ON q.vec_id % 20 = 0 AND q.label = c.label AND c.vec_id % 40 = q.vec_id // 20 % 40 AND c.vec_id <> q.vec_id),
ideal AS (SELECT query_id, max(n) AS n, sum(gain / log2(i + 1)) FILTER (i <= 10) AS best FROM (
  SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i, count(*) OVER (PARTITION BY query_id) AS n FROM rel) GROUP BY query_id),
marked AS (SELECT r.query_id, r.ql AS label, rank, coalesce(gain, 0) AS gain FROM ranked r LEFT JOIN rel USING (query_id, candidate_id)),
cum AS (SELECT *, sum(CASE WHEN gain > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM marked),
per AS (SELECT query_id, label,
  max(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_10, coalesce(1.0 / min(CASE WHEN gain > 0 THEN rank END), 0) AS mrr_10,
  coalesce(sum(CASE WHEN gain > 0 THEN hits::DOUBLE / rank END), 0) / least(greatest(coalesce(max(n), 0), 1), 10) AS map_10,
  coalesce(sum(gain / log2(rank + 1)), 0) / greatest(coalesce(max(best), 0), 1e-10) AS ndcg_10
  FROM cum LEFT JOIN ideal USING (query_id) GROUP BY query_id, label)
"""
METRICS_SQL = RANKED + GAINS
TEN = ("hit@10", "mrr@10", "map@10", "ndcg@10")


def _relevant(t: Tables) -> DataFrame:
    e = t.embeddings
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.expr("vec_id DIV 20 % 40").alias("seat"))
    pairs = q.join(e.select(F.col("vec_id").alias("candidate_id"), "label", (F.col("vec_id") % 40).alias("seat")), ["label", "seat"]).where("candidate_id <> query_id")
    return qrels.group_pairs(pairs.withColumn("gain", 1.0 + F.col("candidate_id") % 3), "query_id", "candidate_id", "gain", ["candidate_id"])


def _metrics(t: Tables) -> DataFrame:
    queries, ranked = _ranked(t)
    return retrieval.query_metrics(ranked, retrieval.relevance(_relevant(t)), queries.select(F.col("vec_id").alias("query_id")), [10])


MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in ("hit_10", "mrr_10", "map_10", "ndcg_10"))


@query(METRICS_SQL + f"SELECT count(*) AS n_queries, {MEANS} FROM per")
def retrieval_metrics(t: Tables) -> DataFrame:
    return retrieval.mean_metrics(_metrics(t))


@query(METRICS_SQL + ", tasks AS (SELECT 'm' || (label % 2)::VARCHAR AS modality, 't' || (label % 4)::VARCHAR AS task, CASE label % 2 WHEN 0 THEN ndcg_10 ELSE hit_10 END AS value FROM per) SELECT coalesce(modality, 'all') AS modality, coalesce(task, 'all') AS task, round(avg(value), 4) AS mean, count(*) AS n FROM tasks GROUP BY GROUPING SETS ((modality, task), (modality), ())")
def benchmark_summary(t: Tables) -> DataFrame:
    """The metric that counts depends on the modality."""
    label = F.col("label")
    rows = _metrics(t).join(t.embeddings.select(F.col("vec_id").alias("query_id"), "label"), "query_id")
    rows = rows.select(F.concat(F.lit("m"), (label % 2).cast("string")).alias("modality"), F.concat(F.lit("t"), (label % 4).cast("string")).alias("task"), F.when(label % 2 == 0, F.col("ndcg_10")).otherwise(F.col("hit_10")).alias("value"))
    return analytics.summary(rows, "modality", "task", "value")


MODES = "CASE WHEN query_id % 60 = 0 THEN 'exhaustive' WHEN query_id % 60 = 20 THEN 'sparse' END"


@query(RANKED.replace("WHERE rank <= 10)", "WHERE rank <= 5)") + f""",
own AS (SELECT s.query_id, s.candidate_id, row_number() OVER (PARTITION BY s.query_id ORDER BY score DESC, s.candidate_id) AS rank FROM scored s WHERE candidate_id % 25 = query_id // 20 % 25)
SELECT query_id, candidate_id, rank::BIGINT AS rank FROM ranked WHERE coalesce({MODES}, 'sparse') = 'sparse' UNION ALL SELECT query_id, candidate_id, rank::BIGINT FROM own WHERE {MODES} = 'exhaustive' AND rank <= 5""")
def modes_ranking(t: Tables) -> DataFrame:
    """Sparse and exhaustive queries in one plan; a null mode is sparse."""
    e = t.embeddings
    vectors = e.select("vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.expr("vec_id DIV 20 % 25").alias("seat"))
    pairs = asked.join(e.select(F.col("vec_id").alias("c"), (F.col("vec_id") % 25).alias("seat")), "seat").where("c <> query_id")
    own = pairs.groupBy("query_id").agg(F.array_sort(F.collect_list("c")).alias("candidate_ids"))
    found = retrieval.rank_by_mode(vectors.where("vec_id % 20 = 0"), vectors, own.withColumn("mode", F.expr(MODES)), 5, skip_self=True)
    return found.select("query_id", "candidate_id", F.col("rank").cast("long").alias("rank"))


@query(METRICS_SQL.replace("coalesce(gain, 0) AS gain", "CASE WHEN gain IS NULL THEN 0 ELSE 1 END AS gain").replace("sum(gain / log2(i + 1)) FILTER (i <= 10)", "sum(1 / log2(i + 1)) FILTER (i <= 10)") + "SELECT query_id, round(hit_10, 6) AS hit_10, round(mrr_10, 6) AS mrr_10, round(map_10, 6) AS map_10, round(ndcg_10, 6) AS ndcg_10 FROM per")
def metrics_of_vectors(t: Tables) -> DataFrame:
    """From vectors and lists of relevant ids, some of which no candidate has."""
    vectors = t.embeddings.select("vec_id", "embedding")
    listed = _relevant(t).select("query_id", F.concat("candidate_ids", F.array(F.lit(-1).cast("long"))).alias("candidate_ids"))
    per = retrieval.vector_metrics(vectors.where("vec_id % 20 = 0"), vectors, listed, TEN, skip_self=True)
    return per.select("query_id", *[F.round(c, 6).alias(c) for c in per.columns[1:]])


@query("""WITH c AS (SELECT label, min_by(embedding, vec_id) AS v FROM embeddings GROUP BY label),
s AS (SELECT e.vec_id, e.label, c.label AS k, round(list_sum(list_transform(list_zip(e.embedding, c.v), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score FROM embeddings e, c WHERE e.label IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k) AS rank FROM s)
SELECT vec_id AS query_id, max(CASE WHEN k = label AND rank <= 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy_1, max(CASE WHEN k = label AND rank <= 3 THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy_3 FROM r GROUP BY vec_id""")
def label_accuracy(t: Tables) -> DataFrame:
    """Each vector against one vector of each class."""
    e = t.embeddings
    classes = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("v")).select(F.col("label").cast("long"), "v")
    labels = e.where("label IS NOT NULL").select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("label"))
    return retrieval.label_accuracy(e.select("vec_id", "embedding"), classes, labels, (1, 3))


@query("""WITH e AS (SELECT vec_id, label, embedding FROM embeddings WHERE label IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, q.label, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score,
  c.vec_id % 4 = q.vec_id // 20 % 4 AS listed, CASE WHEN c.vec_id % 40 = q.vec_id // 20 % 40 THEN 1.0 + c.vec_id % 3 ELSE 0 END AS gain FROM e q JOIN e c ON q.label = c.label AND q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, rank, gain FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM pairs WHERE label % 3 > 0 OR listed) WHERE rank <= 10),
got AS (SELECT query_id, max(CASE WHEN gain > 0 AND rank = 1 THEN 1.0 ELSE 0 END) AS hit_1, sum(gain / log2(rank + 1)) AS dcg FROM ranked GROUP BY query_id),
ideal AS (SELECT query_id, sum(gain / log2(i + 1)) AS best FROM (SELECT query_id, gain, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC) AS i FROM pairs WHERE gain > 0) WHERE i <= 10 GROUP BY query_id),
per AS (SELECT label, coalesce(hit_1, 0)::DOUBLE AS hit_1, coalesce(dcg / best, 0)::DOUBLE AS ndcg_10 FROM e LEFT JOIN got ON query_id = vec_id LEFT JOIN ideal ON ideal.query_id = vec_id WHERE vec_id % 20 = 0),
own AS (SELECT label, avg(hit_1) AS hit_1, avg(ndcg_10) AS ndcg_10, count(*) AS n FROM per GROUP BY label),
main AS (SELECT 'm' || (label % 2)::VARCHAR AS modality, 't' || (label % 4)::VARCHAR AS task, CASE label % 2 WHEN 0 THEN ndcg_10 ELSE hit_1 END AS value FROM own)
SELECT 'd' || label::VARCHAR AS dataset, 'hit_1' AS metric, round(hit_1, 4) AS value, n FROM own UNION ALL SELECT 'd' || label::VARCHAR, 'ndcg_10', round(ndcg_10, 4), n FROM own
UNION ALL SELECT CASE WHEN modality IS NULL THEN '_summary' WHEN task IS NULL THEN modality ELSE modality || '/' || task END, 'mean', round(avg(value), 4), count(*) FROM main GROUP BY GROUPING SETS ((modality, task), (modality), ())""")
def benchmark_run(t: Tables) -> DataFrame:
    """Each label is a dataset, its twentieth vectors the queries; every third dataset ranks only what its qrels list."""
    e = t.embeddings.where("label IS NOT NULL").select(F.concat(F.lit("d"), F.col("label").cast("string")).alias("dataset"), "label", "vec_id", "embedding")
    asked = e.where("vec_id % 20 = 0")
    lists = e.groupBy("dataset", F.expr("vec_id % 4").alias("four")).agg(F.array_sort(F.collect_list("vec_id")).alias("c"))  # each vector once in all
    seats = asked.selectExpr("dataset", "label", "vec_id AS query_id", "vec_id DIV 20 % 40 AS seat", "vec_id DIV 20 % 40 % 4 AS four")
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.spark.sparkContext.defaultParallelism)
    judged = seats.repartition(parts, "dataset", "query_id").join(F.broadcast(lists), ["dataset", "four"]).withColumn("candidate_ids", F.expr("filter(c, x -> x <> query_id)")).where("size(candidate_ids) > 0")
    judged = judged.select("dataset", "query_id", F.expr("CASE WHEN label % 3 = 0 THEN 'exhaustive' END AS mode"), "candidate_ids", F.expr("transform(candidate_ids, x -> CASE WHEN x % 40 = seat THEN 1.0D + x % 3 ELSE 0.0D END)").alias("candidate_scores"))
    names = asked.select("dataset", F.expr("'m' || label % 2 AS modality"), F.expr("'t' || label % 4 AS task_type")).distinct()  # a dataset without queries would raise
    vectors = lambda df: df.select("dataset", "vec_id", "embedding")
    out = benchmarks.run(vectors(asked), vectors(e), judged, names, {"m0": "ndcg@10", "m1": "hit@1"}, ["hit@1", "ndcg@10"], skip_self=True)
    return out.select("dataset", "metric", F.round("value", 4).alias("value"), "n")


POOL = "JOIN embeddings c ON q.vec_id % 20 = 0 AND c.vec_id % 50 = q.label % 50"


@query(f"""SELECT query_id, candidate_id, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM (
  SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, round(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 9) AS score FROM embeddings q {POOL})) WHERE rank <= 5""")
def exhaustive_ranking(t: Tables) -> DataFrame:
    """Each twentieth vector among those whose id fits its label. All pairs come from a few slots, so candidates are dealt by id, to tasks of some PAIRS_BLOCK pairs."""
    e = t.embeddings
    queries = e.where("vec_id % 20 = 0")
    asked = queries.select(F.col("vec_id").alias("query_id"), (F.col("label") % 50).alias("slot"))
    held = e.select(F.col("vec_id").alias("candidate_id"), (F.col("vec_id") % 50).alias("slot"))
    many = lambda df, c: df.groupBy("slot").agg(F.count(F.lit(1)).alias(c))
    pairs = many(asked, "q").join(many(held, "c"), "slot").agg(F.coalesce(F.sum(F.col("q") * F.col("c")), F.lit(0))).first()[0]
    parts = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), t.spark.sparkContext.defaultParallelism, -(-pairs // retrieval.PAIRS_BLOCK))
    pool = held.repartition(parts, "candidate_id").join(F.broadcast(asked), "slot")
    return retrieval.score_pool(queries.select("vec_id", "embedding"), e.select("vec_id", "embedding"), pool, 5, pairs).select("query_id", "candidate_id", F.col("rank").cast("long"))


# Lookup joins.


@query("SELECT l_orderkey, l_linenumber, p_name, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey")
def keyed_lookup_error(t: Tables) -> DataFrame:
    spec = lookup.Lookup(t.part, "l_partkey", "p_partkey", {"p_name": "p_name", "p_brand": "p_brand"})
    return lookup.lookup(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey"), spec).drop("l_partkey")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def keyed_lookup_skip(t: Tables) -> DataFrame:
    return lookup.lookup(t.documents.select("doc_id"), lookup.Lookup(t.labels, "doc_id", "doc_id", {"quality": "quality"}, "skip"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, c_name, n_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def chained_lookup(t: Tables) -> DataFrame:
    chain = [lookup.Lookup(t.orders, "l_orderkey", "o_orderkey", {"o_custkey": "o_custkey"}), lookup.Lookup(t.customer, "o_custkey", "c_custkey", {"c_name": "c_name", "c_nationkey": "c_nationkey"}), lookup.Lookup(t.nation, "c_nationkey", "n_nationkey", {"n_name": "n_name"})]
    return lookup.lookup_chain(t.lineitem.select("l_orderkey", "l_linenumber"), chain).drop("c_nationkey")


@query("SELECT s_suppkey, a.n_name AS home_n_name, b.n_name AS next_n_name FROM supplier LEFT JOIN nation a ON s_nationkey = a.n_nationkey LEFT JOIN nation b ON s_nationkey + 1 = b.n_nationkey")
def multi_role_lookup(t: Tables) -> DataFrame:
    rows = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("home"), (F.col("s_nationkey") + 1).alias("next"))
    return lookup.multi_role(rows, t.nation, "n_nationkey", {"home": "home", "next": "next"}, ["n_name"]).select("s_suppkey", "home_n_name", "next_n_name")


@query("SELECT n_nationkey AS request_pos, r_name FROM nation JOIN (SELECT r_name, row_number() OVER (ORDER BY r_regionkey) - 1 AS pos FROM region) ON pos = n_nationkey % 5")
def positional_lookup(t: Tables) -> DataFrame:
    side = t.region.withColumn("row_pos", (F.row_number().over(W.orderBy("r_regionkey")) - 1).cast("long")).select("row_pos", "r_name")
    return lookup.positional(side, t.nation.select((F.col("n_nationkey") % 5).cast("long").alias("row_pos"), F.col("n_nationkey").alias("request_pos"))).select("request_pos", "r_name")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN p_name ELSE s_name END AS side_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey")
def routed_lookup(t: Tables) -> DataFrame:
    part, supplier = t.part.select(F.col("p_partkey").alias("k"), F.col("p_name").alias("side_name")), t.supplier.select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("side_name"))
    returned = F.col("l_returnflag") == "R"
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(returned, "part").otherwise("supplier").alias("src"), F.when(returned, F.col("l_partkey")).otherwise(F.col("l_suppkey")).alias("key"))
    return lookup.routed_lookup(rows, {"part": part, "supplier": supplier}, "src", "key", "k").select("l_orderkey", "l_linenumber", "side_name")


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def ordered_children(t: Tables) -> DataFrame:
    return lookup.ordered_children(t.conversations, "conv_id", ["turn"], "role", "roles")


@query("""SELECT user_id, CASE WHEN len(ids) >= 4 THEN [ids[1], ids[1 + ((len(ids) - 1) * 1 // 3)], ids[1 + ((len(ids) - 1) * 2 // 3)], ids[len(ids)]]
  ELSE list_transform(range(4), lambda i: ids[1 + CASE WHEN i = 3 THEN len(ids) - 1 ELSE floor(i * (len(ids) - 1) / 3.0)::BIGINT END]) END AS sampled FROM (SELECT user_id, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id)""")
def sampled_children(t: Tables) -> DataFrame:
    """Four of each parent's children, spread evenly over their order."""
    kids = lookup.ordered_children(t.events, "user_id", ["ts", "event_id"], "event_id", "ids")
    at = arrays.uniform_indices(F.size("ids").cast("long"), 4)
    return kids.select("user_id", F.transform(at, lambda i: F.get("ids", i.cast("int"))).alias("sampled"))


# Exclusion.

KEY = r"lower(trim(regexp_replace({0}, '\s+', ' ', 'g')))"


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def exclude_single(t: Tables) -> DataFrame:
    return exclude.exclude(t.customer.select("c_custkey"), t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey"), "c_custkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity > 45 AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey)")
def exclude_composite(t: Tables) -> DataFrame:
    keys = t.lineitem.where("l_quantity > 45").select("l_partkey", "l_suppkey")
    return exclude.exclude(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), keys, "l_partkey", "l_suppkey").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def exclude_either(t: Tables) -> DataFrame:
    rules = (t.customer.where("c_acctbal < 0").select("c_custkey"), "o_custkey"), (t.lineitem.where("l_returnflag = 'R'").select("l_orderkey"), "o_orderkey")
    return exclude.exclude_either(t.orders.select("o_orderkey", "o_custkey"), *rules).select("o_orderkey")


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {KEY.format('line')} IN (SELECT {KEY.format('text')} FROM benchmark))")
def exclude_any_element(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.split("text", "\n").alias("lines"))
    return exclude.exclude_any_element(lines, t.benchmark.select("text"), "doc_id", "lines").select("doc_id")


@query("SELECT CASE WHEN o_custkey IS NULL THEN 'kept' ELSE 'excluded' END AS part, count(*) AS n FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') ON c_custkey = o_custkey GROUP BY ALL")
def exclusion_audit(t: Tables) -> DataFrame:
    rows, keys = t.customer.select("c_custkey"), t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    both = exclude.exclude(rows, keys, "c_custkey").select(F.lit("kept").alias("part")).unionByName(exclude.excluded(rows, keys, "c_custkey").select(F.lit("excluded").alias("part")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_required(t: Tables) -> DataFrame:
    return exclude.require_all(t.orders.select(F.col("o_custkey").alias("c_custkey")), t.customer, "c_custkey").select("c_custkey", "c_name")


@query(f"SELECT DISTINCT {KEY.format('o_orderpriority')} AS question, {KEY.format('p_name')} AS answer FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 40")
def overlap_keys(t: Tables) -> DataFrame:
    q = qrels.group_pairs(t.lineitem.withColumn("s", F.when(F.col("l_quantity") > 40, 1.0).otherwise(0.0)), "l_orderkey", "l_partkey", "s", ["l_linenumber"])
    return exclude.overlap_keys(q, t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("text")), t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text")))


# Dedup and ordinals.


@query("SELECT row_number() OVER (ORDER BY first) - 1 AS id, p_brand FROM (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY p_brand)")
def first_seen_ids(t: Tables) -> DataFrame:
    return dedup.first_seen_ids(t.part, ["p_brand"], ["p_partkey"])


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1")
def first_row_per_key(t: Tables) -> DataFrame:
    return dedup.first_rows(t.lineitem.select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], ["l_orderkey", "l_linenumber"])


@query("SELECT conv_id, turn, occurrence FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS occurrence FROM conversations) WHERE occurrence > 1")
def id_collisions(t: Tables) -> DataFrame:
    return dedup.collisions(t.conversations, "conv_id", ["turn"]).select("conv_id", "turn", F.col("occurrence").cast("long"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey HAVING count(*) > 1")
def duplicate_keys(t: Tables) -> DataFrame:
    return dedup.duplicate_keys(t.lineitem, "l_partkey")


@query("SELECT o_custkey, o_orderkey, shard FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY shard, o_orderkey) AS rn FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS shard FROM orders)) WHERE rn = 1")
def merge_shards(t: Tables) -> DataFrame:
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus")
    return dedup.merge_shards([rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'")], ["o_custkey"], ["o_orderkey"]).select("o_custkey", "o_orderkey", "shard")


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_id % 7 = 0 THEN ' Unanswerable' WHEN event_id % 5 = 0 THEN ' ' || upper(event_type) || ' ' ELSE event_type END AS answer,
  CASE event_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS w FROM events),
v AS (SELECT user_id, lower(trim(answer)) AS form, sum(w) AS total, min(event_id) AS seen, min_by(trim(answer), event_id) AS answer FROM e WHERE w > 0 AND lower(trim(answer)) <> 'unanswerable' GROUP BY user_id, form)
SELECT user_id, answer, total::BIGINT AS total FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY total DESC, seen) AS rn FROM v) WHERE rn = 1""")
def weighted_vote(t: Tables) -> DataFrame:
    id = F.col("event_id")
    answer = F.when(id % 7 == 0, " Unanswerable").when(id % 5 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).otherwise(F.col("event_type"))
    said = F.element_at(F.array(F.lit(" Yes"), F.lit("maybe"), F.lit("no")), (id % 3 + 1).cast("int"))
    rows = t.events.select("user_id", "event_id", answer.alias("answer"), dedup.confidence(said).cast("long").alias("w"))
    return dedup.weighted_vote(rows, "user_id", "answer", "w", "event_id")


# Relevance tables.


@query("SELECT l_orderkey AS query_id, list(l_partkey ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS candidate_ids, list(l_quantity ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS candidate_scores, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_quantity, l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey")
def qrels_from_pairs(t: Tables) -> DataFrame:
    return qrels.group_pairs(t.lineitem, "l_orderkey", "l_partkey", "l_quantity", ["l_linenumber"], ["l_returnflag"])


CONDITIONAL = "(SELECT o_custkey AS query_id, list(CASE WHEN o_orderkey % 97 = 0 THEN '?' ELSE o_orderstatus END ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey), (SELECT list_sort(list(DISTINCT o_orderstatus)) AS g FROM orders)"
SAME = "list_sort(list_distinct(ids)) = g"


@query(f"SELECT query_id, CASE WHEN {SAME} THEN 'sparse' ELSE 'exhaustive' END AS mode, CASE WHEN {SAME} THEN ids[1:1] ELSE ids END AS candidate_ids, CASE WHEN {SAME} THEN [1.0::DOUBLE] ELSE list_transform(range(len(ids)), lambda i: CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) END AS candidate_scores FROM {CONDITIONAL}")
def conditional_qrels(t: Tables) -> DataFrame:
    """Some queries have a candidate that the global table lacks: as many as there are isn't the same as all there are."""
    status = F.when(F.col("o_orderkey") % 97 == 0, "?").otherwise(F.col("o_orderstatus"))
    local = qrels.group_pairs(t.orders.withColumn("s", F.lit(1.0)).withColumn("status", status), "o_custkey", "status", "s", ["o_orderkey"])
    return qrels.conditional(local, t.orders.select("o_orderstatus"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id, i) - 1 AS candidate_id, words[i] AS text FROM (SELECT doc_id, words, unnest(range(1, 3)) AS i FROM (SELECT doc_id, [lang, source] AS words FROM documents))")
def private_candidates(t: Tables) -> DataFrame:
    return qrels.private_candidates(t.documents.select("doc_id", F.array("lang", "source").alias("c")), "c", ["doc_id"])


@query("SELECT a.conv_id, a.turn, a.text AS query, b.text AS positive FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def train_pairs(t: Tables) -> DataFrame:
    c = t.conversations
    answers = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("positive"))
    return c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query")).join(answers, ["conv_id", "turn"])


# Text functions.


@query(r"""SELECT doc_id, CASE WHEN trim(regexp_replace(t, '\s+', '', 'g')) = '' THEN '' ELSE t END AS text FROM (
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r', chr(10), 'g'), '[ \t]+\n', chr(10), 'g'), '[ \t]+\z', ''), '\A[ \t]+', '') AS t FROM documents)""")
def whitespace_normalize(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.normalize_space(F.col("text")).alias("text"))


@query(f"SELECT doc_id, md5({KEY.format('text')}) AS key FROM documents")
def match_key(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.md5(text.match_key(F.col("text"))).alias("key"))


@query(r"SELECT conv_id, turn, CASE WHEN text = '' THEN '' ELSE regexp_replace(text, '\n+\z', '') || chr(10) END AS text FROM conversations")
def trailing_newline(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.trailing_newline(F.col("text"), "ensure_single").alias("text"))


@query("SELECT conv_id, turn, CASE WHEN starts_with(ltrim(text), 'Query: ') THEN text ELSE 'Query: ' || text END AS text FROM conversations")
def prefix_add(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", text.ensure_prefix(F.col("text"), "Query: ").alias("text"))


NORMAL = r"CASE WHEN regexp_replace({x}, '\s+', '', 'g') = '' THEN '' ELSE regexp_replace(regexp_replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t]+(\n|$)', '\1', 'g'), '^[ \t]+', '') END"


@query(f"""WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN '  <image> ' || text WHEN 1 THEN text || chr(9) || chr(13) || chr(10) || ' <image> and <image>  ' ELSE text || ' <image>' END AS x FROM conversations),
r AS (SELECT *, {NORMAL.format(x="replace(x, '<image>', '')")} AS rest, {NORMAL.format(x="x")} AS whole FROM c)
SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN whole WHEN rest = '' THEN '<image>' ELSE '<image>' || chr(10) || regexp_replace(rest, '^\n+', '') END AS text FROM r""")
def token_layout(t: Tables) -> DataFrame:
    """A token that occurs once moves to a line of its own; texts with two are normalized, those without one get it first."""
    k = F.col("turn") % 3
    shown = F.when(k == 0, F.concat(F.lit("  <image> "), "text")).when(k == 1, F.concat("text", F.lit("\t\r\n <image> and <image>  "))).otherwise(F.col("text"))
    return t.conversations.select("conv_id", "turn", text.token_on_first_line(text.ensure_token(shown, "<image>", "append", " "), "<image>").alias("text"))


@query("SELECT p_partkey, '(A) ' || p_brand || chr(10) || '(B) ' || p_type AS block FROM part")
def choice_block(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.choice_block(F.array("p_brand", "p_type")).alias("block"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_type END AS answer FROM part")
def answer_letter(t: Tables) -> DataFrame:
    letter = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("p_size") % 3 + 1).cast("int"))
    return t.part.select("p_partkey", text.answer_text(letter, F.array(F.concat(F.lit("A. "), "p_brand"), F.concat(F.lit("B) "), "p_type"))).alias("answer"))


@query("SELECT p_partkey, 'asset_' || substr(sha1(p_partkey::VARCHAR || chr(0) || p_name), 1, 16) AS id FROM part")
def stable_id(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", text.stable_id("asset", F.col("p_partkey"), F.col("p_name")).alias("id"))


@query("SELECT l_orderkey, l_linenumber, printf('%s#segment=%.3f-%.3f', 'v' || l_orderkey::VARCHAR, l_quantity, l_quantity + 10) AS key FROM lineitem")
def segment_key(t: Tables) -> DataFrame:
    q = F.col("l_quantity")
    return t.lineitem.select("l_orderkey", "l_linenumber", text.segment_key(F.concat(F.lit("v"), F.col("l_orderkey").cast("string")), q, q + 10).alias("key"))


# Mixture, sharding and reports.


@query("SELECT source, n, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def source_offsets(t: Tables) -> DataFrame:
    return mixture.offsets(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n")


@query("SELECT lang, source, count(*) AS n, count(*) FILTER (n_chars > 1000) AS long_texts FROM documents GROUP BY lang, source")
def split_counts(t: Tables) -> DataFrame:
    return t.documents.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_chars") > 1000).alias("long_texts"))


WEIGHTS = {"src0": 4, "src1": 3, "src2": 2}


@query("""WITH s AS (SELECT source, count(*) AS n, CASE source WHEN 'src0' THEN 4 WHEN 'src1' THEN 3 WHEN 'src2' THEN 2 ELSE 1 END AS weight FROM documents GROUP BY source), g AS (SELECT sum(weight) AS w, sum(n) AS t FROM s)
  SELECT source, n, weight::BIGINT AS weight, round(100.0 * weight / w, 4)::DOUBLE AS weight_share, round(100.0 * n / t, 4)::DOUBLE AS size_share, (n * w // weight)::BIGINT AS expected_length FROM s, g""")
def mixture_report(t: Tables) -> DataFrame:
    return mixture.report(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n", WEIGHTS)


@query("SELECT doc_id, source, pos::BIGINT AS pos, ((pos // 8) % 4)::BIGINT AS rank FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos FROM documents)")
def shard_assignment(t: Tables) -> DataFrame:
    return mixture.ordinals(t.documents.select("doc_id", "source"), "source", ["doc_id"]).withColumn("rank", mixture.shard("pos", 8, 4))


@query("""WITH n AS (SELECT count(*) AS n FROM documents), c AS (SELECT k, row_number() OVER (ORDER BY md5('7:' || k::VARCHAR), k) - 1 AS spot FROM (SELECT unnest(range(n // 16)) AS k FROM n))
SELECT doc_id, (coalesce(spot, (SELECT n // 16 FROM n)) * 16 + doc_id % 16)::BIGINT AS place FROM documents LEFT JOIN c ON k = doc_id // 16""")
def chunk_order(t: Tables) -> DataFrame:
    """Whole chunks of 16 in seeded order, the short one last."""
    return mixture.shuffled_chunks(t.documents.select("doc_id"), "doc_id", 16, t.documents.count(), 7).select("doc_id", "place")


@query("""WITH s AS (SELECT event_id, row_number() OVER (ORDER BY md5('5:' || event_id::VARCHAR), event_id) - 1 AS pos, count(*) OVER () AS n FROM events),
p AS (SELECT event_id, pos + k * n AS spot FROM s, range(0, 2) r(k) WHERE pos + k * n < ceil(n / 7.0) * 7)
SELECT event_id, (spot % 7)::BIGINT AS rank, (spot // 7)::BIGINT AS step FROM p WHERE spot // 7 >= 3""")
def rank_samples(t: Tables) -> DataFrame:
    """Shuffled rows dealt to seven ranks, the first repeated so that all have as many, after three steps."""
    return mixture.rank_samples(t.events.select("event_id"), ["event_id"], t.events.count(), 7, seed=5, consumed=21)


@query("""WITH n AS (SELECT count(*) AS n FROM events), e AS (SELECT event_id, event_id // 24 AS local, n // 24 AS whole FROM events, n)
SELECT event_id, (k * whole + local)::BIGINT AS step, (event_id % 24 // 8)::BIGINT AS rank, (event_id % 8)::BIGINT AS slot FROM e, range(0, 3) r(k) WHERE local < whole AND k * whole + local < whole * 2 + 5""")
def simulated_batches(t: Tables) -> DataFrame:
    """Two epochs and five steps of batches of eight for three ranks."""
    n = t.events.count()
    return mixture.batches(t.events.select("event_id"), "event_id", n, 8, 3, n // 24 * 2 + 5)


@query("WITH n AS (SELECT count(*) AS n FROM documents) SELECT doc_id, (CASE WHEN doc_id < (n % 7) * (n // 7 + 1) THEN doc_id // (n // 7 + 1) ELSE n % 7 + (doc_id - (n % 7) * (n // 7 + 1)) // (n // 7) END)::BIGINT AS rank FROM documents, n")
def contiguous_shards(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", mixture.contiguous("doc_id", t.documents.count(), 7).alias("rank"))


@query("""WITH s AS (SELECT lang, n, sum(n) OVER (ORDER BY lang) - n AS off FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang))
SELECT d.doc_id AS position, s.lang, (d.doc_id - off)::BIGINT AS local FROM documents d JOIN s ON d.doc_id >= off AND d.doc_id < off + n""")
def global_index(t: Tables) -> DataFrame:
    """Which source a global position lies in, and where in it."""
    sizes = t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return mixture.locate(t.documents.select(F.col("doc_id").alias("position")), sizes, "lang", "n").select("position", "lang", "local")


@query("SELECT doc_id, lang FROM documents")
def restored_order(t: Tables) -> DataFrame:
    """Rows gathered from ranks, back in their order; positions are checked."""
    n = t.documents.count()
    parts = t.documents.select("doc_id", "lang").withColumn("rank", mixture.contiguous("doc_id", n, 5)).repartition(5, "rank")
    return mixture.restore_order(parts, "doc_id", n).select("doc_id", "lang")


@query("SELECT n_nationkey AS request, CASE n_nationkey % 2 WHEN 0 THEN 'region' ELSE 'nation' END AS subset, CASE n_nationkey % 2 WHEN 0 THEN r_name ELSE n_name END AS name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey % 5")
def union_fetch(t: Tables) -> DataFrame:
    """Named subsets put together, and rows fetched from them by subset and place."""
    both = mixture.named_union({"region": t.region.select(F.col("r_regionkey").alias("local"), F.col("r_name").alias("name")), "nation": t.nation.select(F.col("n_nationkey").alias("local"), F.col("n_name").alias("name"))})
    odd = F.col("n_nationkey") % 2 == 1
    wanted = t.nation.select(F.col("n_nationkey").alias("request"), F.when(odd, "nation").otherwise("region").alias("subset"), F.when(odd, F.col("n_nationkey")).otherwise(F.col("n_nationkey") % 5).alias("local"))
    return mixture.fetch(wanted, both, "subset", "local", "request").select("request", "subset", "name")


@query("""WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM documents),
r AS (SELECT *, dense_rank() OVER (ORDER BY lang) - 1 AS turn FROM p), m AS (SELECT max(ceil(n / 32.0)) AS blocks FROM r)
SELECT doc_id, lang, (pos // 32)::BIGINT AS turn, turn AS seat, (pos % 32)::BIGINT AS slot FROM r""")
def round_robin_interleave(t: Tables) -> DataFrame:
    return mixture.take_turns(t.documents.select("doc_id", "lang"), "lang", ["doc_id"], 32).select("doc_id", "lang", "turn", "seat", "slot")


@query("""WITH s AS (SELECT lang, (n + 31) // 32 AS parts, row_number() OVER (ORDER BY lang) - 1 AS seat, count(*) OVER () AS k, max(n) OVER () AS most FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)),
blocks AS (SELECT any_value(k) AS k, unnest(range(0, 64 + any_value(k) * any_value(most))) AS block FROM s),
drawn AS (SELECT block, floor(('0x' || substr(md5('3:' || block), 1, 13))::BIGINT / 4503599627370496.0 * k)::BIGINT AS seat FROM blocks),
dealt AS (SELECT block, lang, parts, row_number() OVER (PARTITION BY lang ORDER BY block) - 1 AS pos FROM drawn JOIN s USING (seat)),
plan AS (SELECT block, lang, pos // parts AS round, pos % parts AS part FROM dealt WHERE block < (SELECT max(block) FROM dealt WHERE pos = parts)),
rounds AS (SELECT doc_id, lang, unnest(range(0, m + 1)) AS round FROM documents JOIN (SELECT lang, max(round) AS m FROM plan GROUP BY lang) USING (lang)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang, round ORDER BY md5('3:' || round || ':' || doc_id), doc_id) - 1 AS pos FROM rounds)
SELECT p.lang, p.round::BIGINT AS round, doc_id, block::BIGINT AS block, (pos % 32)::BIGINT AS slot FROM placed p JOIN plan ON p.lang = plan.lang AND p.round = plan.round AND part = pos // 32""")
def weighted_shuffled_interleave(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "lang")
    sizes = {r[0]: r[1] for r in docs.groupBy("lang").count().orderBy("lang").collect()}
    plan = mixture.draws(t.spark, sizes, "lang", 32, dict.fromkeys(sizes, 1.0), seed=3)
    return mixture.interleave(docs, "lang", ["doc_id"], plan, 32, seed=3)


@query("SELECT doc_id, CASE WHEN doc_id < (SELECT count(*) FROM documents) // 32 * 32 THEN doc_id - doc_id % 32 + (doc_id % 4) * 8 + (doc_id % 32) // 4 ELSE doc_id END AS place FROM documents")
def stride_interleave(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", mixture.stride("doc_id", 4, 8, t.documents.count()).alias("place"))


@query('SELECT (event_id // 50)::BIGINT AS "window", round(sum(value), 4) AS total, round(avg(value), 4) AS mean, max(value) AS most, count(*) AS n FROM events GROUP BY ALL')
def step_windows(t: Tables) -> DataFrame:
    out = analytics.step_windows(t.events.select((F.col("event_id") + 1).alias("step"), "value"), "step", "value", 50)
    return out.select("window", F.round("total", 4).alias("total"), F.round("mean", 4).alias("mean"), "most", "n")


@query("""WITH r AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)
  SELECT user_id, event_id, value, best, n - max(CASE WHEN prev IS NULL OR value > prev THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS patience FROM r""")
def running_best(t: Tables) -> DataFrame:
    return analytics.running_best(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value")


@query("""WITH r AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id) AS best, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n,
  min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM events)
  SELECT user_id, event_id, best, n - max(CASE WHEN prev IS NULL OR prev - value > 0.5 THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS patience FROM r""")
def running_best_lower(t: Tables) -> DataFrame:
    """The least value so far; only what is lower by more than a half counts as better."""
    out = analytics.running_best(t.events.select("user_id", "event_id", "value"), "user_id", "event_id", "value", threshold=0.5, lower=True)
    return out.select("user_id", "event_id", "best", "patience")


PLANNED = """WITH s AS (SELECT source, count(*) AS n, count(*) FILTER (lang = 'en') + 1 AS w FROM documents GROUP BY source),
f AS (SELECT *, greatest(1, floor(n * 100 / (SELECT {most} * sum(n) FROM s))::BIGINT + 1) AS least, greatest(1, round_even(w * 100 / (SELECT sum(w) FROM s), 0)::BIGINT) AS scaled FROM s),
g AS (SELECT source, n, least, greatest(least, scaled) AS w FROM f), o AS (SELECT sum(w) - 100 AS over FROM g),
taken AS (SELECT source, count(*) AS t FROM (SELECT source, row_number() OVER (ORDER BY step DESC, source) AS i FROM (SELECT source, unnest(range(1, w - least + 1)) AS step FROM g)) WHERE i <= (SELECT over FROM o) GROUP BY source)
SELECT '{name}' AS plan, source, n, (w + CASE WHEN (SELECT over FROM o) < 0 AND source = (SELECT source FROM s ORDER BY n, source LIMIT 1) THEN -(SELECT over FROM o) ELSE 0 END - coalesce(t, 0))::BIGINT AS weight FROM g LEFT JOIN taken USING (source)"""


@query(" UNION ALL ".join(f"SELECT * FROM ({PLANNED.format(most=most, name=name)})" for name, most in (("tight", 1.1), ("wide", 9))))
def weight_plan(t: Tables) -> DataFrame:
    """Weights of the sources from the number of their English texts, with high floors and with low ones."""
    sizes = t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("lang") == "en") + 1).alias("w"))
    n = t.documents.count()
    plans = [mixture.weight_plan(sizes, "source", "n", "w", "source", most * n).select(F.lit(name).alias("plan"), "source", "n", "weight") for name, most in (("tight", 1.1), ("wide", 9))]
    return plans[0].unionByName(plans[1])


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 3")
def keep_last_n(t: Tables) -> DataFrame:
    return analytics.keep_last(t.events.select("user_id", "event_id"), "user_id", "event_id", 3)


@query("SELECT doc_id, 2 * (t * (8.0 * 64 * 64 + 6.0 * 64 * 256) + 4.0 * 64 * t * t) AS flops FROM (SELECT doc_id, n_chars::DOUBLE AS t FROM documents)")
def flops_language(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", arrays.language_flops(F.col("n_chars"), 2, 64, 256).alias("flops"))


IN_BATCH = """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS candidate_id, list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / 0.5 AS s
  FROM embeddings q JOIN embeddings c ON c.vec_id // 20 = q.vec_id // 20), m AS (SELECT *, max(s) OVER (PARTITION BY query_id) AS m FROM s),
  l AS (SELECT query_id, ln(sum(exp(s - m))) + max(m) - max(CASE WHEN candidate_id = query_id THEN s END) AS loss FROM m GROUP BY query_id)"""


def _in_batch(t: Tables) -> DataFrame:
    e = t.embeddings.select(F.expr("vec_id DIV 20").alias("batch"), "vec_id", "embedding")
    return analytics.in_batch_scores(e, e, "batch", "vec_id", "embedding")


@query(IN_BATCH + " SELECT query_id, round(loss, 6) AS loss FROM l")
def contrastive_loss(t: Tables) -> DataFrame:
    """The loss of every row among the twenty of its batch."""
    return analytics.contrastive_loss(_in_batch(t), "query", "candidate", "score", "positive", 0.5).select(F.col("query").alias("query_id"), F.round("loss", 6).alias("loss"))


@query(IN_BATCH + " SELECT round(avg(loss), 5) AS mean, round(sum(loss), 2) AS total FROM l")
def contrastive_loss_reduced(t: Tables) -> DataFrame:
    loss = lambda how: analytics.contrastive_loss(_in_batch(t), "query", "candidate", "score", "positive", 0.5, how)
    return loss("mean").select(F.round("loss", 5).alias("mean")).join(loss("sum").select(F.round("loss", 2).alias("total")))


@query("""WITH s AS (SELECT q.vec_id AS query, i AS place, 2 * list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) AS s
  FROM embeddings q, range(0, 4) r(i) JOIN embeddings c ON c.vec_id = q.vec_id // 4 * 4 + (q.vec_id + i) % 4), m AS (SELECT *, max(s) OVER (PARTITION BY query) AS m FROM s)
  SELECT query, round(ln(sum(exp(s - m))) + max(m) - max(CASE WHEN place = 0 THEN s END), 6) AS loss, arg_max(place, (round(s, 12), -place))::BIGINT AS pick, arg_max(place, (round(s, 12), -place)) = 0 AS correct FROM m GROUP BY query""")
def choice_loss(t: Tables) -> DataFrame:
    """Four candidates for each query, of which the first, here itself, is right."""
    e = t.embeddings.select("vec_id", "embedding")
    asked = e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("q"), F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("place"))
    asked = asked.withColumn("vec_id", F.expr("query DIV 4 * 4 + (query + place) % 4"))
    scored = asked.join(e, "vec_id").select("query", "place", F.round(arrays.dot(F.col("q"), F.col("embedding")), 12).alias("score"))
    return analytics.choice_loss(scored, "query", "place", "score", 2.0).select("query", F.round("loss", 6).alias("loss"), "pick", "correct")


from . import catalogue_more, catalogue_parsers, catalogue_quality, catalogue_training  # noqa: E402, F401  they register their queries


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Small fixtures for operators whose point is what they refuse or how they break ties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrymill.functions import arrays, text
from quarrymill.operators import analytics, lookup, mixture, qrels, quality
from quarrymill.plans import converters, retrieval
from quarrymill.sources import files
from quarrymill.streaming import gate


def test_lookup_raises_on_unmatched_and_on_duplicate_keys(spark):
    left = spark.createDataFrame([(1, "a"), (2, "x")], "n int, k string")
    side = spark.createDataFrame([("a", 10)], "k2 string, v int")
    found = lookup.lookup(left, lookup.Lookup(side, "k", "k2"))
    for read in (found.collect, found.select("n").collect, found.select("n", "v").collect, found.count, found.agg(F.max("n")).collect):
        with pytest.raises(Exception, match="no match for key x"):
            read()
    assert {r["v"] for r in lookup.lookup(left, lookup.Lookup(side, "k", "k2", missing="skip")).collect()} == {10, None}
    assert lookup.lookup(left.where("n = 1"), lookup.Lookup(side.select("k2"), "k", "k2")).collect() == [(1, "a")]
    # Joins are lazy plans: a repeated key raises when the side is read.
    with pytest.raises(Exception, match="duplicate keys"):
        lookup.lookup(left, lookup.Lookup(side.union(side), "k", "k2", missing="skip")).collect()
    with pytest.raises(IndexError):
        lookup.positional(left.withColumnRenamed("n", "row_pos"), spark.createDataFrame([(-1, 0)], "row_pos int, request_pos int"))
    names = spark.createDataFrame([(["x", "y"],)], "names array<string>")
    assert lookup.class_names(left.where("n = 1"), "n", names, "name").collect()[0]["name"] == "y"
    with pytest.raises(Exception, match="no class 2"):
        lookup.class_names(left, "n", names, "name").collect()


def test_metrics_of_graded_and_binary_rankings(spark):
    ranked = spark.createDataFrame([(0, c, r) for r, c in enumerate("abc", 1)], "query_id long, candidate_id string, rank int")
    queries = spark.createDataFrame([(0,), (1,)], "query_id long")
    qrels = spark.createDataFrame([(0, ["a", "c"], [3.0, 2.0])], "query_id long, candidate_ids array<string>, candidate_scores array<double>")
    got = {r["query_id"]: r for r in retrieval.query_metrics(ranked, retrieval.relevance(qrels), queries, [1, 3]).collect()}
    assert got[0]["hit_3"] == got[0]["mrr_3"] == 1.0 and got[0]["map_3"] == pytest.approx(5 / 6)
    assert got[0]["ndcg_3"] == pytest.approx((3 + 2 / 2) / (3 + 2 / 1.584962500721156))
    assert set(got[1][1:]) == {0.0}
    assert retrieval.parse_metrics(["hit@1", "hit@1", "ndcg@10"]) == [("hit", 1), ("ndcg", 10)]
    with pytest.raises(ValueError):
        retrieval.parse_metrics(["hit@0"])


def test_schedule_without_weights_takes_turns():
    assert [(b[1], b[3]) for b in mixture.schedule({"a": 3, "b": 2}, 1, stop="first_exhausted")] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2)]
    both = mixture.schedule({"a": 3, "b": 2}, 1)
    assert {(b[1], b[3]) for b in both} >= {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)}
    assert sum(mixture.optimize_weights({"a": 1000, "b": 10, "c": 500}, 4_500_000).values()) == 100


def test_text_and_array_functions(spark):
    row = spark.createDataFrame([(" a \r\nb\t\n",)], "t string").select(
        text.normalize_space(F.col("t")).alias("n"), text.side(F.lit(" TGT ")).alias("s"), text.last_number(F.lit("frame_2_010")).alias("d"),
        arrays.uniform_indices(F.lit(10), 4).alias("u"), arrays.frame_range(F.lit(0.5), F.lit(9.0), F.lit(2.0), F.lit(10)).alias("f"), text.stem(F.lit("x/y.tar.gz")).alias("stem"),
    ).first()
    assert row["n"] == "a\nb\n" and row["s"] == "positive" and row["d"] == 10 and row["u"] == [0, 3, 6, 9]
    assert tuple(row["f"]) == (1, 10) and row["stem"] == "y.tar"


def test_gate_and_audit(spark):
    found = quality.required_fields(spark.createDataFrame([(1, None, "sample_1")], "id int, t string, sample_id string"), ["t"], "d")
    with pytest.raises(ValueError, match="schema_required_field_missing=1"):
        quality.gate(found)
    assert quality.gate(found, "off").count() == quality.gate(found, "light").count() == 1
    with pytest.raises(ValueError):
        quality.gate(found.where("false"), "light", quality.audit(found))
    assert quality.gate(found.where("false"), "full").count() == 0
    with pytest.raises(ValueError, match="unknown mode"):
        quality.gate(found, "some")
    report = quality.report(quality.audit(found), quality.decisions(found), "d")
    assert "- Ready: no" in report and "- `schema_required_field_missing`: Missing required field: t" in report and "0 / 0 / 1" in report
    assert "- None" in quality.report(quality.audit(found.where("false")), quality.decisions(found.where("false")), "d")


def test_findings_take_the_gravest_target(spark):
    rows = [("empty_text", "error", "sample", "drop", "d", "m1", "s1", None, None), ("broken_media", "error", "asset", "quarantine", "d", "m2", "s1", None, "a1"), ("invalid_positive", "error", "relation", "block", "d", "m3", None, "r1", None)]
    found = spark.createDataFrame([(*r, None) for r in rows], quality.FINDING)
    got = {(r["target_type"], r["target_id"]): (r["action"], r["reasons"], r["messages"]) for r in quality.decisions(found).collect()}
    assert got == {("sample", "s1"): ("drop", ["empty_text"], ["m1"]), ("asset", "a1"): ("quarantine", ["broken_media"], ["m2"]), ("relation", "r1"): ("quarantine", ["invalid_positive"], ["m3"])}


def test_integrity_of_relevance(spark):
    q, c = spark.createDataFrame([("q1",)], "id string"), spark.createDataFrame([("c1",)], "id string")
    kind = "relation_id string, query_id string, candidate_ids array<string>, candidate_scores array<double>"
    assert [r["message"] for r in quality.retrieval_integrity(q, c, spark.createDataFrame([], kind), "d").collect()] == ["Retrieval dataset has no qrels rows."]
    rows = [("r1", "q1", ["c1"], [1.0]), ("r2", "gone", ["c1", "lost"], [1.0, 0.0]), ("r3", "q1", [], []), ("r4", "q1", None, None), ("r5", "q1", ["c1"], [0.0]), ("r6", "q1", ["c1"], [None])]
    got = sorted((r["relation_id"], r["reason_code"]) for r in quality.retrieval_integrity(q, c, spark.createDataFrame(rows, kind), "d").collect())
    assert got == [("r2", "missing_candidate_link"), ("r2", "missing_query_link"), ("r3", "empty_qrels"), ("r4", "empty_qrels"), ("r5", "invalid_positive"), ("r6", "invalid_positive")]
    with pytest.raises(ValueError, match="unsupported loader"):
        quality.train_documents(q, "other", "d", ["id"])


def test_relevance_refuses(spark):
    kind = "query_id long, candidate_ids array<long>, candidate_scores array<double>"
    with pytest.raises(Exception, match="unequal length"):
        retrieval.relevance(spark.createDataFrame([(1, [1, 2], [1.0])], kind)).collect()
    known = spark.createDataFrame([(1,), (2,)], "id long")
    with pytest.raises(Exception, match="unknown candidate 3"):
        retrieval.relevance(spark.createDataFrame([(1, [1, 3], [1.0, 1.0])], kind), known).collect()
    got = retrieval.relevance(spark.createDataFrame([(1, [1, 2, 1, None, 2], [1.0, None, 3.0, 1.0, 0.0])], kind), known).collect()
    assert [tuple(r) for r in got] == [(1, 1, 3.0)]


def test_top_k_in_blocks_equals_plain_sorting(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 2000)
    monkeypatch.setattr(retrieval, "RUN", 16)
    rng = np.random.default_rng(0)
    vectors = rng.integers(-2, 3, (100, 3)).astype(float)  # many ties
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["candidate_id"] for r in retrieval.top_k(rows.where("id % 5 = 0"), rows, 6, skip_self=True).collect()}
    for q in range(0, 100, 5):
        order = sorted((c for c in range(100) if c != q), key=lambda c: (-round(float(vectors[q] @ vectors[c]), 9), c))
        assert [got[q, k + 1] for k in range(6)] == order[:6]
    few = retrieval.top_k(rows.where("id = 1"), rows.where("id < 3"), 10)
    assert few.count() == 3  # ranks beyond the pool aren't there
    assert retrieval.top_k(rows.where("id < 0"), rows, 3).count() == 0


def test_samplers(spark):
    rows = spark.range(10).toDF("i")
    dealt = mixture.rank_samples(rows, ["i"], 10, 4).collect()
    by = {k: [r["i"] for r in sorted(dealt, key=lambda r: r["step"]) if r["rank"] == k] for k in range(4)}
    assert by == {0: [0, 4, 8], 1: [1, 5, 9], 2: [2, 6, 0], 3: [3, 7, 1]}
    assert sorted(r["i"] for r in mixture.rank_samples(rows, ["i"], 10, 4, drop_last=True).collect()) == list(range(8))
    assert {r["step"] for r in mixture.rank_samples(rows, ["i"], 10, 4, consumed=4).collect()} == {1, 2}
    assert mixture.rank_samples(rows.where("i < 2"), ["i"], 2, 5).count() == 5
    first, again, other = ([r["i"] for r in mixture.rank_samples(rows, ["i"], 10, 1, seed=s).orderBy("step").collect()] for s in (1, 1, 2))
    assert first == again != other and sorted(first) == list(range(10))
    placed = mixture.shuffled_chunks(rows, "i", 3, 10, 5).orderBy("place").collect()
    assert [r["i"] for r in placed][9] == 9 and all([r["i"] for r in placed][3 * k + 1] == [r["i"] for r in placed][3 * k] + 1 for k in range(3))
    assert mixture.shuffled_chunks(rows, "i", 3, 10, 5, drop_last=True).count() == 9
    run = mixture.batches(rows, "i", 10, 2, 2, 5).collect()
    assert len(run) == 5 * 4 and {r["i"] for r in run} == set(range(8)) and {r["step"] for r in run} == set(range(5))
    assert mixture.batches(rows, "i", 10, 2, 2, 3, drop_last=False).count() == 10
    with pytest.raises(ValueError):
        mixture.batches(rows, "i", 10, 8, 2, 1)
    ranks = [r[0] for r in rows.select(mixture.contiguous("i", 10, 4)).collect()]
    assert ranks == [0, 0, 0, 1, 1, 1, 2, 2, 3, 3]
    assert [r["i"] for r in mixture.restore_order(rows.repartition(3), "i", 10).collect()] == list(range(10))
    with pytest.raises(Exception, match="no permutation"):
        mixture.restore_order(rows.union(rows.where("i = 1")), "i", 11).collect()


def test_conditional_relevance_compares_sets(spark):
    local = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "x"]), (3, ["b", "a", "a"]), (4, ["a"])], "query_id long, candidate_ids array<string>")
    got = {r["query_id"]: r["mode"] for r in qrels.conditional(local, spark.createDataFrame([("a",), ("b",)], "id string")).collect()}
    assert got == {1: "sparse", 2: "exhaustive", 3: "sparse", 4: "exhaustive"}
    with pytest.raises(Exception, match="differ at 1"):
        rows = spark.createDataFrame([(0, "a"), (1, "b")], "pos long, query_id string")
        qrels.aligned(rows, spark.createDataFrame([(0, "a"), (1, "c")], "pos long, id string")).collect()


def test_losses_of_small_batches(spark):
    unit = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0]])], "b int, p long, v array<double>")
    keys = spark.createDataFrame([(0, i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 0.0], [0.0, 1.0], [0.0, 0.0]])], "b int, p long, v array<double>")
    scores = analytics.in_batch_scores(unit, keys, "b", "p", "v", per_query=2)
    each = math.log(math.e + 3) - 1
    assert [r["loss"] for r in analytics.contrastive_loss(scores, "query", "candidate", "score", "positive", 1.0).collect()] == pytest.approx([each, each])
    assert analytics.contrastive_loss(scores, "query", "candidate", "score", "positive", 1.0, "sum").first()[0] == pytest.approx(2 * each)
    with pytest.raises(ValueError):
        analytics.contrastive_loss(scores, "query", "candidate", "score", "positive", 1.0, "some")
    nothing = analytics.totals(spark.createDataFrame([], "v double"), ["v"]).first()
    assert nothing["n"] == 0 and math.isnan(nothing["v"])
    worse = analytics.running_best(spark.createDataFrame([("k", i, v) for i, v in enumerate([3.0, 2.95, 2.0, 2.5])], "k string, s int, v double"), "k", "s", "v", threshold=0.1, lower=True).orderBy("s").collect()
    assert [(r["best"], r["patience"]) for r in worse] == [(3.0, 0), (2.95, 1), (2.0, 0), (2.0, 1)]


def test_sources_and_stream(spark, tmp_path):
    (tmp_path / "a.txt").write_text("v1 0.5 2##He runs\n\n")
    assert [tuple(r) for r in files.annotation_lines(spark, str(tmp_path / "a.txt")).collect()] == [("v1", 0.5, 2.0, "He runs")]
    (tmp_path / "b.txt").write_text("v1 0.5\n")
    with pytest.raises(Exception, match="bad line"):
        files.annotation_lines(spark, str(tmp_path / "b.txt")).collect()
    df = spark.createDataFrame([("x", 1), ("y", 2)], "s string, v int")
    with pytest.raises(ValueError, match="no rows for"):
        files.fan_out(df, str(tmp_path / "out"), "s", ["x", "z"])
    files.fan_out(df, str(tmp_path / "out"), "s", ["x"])
    assert files.scan(spark, str(tmp_path / "out"), ["v"], "s = 'x'").collect()[0][0] == 1
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"id": "a", "ts": "2024-01-01T00:00:00", "text": "t"}\n{"id": "b", "ts": "2024-01-01T00:10:00", "text": " "}\n')
    stream = spark.readStream.schema("id string, ts timestamp, text string").json(str(tmp_path / "in"))
    counted = gate.counts(gate.checked(stream, ["text"]).withColumn("k", F.lit("all")), "ts", "k")
    counted.writeStream.format("memory").queryName("gate").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [(r["n"], r["failed"]) for r in spark.table("gate").collect()] == [(2, 1)]


def test_queries_with_many_judgments_are_put_together_from_runs(spark, monkeypatch):
    monkeypatch.setattr(qrels, "RUN", 8)
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([*range(9), None]), rng.choice([0.5, 1.0, None]), rng.choice([*range(20), None]), rng.choice("ab")) for _ in range(500)] + [(9, 1, 1.0, 1, "a")]
    pairs = spark.createDataFrame(rows, "q long, c long, s double, at long, x string").repartition(5)
    args = pairs, "q", "c", "s", ["at"], ["x"]
    plain, large = (sorted((tuple(r) for r in f(*args).collect()), key=repr) for f in (qrels.group_pairs, qrels.group_large))
    assert plain == large and len(large) == 5
    # Judgments of a bundle go this way once a query has more than a run, by their runs alone.
    queries, corpus = spark.createDataFrame([(1,)], "`query-id` long"), spark.range(40).selectExpr("id AS `corpus-id`", "named_struct('bytes', X'00', 'path', 'p') AS image")
    judged = spark.range(40).selectExpr("1L AS `query-id`", "id AS `corpus-id`", "1 AS score", "-id AS at")
    _, _, table = converters.beir_bundle(queries, corpus, judged, ("at",))
    assert table.first()["candidate_ids"] == list(range(39, -1, -1)) and "__run" in table._jdf.queryExecution().toString()

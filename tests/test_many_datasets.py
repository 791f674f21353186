"""Many datasets evaluated in one plan, and families of metrics that a user adds."""

import time

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrymill.plans import benchmarks, retrieval


@pytest.fixture(scope="module")
def data(spark):
    """Three datasets with the same ids, one much larger; d2 ranks only what its qrels list."""
    rng = np.random.default_rng(5)
    vectors, qrels = [], []
    for name, n in (("d0", 400), ("d1", 30), ("d2", 25)):
        vectors += [(name, i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(n)]
        for q in range(0, n, 5):
            ids = sorted(int(x) for x in rng.choice([i for i in range(n) if i != q], 8, replace=False))
            qrels.append((name, q, "exhaustive" if name == "d2" else None, ids, rng.integers(0, 3, 8).astype(float).tolist()))
    return spark.createDataFrame(vectors, "dataset string, id long, vector array<float>"), spark.createDataFrame(qrels, "dataset string, query_id long, mode string, candidate_ids array<long>, candidate_scores array<double>")


def test_each_dataset_as_if_alone(data, monkeypatch):
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 1500)
    monkeypatch.setattr(retrieval, "RUN", 16)
    vectors, qrels = data
    queries, metrics = vectors.where("id % 5 = 0"), ["hit@1", "mrr@5", "map@5", "ndcg@3"]
    together = {(r["dataset"], r["query_id"]): tuple(r)[2:] for r in retrieval.evaluate_each(queries, vectors, qrels, metrics, skip_self=True).collect()}
    for name in ("d0", "d1", "d2"):
        own = lambda df: df.where(F.col("dataset") == name).drop("dataset")  # noqa: E731, B023
        alone = retrieval.evaluate(own(queries), own(vectors), own(qrels), metrics, skip_self=True).collect()
        assert {(name, r["query_id"]): tuple(r)[1:] for r in alone} == {k: v for k, v in together.items() if k[0] == name}
    assert len(together) == 80 + 6 + 5


def test_checks_of_one_dataset_hold_within_many(spark, data):
    vectors, qrels = data
    queries = vectors.where("id % 5 = 0")
    wrong = qrels.withColumn("candidate_ids", F.when((F.col("dataset") == "d1") & (F.col("query_id") == 0), F.array(F.lit(399).cast("long"), *[F.lit(i).cast("long") for i in range(1, 8)])).otherwise(F.col("candidate_ids")))
    with pytest.raises(Exception, match="unknown candidate"):  # d0 has 399, d1 has not
        retrieval.evaluate_each(queries, vectors, wrong).collect()
    names = spark.createDataFrame([("d0", "a", "x"), ("d1", "a", "y"), ("d2", "b", "z")], "dataset string, modality string, task_type string")
    out = {(r["dataset"], r["metric"]): (r["value"], r["n"]) for r in benchmarks.run(queries, vectors, qrels, names, {"a": "hit@1", "b": "ndcg@3"}, ["hit@1", "ndcg@3"], skip_self=True).collect()}
    assert {k[0] for k in out} == {"d0", "d1", "d2", "a/x", "a/y", "b/z", "a", "b", "_summary"} and out["d1", "hit_1"][1] == 6
    main = [out["d0", "hit_1"][0], out["d1", "hit_1"][0], out["d2", "ndcg_3"][0]]
    assert out["_summary", "mean"] == (pytest.approx(np.mean(main), abs=1e-4), 3) and out["a", "mean"][0] == pytest.approx(np.mean(main[:2]), abs=1e-4)
    with pytest.raises(Exception, match="no queries of dataset d9"):
        benchmarks.run(queries, vectors, qrels, names.union(spark.createDataFrame([("d9", "a", "x")])), {"a": "hit@1", "b": "hit@1"}, ["hit@1"]).collect()
    with pytest.raises(Exception, match="unknown dataset d2"):
        benchmarks.run(queries, vectors, qrels, names.where("dataset <> 'd2'"), {"a": "hit@1", "b": "hit@1"}, ["hit@1"]).collect()
    with pytest.raises(ValueError, match="metrics lack"):
        benchmarks.run(queries, vectors, qrels, names, {"a": "hit@10"}, ["hit@1"])
    mixed = vectors.withColumn("vector", F.when(F.col("id") == 3, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector")))
    with pytest.raises(Exception, match="vectors of a dataset"):
        retrieval.evaluate_each(queries, mixed, qrels).collect()


def test_large_datasets_are_spread_and_small_ones_stay_whole(monkeypatch):
    monkeypatch.setattr(retrieval, "RUN", 100)
    monkeypatch.setattr(retrieval, "GROUP_BYTES", 1 << 20)
    large, small, wide = retrieval.deal([(5_000, 100_000, 256), (10, 50, 256), (500, 3_000, 4096)], 16)
    assert small == (1, 1)
    for (q, c, size), (blocks, groups) in (((5_000, 100_000, 256), large), ((500, 3_000, 4096), wide)):
        assert -(-q // blocks) * size <= 1 << 20 and -(-c // groups) * size <= 1 << 20
    assert large[0] * large[1] >= 15


def test_families_that_a_user_adds(data, monkeypatch):
    monkeypatch.setattr(retrieval, "ADDED", {})
    vectors, qrels = data
    queries = vectors.where("id % 5 = 0")
    count = lambda x: F.size(F.filter(x, lambda g: g > 0))
    retrieval.register_family("recall", lambda gains, ideal, k: F.when(F.size(ideal) > 0, count(gains) / F.size(ideal)).otherwise(0.0))

    @F.pandas_udf("double")
    def spread(gains: pd.Series) -> pd.Series:
        return gains.map(lambda g: float(np.sum(g)))

    retrieval.register_family("gain", lambda gains, ideal, k: spread(gains))
    for bad in ("hit", "recall", "no word", ""):
        with pytest.raises(ValueError):
            retrieval.register_family(bad, lambda g, i, k: F.lit(0.0))
    with pytest.raises(ValueError, match="unknown metric"):
        retrieval.parse_metrics(["other@3"])
    names = ["recall@5", "hit@5", "gain@2", "recall@1"]
    per = retrieval.evaluate_each(queries, vectors, qrels, names, skip_self=True)
    assert per.columns == ["dataset", "query_id", "recall_5", "hit_5", "gain_2", "recall_1"]
    ranked = retrieval.top_k_each(queries, vectors, 5, skip_self=True).where("dataset = 'd0'").collect()
    gains = {(r["query_id"], c): g for r in qrels.where("dataset = 'd0'").collect() for c, g in zip(r["candidate_ids"], r["candidate_scores"], strict=True) if g > 0}
    for r in per.where("dataset = 'd0'").collect():
        mine = {x["rank"]: gains.get((x["query_id"], x["candidate_id"]), 0) for x in ranked if x["query_id"] == r["query_id"]}
        n = sum(q == r["query_id"] for q, _ in gains)
        assert r["gain_2"] == mine[1] + mine[2] and r["hit_5"] == float(any(mine.values()))
        assert r["recall_5"] == pytest.approx(sum(g > 0 for g in mine.values()) / min(n, 5) if n else 0.0)


def test_long_lists_of_judgments_take_no_square_of_their_length(spark):
    """A list of 60,000 ids in a dataset: compared by pairs it would take minutes."""
    n = 60_000
    vectors = spark.range(n).selectExpr("'d' AS dataset", "id", "array(float(id % 7), 1f) AS vector")
    judged = spark.range(0, 40, 20).selectExpr("'d' AS dataset", "id AS query_id", "'exhaustive' AS mode", f"sequence(0L, {n - 1}L) AS candidate_ids").selectExpr("*", "transform(candidate_ids, x -> IF(x % 7 = 6 AND x > 100, 1D, 0D)) AS candidate_scores")
    began = time.monotonic()
    got = retrieval.evaluate_each(vectors.where("id < 40 AND id % 20 = 0"), vectors, judged, ["hit@1", "mrr@20"]).orderBy("query_id").collect()
    assert time.monotonic() - began < 60
    assert [tuple(r) for r in got] == [("d", 0, 0.0, 0.0), ("d", 20, 0.0, pytest.approx(1 / 15))]


def test_later_rows_of_a_query_overrule_its_earlier_ones(spark):
    rows = [("a", 1, [5, 6], [1.0, 2.0]), ("a", 1, [9, 5], [1.0, 0.0]), ("b", 1, [5], [3.0]), ("b", 2, [4, 4, 3], [0.0, 2.0, 1.0]), ("b", 3, [4, 4], [2.0, 0.0])]
    qrels = spark.createDataFrame(rows, "dataset string, query_id long, candidate_ids array<long>, candidate_scores array<double>")
    got = sorted(tuple(r) for r in retrieval.relevance(qrels, within=["dataset"]).collect())
    assert got == [("a", 1, 6, 2.0), ("a", 1, 9, 1.0), ("b", 1, 5, 3.0), ("b", 2, 3, 1.0), ("b", 2, 4, 2.0)]
    zero = qrels.withColumn("candidate_scores", F.transform("candidate_ids", lambda x: F.lit(0.0)))
    with pytest.raises(Exception, match="unknown candidate b 3"):  # pairs without gain are checked too
        retrieval.relevance(zero, spark.createDataFrame([("a", i) for i in (5, 6, 9)] + [("b", i) for i in (4, 5)], "dataset string, id long"), ["dataset"]).collect()


def test_pools_on_odd_vectors_equal_a_plain_ranking(spark, monkeypatch):
    """Pairs in blocks: repeated ids and pairs, no vector, nulls inside, other lengths, NaN; no vector travels with a pair."""
    monkeypatch.setattr(retrieval, "RUN_POOL", 4)
    rng = np.random.default_rng(11)
    vectors = [(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(40)]
    vectors += [(7, [1.0, 2.0, 0.5, 1.0]), (40, None), (41, [1.0, None, 0.0, 0.0]), (42, [1.0, 1.0]), (43, [float("nan"), 1.0, 0.0, 0.0]), (44, []), (None, [1.0] * 4)]
    asked = [v for v in vectors if v[0] is None or v[0] % 5 == 0 or v[0] > 40] + [(10, [0.0, 0.0, 1.0, 3.0])]
    pairs = [(int(q), int(c)) for q, c in rng.integers(0, 48, (900, 2))] + [(5, 6), (5, 6), (None, 1), (5, None)]
    kind = "id int, vector array<float>"
    found = retrieval.score_pool(spark.createDataFrame(asked, kind), spark.createDataFrame(vectors, kind), spark.createDataFrame(pairs, "query_id int, candidate_id int"), 3)
    assert dict(found.dtypes) == {"query_id": "int", "candidate_id": "int", "score": "double", "rank": "int"}
    want = {}
    for q, c in pairs:
        for _, a in (x for x in asked if x[0] == q and q is not None):
            for _, b in (x for x in vectors if x[0] == c and c is not None):
                whole = a is not None and b is not None and len(a) == len(b) and None not in a and None not in b
                score = round(sum((x * y for x, y in zip(a, b, strict=True)), 0.0), 9) if whole else None
                want.setdefault(q, []).append((2 if score is None else 0 if score != score else 1, -score if score is not None and score == score else 0, c, repr(score)))
    got = sorted((r["query_id"], r["rank"], r["candidate_id"], repr(r["score"])) for r in found.collect())
    assert got == sorted((q, i, x[2], x[3]) for q, all_ in want.items() for i, x in enumerate(sorted(all_)[:3], 1))


def test_pairs_of_a_pool_are_bounded_in_each_block(spark, monkeypatch):
    """As many blocks as the pairs need, whatever few bytes their vectors have; the ranking stays that of one block."""
    assert retrieval.pool_blocks([(30_000, 528), (600_000, 528)], 0, 12) == (6, 19)
    for sides, pairs in [(((30_000, 528), (600_000, 528)), 360_000_000), (((600_000, 528), (30_000, 528)), 360_000_000), (((1, 24), (10**8, 24)), 10**8), (((10**5, 24), (10**5, 24)), 10**10)]:
        asked, held = retrieval.pool_blocks(sides, pairs, 12)
        assert asked <= max(6, sides[0][0]) and held <= max(6, sides[1][0])
        assert asked * held * retrieval.PAIRS_BLOCK >= pairs
    rng = np.random.default_rng(12)
    vectors = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(300)], "id long, vector array<double>")
    asked, pairs = vectors.where("id % 5 = 0"), vectors.select(F.col("id").alias("candidate_id")).crossJoin(vectors.where("id % 5 = 0").select(F.col("id").alias("query_id")))
    ranked = lambda: sorted(map(tuple, retrieval.score_pool(asked, vectors, pairs, 4).select("query_id", "rank", "candidate_id", "score").collect()))
    whole = ranked()
    monkeypatch.setattr(retrieval, "PAIRS_BLOCK", 600)
    assert ranked() == whole and len(whole) == 240

    def counted(k):
        def run(batches):
            n = sum(int((b.column("order").to_numpy() % 3 == 2).sum()) for b in batches)
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([n]), pa.array([0]), pa.array([0.0])], names=["dataset", "query_id", "candidate_id", "score"])

        return run

    monkeypatch.setattr(retrieval, "_pool_best", counted)
    counts = [r["query_id"] for r in retrieval.score_pool(asked, vectors, pairs, 10**6).collect()]
    assert sum(counts) == 60 * 300 and len(counts) >= 30
    assert max(counts) <= 4 * 600  # hashing deals unevenly

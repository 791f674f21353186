"""Plans that earlier versions made on the driver or in one task."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import mixture, qrels
from quarrymill.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_interleaves_have_no_list_of_blocks_on_the_driver(spark, monkeypatch):
    def fail(*args, **kw):
        raise AssertionError("a list of all blocks on the driver")

    monkeypatch.setattr(mixture, "schedule", fail)
    for name in ("round_robin_interleave", "weighted_shuffled_interleave"):
        assert catalogue.QUERIES[name](spark, SF).count() >= spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("stop", ["all_exhausted", "first_exhausted"])
def test_drawn_blocks_follow_the_sampler(spark, stop):
    sizes, weights, batch = {"a": 70, "b": 9, "c": 400}, {"a": 1.0, "b": 2.0, "c": 1.0}, 8
    plan = mixture.draws(spark, sizes, "s", batch, weights, stop, seed=5)
    got = sorted(map(tuple, plan.select("block", "s", "round", "part").collect()))
    assert [g[0] for g in got] == list(range(len(got)))
    at, parts = Counter(), {k: -(-n // batch) for k, n in sizes.items()}
    for _, s, r, part in got:
        assert (r, part) == divmod(at[s], parts[s])
        at[s] += 1
    full = [k for k in sizes if at[k] >= parts[k]]
    assert full == list(sizes) if stop == "all_exhausted" else len(full) >= 1 and all(at[k] <= parts[k] for k in sizes)
    rows = spark.createDataFrame([(s, i) for s, n in sizes.items() for i in range(n)], "s string, i long")
    found = mixture.interleave(rows, "s", ["i"], plan, batch, seed=5).collect()
    assert len({(r["block"], r["slot"]) for r in found}) == len(found)
    assert Counter(r["block"] for r in found) == {b: min(batch, sizes[s] - part * batch) for b, s, _, part in got}
    for s, r in {(g[1], g[2]) for g in got}:
        once = [x["i"] for x in found if (x["s"], x["round"]) == (s, r)]
        assert len(set(once)) == len(once)


def test_private_candidates_are_numbered_in_many_tasks(spark):
    queries = spark.range(20_000).select("id", F.transform(F.sequence(F.lit(0), (F.col("id") % 4).cast("int")), lambda x: F.concat_ws(":", "id", x)).alias("c"))
    queries = queries.withColumn("c", F.when(F.col("id") % 5 > 0, F.col("c")).otherwise(F.array().cast("array<string>")))
    out = qrels.private_candidates(queries, "c", ["id"])
    want = [f"{i}:{j}" for i in range(20_000) if i % 5 for j in range(i % 4 + 1)]
    assert [r["text"] for r in sorted(out.collect(), key=lambda r: r["candidate_id"])] == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(id" not in plan  # no window over all queries

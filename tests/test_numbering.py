"""Places in an order, with columns that the order doesn't need, beyond the rows from which ranges are drawn."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import dedup, mixture, qrels
from quarrymill.operators.numbering import numbered

N = 30_000


@pytest.fixture(scope="module")
def rows(spark):
    """Shuffled ids with a source (one holds a third), a repeated key and a text that nothing orders by."""
    table = spark.range(0, N, 1, 16).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 's' || id % 5 END").alias("s"), F.expr("id * 7919 % 4999").alias("k"))
    return table.withColumn("text", F.sha2(F.col("id").cast("string"), 256)).repartition(16, "k")


def plain(rows):
    return sorted(map(tuple, rows.select("id", "s", "k", "text").collect()))


def places(table):
    at, out = Counter(), {}
    for i, s, _, _ in table:
        out[i] = at[s]
        at[s] += 1
    return out


def test_ordinals_keep_every_row_with_its_place(rows):
    want, found = places(plain(rows)), mixture.ordinals(rows, "s", ["id"])
    assert {r["id"]: r["pos"] for r in found.collect()} == want
    assert found.count() == N and found.select("pos").agg(F.sum("pos")).first()[0] == sum(want.values())
    some = found.where("text < '8'").join(rows.select("id", F.col("text").alias("again")), "id").collect()  # a filter and a join after it
    assert {r["id"]: r["pos"] for r in some} == {i: want[i] for i, _, _, t in plain(rows) if t < "8"}
    assert all(r["text"] == r["again"] for r in some)


def test_numbered_with_ties_and_without_rows(spark, rows):
    found = numbered(rows, ["k"]).collect()
    assert sorted(r["pos"] for r in found) == list(range(N))
    assert [r["k"] for r in sorted(found, key=lambda r: r["pos"])] == sorted(r["k"] for r in found)
    assert numbered(rows.where("false"), ["k"], ["s"]).collect() == []


def test_first_seen_ids_and_global_pool(rows):
    first = {}
    for i, _, k, t in plain(rows):
        first.setdefault(k, (i, t))
    ids = {k: n for n, k in enumerate(sorted(first, key=lambda k: first[k][0]))}
    found = dedup.first_seen_ids(rows, ["k"], ["id"])
    assert {r["k"]: r["id"] for r in found.collect()} == ids
    assert found.join(rows.select("k").distinct(), "k").where("id >= 0").select("id").distinct().count() == len(ids)
    pool = qrels.global_pool(rows.withColumnRenamed("id", "i"), "k", ["i"]).collect()
    assert {r["k"]: (r["id"], r["i"], r["text"]) for r in pool} == {k: (ids[k], *first[k]) for k in first}


def test_turns_and_draws_lose_no_row(spark, rows):
    known = rows.where("s IS NOT NULL")
    want = places([r for r in plain(rows) if r[1]])
    turns = {r["id"]: (r["turn"], r["slot"]) for r in mixture.take_turns(known, "s", ["id"], 32).collect()}
    assert turns == {i: divmod(n, 32) for i, n in want.items()}
    sizes = dict(Counter(r[1] for r in plain(rows) if r[1]))
    plan = mixture.draws(spark, sizes, "s", 32, dict.fromkeys(sizes, 1.0), seed=2)
    read = defaultdict(list)
    for r in mixture.interleave(known, "s", ["id"], plan, 32, seed=2).collect():
        read[r["s"], r["round"]].append(r["id"])
    for s, n in sizes.items():
        assert len(read[s, 0]) == len(set(read[s, 0])) == n


@pytest.mark.parametrize("ranks", [1, 7])
def test_rank_samples_carries_further_columns(rows, ranks):
    found = mixture.rank_samples(rows, ["id"], N, ranks, seed=4).collect()
    assert len({(r["rank"], r["step"]) for r in found}) == len(found) == -(-N // ranks) * ranks
    assert {r["id"]: r["text"] for r in found} == {i: t for i, _, _, t in plain(rows)}


def test_shuffled_chunks_carries_further_columns(rows):
    found = sorted(mixture.shuffled_chunks(rows, "id", 7, N, 3).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in found] == list(range(N))
    assert all(found[i + 1]["id"] == found[i]["id"] + 1 for i in range(N - 1) if i % 7 < 6 and i < N // 7 * 7)
    assert [r["id"] for r in found] != sorted(r["id"] for r in found)


def test_private_candidates_with_filter_and_join(spark):
    size = {i: random.Random(i).randrange(4) for i in range(5_000)}
    queries = spark.createDataFrame([(i, [f"{i}:{j}" for j in range(n)], "x" * i) for i, n in size.items()], "id long, c array<string>, more string").repartition(8)
    want = [f"{i}:{j}" for i, n in size.items() for j in range(n)]
    out = qrels.private_candidates(queries, "c", ["id"])
    assert [r["text"] for r in sorted(out.collect(), key=lambda r: r["candidate_id"])] == want
    half = out.where("candidate_id % 2 = 0").join(queries.select("id", "more"), "id").collect()
    assert {r["candidate_id"]: r["text"] for r in half} == {i: t for i, t in enumerate(want) if i % 2 == 0}


def plain_weights(sources, most, total):
    """The weights said step by step; sources: (size, weight) in order."""
    least = [max(1, int(n * total / most) + 1) for n, _ in sources]
    w = [max(a, 1, round(x * total / sum(x for _, x in sources))) for a, (_, x) in zip(least, sources, strict=True)]
    while sum(w) < total:
        w[min(range(len(w)), key=lambda i: sources[i][0])] += 1
    while sum(w) > total and max(x - a for x, a in zip(w, least, strict=True)) > 0:
        w[max(range(len(w)), key=lambda i: w[i] - least[i])] -= 1
    return w


def test_weight_plan_equals_a_step_for_each_unit(spark):
    rng = random.Random(6)
    for _ in range(6):
        sources = [(rng.randrange(1, 10_000), rng.randrange(1, 50)) for _ in range(rng.randrange(1, 12))]
        most = sum(n for n, _ in sources) * rng.choice([0.5, 1.0, 1.5, 20])
        table = spark.createDataFrame([(f"s{i}", n, w, i) for i, (n, w) in enumerate(sources)], "s string, n long, w long, i long")
        got = {r["s"]: r["weight"] for r in mixture.weight_plan(table, "s", "n", "w", "i", most, 100).collect()}
        assert [got[f"s{i}"] for i in range(len(sources))] == plain_weights(sources, most, 100), (sources, most)

"""Fill-in-middle, filter audit and multi-index against plain versions, on small and odd tables."""

import hashlib
from itertools import permutations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from quarrymill.llm import fill_middle, filter_audit, multi_index, queries

UNITS = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, text string, lang string, n string, form string, output string, mask string, sha string, part string, quality string"
LONG = "tail " * 200_000
TEXTS = [
    None, "", " ", "\n\n\t ", "word", " word", "word ", "a b", "two  words\n", "<P>", "x <S> y", "a<M", "<<P>", "ünï çødé 漢字 🙂 end", "\x0b\x0c mixed \r\n classes \t x ",
    "nbsp is no space   here", LONG, "A B C D E F", "one # sign", "one one one one one two", "SHOUT " * 120, "plain words here " * 40,
]


def odd_rows():
    rows = [(i * 3, t, ("en", None, "", "de")[i % 4], "x", "y", "z", "m", "s", "p", "q") for i, t in enumerate(TEXTS * 3)]
    return [*rows, rows[5], rows[5], (None, "word", "en", *rows[0][3:]), (None, None, None, *rows[0][3:]), (-7, "a b", "en", *rows[0][3:])]


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def cut(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    d = digest(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(d[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, digest(text), digest(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), digest(out), digest(text)


def test_fill_in_middle_equals_a_plain_version(spark):
    rows = odd_rows()
    got = fill_middle.digests(spark.createDataFrame(rows, ODD)).collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((cut(r[0], r[1]) for r in rows), key=key)
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fill_middle.digests(spark.createDataFrame([], ODD)).collect() == []


def test_events_alone_give_the_units(monkeypatch):
    automaton = fill_middle._automaton()
    monkeypatch.setattr(fill_middle, "EVENTS", 4)  # so that a text takes many reads
    for text in TEXTS:
        if text and len(text) < 1000:
            ends, held = fill_middle.unit_ends(text, automaton)
            assert ends.tolist() == [m.end() for m in UNITS.finditer(text)]
            assert held == bool(regex.search("<[PSM]>", text))


def audit(rows, labels):
    """The audit by running every order over every document."""
    firsts = {}
    for i, t, *_ in rows:
        if i is not None:
            firsts[t or ""] = min(firsts.get(t or "", i), i)
    said = {}
    for i, q, t in labels:
        old = said.get(i, (0, 0))
        said[i] = (max(old[0], int(q == 1)), max(old[1], int(t == 1)))
    docs = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WORDS.findall(t)
        fails = "".join(f for f, x in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(regex.findall("[A-Z]", t)) > 10 * len(t), regex.search(r"[#$%&*|]", t), i is not None and firsts[t] < i), strict=True) if x)
        docs.append((lang or "", fails, *(said.get(i, (0, 0)) if i is not None else (0, 0))))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                gone = lambda d: any(x in d[1] for x in order[: step - 1])  # noqa: E731, B023
                here = [d for d in own if f in d[1] and not gone(d)]
                counts = (sum(not gone(d) and f not in d[1] for d in own), len(here), sum(f in d[1] and gone(d) for d in own), sum(d[1] == f for d in own), sum(d[2] for d in here), sum(d[3] for d in here))
                out[part, order, step] = counts
                shapley[part, f] = shapley.get((part, f), 0) + len(here)
    return {(p, o, s): (*c, shapley[p, o[s - 1]]) for (p, o, s), c in out.items()}


def test_filter_audit_equals_every_order_run_by_itself(spark):
    rows = odd_rows()
    labels = [(0, 1, 0), (0, 0, 1), (3, 1, None), (6, None, 1), (60, 1, 1), (9, 7, 0), (None, 1, 1), (999, 1, 1), *[(i, 1, 0) for i in range(90, 150, 3)]]
    docs, said = spark.createDataFrame(rows, ODD), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, said).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in found} == audit(rows, labels)
    assert len(found) == 600 * 3
    assert filter_audit.audit(docs.where("false"), said).collect() == []
    none = filter_audit.audit(docs, said.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(none) == (0, 0)


def test_audit_of_large_groups_of_copies(spark, monkeypatch):
    """Copies that join_groups broadcasts and those that it shuffles."""
    rows = [(i, "copy of a text" if i % 3 == 0 else f"text {i % 700}", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(16)
    found = filter_audit.audit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).where("filter_order = 'EABCD' AND step = 1").first()
    assert found["removed"] == 3000 - len({r[1] for r in rows})


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(1)
    for _ in range(50):
        one, two = rng.integers(0, 9, 7).astype(float), rng.integers(0, 9, 5).astype(float)
        sizes = rng.integers(0, 4, 35).tolist()
        total = (one[:, None] + two[None, :]).ravel()
        met = multi_index.walk(one, two, sizes, 10**9)
        assert sorted(met) == [c for c in range(35) if sizes[c]]
        assert total[met].tolist() == sorted(total[met])
        some = multi_index.walk(one, two, sizes, 12)
        assert some == met[: len(some)] and sum(sizes[c] for c in some) >= 12 > sum(sizes[c] for c in some[:-1])


def brute(vectors, k, step):
    ids, v = np.array([i for i, _ in vectors]), np.array([x for _, x in vectors], float)
    out = {}
    for q in np.flatnonzero(ids % step == 0):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(d[j])) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_against_brute_force(spark, sf):
    vectors = [(r[0], r[1]) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, found = brute(vectors, 10, 100), {}
    for r in queries.op13_nearest_neighbours(spark, f"/root/testdata/{sf}").collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert found.keys() == want.keys()
    at = dict(vectors)
    for q, rows in found.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and q not in {r[1] for r in rows}
        assert [r[2] for r in rows] == sorted(r[2] for r in rows)
        for _, i, score in rows:
            assert score == pytest.approx(np.sqrt(((np.array(at[q], float) - np.array(at[i], float)) ** 2).sum()), abs=1e-14)
    assert np.mean([len({i for i, _ in want[q]} & {r[1] for r in found[q]}) / 10 for q in want]) >= 0.9


def test_vectors_that_take_no_part_ties_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(100 * i, [float(i), 1.0, 0.0]) for i in range(1, 6)] + [(7, [3.0, 1.0, 0.0]), (8, [3.0, 1.0, 0.0])]
    odd = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [1.0, None, 2.0]), (5, [1.0, nan, 2.0]), (6, [1.0, inf, 2.0]), (9, [1.0, 2.0]), (None, [1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in good + odd], "vec_id long, embedding array<double>, cell int, row string")
    got = {}
    for r in multi_index.neighbours_of_every(table, 100, 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: [(i, s) for _, i, s in sorted(x)] for q, x in got.items()} == brute(good, 10, 100)
    assert got[300][0][1:] == (7, 0.0) and got[300][1][1:] == (8, 0.0)  # ties to the smaller id
    twice = spark.createDataFrame([(100, [1.0, 2.0]), (100, [1.0, 2.5]), (3, [4.0, 4.0])], "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in multi_index.neighbours_of_every(twice, 100, 10).collect())
    assert found == [(100, 1, 100), (100, 1, 100), (100, 2, 3), (100, 2, 3)]
    for none in (table.where("false"), table.where("vec_id = 3"), table.where("vec_id = 7"), table.where("vec_id = 100")):
        assert multi_index.neighbours_of_every(none, 100, 10).collect() == []


def test_one_crowded_cell_and_small_shards(spark, monkeypatch):
    """A third of all vectors is one point; shards and blocks are so small that cells are split and queries dealt."""
    monkeypatch.setattr(multi_index, "SHARD_BYTES", 64 * 8 * 16)
    rng = np.random.default_rng(4)
    vectors = [(i, [1.0] * 8 if i % 3 == 0 else rng.normal(size=8).round(3).tolist()) for i in range(1200)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(8)
    want, found = brute(vectors, 5, 10), {}
    for r in multi_index.search(multi_index.Index(table), 5, F.col("vec_id") % 10 == 0, recall=1.0).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {q: len(x) for q, x in found.items()} == {q: 5 for q in want}
    same = [len({i for i, _ in want[q]} & {r[1] for r in found[q]}) / 5 for q in want]
    assert np.mean(same) >= 0.95
    assert all([(i, s) for _, i, s in sorted(found[q])] == want[q] for q in want if q % 3 == 0)

"""Plain versions of what SQL can't say, the pipeline from end to end, and odd tables for every operator."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quarrymill.llm import mixing, near_dedup, packing, pii, quality_lm, queries, sql, toxicity, url_filters

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
ODD = "doc_id long, lang string, source string, n_chars long, text string, score string, votes string, listed string, host string, shard string"


def near_components(rows, n, percent):
    """{id: (shingles, component)} by comparing all pairs of sets that share a shingle."""
    sets, holders = {}, {}
    for i, text in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    common = Counter()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_of_the_test_table_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = near_components([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], 4, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_near_dedup(spark, "/root/testdata/sf0.01").collect()}
    assert got == want


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [(int(k % 3 == 0), np.unique(np.concatenate((rng.integers(0, 40, 6), [100 + k % 3])))) for k in range(60)]
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[i]) - z[i]) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for label, at in rows:
            places = [*map(int, at), toxicity.BIAS]
            w = {i: weight(i) for i in places}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in places:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * w[i]
                n[i] += g * g
    got = toxicity.ftrl(rows)
    assert {i: got[i] for i in np.flatnonzero(got).tolist()} == pytest.approx({i: weight(i) for i in z if weight(i)})
    assert got[100] > 0 and 0 < len(np.flatnonzero(got)) < 44


def test_pieces_of_cut_documents_are_gapless_and_hold_their_ids(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["lorem", "ipsum", "Über", "amet, elit.\n"], n)) for n in (3, 900, 4000, 30, 2500, 0)]
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER).toPandas()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for doc, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == doc].sort_values("start")
        assert mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all() and placed.groupby("sequence_id").length.sum().max() <= 1024


def test_weights_of_nothing(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 100), ("a", "x", "s2", 1000), ("b", "x", "s3", 500)], "domain string, lang string, source string, tokens long")
    share = lambda **kw: {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, mixing.Mix(domains={"a": 1, "b": 1}, langs={}, **kw)).collect()}
    assert share(sources={"s1": 0}, budget_permille=500, max_epochs=1) == {"s1": 0, "s2": 400, "s3": 400}
    both = {r["source"]: r["budget"] for r in mixing.leaf_budgets(leaves, mixing.Mix(domains={"a": 0, "b": 0}, langs={}, max_epochs=1)).collect()}
    assert both == {"s1": 0, "s2": 0, "s3": 0}
    for wrong in ({"sources": {"s": -1}}, {"langs": {"x": 0.5}}, {"max_epochs": 0}, {"budget_permille": -1}):
        with pytest.raises(ValueError):
            mixing.Mix(**wrong)


def test_prefixes_found_in_narrowing_ranges(spark, monkeypatch):
    """The same documents are read whether the last range is ordered at once or narrowed first."""
    rows = spark.range(4000).selectExpr("id AS doc_id", "'web' AS domain", "CAST(id % 2 AS string) AS lang", "'s' AS source", "1 + id % 7 AS n_tokens")
    mix = mixing.Mix(domains={}, langs={}, budget_permille=700)
    whole = {(r["doc_id"], r["times"]) for r in mixing.plan(rows, mix).collect()}
    monkeypatch.setattr(mixing, "LAST_ROWS", 2)
    assert {(r["doc_id"], r["times"]) for r in mixing.plan(rows, mix).collect()} == whole and len(whole) == 4000


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(2)
    words = np.array(["lorem", "ipsum", "dolor", "x@y.z", "10.0.0.1", "Über"])
    long = " ".join(rng.choice(words, 200_000))
    rows = [(i, "en", "src0", 1, " ".join(rng.choice(words, 60)), "a", "b", "c", "d", "e") for i in range(6)]
    rows += [rows[0], rows[0], (None, *rows[0][1:]), (10, None, None, None, None, None, None, None, None, None), (11, "de", "s", 0, "", *"abcde"), (12, "de", "s", 0, long, *"abcde"), (13, "de", "s", 0, "1" * 100_000, *"abcde"), (14, "de", "s", 0, "é" * 100_000, *"abcde")]
    return spark.createDataFrame(rows, ODD)


def test_odd_documents(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(14)] + [(None, 1, 1, "y"), (3, None, None, "z"), (0, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    n = odd.count()
    scored = toxicity.score_documents(odd, labels).collect()
    assert len(scored) == n and all(0 <= r["score"] <= 1 for r in scored) and len({r["score"] for r in scored if r["doc_id"] == 0}) == 1
    judged = quality_lm.classify(odd, labels.dropDuplicates(["doc_id"])).collect()
    assert len(judged) == n and all(r["kept"] for r in judged if r["n_tokens"] == 0) and len({tuple(r) for r in judged if r["doc_id"] == 0}) == 1
    found = pii.find_personal_data(odd).collect()
    assert len(found) == n and next(r for r in found if r["doc_id"] == 10)["spans"] == "" and next(r for r in found if r["doc_id"] == 12)["n_email"] > 1000
    assert mixing.mix_plan(odd).count() == n and near_dedup.near_duplicates(odd).count() == n
    urls = odd.selectExpr("doc_id AS page_id", "text AS url", "host", "listed", "'r' AS rule")
    assert url_filters.judge_urls(urls, url_filters.default_list(spark)).count() == n


def test_empty_tables(spark, odd):
    none, labels = odd.where("false"), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(none, labels).count() == 0
    assert toxicity.score_documents(odd, labels.where("false")).where("score <> 0.5").count() == 0
    assert quality_lm.classify(none, labels).count() == 0
    assert quality_lm.classify(odd, labels.where("false")).where("NOT kept").count() == 0
    assert pii.find_personal_data(none).count() == 0 and near_dedup.near_duplicates(none).count() == 0
    assert mixing.mix_plan(none).count() == 0 and packing.pack(none, TOKENIZER).count() == 0
    pages = none.selectExpr("doc_id AS page_id", "text AS url")
    assert url_filters.judge_urls(pages, url_filters.default_list(spark)).count() == 0
    full = odd.selectExpr("doc_id AS page_id", "concat('https://', doc_id, '.org/') AS url")
    assert url_filters.judge_urls(full, url_filters.default_list(spark).where("false")).where("verdict <> 'allow'").count() == 0


def test_pipeline_equals_its_stages_said_plainly(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = np.array([f"{a}{b}" for a in ("lo", "rem", "ip", "sum", "do") for b in ("lor", "sit", "am", "et,", "Con", "sec.")])
    text = lambda n: " ".join(rng.choice(words, n))
    base = [text(int(rng.integers(60, 300))) for _ in range(120)]
    texts = base + [base[3]] * 4 + [base[5] + " ending"] + [base[7] + " other end", "one " + base[7]] + [text(20), "", None, "word " * 80, " ".join(w + "$$$" for w in rng.choice(words, 90))]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[3])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    kept = duck.execute(f"WITH {sql.quality_measures()} SELECT doc_id, text, lang, source FROM judged WHERE kept").fetchall()
    once = {}
    for doc, t, lang, source in kept:
        if t not in once or doc > once[t][0]:
            once[t] = (doc, t, lang, source)
    part = near_components([(d, t) for d, t, *_ in once.values()], 5, 80)
    left = [r for r in once.values() if part[r[0]][1] == r[0]]
    assert 0 < len(left) < len(once) < len(kept) < len(rows)
    duck.execute("CREATE TABLE left_ (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    duck.executemany("INSERT INTO left_ VALUES (?, ?, ?, ?)", left)
    times = dict(duck.execute(f"WITH {sql.mixing_plan('left_')} SELECT doc_id, times FROM planned").fetchall())
    tokenizer = Tokenizer.from_file(TOKENIZER)
    # Ids of all pieces of a document, by what their lengths and checks allow: tokens of each reading, and whole readings' checksums.
    tokens = got.groupby("doc_id").length.sum().to_dict()
    assert tokens == {doc: times[doc] * (len(tokenizer.encode(t, add_special_tokens=False).ids) + 1) for doc, t, *_ in left if times[doc]}
    for doc, t, *_ in left:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for r in got[got.doc_id == doc].itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32

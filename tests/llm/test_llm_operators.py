"""The training-data operators on small fixtures: brute force, exact round trips, and odd rows."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import regex
from tokenizers import Tokenizer

import corpus_pipeline
from quarrymill.llm import bloom, exact_dedup, graph, html_text, mixing, near_dedup, packing, pii, quality_lm, quality_rules, toxicity, url_filters

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, lang string, source string, n_chars long, text string, __maybe string, digest string, row string"
WORDS = regex.compile(r"[^\x20\x09-\x0D]+")


def odd_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing column names."""
    rng = np.random.default_rng(1)
    words = np.array(["lorem", "ipsum", "dolor", "sit", "amet,", "consectetur", "Über", "niño", "x.", "the"])
    long = " ".join(rng.choice(words, 30000))
    normal = [" ".join(rng.choice(words, 80)) for _ in range(12)]
    rows = [(i, "en", "src0", len(t), t, "m", "d", "r") for i, t in enumerate(normal)]
    rows += [(100, "en", "src0", 0, normal[0], None, None, None), (101, "en", "src1", 0, normal[0] + " added", None, None, None)]
    rows += [(102, None, None, None, None, None, None, None), (103, "de", "src2", 0, "", None, None, None), (104, "de", "src2", 2, " \n", None, None, None)]
    rows += [(None, "en", "src0", 3, "a b c", None, None, None), (None, "en", "src0", 3, "a b c", None, None, None), (105, "en", "src0", len(long), long, None, None, None)]
    rows += [(106, "fr", "src3", 9, "one two    three\r\n<|endoftext|> it's ok", None, None, None)] * 2
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_near(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_near_duplicates_equal_brute_force(docs):
    got = [r for r in near_dedup.near_duplicates(docs, 4, 80).collect()]
    want = brute_near([(r[0], r[4]) for r in odd_rows() if r[0] is not None], 4, 80)
    assert len(got) == len(odd_rows())
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]


def test_register_estimate_is_near_the_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:900], rng.integers(0, 1 << 63, 100, dtype=np.uint64)))
    r = near_dedup.registers(np.concatenate((a, b)), np.array([0, 1000]))
    assert abs((r[0] == r[1]).mean() - 900 / 1100) < 0.15


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 9)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 109)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_duplicates(docs):
    rows = odd_rows()
    groups = {}
    for r in rows:
        groups.setdefault(r[4] or "", []).append(-1 if r[0] is None else r[0])
    for r in exact_dedup.exact_duplicates(docs).collect():
        text = next(x[4] or "" for x in rows if hashlib.sha256((x[4] or "").encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(groups[text]) and (-1 if r["keep_id"] is None else r["keep_id"]) == max(groups[text])
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_bloom_filters_lose_no_key(spark):
    keys = spark.range(500).selectExpr("xxhash64(id) AS h")
    bits = bloom.filter_bits(500)
    filt = bloom.build(keys, bits)
    from pyspark.sql import functions as F

    assert bloom.probe(keys, F.col("h"), filt, bits, "maybe").where("maybe").count() == 500
    others = spark.range(10_000, 20_000).selectExpr("xxhash64(id) AS h")
    assert bloom.probe(others, F.col("h"), filt, bits, "maybe").where("maybe").count() < 300


def test_quality_counts_equal_brute_force(docs):
    rows = {(r[0], r[4]): r for r in odd_rows()}
    by_text = {}
    for _, text in rows:
        t = text or ""
        w = WORDS.findall(t)
        windows = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i in range(len(w) - 2) if windows[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if WORDS.search(x)]
        by_text.setdefault((len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)), 0)
    got = quality_rules.judge(docs).collect()
    assert len(got) == len(odd_rows())
    for r in got:
        assert tuple(r[1:6]) in by_text
        assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in got)


def test_fences_follow_language_and_source(spark):
    """One share of marks passes where such text is usual and fails where it isn't: no single cutoff gives that."""
    rng = np.random.default_rng(6)

    def text(marked):
        words = [f"w{x}" + ("," if k < marked else "") for k, x in enumerate(rng.integers(0, 10**6, 100))]
        return " ".join(rng.permutation(words))

    rows = [(lang, src, text(usual + int(rng.integers(0, 8)))) for lang, src, usual in (("en", "a", 5), ("en", "b", 5), ("de", "a", 60), ("de", "b", 60)) for _ in range(80)]
    odd = [("en", "a", text(70)), ("de", "a", text(70)), ("en", "small", text(70)), ("fr", "few", text(70)), ("en", "small", text(8))]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows + odd)], "doc_id long, lang string, source string, text string")
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    assert not any(r["base_failed"] for r in got.values()) and all(got[i]["kept"] for i in range(len(rows)))
    assert [got[len(rows) + k]["kept"] for k in range(5)] == [False, True, False, True, True]
    assert abs(got[len(rows)]["marks"] - got[len(rows) + 1]["marks"]) < 10


def test_quantile_sketches_merge_to_the_same(spark):
    rows = spark.range(1000).selectExpr("CAST(id % 3 AS string) AS lang", "id * id AS m")
    whole = {tuple(r) for r in quality_rules.sketch(rows, ["lang"], ["m"]).collect()}
    parts = quality_rules.sketch(rows.where("m % 2 = 0"), ["lang"], ["m"]).unionByName(quality_rules.sketch(rows.where("m % 2 = 1"), ["lang"], ["m"]))
    assert {tuple(r) for r in quality_rules.merge(parts, ["lang"]).select("lang", "metric", "bucket", "n").collect()} == whole


def test_mixing_spends_the_budget_and_gives_shortage_to_siblings(spark):
    leaves = [("a", "x", "s1", 100), ("a", "x", "s2", 1000), ("b", "x", "s3", 10000)]
    mix = mixing.Mix(domains={"a": 1, "b": 1}, langs={}, max_epochs=1, budget_permille=150)
    got = {r["source"]: r["budget"] for r in mixing.leaf_budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long"), mix).collect()}
    assert got == {"s1": 100, "s2": 732, "s3": 832}  # half each; s1's shortage goes to s2


def test_mixing_odd_rows(docs, none):
    planned = mixing.mix_plan(docs).collect()
    assert len(planned) == len(odd_rows()) and all(r["times"] >= 0 for r in planned)
    out = mixing.mix_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["times"] for r in planned)
    assert mixing.mix_documents(none).count() == 0


def test_packing_is_an_exact_round_trip(docs):
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    want = Counter()
    for r in odd_rows():
        ids = [*t.encode(r[4] or "", add_special_tokens=False).ids, 0]
        want[r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = packing.pack(docs, TOKENIZER).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= packing.SIZE
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    assert got.length.sum() == sum(n * c for (_, n, _), c in want.items())
    whole = got[got.length == got.doc_tokens]
    assert all((None if np.isnan(r.doc_id) else int(r.doc_id), r.length, r.ids_crc32) in want for r in whole.itertuples())


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(5)
    points = np.cumsum(rng.integers(1, 6, 40))
    pen = rng.integers(0, 5, 40)
    best = {0: 0}
    for k, p in enumerate(points.tolist()):
        best[p] = min(best[q] + 12 - (p - q) + int(pen[k]) for q in best if p - q <= 12)
    ends = packing.cut(points, pen, 12)
    cost = sum(12 - (b - a) + int(pen[list(points).index(b)]) for a, b in zip([0, *ends], ends, strict=False))
    assert ends[-1] == points[-1] and cost == best[int(points[-1])]


def test_toxicity_learns_held_out_rows(spark):
    rng = np.random.default_rng(7)
    words = np.array([f"w{i}" for i in range(200)])
    rows = [(i, " ".join(rng.choice(words, 60)) + (" scum!" if i % 5 == 0 else "")) for i in range(600)] + [(600, None), (601, ""), (None, "scum")]
    got = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(600)], "doc_id long, toxic int")).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    assert len(got) == len(rows) and len(held) > 150
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score_documents(spark.createDataFrame(rows[:3], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).count() == 3


def test_personal_data(spark):
    card = "4111 1111 1111 1111"
    text = f"é mail a.b@c.example.com now. 10.0.0.1 999.1.1.1 then {card}, not 1234 5678 1234 5678, +1 (555) 010-2030x"
    rows = [(1, text), (2, None), (3, ""), (3, ""), (None, "x@y.z")]
    got = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = next(r for r in got if r["doc_id"] == 1)
    base = [("email", "a.b@c.example.com"), ("ip", "10.0.0.1"), ("card", card), ("phone", "+1 (555) 010-2030")]
    want = [f"{k}:{text.index(s)}:{text.index(s) + len(s)}" for k, s in base]
    assert (first["n_email"], first["n_ip"], first["n_card"], first["n_phone"]) == (1, 1, 1, 1)
    assert first["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
    assert set(want) <= set(first["spans"].split(","))
    assert len(got) == len(rows)


def test_html_text():
    page = (
        "<html><head><title>t</title></head><body><nav><a href=/>home</a><p>menu</nav><div class='cookie-notice'>We use cookies</div><article><h1>Head &amp; more</h1>"
        "<p>First  paragraph\nof <b>text</b>.<p>Second one, long enough to count.<script>var x='<p>no</p>'</script></article><section id=comments><p>Nice post!</section><footer>&copy; me</footer>"
    )
    assert html_text.extract(page) == "Head & more\n\nFirst paragraph of text.\n\nSecond one, long enough to count."
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("<p") == ""


def test_minimum_cut_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(30):
        n = 6
        scores = rng.normal(size=n).round(2).tolist()
        ties = [(i, j, float(rng.random().__round__(2))) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(keep):
            return sum(s for s, k in zip(scores, keep, strict=True) if s > 0 and not k) - sum(s for s, k in zip(scores, keep, strict=True) if s < 0 and k) + sum(c for i, j, c in ties if keep[i] != keep[j])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(scores, ties)) == pytest.approx(best)


def test_urls(spark):
    rows = [(1, "HTTP://WWW.Example.com/en/x?q#f"), (2, "http://example.com/en/x"), (3, "https://a.net/fr/"), (4, None), (5, "no scheme"), (6, "http://m.spam-farm.example.net:80/x"), (7, "https://x.com/"), (7, "https://x.org?y"),
            (8, "http://a.casino-win499.example.org/q"), (9, "http://casino-win501.example.org/q"), (10, "http://redirect.example.org/free-bets/7//?x"), (11, "http://redirect.example.org/free-bets/7/more"), (12, "http://redirect.example.org/")]
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), url_filters.default_list(spark)).collect()}
    assert got == {
        (1, "www.example.com", "/en/x", "www.example.com/en/", "allow"), (2, "example.com", "/en/x", "example.com/en/", "block"), (3, "a.net", "/fr/", "net/fr/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "m.spam-farm.example.net:80", "/x", None, "block"), (7, "x.com", "/", "com/", "allow"), (7, "x.org", "", None, "allow"),
        (8, "a.casino-win499.example.org", "/q", None, "block"), (9, "casino-win501.example.org", "/q", None, "allow"), (10, "redirect.example.org", "/free-bets/7//", None, "block"),
        (11, "redirect.example.org", "/free-bets/7/more", None, "allow"), (12, "redirect.example.org", "/", None, "allow"),
    }


def test_quality_model_tells_junk_from_trusted_text(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"word{i}" for i in range(40)])
    rows = [(i, "en", " ".join(rng.choice(words, 80))) for i in range(120)] + [(200, "en", " ".join(f"%%{i} zq{i}" for i in range(60))), (201, None, None), (202, "en", "")]
    labels = [(i, 1) for i in range(0, 120, 2)]
    got = {r["doc_id"]: r for r in quality_lm.classify(spark.createDataFrame(rows, "doc_id long, lang string, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert not got[200]["kept"] and sum(got[i]["kept"] for i in range(120)) >= 118 and got[202]["kept"]


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_odd_and_empty_tables(spark, docs, none, stage):
    f = corpus_pipeline.STAGES[stage][1]
    assert f(spark, none, "").count() == 0
    out = f(spark, docs, "")
    assert stage == 4 or out.columns == docs.columns
    out.count()


def test_block_links_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 40, 60)
    sets = [np.unique(np.where(rng.random(60) < rate, rng.integers(0, 1 << 40, 60), base)) for rate in rng.choice([0.02, 0.1, 0.15, 0.5], 80)]

    def roots(pairs):
        up = list(range(len(sets)))
        for a, b in pairs:
            a, b = up[a], up[b]
            up = [min(a, b) if x in (a, b) else x for x in up]
        return up

    common = lambda a, b: len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    near = [(a, b) for a in range(80) for b in range(a) if 100 * (c := common(a, b)) >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    rows = pd.DataFrame({"rep": range(80), "component": range(80), "block": [k % 2 for k in range(80)], "shingles": sets})
    found = []
    for i, j in ((0, 0), (0, 1), (1, 1)):
        part = rows[rows["block"].isin((i, j))].assign(i=i, j=j)
        links = near_dedup._block_links(80)(part)
        assert len(links) < len(part)
        found += list(links.itertuples(index=False, name=None))
    assert {(max(p), min(p)) for p in found} <= set(near)
    assert roots(found) == roots(near) and len(set(roots(near))) > 1

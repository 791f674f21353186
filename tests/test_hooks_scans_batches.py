"""Table functions of a user's own, searches for many patterns, batches of ragged rows."""

import datetime
import random
import re
import time
import uuid

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import collate, hook, scan


def test_join_hook_keeps_base_rows_and_sees_side_rows_in_order(spark):
    rng = random.Random(3)
    side = [(rng.choice([*range(20), None]), rng.randrange(1000), f"t{i}") for i in range(400)]
    base = [(i % 25 if i % 9 else None, f"b{i}") for i in range(200)] + [(3, "b3")]
    left, right = spark.createDataFrame(base, "k long, name string"), spark.createDataFrame(side, "k long, at long, text string").repartition(7)
    made = lambda rows: {"n": len(rows), "said": "|".join(r["text"] for r in rows[:3])}
    got = sorted((r["k"] is None, r["k"] or 0, r["name"], r["n"], r["said"]) for r in hook.join_hook(left, right, "k", ["at", "text"], made, "n int, said string").collect())
    want = []
    for k, name in base:
        own = [t for at, t in sorted((at, t) for x, at, t in side if x == k and k is not None)]
        want.append((k is None, k or 0, name, len(own), "|".join(own[:3])))
    assert got == sorted(want)
    with pytest.raises(ValueError, match="collide"):
        hook.join_hook(left, right, "k", ["at"], made, "name string")
    with pytest.raises(Exception, match="KeyError"):
        hook.join_hook(left, right, "k", ["at"], lambda rows: {}, "n int").collect()
    assert hook.join_hook(left.where("false"), right, "k", ["at"], made, "n int, said string").collect() == []


def test_join_hook_over_batches_of_many_keys(spark, capsys):
    """Rows go to the function as Arrow batches; keys that pass over several batches, NaN and null ones, nulls and times in side rows."""
    rng = random.Random(8)
    nan, at = float("nan"), datetime.datetime(2024, 2, 29, 12, 30)
    side = [(k, i, None if i % 5 == 0 else {"t": at, "v": i}, None if i % 7 == 0 else f"s{i}") for i, k in enumerate(rng.choice([*map(float, range(9)), nan, nan, -0.0, None]) for _ in range(300))]
    base = [(rng.choice([*map(float, range(12)), nan, None]), i) for i in range(150)]
    left, right = spark.createDataFrame(base, "k double, id int"), spark.createDataFrame(side, "k double, i int, x struct<t: timestamp, v: int>, s string").repartition(5)

    def made(rows):
        assert all(r.x is None or r.x.t == at and r["x"]["v"] == r.i for r in rows)
        return {"n": len(rows), "said": [r.s for r in rows], "call": uuid.uuid4().hex}

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        found = hook.join_hook(left, right, "k", ["i"], made, "n int, said array<string>, call string", name="many_keys")
        found.explain()
        assert "ArrowEvalPythonUDTF" in capsys.readouterr().out
        got = found.collect()
        union = left.selectExpr("k AS __key", "struct(*) AS __base").unionByName(right.where("k IS NOT NULL").selectExpr("k AS __key", "struct(*) AS __side"), allowMissingColumns=True)
        union.createOrReplaceTempView("many_keys_rows")
        by_sql = spark.sql("SELECT * FROM many_keys(TABLE(many_keys_rows) PARTITION BY pmod(xxhash64(__key), 5) ORDER BY (__key, __side IS NULL, __side.i))").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    name = lambda k: None if k is None else repr(k + 0.0)
    want = {name(k): [s for x, _, _, s in side if name(x) == name(k)] if k is not None else [] for k, _ in base}
    for rows in (got, by_sql):
        assert sorted(r["id"] for r in rows) == list(range(150))
        assert all(name(r["k"]) == name(base[r["id"]][0]) and r["said"] == want[name(r["k"])] and r["n"] == len(r["said"]) for r in rows)
        assert len({(name(r["k"]), r["call"]) for r in rows}) == len(want)  # called once for each key


PATTERNS = [r"\bpass(word|phrase)\s*[:=]", r"api[_-]?key\s*[:=]", r"/mnt(?:/|$)", r"docs/internal", r"\bX\b", r"^a.c$", r"colou?r", r"(secret)s?", r"straße|STRASSE", "[0-9]{4}", "kelvin"]


def test_found_lines_equal_a_search_by_each_pattern(spark):
    rng = random.Random(5)
    bits = ["password: x", "PASSPHRASE =y", "api-key=1", "ApiKey :2", "/mnt/a", "at /mnt", "docs/INTERNAL/x", " x ", "abc", "aXc", "color", "COLOUR", "secrets", "ſecret", "paſsword:", "Strasse", "2024", "Kelvin", "kelvın", "İx", "plain", ""]
    texts = ["".join(rng.choice(bits) + rng.choice(["\n", "\r\n", " ", "\x0b", " ", ""]) for _ in range(30)) for _ in range(80)] + [None, "", "\n\n"]
    got = {(r["path"], r["line"], r["pattern"]) for r in scan.find_patterns(spark.createDataFrame(list(enumerate(texts)), "path long, text string"), PATTERNS).collect()}
    want = {(str(i), n, p) for i, t in enumerate(texts) for n, line in enumerate((t or "").splitlines(), 1) for p in PATTERNS if re.search(p, line, re.IGNORECASE)}
    assert got == want and {p for _, _, p in want} == set(PATTERNS)


def test_literals_that_a_match_must_hold():
    want = {r"\bpass(word|phrase)\s*[:=]": "pass", r"api[_-]?key": "api", r"docs/internal": "docs/internal", r"\bX\b": "", "ab": "", r"(secret)s?": "secret", "foo|bar": "", r"(?:abc)+": "", "straße": "stra"}
    assert {p: scan.literal_of(p) for p in want} == want


def test_time_does_not_grow_with_the_number_of_patterns():
    import pyarrow as pa

    rng = random.Random(1)
    text = "\n".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) for _ in range(4000))
    batch = pa.RecordBatch.from_pydict({"path": ["a"], "text": [text]})

    def seconds(n):
        patterns = [f"{''.join(rng.choices('klmnopqrst', k=8))}[0-9]+x{i}" for i in range(n)]
        began = time.process_time()
        assert sum(b.num_rows for b in scan._scanner(patterns)(iter([batch]))) == 0
        return time.process_time() - began

    seconds(10)
    assert seconds(1000) < 5 * seconds(10) + 1


def test_release_check(spark):
    rows = [("a/.env", b""), ("m/x.ckpt", b""), ("src/a.py", "ok\nPassword = 1\n".encode()), ("data/b.py", b"password=1"), ("src/bin.py", b"\xff\xfepassword="), ("src/.pt", b"password:"), ("logs", b"")]
    got = {tuple(r) for r in scan.release_check(spark.createDataFrame(rows, "path string, content binary"), [r"\bpassword\s*[:=]"]).collect()}
    p = r"\bpassword\s*[:=]"
    assert got == {("a/.env", 0, "forbidden name"), ("m/x.ckpt", 0, "forbidden suffix"), ("src/a.py", 2, p), ("src/.pt", 1, p), ("logs", 0, "forbidden name")}


ROWS = "batch int, slot int, ids array<int>, mask array<int>, types array<int>, grid array<array<int>>"


@pytest.mark.parametrize("side", ["left", "right"])
def test_ragged_rows_become_batches(spark, side):
    rows = [(0, 1, [4], None, [9], [[1, 2]]), (0, 0, [1, 2, 3], None, None, None), (0, 2, [], None, [], [[3, 4], [5, 6]]), (1, 0, [7, 8], None, None, None)]
    df = spark.createDataFrame(rows, ROWS).withColumnRenamed("mask", "none")
    got = {r["batch"]: r for r in collate.collate(df, "batch", "slot", "ids", ["types", "none"], ["grid"], pad=-1, side=side).collect()}
    pad = lambda x, v: [v] * (3 - len(x)) + x if side == "left" else x + [v] * (3 - len(x))
    first = got[0]
    assert (first["n"], first["width"], first["ids"]) == (3, 3, [pad(x, -1) for x in ([1, 2, 3], [4], [])])
    assert first["mask"] == [pad([1] * n, 0) for n in (3, 1, 0)] and first["types"] == [pad(x, 0) for x in ([0, 0, 0], [9], [])]
    assert first["values"] == [1, 2, 3, 4] and first["offsets"] == [0, 3, 4, 4] and first["grid"] == [[1, 2], [3, 4], [5, 6]] and first["none"] is None
    assert got[1]["grid"] is None and got[1]["types"] is None
    with pytest.raises(Exception, match="types of length 4 exceeds the width 2"):
        collate.collate(spark.createDataFrame([(0, 0, [1, 2], None, [1, 2, 3, 4], None)], ROWS), "batch", "slot", "ids", ["types"]).collect()
    with pytest.raises(Exception, match="a row without ids in batch 5"):
        collate.collate(spark.createDataFrame([(5, 0, None, None, None, None)], ROWS), "batch", "slot", "ids").collect()
    with pytest.raises(ValueError):
        collate.collate(df, "batch", "slot", "ids", side="up")


def test_payloads(spark):
    kind = "images array<binary>, media array<struct<kind: string, content: array<binary>>>"
    of = lambda *row: spark.createDataFrame([row], kind).select(collate.payload(F.col("images"), F.col("media")).alias("p")).first()["p"]
    assert of(None, None) is None and of([None], []) is None
    assert (of([b"a", None], None)["kind"], of([b"a", None], None)["content"]) == ("image", [b"a"])
    assert of(None, [("image", [b"a"]), ("image", [b"b"])])["content"] == [b"a", b"b"]
    assert of([], [("video", [b"a", b"b"])])["kind"] == "video"
    for row, said in (((None, [("image", [b"a"]), ("video", [b"b"])]), "mixes"), ((None, [("video", [b"a"]), ("video", [b"b"])]), "more than one video"), (([b"a"], [("image", [b"b"])]), "both"), ((None, [("sound", [b"a"])]), "isn't known")):
        with pytest.raises(Exception, match=said):
            of(*row)

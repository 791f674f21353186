"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import quality
from quarrymill.plans import converters
from quarrymill.sources import files


def test_scans(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "x int, y string").write.parquet(str(tmp_path / "t"))
    assert files.scan(spark, str(tmp_path / "t"), ["y", "y"], "x = 2").collect() == [("b",)]
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path / "t"), ["x"], read_columns=["y"])
    with pytest.raises(TypeError):
        files.scan(spark, str(tmp_path / "t"), [1])
    assert {r["row_index"] for r in files.row_numbers(files.scan(spark, str(tmp_path / "t")).coalesce(1)).collect()} <= {0, 1}
    for name in ("b", "a", "none"):
        (tmp_path / "sets" / name).mkdir(parents=True)
    for name in ("a", "b"):
        (tmp_path / "sets" / name / "train.jsonl").write_text("{}")
    assert files.subsets(spark, str(tmp_path / "sets"), ["train.jsonl", "all.jsonl"]) == ["a", "b"]
    with pytest.raises(FileNotFoundError):
        files.subsets(spark, str(tmp_path / "sets"), ["test.jsonl"])
    with pytest.raises(FileNotFoundError):
        files.first_matching(spark, str(tmp_path), ["x*", "y*"])


def test_json_lines(spark, tmp_path):
    (tmp_path / "good.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2}\n')
    assert [tuple(r) for r in files.jsonl(spark, str(tmp_path / "good.jsonl"), "a int, b string", strict=True).collect()] == [(1, "x"), (2, None)]
    for bad in ('{"a": 1', "[1]", "3", '{"a": "no number"}'):
        (tmp_path / "bad.jsonl").write_text('{"a": 1}\n' + bad + "\n")
        with pytest.raises(Exception, match="bad line in bad.jsonl"):
            files.jsonl(spark, str(tmp_path / "bad.jsonl"), "a int", strict=True).collect()
    (tmp_path / "head.jsonl").write_text('{"a": 1, "b": {"c": [1.5]}}\n{"a": 2}\n' + '{"a": 3}\n' * 200)
    rows = files.jsonl_like_its_head(spark, str(tmp_path / "head.jsonl"))
    assert rows.count() == 202 and rows.select(F.sum("a")).first()[0] == 603
    (tmp_path / "head.jsonl").write_text('{"a": 1}\n' * 100 + '{"a": "text"}\n')
    with pytest.raises(Exception, match="bad line"):
        files.jsonl_like_its_head(spark, str(tmp_path / "head.jsonl")).collect()


def test_names_of_sources():
    assert files.resolve("x", "eval/a/b", {"eval": "/data/eval/"}) == "/data/eval/a/b"
    assert files.resolve("x", "eval/a", {"eval": "/d"}, {"x": "/own"}) == "/own"
    with pytest.raises(ValueError, match="unknown root"):
        files.resolve("x", "other/a", {"eval": "/d"})
    assert files.dataset_reference("org/name::sub/test") == ("org/name", "sub", "test") and files.dataset_reference("r::test") == ("r", None, "test")
    for bad in ("r", "r::", "::test", "r::a/b/c"):
        with pytest.raises(ValueError):
            files.dataset_reference(bad)


def test_folders_of_pictures(spark, tmp_path):
    (tmp_path / "f" / "v").mkdir(parents=True)
    for name, data in (("frame_10.jpg", b"ten"), ("frame_2.jpg", b"two")):
        (tmp_path / "f" / "v" / name).write_bytes(data)
    assert [bytes(x) for x in files.frames(spark, str(tmp_path / "f")).first()["frames"]] == [b"two", b"ten"]
    assert [bytes(x) for x in files.frames(spark, str(tmp_path / "f"), natural=False).first()["frames"]] == [b"ten", b"two"]
    wanted = spark.createDataFrame([(0, "v/frame_2.jpg"), (1, "v/frame_10.jpg")], "n int, path string")
    assert [bytes(r["bytes"]) for r in files.file_bytes(wanted, spark, str(tmp_path / "f")).orderBy("n").collect()] == [b"two", b"ten"]
    with pytest.raises(Exception, match="missing or empty file: gone"):
        files.file_bytes(spark.createDataFrame([("gone",)], "path string"), spark, str(tmp_path / "f")).collect()
    (tmp_path / "f" / "v" / "frame_3.jpg").write_bytes(b"")
    with pytest.raises(Exception, match="empty frame"):
        files.frames(spark, str(tmp_path / "f"), strict=True).collect()
    paths = spark.createDataFrame([(p,) for p in ("c1/positive_clip/1.jpg", "c1/negative_clip_2/1.jpg", "c2/negative_0_a.jpg", "c2/positive_b.jpg", "c2/other.jpg")], "path string")
    assert sorted((r["clip"], r["kind"], r["place"]) for r in files.clips(paths).where("place IS NOT NULL").collect()) == [("c1", "negative", 2), ("c2", "negative", 0)]
    assert sorted((r["clip"], r["kind"]) for r in files.clips(paths).where("place IS NULL").collect()) == [("c1", "positive"), ("c2", "positive")]
    (tmp_path / "Run_test_split1.txt").write_text("Run/a.avi 1\n\nRun/b.avi\n")
    assert [tuple(r) for r in files.split_list(spark, str(tmp_path / "Run_test_split1.txt")).collect()] == [("Run", "Run/a.avi"), ("Run", "Run/b.avi")]
    assert files.split_list(spark, str(tmp_path / "Run_test_split1.txt"), by_file=True).first()["class"] == "Run"


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    one = spark.range(3)
    with pytest.raises(ValueError, match="no rows"):
        files.write_nonempty(one.where("false"), at)
    files.write_nonempty(one, at)
    for n in (4, 5, 6):
        files.replace_table(spark.range(n), at, keep=2)
    assert [spark.read.parquet(x).count() for x in (at, at + ".bak1", at + ".bak2")] == [6, 5, 4]
    files.repack(spark, at, 2)
    assert spark.read.parquet(at).count() == 6 and len(list((tmp_path / "t").glob("*.parquet"))) == 2 and spark.read.parquet(at + ".bak1").count() == 6
    files.write_jsonl(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "j")).collect()] == [{"a": 1, "b": None}]
    result = files.results({"d": {"hit_1": float("nan")}}, {"all": 0.5}, {"seed": 1})
    files.write_json(spark, str(tmp_path / "results.json"), result)
    assert json.loads((tmp_path / "results.json").read_text()) == {"meta": {"seed": 1}, "summary": {"all": 0.5}, "datasets": {"d": {"hit_1": None}}}
    assert set(files.flat_metrics(result)) == {"eval/summary/all", "eval/d/hit_1"}
    found = quality.empty_text(spark.createDataFrame([(" ", "sample_1")], "text string, sample_id string"), "text", "d")
    decided, audited = quality.decisions(found), quality.audit(found)
    files.write_quality(spark, str(tmp_path / "q"), found, decided, audited, quality.report(audited, decided, "d"))
    assert json.loads((tmp_path / "q" / "quality_audit.json").read_text())["n_findings"] == 1 and "Quality Report" in (tmp_path / "q" / "quality_report.md").read_text()


def test_rows_that_converters_refuse(spark):
    queries = spark.createDataFrame([("q1", "t", 7, ["c1"]), ("q2", "t", 7, []), ("q3", "t", 8, ["c9"])], "qid string, query_txt string, task_id int, pos_cand_list array<string>")
    pool = spark.createDataFrame([("c1", "one"), ("c2", "two")], "did string, txt string")
    with pytest.raises(Exception, match="no positive candidate: q2"):
        converters.candidate_pool(queries, pool, 7)[0].collect()
    with pytest.raises(Exception, match="no match for key c9"):
        converters.candidate_pool(queries, pool, 8)[0].collect()
    kept, gone, there = converters.candidate_pool(queries.where("qid <> 'q2'"), pool, 7, spark.createDataFrame([("q1",)], "qid string"))
    assert (kept.count(), gone.count(), [r["did"] for r in there.collect()]) == (0, 1, ["c1"])
    sides = spark.createDataFrame([("", None, "p")], "q string, i string, p string")
    assert converters.without_empty_sides(sides, ["q", "i"], ["p"]).count() == 0
    with pytest.raises(Exception, match="a side of a row is empty"):
        converters.without_empty_sides(sides, ["q", "i"], ["p"], strict=True).collect()
    blank = spark.createDataFrame([([" ", "a"],)], "c array<string>")
    for drop in (True, False):
        with pytest.raises(Exception, match="blank candidate"):
            blank.select(converters.real_candidates(F.col("c"), drop)).collect()
    answers = spark.createDataFrame([(1, True, [("Red ", "no"), (" blue", "maybe"), ("Blue", "maybe"), ("unanswerable", "yes"), ("green", "maybe")]), (2, True, [("x", "no")]), (3, False, [("y", "yes")])], "k int, answerable boolean, answers array<struct<answer: string, answer_confidence: string>>")
    assert {r["k"]: r["selected_answer"] for r in converters.voted_answers(answers, "k").collect()} == {1: "blue", 2: None, 3: None}

"""Archives and conversions on small inputs."""

import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrymill.plans import converters
from quarrymill.sources import archives


def _tar(path, files):
    with tarfile.open(path, "w") as tar:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))


def test_archives(spark, tmp_path):
    _tar(tmp_path / "a.tar", {"d/1.jpg": b"one", "d/1.cls": b"3\n", "d/2.jpg": b"", "d/2.cls": b"0"})
    found = archives.members(spark, str(tmp_path / "*.tar"))
    assert {r["member"]: bytes(r["content"]) for r in found.collect()} == {"d/1.jpg": b"one", "d/1.cls": b"3\n", "d/2.jpg": b"", "d/2.cls": b"0"}
    assert {(r["stem"], r["label"], bytes(r["image"])) for r in archives.paired_samples(found, 4).collect()} == {("d/1", 3, b"one"), ("d/2", 0, b"")}
    with pytest.raises(Exception, match="bad sample d/1"):
        archives.paired_samples(found, 3).collect()
    wanted = spark.createDataFrame([("d/1.jpg",)], "member string")
    assert [r["member"] for r in archives.selected(found, wanted).collect()] == ["d/1.jpg"]
    with pytest.raises(Exception, match="no archive has x"):
        archives.selected(found, wanted.union(spark.createDataFrame([("x",)], "member string"))).collect()
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("m.json", '{"a": 1}')
        z.writestr("m.txt", "no")
    rows = archives.json_members(archives.members(spark, str(tmp_path / "b.zip"), [".json"]), "a int").collect()
    assert [(r["member"], r["a"]) for r in rows] == [("m.json", 1)]


def _beir(spark, queries=((0, "q0"), (1, "q1")), judged=((0, 27, 2), (0, 29, 1), (1, 28, 2))):
    q = spark.createDataFrame(queries, "`query-id` long, query string")
    c = spark.createDataFrame([(i, (b"x", f"{i}.png")) for i in (27, 28, 29)], "`corpus-id` long, image struct<bytes: binary, path: string>")
    return q, c, spark.createDataFrame([(*r, "a") for r in judged], "`query-id` long, `corpus-id` long, score long, answer string")


def test_beir_bundle(spark):
    queries, candidates, table = converters.beir_bundle(*_beir(spark))
    assert {r["query_id"]: (r["candidate_ids"], r["candidate_scores"]) for r in table.collect()} == {0: ([27, 29], [2.0, 1.0]), 1: ([28], [2.0])}
    assert {r["id"]: r["answer"] for r in queries.collect()} == {0: ["a", "a"], 1: ["a"]}
    assert set(candidates.columns) == {"id", "image", "path"}
    for wrong, message in (
        ({"queries": ((0, "q"), (0, "r"))}, "duplicate"), ({"queries": ((0, "q"), (None, "r"))}, "null query-id"),
        ({"queries": ((0, "q"), (1, "r"), (2, "s"))}, "without judgments"), ({"judged": ((0, 27, 1), (1, 5, 1))}, "unknown corpus-id"), ({"judged": ((0, 27, 1), (1, 28, 1), (9, 28, 1))}, "unknown query-id"),
    ):
        with pytest.raises(ValueError, match=message):
            converters.beir_bundle(*_beir(spark, **wrong))


def test_rows_of_sources(spark):
    lines = spark.createDataFrame([("a.avi 1",), ("b.avi 2",), ("c.avi 0",), ("",)], "value string")
    assert {tuple(r) for r in converters.tagged_splits(lines, F.lit("run")).collect()} == {("run", "a.avi", "train"), ("run", "b.avi", "test")}
    with pytest.raises(Exception, match="bad line"):
        converters.tagged_splits(spark.createDataFrame([("a.avi 7",)], "value string"), F.lit("run")).collect()

    rows = spark.createDataFrame([("v", [0.0, 2.5], [1.0, 3.0], ["x", "y"])], "video string, s array<double>, e array<double>, c array<string>")
    got = converters.segments(rows, {"start": "s", "end": "e", "caption": "c"}).collect()
    assert [(r["segment"], r["caption"], r["frame_unit_key"]) for r in got] == [(0, "x", "v#segment=0.000-1.000"), (1, "y", "v#segment=2.500-3.000")]
    with pytest.raises(Exception, match="unequal lengths"):
        converters.segments(rows.withColumn("c", F.array(F.lit("x"))), {"start": "s", "end": "e", "caption": "c"}).collect()

    keyed = converters.highlight_keys(spark.createDataFrame([("v", [[1.0, 2.0]]), ("w", None)], "vid string, relevant_windows array<array<float>>")).collect()
    assert [(r[2], r[3]) for r in keyed] == [("v#full", ["v#segment=1.000-2.000"]), ("w#full", [])]

    kind = "query_id string, query string, answers array<string>, positive_passages array<struct<docid: string, title: string, text: string>>, negative_passages array<struct<docid: string>>"
    samples = converters.positive_passages(spark.createDataFrame([("1", " who ", ["a"], [("d1", None, "t"), ("d2", "T", None)], [("n",)]), ("2", "what", [], [("d3", "", "")], [])], kind))
    assert [(r["positive_rank"], r["positive_docid"], r["positive_title"], r["positive_text"]) for r in samples.where("query_id = '1'").collect()] == [(0, "d1", "", "t"), (1, "d2", "T", "")]
    kept, gone = converters.without_eval_queries(samples, spark.createDataFrame([("Find: who",)], "t string"), "Find: ")
    assert ({r["query"] for r in kept.collect()}, gone.count()) == ({"what"}, 2)

    five = spark.createDataFrame([(list("abcde"),)], "options array<string>")
    assert converters.fixed_options(five).count() == 1
    with pytest.raises(Exception, match="not 4 options"):
        converters.fixed_options(five, n=4).collect()
    qa = converters.question_rows(spark.createDataFrame([("v", [("q", "a"), ("r", "b")])], "video string, QA array<struct<question: string, answer: string>>"))
    assert [tuple(r) for r in qa.collect()] == [("v", 0, "q", "a"), ("v", 1, "r", "b")]
    assert converters.decoded_only(qa, "video", spark.createDataFrame([("u",)], "frame_unit_key string")).count() == 0

"""Samples of training sources and the benchmark's index."""

import pytest
from pyspark.sql import functions as F

from quarrymill.plans import benchmarks, training


def test_samples_of_a_question_source(spark):
    rows = spark.createDataFrame([("i1", " What \r\n is it? ", "a cat\n", "train", "other")], "image string, question string, selected_answer string, image_split string, answer_type string")
    side = spark.createDataFrame([("i1", b"x")], "path string, image_bytes binary")
    source = training.get("vizwiz_train")
    got = training.samples(rows, [side], source, "VizWiz").first()
    assert got["query"]["text"] == "<|image_pad|>\nRepresent the given image with the following question: What\n is it?\n" and got["query"]["has_media"]
    assert tuple(got["positive"]) == ("a cat", False) and tuple(got["negative"]) == ("", False)
    assert got["metadata"] == {"dataset_name": "VizWiz", "image_split": "train", "answer_type": "other"}
    assert training.aligned_media(training.samples(rows, [side], source)).count() == 1
    with pytest.raises(Exception, match="no match for key i1"):
        training.samples(rows, [side.where("false")], source).collect()
    with pytest.raises(Exception, match="has no positive"):
        training.samples(rows.withColumn("selected_answer", F.lit(" ")), [side], source, "VizWiz").collect()
    other = training.get("vizwiz_train", {"query": {"instruction": "", "end": "strip"}})
    assert training.samples(rows, [side], other).first()["query"]["text"] == "<|image_pad|>\nWhat\n is it?"


def test_samples_of_a_caption_source(spark):
    rows = spark.createDataFrame([("v", ["  ", "a dog runs", "b"], "3")], "video string, caption array<string>, category string")
    units = spark.createDataFrame([("v", [b"1"])], "frame_unit_key string, frames array<binary>")
    got = training.samples(rows, [units], training.get("msrvtt_train"), "MSR-VTT").first()
    assert got["query"]["text"] == "Find a video that contains the following visual content: a dog runs\n" and not got["query"]["has_media"]
    assert got["positive"]["text"] == "<|video_pad|>\nUnderstand the content of the provided video.\n" and got["positive"]["has_media"]
    late = training.map_samples(training.samples(rows, [units], training.get("msrvtt_train")), lambda df: df.where("positive.has_media"), lambda df: df.select("query.text"))
    assert late.count() == 1
    wrong = training.samples(rows, [units], training.get("msrvtt_train", {"query": {"instruction": "See <|video_pad|>"}}))
    with pytest.raises(Exception, match="token and media of query differ"):
        training.aligned_media(wrong).collect()
    assert training.aligned_media(wrong, override=True).count() == 1


def test_skipped_media_leave_no_token(spark):
    rows = spark.createDataFrame([("q", None, "yes"), ("r", "p", "no")], "question string, image_path string, answer_text string")
    side = spark.createDataFrame([("p", b"x")], "path string, image binary")
    got = {r["positive"]["text"]: r["query"] for r in training.samples(rows, [side], training.get("scienceqa_train")).collect()}
    assert not got["yes"]["text"].startswith("<") and got["no"]["text"].startswith("<|image_pad|>\n")


@pytest.mark.parametrize("name", sorted(training.SOURCES))
def test_every_source_gives_samples(spark, name):
    """Each source on one row that has all its columns."""
    source = training.get(name)
    sides = (source.query, source.positive, source.negative)
    captions = {s.body for s in sides if s.pick}
    media = [s.media for s in (source.query, source.positive) if s.media]
    columns = {s.body for s in sides if s.body} | {key for key, *_ in source.lookups} | set(source.metadata)
    rows = spark.range(1).select(*[(F.array(F.lit("text")) if c in captions else F.lit(f"of {c}")).alias(c) for c in sorted(columns)])
    tables = [spark.range(1).select(F.lit(f"of {key}").alias(side_key), *[F.lit(b"x").alias(m) for m in ([media[k]] if len(source.lookups) > 1 else dict.fromkeys(media))]) for k, (key, side_key, _) in enumerate(source.lookups)]
    got = training.samples(rows, tables, source, name)
    assert training.aligned_media(got).count() == 1
    row = got.first()
    assert all(x in row["query"]["text"] for x in [source.query.instruction.strip()]) and row["positive"]["text"].strip()


def test_registry_refuses():
    for changes in ({"side": {}}, {"query": {"color": "red"}}, {"query": {"end": "never"}}, {"query": {"separator": "tab"}}):
        with pytest.raises(ValueError):
            training.get("gqa_train", changes)
    with pytest.raises(KeyError):
        training.get("none")
    with pytest.raises(ValueError, match="is registered"):
        training.register("gqa_train", training.SOURCES["gqa_train"])


def test_benchmark_index(spark, tmp_path):
    rows = benchmarks.rows()
    assert len(rows) == len({r[0] for r in rows}) == 78
    assert [sum(r[2] == m for r in rows) for m in ("image", "video", "visdoc")] == [36, 18, 24]
    for name in ("queries", "candidates", "qrels", "metadata.json"):
        (tmp_path / "image-tasks" / "GQA" / name).mkdir(parents=True)
    assert [r[0] for r in benchmarks.discover(spark, str(tmp_path), ["GQA"], ["hit@1"], {"image": "hit@1"})] == ["GQA"]
    with pytest.raises(FileNotFoundError, match="MSVD/queries"):
        benchmarks.discover(spark, str(tmp_path), ["GQA", "MSVD"])
    with pytest.raises(ValueError, match="unknown datasets"):
        benchmarks.discover(spark, str(tmp_path), ["GQA", "none"])
    with pytest.raises(ValueError, match="metrics lack"):
        benchmarks.discover(spark, str(tmp_path), ["GQA"], ["hit@1"], {"image": "ndcg@5"})
    results = spark.createDataFrame([("GQA", "hit_1", 0.5), ("GQA", "ndcg_5", 0.9), ("VizWiz", "hit_1", 1.0), ("MSVD", "hit_1", 0.2), ("ViDoRe_docvqa", "ndcg_5", 0.4), ("ViDoRe_docvqa", "hit_1", 0.1)], "dataset string, metric string, value double")
    got = {(r["modality"], r["task_type"]): (r["mean"], r["n"]) for r in benchmarks.rollup(results, benchmarks.index(spark), {"image": "hit_1", "video": "hit_1", "visdoc": "ndcg_5"}).withColumnRenamed("task", "task_type").collect()}
    assert got["image", "image_question_answer"] == (0.75, 2) and got["visdoc", "all"] == (0.4, 1) and got["all", "all"] == (0.525, 4)
    with pytest.raises(Exception, match="unknown dataset x"):
        benchmarks.rollup(spark.createDataFrame([("x", "hit_1", 1.0)], results.schema), benchmarks.index(spark), {"image": "hit_1"}).collect()


def test_document_sources(spark):
    from quarrymill.plans import documents

    kind = "query string, options string, answer string, image binary, page int"
    rows = [("q?", "['A. x', \"it's\"]", "A", b"x", 1), ("<image>q", "", "B. whole", b"x", None), ("", "[1", "C", b"x", 3), (None, "['A) a', 'B) b']", "B", b"x", 4), ("q", "['only']", "E", b"x", 5)]
    got = documents.question_samples(spark.createDataFrame(rows, kind)).collect()
    assert [r["query"]["text"] for r in got] == ["<|image_pad|>\nq? Options: ['A. x', \"it's\"]", "<|image_pad|>\nq", "<|image_pad|>", "<|image_pad|>\nOptions: ['A) a', 'B) b']", "<|image_pad|>\nq Options: ['only']"]
    assert [r["positive"]["text"] for r in got] == ["x", "B. whole", "C", "b", "E"]
    assert got[1]["metadata"] == {"dataset_name": "vidore_train"} and got[0]["metadata"]["page"] == "1"
    with pytest.raises(Exception, match="has no picture"):
        documents.question_samples(spark.createDataFrame([("q", None, "a", None, 1)], kind)).collect()
    with pytest.raises(ValueError):
        documents.question_samples(spark.createDataFrame(rows, kind), query_end="x")
    pages = spark.createDataFrame([(" q \n", "Textbooks", b"x"), ("q", None, b"x")], "query string, source string, image binary")
    got = documents.source_samples(pages, queries={"Textbooks": "Find:"}, separator="newline").collect()
    assert [r["query"]["text"] for r in got] == ["Find:\n q\n", "q\n"] and [r["positive"]["text"] for r in got] == [f"<|image_pad|>\n{documents.PAGE_PROMPTS['Textbooks']}\n", "<|image_pad|>\n"]

"""Parsers of the benchmark's datasets: checks, knobs and forms on single rows."""

import pytest
from pyspark.sql import functions as F

from quarrymill.plans import benchmarks, parsers

IMAGE, VIDEO = parsers.IMAGE, parsers.VIDEO


def one(spark, dataset, role, kind, *values, mode="canonical", **knobs):
    return parsers.items(spark.createDataFrame([values], kind), dataset, role, mode, **knobs).first()


def test_every_dataset_of_the_index_has_a_parser_whose_plan_can_be_made(spark):
    assert {r[0] for r in benchmarks.rows()} == set(parsers.PARSERS)
    types = {"image": "binary", "video": "array<binary>", "options": "array<string>", "candidates": "array<string>", "option": "array<string>"}
    for name, sides in parsers.PARSERS.items():
        for role, side in zip(("query", "candidate"), sides, strict=True):
            table = spark.createDataFrame([], ", ".join(f"`{c}` {types.get(c, 'string')}" for c in (*side.columns, "further")))
            for mode in parsers.MODES:
                out = parsers.items(table, name, role, mode)
                assert out.columns == ["id", "text", "media", "repairs", "token_allowed", "metadata"]
    plan = parsers.items(spark.read.schema("id string, query string, corpus_range string, further binary").parquet("/root/testdata/sf0.001/region.parquet"), "ViDoSeek-doc", "query")
    assert "further" not in plan._jdf.queryExecution().executedPlan().toString()  # only declared columns are read


def test_refusals(spark):
    table = spark.createDataFrame([("1", "q")], "id string, query string")
    with pytest.raises(KeyError):
        parsers.items(table, "nothing", "query")
    for bad in ({"role": "other"}, {"role": "query", "mode": "else"}, {"role": "query", "wrong": 1}):
        with pytest.raises(ValueError):
            parsers.items(table, "ViDoRe_docvqa", **bad)
    with pytest.raises(ValueError, match=r"lacks \['image'\]"):
        parsers.items(table, "ViDoRe_docvqa", "candidate")
    with pytest.raises(Exception, match="a query has no text"):
        one(spark, "ViDoRe_docvqa", "query", "id string, query string", "1", " \n")
    with pytest.raises(Exception, match="a candidate has no page"):
        one(spark, "ViDoRe_docvqa", "candidate", "id string, image binary", "1", None)
    with pytest.raises(Exception, match="a candidate has no video"):
        one(spark, "MSVD", "candidate", "id string, video_id string, video array<binary>", "1", "v", [None])
    with pytest.raises(Exception, match="a query has no question"):
        one(spark, "ActivityNetQA", "query", "id string, question string, video array<binary>", "1", " ", [b"f"])
    with pytest.raises(Exception, match="token and media differ in query 1"):
        one(spark, "GQA", "query", "id string, qry_text string, image binary", "1", "no token", b"x")
    with pytest.raises(ValueError, match="is registered"):
        parsers.register("GQA", parsers.PARSERS["GQA"])
    with pytest.raises(ValueError, match="unknown form"):
        parsers.register("new", (parsers.Side("else", ("id",)), parsers.ANSWER))
    with pytest.raises(ValueError, match="has no"):
        parsers.register("new", (parsers.Side("answer", ("id", "text"), {"odd": 1}), parsers.ANSWER))


def test_knobs_of_the_caller_go_over_those_of_the_dataset(spark):
    kind = "id string, query string"
    assert one(spark, "ViDoRe_docvqa", "query", kind, "1", " a  \r\nb \n\n")["text"] == "Find a document image that matches the given query:  a\nb\n"
    assert one(spark, "ViDoRe_docvqa", "query", kind, "1", " a  \n", mode="origin")["text"] == "Find a document image that matches the given query:  a  \n"
    assert one(spark, "ViDoRe_docvqa", "query", kind, "1", "a ", instruction="")["text"] == "a\n"
    assert one(spark, "ViDoRe_docvqa", "query", kind, "1", "a ", tidy=False)["text"].endswith(": a \n")
    page = "id string, image binary"
    assert one(spark, "ViDoRe_docvqa", "candidate", page, "1", b"x", separator=" ", newline=False)["text"] == f"{IMAGE} Understand the content of the provided document image."
    assert one(spark, "ViDoRe_docvqa", "candidate", page, "1", b"x", mode="origin")["text"] == f"{IMAGE} Understand the content of the provided document image."
    frames = one(spark, "QVHighlight", "candidate", "id string, video array<binary>", "1", [b"f"] * 5 + [None], frames=3)
    assert (frames["media"]["kind"], frames["media"]["total"], frames["media"]["taken"]) == ("video", 6, [0, 2, 4])
    assert one(spark, "Video-MME", "candidate", "id string, text string", "1", "B. The answer.", bare_choice=True)["text"] == "The answer"


def test_tokens_and_media(spark):
    kind = "id string, qry_text string"
    found = one(spark, "MSCOCO_t2i", "query", kind, "1", "<image> find it")
    assert found["text"] == f"{IMAGE} find it" and found["token_allowed"] and found["media"] is None
    found = one(spark, "EDIS", "query", kind, "1", "<image>\n find it  ")
    assert found["text"] == " find it" and found["repairs"] == ["visual_token_alignment_strip_without_media"]
    assert one(spark, "EDIS", "query", kind, "1", "plain")["repairs"] == []
    crop = "id string, tgt_text string, image binary"
    found = one(spark, "RefCOCO", "candidate", crop, "1", "<|image_1|>\nRepresent the given cropped image of the object", b"x")
    assert found["text"] == f"{IMAGE}\nRepresent the given cropped image of the object.\n" and found["repairs"] == ["canonical_cropped_object_candidate_sentence"]
    found = one(spark, "RefCOCO", "candidate", crop, "1", "<|image_1|>\nRepresent the given cropped image of the object", b"x", mode="origin")
    assert found["text"] == f"{IMAGE}\nRepresent the given cropped image of the object" and found["repairs"] == []
    assert one(spark, "MSCOCO_i2t", "candidate", "id string, text array<string>", "1", ["first", "second"])["text"] == "first"


def test_what_is_left_untouched_becomes_metadata(spark):
    kind = "id long, video array<binary>, source_id string, segment string, video_path string, youtube_id string"
    found = one(spark, "YouCook2", "candidate", kind, 7, [b"f"], "s", None, "p", "y")
    assert found["id"] == "7" and found["metadata"] == {"source_id": "s", "youtube_id": "y"}


def test_dialogues_are_folded_turn_by_turn(spark):
    table = spark.createDataFrame([("1", "Look:", None)], "id string, qry_text string, qry_inst string")
    turns = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(t).alias("text")) for r, t in (("user", " what? "), ("assistant", None), ("assistant", "that"), ("user", " "))])
    found = parsers.items(table.withColumn("turns", turns).withColumn("qry_text", F.lit("Look: ")), "VisDial", "query").first()
    assert found["text"] == "Look:\nQ: what?\nA: that\n"
    for said, want in (("Look: here", "Look: here"), ("Look: Q: a", "Look:\nQ: a"), ("Look: a\nA: b\n\n", "Look:\na\nA: b\n"), ("none", "none")):
        assert parsers.items(table.withColumn("qry_text", F.lit(said)), "VisDial", "query").first()["text"] == want

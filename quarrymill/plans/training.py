"""Training sources at read time: rows, joined with their side tables, become samples of three sides.

A sample has query, positive and negative, each a text and whether it has media.
What differs between sources is data: which column is the body, which instruction
goes before it, where media come from. One plan reads all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays, text
from ..operators.lookup import Lookup, lookup_chain

IMAGE, VIDEO = "<|image_pad|>", "<|video_pad|>"
# Tokens of older texts.
LEGACY = {"<|image_1|>": IMAGE}
NEWLINES = ("preserve", "strip", "ensure_single")


@dataclass(frozen=True)
class Side:
    """Text of a side: an instruction and the body of a column, joined; media of a looked-up column, with their token on a
    line of its own; how the text ends. pick chooses among the captions of an array: first, all or seeded."""

    body: str = ""
    instruction: str = ""
    separator: str = "space"
    media: str = ""
    token: str = ""
    end: str = "ensure_single"
    pick: str = ""


@dataclass(frozen=True)
class Source:
    query: Side
    positive: Side
    lookups: Sequence[tuple[str, str, str]] = ()  # key of the row, key of the side table, error or skip
    negative: Side = field(default_factory=Side)
    metadata: Sequence[str] = ()


def _answer(body: str) -> Side:
    return Side(body, end="strip")


def _seen(instruction: str, media: str, token: str = VIDEO) -> Side:
    return Side(instruction=instruction, media=media, token=token)


def _asked(instruction: str, body: str, media: str = "", token: str = "", pick: str = "") -> Side:
    return Side(body, instruction, media=media, token=token, pick=pick)


# Instructions.
CONTENT = "Understand the content of the provided video."
SEGMENT = "Understand the content of the provided video segment."
QUESTION = "Represent the given image with the following question:"
CLIP = "Find the clip that corresponds to the described scene in the given video:"
CROP = "Represent the given cropped image of the object."

# The sources, their columns, instructions and side tables.
SOURCES: dict[str, Source] = {
    "activitynet_captions_train": Source(_asked("Find the video segment that corresponds to the following description:", "segment_sentence"), _seen(SEGMENT, "frames"), (("frame_unit_key", "frame_unit_key", "error"),), metadata=("video_id", "video", "segment_index")),
    "breakfast_train": Source(_asked("Recognize the breakfast type that the person is cooking in the video.", "", "frames", VIDEO), _answer("label"), (("video_path", "frame_unit_key", "error"),), metadata=("video_id", "camera")),
    "charades_sta_train": Source(_asked(CLIP, "description", "query_frames", VIDEO), _seen(CONTENT, "positive_frames"), (("query_frame_unit_key", "frame_unit_key", "error"), ("positive_frame_unit_key", "frame_unit_key", "error")), metadata=("id", "video")),
    "country211_train": Source(_asked("Identify the country depicted in the image", "", "image", IMAGE), _answer("class_name"), (("image_path", "path", "error"),), metadata=("class_index",)),
    "didemo_train": Source(_asked("Find a video that includes the following described scenes:", "caption"), _seen(CONTENT, "frames"), (("video", "frame_unit_key", "error"),), metadata=("video_id",)),
    "gqa_train": Source(_asked(QUESTION, "question", "image", IMAGE), _answer("fullAnswer"), (("imageId", "path", "error"),), metadata=("id", "answer")),
    "hmdb51_train": Source(_asked("What actions or objects interactions are the person in the video doing?", "", "frames", VIDEO), _answer("pos_text"), (("video_path", "frame_unit_key", "error"),), metadata=("video_id", "split_tag")),
    "kinetics700_train": Source(_asked("Recognize the category of the video content.", "", "frames", VIDEO), _answer("label"), (("video_path", "frame_unit_key", "error"),), metadata=("video_id", "youtube_id")),
    "mmlongbench_doc_train": Source(_asked("Find a document image that matches the given query:", "question"), _seen("Understand the content of the provided document image.", "page_image", IMAGE), (("page_key", "path", "error"),), metadata=("doc_id", "doc_type")),
    "msrvtt_train": Source(_asked("Find a video that contains the following visual content:", "caption", pick="first"), _seen(CONTENT, "frames"), (("video", "frame_unit_key", "error"),), metadata=("video_id", "category")),
    "msvd_train": Source(_asked("Find the video snippet that corresponds to the given summary:", "caption", pick="first"), _seen(CONTENT, "frames"), (("video", "frame_unit_key", "error"),), metadata=("video_id",)),
    "nextqa_train": Source(_asked("Given a video and a question, select the most accurate answer from the provided candidates.", "question", "frames", VIDEO), _answer("answer"), (("video_path", "frame_unit_key", "error"),), metadata=("qid", "type")),
    "place365_train": Source(_asked("Identify the scene shown in the image", "", "image", IMAGE), _answer("class_name"), (("image_path", "path", "error"),)),
    "qvhighlight_train": Source(_asked(CLIP, "query", "query_frames", VIDEO), _seen(CONTENT, "positive_frames"), (("query_frame_unit_key", "frame_unit_key", "error"), ("positive_frame_unit_key", "frame_unit_key", "error")), metadata=("qid", "vid")),
    "refcoco_train": Source(_asked("Select the portion of the image that follows the language expressions:", "captions", "image", IMAGE, pick="first"), _seen(CROP, "image", IMAGE), (("image_id", "image_id", "error"),), metadata=("ann_id", "ref_id")),
    "scienceqa_train": Source(_asked(QUESTION, "question", "image", IMAGE), _answer("answer_text"), (("image_path", "path", "skip"),), metadata=("subject", "topic")),
    "ssv2_train": Source(_asked("What actions or object interactions are being performed by the person in the video?", "", "frames", VIDEO), _answer("pos_text"), (("video_path", "frame_unit_key", "error"),), Side("neg_text", end="strip"), ("video_id", "template")),
    "textvqa_train": Source(_asked(QUESTION, "question", "image", IMAGE), replace(_answer("answers"), pick="first"), (("image_id", "path", "error"),), metadata=("question_id",)),
    "ucf101_train": Source(_asked("What activities or sports are being performed by the person in the video?", "", "frames", VIDEO), _answer("pos_text"), (("video_path", "frame_unit_key", "error"),), metadata=("video_id", "class_index")),
    "vatex_train": Source(_asked("Find a video that matches the following caption:", "en_caption", pick="first"), _seen(CONTENT, "frames"), (("video", "frame_unit_key", "error"),), metadata=("video_id",)),
    "visual7w_pointing_train": Source(_asked("Select the portion of the image that answers the question", "question", "query_image", IMAGE), _seen(CROP, "positive_image", IMAGE), (("query_image_path", "path", "error"), ("positive_image_path", "path", "error")), metadata=("qa_id", "answer_name")),
    "vizwiz_train": Source(_asked(QUESTION, "question", "image_bytes", IMAGE), _answer("selected_answer"), (("image", "path", "error"),), metadata=("image_split", "answer_type")),
    "wikissnq_train": Source(_asked("Find the document image that can answer the given query:", "query"), _seen("Represent the given image", "image", IMAGE), (("positive_docid", "path", "error"),), metadata=("query_id", "positive_rank")),
    "youcook2_train": Source(_asked("Find a video that demonstrates the following action while making a recipe:", "caption"), _seen(CONTENT, "frames"), (("frame_unit_key", "frame_unit_key", "error"),), metadata=("video_id", "recipe_type")),
}


def register(name: str, source: Source, known: dict[str, Source] = SOURCES) -> None:
    """A source of the user's own; a name that is taken raises."""
    if name in known:
        raise ValueError(f"source {name!r} is registered")
    known[name] = source


def get(name: str, changes: Mapping[str, Mapping[str, str]] | None = None) -> Source:
    """A source by name, with sides changed: {side: {field: value}}. Unknown names, sides, fields and values raise."""
    if name not in SOURCES:
        raise KeyError(f"unknown source {name!r}")
    source = SOURCES[name]
    for side, values in (changes or {}).items():
        if side not in ("query", "positive", "negative"):
            raise ValueError(f"unknown side {side!r}")
        unknown = set(values) - set(Side.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown fields of {side}: {sorted(unknown)}")
        changed = replace(getattr(source, side), **values)
        if changed.end not in NEWLINES or changed.separator not in ("none", "space", "newline"):
            raise ValueError(f"unknown value of {side}: {dict(values)}")
        source = replace(source, **{side: changed})
    return source


def _text(df: DataFrame, side: Side) -> Column:
    body = F.col(side.body) if side.body else F.lit("")
    if side.pick:
        body = arrays.pick_caption(body, side.pick, F.to_json(F.struct(*[F.col(c) for c in df.columns if c not in (side.media,)])) if side.pick == "seeded" else None)
    body = text.let(F.coalesce(body.cast("string"), F.lit("")), lambda b: text.normalize_space(b))
    joined = text.let(body, lambda b: text.join_texts(F.lit(side.instruction.strip()), b, side.separator))
    if side.token:
        here = F.col(side.media).isNotNull() if side.media in df.columns else F.lit(False)
        joined = text.let(text.replace_tokens(joined, LEGACY), lambda x: text.own_line(x, side.token, here))
    return text.let(joined, lambda x: text.trailing_newline(x, side.end))


def samples(rows: DataFrame, sides: Sequence[DataFrame], source: Source, name: str = "", renames: Sequence[Mapping[str, str]] = ()) -> DataFrame:
    """rows as samples: query, positive, negative (text, has_media) and metadata.

    sides: the side tables in the order of the source's lookups; renames: under
    which names their columns are taken. A positive without text and media raises.
    """
    specs = [Lookup(side, key, side_key, dict(rename), missing) for (key, side_key, missing), side, rename in zip(source.lookups, sides, renames or [{}] * len(sides), strict=True)]
    joined = lookup_chain(rows, specs)

    def side(s: Side) -> Column:
        media = F.col(s.media).isNotNull() if s.media and s.media in joined.columns else F.lit(False)
        return F.struct(_text(joined, s).alias("text"), media.alias("has_media"))

    positive = side(source.positive)
    real = (F.trim(positive["text"]) != "") | positive["has_media"]
    checked = F.when(real, positive).otherwise(F.raise_error(F.lit(f"{name}: a row has no positive")))
    held = [c for c in source.metadata if c in joined.columns]
    notes = F.map_filter(F.create_map(*[x for c in held for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull()) if held else F.create_map().cast("map<string,string>")
    return joined.select(side(source.query).alias("query"), checked.alias("positive"), side(source.negative).alias("negative"), F.map_concat(F.create_map(F.lit("dataset_name"), F.lit(name)), notes).alias("metadata"))


def aligned_media(sample: DataFrame, token: Sequence[str] = (IMAGE, VIDEO), override: bool = False) -> DataFrame:
    """Samples whose sides have a visual token just when they have media; others raise, unless tokens without media are allowed."""
    def differs(side: Column) -> Column:
        has = F.lit(False)
        for t in token:
            has = has | F.contains(side["text"], F.lit(t))
        return ~((has == side["has_media"]) | (F.lit(override) & has))

    sides = F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{n}.text").alias("text"), F.col(f"{n}.has_media").alias("has_media")) for n in ("query", "positive", "negative")])
    wrong = F.get(F.filter(sides, differs), F.lit(0))["name"]
    checked = text.let(wrong, lambda n: F.when(n.isNull(), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("token and media of "), n, F.lit(" differ"))).cast("boolean")))
    return sample.where(checked)


def map_samples(sample: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Steps of a user's own, each a plan, one after another."""
    for step in steps:
        sample = step(sample)
    return sample

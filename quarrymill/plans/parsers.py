"""Benchmark datasets at read time: rows of queries and candidates become items of text and media.

A parser is data: which columns a dataset's sides have, which form makes the text of
each and the values of that form's knobs. Ten forms serve all datasets of the index; a
form is a function from columns to columns, so a parser compiles to one projection
and Spark reads the declared columns only. Knobs given by a caller go over the
dataset's own, which go over the form's.

Two modes: `origin` keeps the text as the dataset has it; `canonical` puts the visual
token on a line of its own, normalizes white space where the dataset asks for it and
ends the text with one line end. What canonical mode changes beyond that is listed in
`repairs`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, text
from .benchmarks import DATASETS
from .training import IMAGE, VIDEO

# Tokens of older texts.
LEGACY = ("<|image_1|>", "<image>")
MODES = ("canonical", "origin")
#: Columns that the image forms use up; what else is declared and not null stays as metadata.
IMAGE_FIELDS = ("id", "text", "images", "image", "qry_text", "qry_inst", "qry_img_path", "tgt_text", "tgt_inst", "tgt_img_path", "media_metadata")


class Row:
    """Columns of a side's table; one that the table lacks is null."""

    def __init__(self, df: DataFrame, dataset: str, role: str):
        self.types, self.dataset, self.role = {f.name: f.dataType for f in df.schema}, dataset, role

    def column(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.types else F.lit(None)

    def scalar(self, name: str) -> Column:
        """A text; the first of a list; empty for null."""
        x = self.column(name)
        x = F.get(x, F.lit(0)) if isinstance(self.types.get(name), T.ArrayType) else x
        return F.coalesce(x.cast("string"), F.lit(""))

    def needed(self, name: str) -> Column:
        said = F.raise_error(F.lit(f"{self.dataset}: a {self.role} has no {name}")).cast("string")
        return F.when(text.blank(self.scalar(name)), said).otherwise(self.scalar(name))

    def image(self) -> Column:
        own, more = self.column("image").isNotNull(), self.column("images")
        return own | (F.size(more) > 0) if "images" in self.types else own

    def frames(self) -> Column:
        if "video" not in self.types:
            return F.array().cast("array<binary>")
        return F.coalesce(F.filter(self.column("video"), lambda f: f.isNotNull()), F.array().cast(self.types["video"]))


@dataclass(frozen=True)
class Made:
    """What a form makes of a row."""

    text: Column
    kind: Column | None = None  # image, video or null
    repairs: Sequence[tuple[str, Column]] = ()  # names of repairs, and where they changed something
    token_allowed: Column | None = None  # a visual token without media is right here
    used: Sequence[str] = ()  # columns that don't go to the metadata


def modern(x: Column) -> Column:
    return text.replace_tokens(x, dict.fromkeys(LEGACY, IMAGE))


def without_tokens(x: Column) -> Column:
    bare = text.let(text.replace_tokens(x, dict.fromkeys(LEGACY, "")), lambda v: text.normalize_space(v))
    return F.regexp_replace(bare, r"\A\n+", "")


def composed(instruction: Column, body: Column, token: str = "", separator: str = " ", squeeze: bool = False, newline: Column | bool = False, extra: bool = False) -> Column:
    """Token, instruction and body, then line ends; squeeze: no blank before a line end."""
    x = F.concat(instruction, F.when(body == "", "").otherwise(F.concat(F.lit(" "), body)))
    x = F.concat(F.lit(token + separator), x) if token else x
    x = F.replace(x, F.lit(" \n"), F.lit("\n")) if squeeze else x
    newline = F.lit(newline) if isinstance(newline, bool) else newline
    return F.concat(x, F.when(newline, "\n").otherwise(""), F.lit("\n" if extra else ""))


def tidy(x: Column, canonical: bool) -> Column:
    """Canonical mode: white space normalized, no line end at the tail."""
    return text.let(x, lambda v: text.trailing_newline(text.normalize_space(v), "strip")) if canonical else x


def _instruction(x: Column, leading_newline: bool) -> Column:
    bare = F.regexp_replace(text.replace_tokens(x, dict.fromkeys(LEGACY, "")), r"\A\s+|\s+\z", "")
    return F.when(bare == "", "").otherwise(F.concat(F.lit("\n" if leading_newline else ""), bare))


def _separator(k: Mapping, canonical: bool) -> str:
    return k["separator"] if k["separator"] is not None else ("\n" if canonical else " ")


def _newline(k: Mapping, canonical: bool) -> bool:
    return k["newline"] if k["newline"] is not None else canonical


def image_prompt(r: Row, k: Mapping, canonical: bool) -> Made:
    """A text about a picture: an instruction, if there is one, goes between token and text."""
    inst, body, media = r.scalar("qry_inst"), r.scalar("qry_text"), r.image()
    full = composed(_instruction(inst, k["leading_newline"]), body, IMAGE, " ", k["squeeze"], k["newline"], k["extra_line"])
    seen = F.when(inst != "", full).otherwise(modern(body))
    if k["tidy"] and canonical:
        seen = text.let(seen, lambda x: F.when(x.endswith("\n"), text.normalize_space(x, True)).otherwise(text.normalize_space(x)))
    alone = body if k["keep_tokens"] else without_tokens(body)
    out = F.when(media & ((inst != "") | (body != "")), seen).when(body != "", alone).otherwise(r.scalar("text"))
    return Made(out, F.when(media, "image"), used=IMAGE_FIELDS)


def _separate_dialogue(x: Column) -> Column:
    at = F.locate(": ", x)
    head, rest = F.substring(x, F.lit(1), at - 1), F.substring(x, at + 2, F.length(x))
    turns = rest.startswith("Q:") | F.contains(rest, F.lit("\nQ:")) | F.contains(rest, F.lit("\nA:"))
    return F.when((at > 0) & turns, F.concat(head, F.lit(":\n"), rest)).otherwise(x)


def text_query(r: Row, k: Mapping, canonical: bool) -> Made:
    """A text that asks for pictures; an instruction before a dialogue gets a line of its own in canonical mode."""
    x, media = F.when(r.scalar("qry_text") != "", r.scalar("qry_text")).otherwise(r.scalar("text")), r.image()
    if "turns" in r.types:
        x = F.concat(x, folded_turns(r.column("turns")))
    if canonical and k["dialogue"]:
        x = text.let(x, lambda v: F.when(v.endswith("\n\n"), F.substring(v, F.lit(1), F.length(v) - 1)).otherwise(v))
        x = text.let(x, _separate_dialogue)
    new = modern(x)
    if k["strip_tokens"]:
        bare = without_tokens(x)
        return Made(F.when(media, new).otherwise(bare), F.when(media, "image"), [("visual_token_alignment_strip_without_media", ~media & (bare != x))], used=(*IMAGE_FIELDS, "turns"))
    return Made(new, F.when(media, "image"), token_allowed=~media & (new != x), used=(*IMAGE_FIELDS, "turns"))


def folded_turns(turns: Column) -> Column:
    """Turns (role, text) in order as lines: those of the user begin with Q, those of others with A; turns without text are left out."""
    line = lambda t: F.concat(F.when(t["role"] == "user", "Q: ").otherwise("A: "), F.trim(t["text"]), F.lit("\n"))
    step = lambda said, t: F.when(text.blank(t["text"]), said).otherwise(F.concat(said, line(t)))
    return F.aggregate(turns, F.lit(""), step)


def image_target(r: Row, k: Mapping, canonical: bool) -> Made:
    """A picture that is looked for, with its caption if there is one."""
    inst, caption, media, repairs = r.scalar("tgt_inst"), r.scalar("tgt_text"), r.image(), []
    with_caption = ~text.blank(caption) if k["caption"] else F.lit(False)
    newline = F.when(with_caption, k["newline_with_caption"]).otherwise(k["newline_without_caption"])
    full = composed(_instruction(inst, False), F.when(with_caption, caption).otherwise(""), IMAGE, " ", k["squeeze"], newline)
    fallback = F.when(caption != "", caption).otherwise(r.scalar("text"))
    if k["query_first"]:
        fallback = F.when(r.scalar("qry_text") != "", r.scalar("qry_text")).otherwise(fallback)
    x = F.when(media & (inst != ""), full).when(media & (caption != ""), modern(caption)).otherwise(fallback)
    if canonical and k["block_layout"]:
        def block(v: Column) -> Column:
            new = modern(v)
            body = F.regexp_replace(F.substring(new, F.lit(len(IMAGE) + 1), F.length(new)), r"\A[ \n]+", "")
            laid = F.concat(F.lit(IMAGE + "\n"), text.trailing_newline(body, "strip"), F.when(new.endswith("\n") & (body != ""), "\n").otherwise(""))
            return F.when(new.startswith(IMAGE), laid).otherwise(new)

        repairs.append(("canonical_candidate_block_layout", text.let(x, block) != x))
        x = text.let(x, block)
    if canonical and k["whole_sentence"]:
        def ended(v: Column) -> Column:
            body = F.regexp_replace(F.substring(modern(v), F.lit(len(IMAGE) + 2), F.length(v)), r"\A\s+|\s+\z", "")
            known = modern(v).startswith(IMAGE + "\n") & body.isin(k["whole_sentence"], k["whole_sentence"] + ".")
            return F.when(known, f"{IMAGE}\n{k['whole_sentence']}.\n").otherwise(v)

        repairs.append(("canonical_cropped_object_candidate_sentence", text.let(x, ended) != x))
        x = text.let(x, ended)
    return Made(x, F.when(media, "image"), repairs, used=IMAGE_FIELDS)


def answer(r: Row, k: Mapping, canonical: bool) -> Made:
    """A text as it stands; tidy: normalized in canonical mode; bare_choice: without the letter of a choice."""
    x = F.when(r.scalar("text") != "", r.scalar("text")).otherwise(r.scalar("tgt_text"))
    x = tidy(x, canonical and k["tidy"])
    if k["bare_choice"]:
        at = F.locate(". ", x)
        x = F.when(at > 0, F.regexp_replace(F.substring(x, at + 2, F.length(x)), r"\A[. ]+|[. ]+\z", "")).otherwise(x)
    return Made(x, used=("id", "text", "tgt_text"))


def video_prompt(r: Row, k: Mapping, canonical: bool) -> Made:
    """An instruction about a video and nothing else."""
    inst = k["instruction"].rstrip() if canonical else k["instruction"]
    return Made(composed(F.lit(inst), F.lit(""), VIDEO, _separator(k, canonical), newline=_newline(k, canonical)), _video(r, k), used=("id", "qry_instruction", "qry_text", "pos_text", "neg_text", "video", "images", "media_metadata"))


def _video(r: Row, k: Mapping) -> Column:
    there = F.when(F.size(r.frames()) > 0, "video")
    said = F.raise_error(F.lit(f"{r.dataset}: a {r.role} has no video")).cast("string")
    return F.coalesce(there, said) if k["media_needed"] else there


def video_seen(r: Row, k: Mapping, canonical: bool) -> Made:
    """A video that is looked for."""
    x = composed(F.lit(k["instruction"]), F.lit(""), VIDEO, _separator(k, canonical), newline=_newline(k, canonical))
    return Made(x, _video(r, k), used=("id", "text", "images", "video", "image", "media_metadata", "caption", "video_path"))


def caption(r: Row, k: Mapping, canonical: bool) -> Made:
    """An instruction and a caption; of a list the first that isn't blank."""
    name = k["body"]
    x = F.coalesce(F.get(F.filter(r.column(name), lambda c: ~text.blank(c)), F.lit(0)), F.lit("")) if isinstance(r.types.get(name), T.ArrayType) else r.scalar(name)
    return Made(composed(F.lit(k["instruction"]), tidy(x, canonical), newline=_newline(k, canonical)), used=("id", name))


def choices(r: Row, k: Mapping, canonical: bool) -> Made:
    """A question about a video and its options, which `layout` lays out: lettered, lines, run_on or none (then `suffix`)."""
    question = tidy(r.needed("question"), canonical)
    names = k["options"]
    if k["layout"] == "none":
        body = F.concat(question, F.lit(k["suffix"]))
    else:
        if len(names) == 1:
            options = F.transform(F.filter(r.column(names[0]), lambda o: o.isNotNull()), lambda o: o.cast("string"))
            options = F.coalesce(options, F.array().cast("array<string>"))
        else:
            options = F.array(*[r.needed(n) for n in names])
        if k["layout"] == "lettered":
            options = F.transform(options, lambda o: tidy(o, canonical))
            body = F.regexp_replace(F.concat(question, F.lit("\nOptions:\n"), text.choice_block(options)), r"\s+\z", "")
        elif k["layout"] == "lines":
            body = F.concat(question, F.lit("\n"), F.array_join(options, "\n"))
        else:
            body = F.concat(question, F.array_join(options, " "))
    x = text.let(body, lambda b: composed(F.lit(k["instruction"]), b, VIDEO, _separator(k, canonical), newline=_newline(k, canonical)))
    return Made(x, _video(r, k), used=("id", "question", "video", "images", "media_metadata", *names))


def moment(r: Row, k: Mapping, canonical: bool) -> Made:
    """A text that asks for a moment: of the video that goes with it, by a picture, or by itself where the dataset has instructions for that."""
    body = tidy(r.needed("query"), canonical)
    made = lambda inst, token="": composed(F.lit(inst), body, token, _separator(k, canonical), newline=_newline(k, canonical))
    video, image = F.size(r.frames()) > 0, r.column("image").isNotNull()
    x, kind = made(k["instruction"], VIDEO), _video(r, k)
    if k["image_instruction"]:
        x = F.when(video, x).when(image, made(k["image_instruction"], IMAGE)).otherwise(made(k["text_instruction"]))
        kind = F.when(video, "video").when(image, "image")
    return Made(x, kind, used=("id", "query", "image", "video", "media_metadata"))


def document_query(r: Row, k: Mapping, canonical: bool) -> Made:
    query = F.when(r.scalar("query") != "", r.scalar("query")).otherwise(r.scalar("text"))
    said = F.raise_error(F.lit(f"{r.dataset}: a query has no text")).cast("string")
    query = F.when(text.blank(query), said).otherwise(query)
    x = F.concat(F.lit(k["instruction"] + " " if k["instruction"] else ""), query)
    if canonical:
        x = F.concat(x, F.lit("\n"))
        x = text.let(x, lambda v: text.normalize_space(v, _newline(k, True))) if k["tidy"] else x
    return Made(x, used=("id", "query", "text", "images", "image", "media_metadata"))


def document_page(r: Row, k: Mapping, canonical: bool) -> Made:
    said = F.raise_error(F.lit(f"{r.dataset}: a candidate has no page")).cast("string")
    x = composed(F.lit(k["instruction"]), F.lit(""), IMAGE, _separator(k, canonical), newline=_newline(k, canonical))
    return Made(x, F.when(r.image(), "image").otherwise(said), used=("id", "images", "image", "text"))


#: The forms and the knobs that each has, with their values where a dataset says nothing.
LAYOUT = {"separator": None, "newline": None}
FORMS: dict[str, tuple[Callable[[Row, Mapping, bool], Made], dict]] = {
    "image_prompt": (image_prompt, {"leading_newline": True, "squeeze": True, "newline": True, "extra_line": False, "tidy": False, "keep_tokens": False}),
    "text_query": (text_query, {"dialogue": False, "strip_tokens": False}),
    "image_target": (image_target, {"caption": True, "squeeze": True, "newline_with_caption": True, "newline_without_caption": True, "block_layout": False, "whole_sentence": "", "query_first": True}),
    "answer": (answer, {"tidy": False, "bare_choice": False}),
    "video_prompt": (video_prompt, {"instruction": "", "frames": 8, "media_needed": False, **LAYOUT}),
    "video_seen": (video_seen, {"instruction": "Understand the content of the provided video.", "frames": 8, "media_needed": True, **LAYOUT}),
    "caption": (caption, {"instruction": "", "body": "caption", "newline": None}),
    "choices": (choices, {"instruction": "", "layout": "lettered", "options": (), "suffix": "", "frames": 8, "media_needed": False, **LAYOUT}),
    "moment": (moment, {"instruction": "", "image_instruction": "", "text_instruction": "", "frames": 8, "media_needed": False, **LAYOUT}),
    "document_query": (document_query, {"instruction": "Find a document image that matches the given query:", "tidy": True, "newline": None}),
    "document_page": (document_page, {"instruction": "Understand the content of the provided document image.", **LAYOUT}),
}


@dataclass(frozen=True)
class Side:
    form: str
    columns: tuple[str, ...]
    knobs: Mapping[str, object] = field(default_factory=dict)


def _side(form: str, columns: str, **knobs: object) -> Side:
    return Side(form, tuple(columns.split()), knobs)


Parser = tuple[Side, Side]
ANSWER = _side("answer", "id text")
QUESTION = "Given a video and a question, select the most accurate answer from the provided candidates. Return only the exact text of your chosen answer. Question: "
CROP = "Represent the given cropped image of the object"
CLIP = "Find the clip that corresponds to the described scene in the given video:"


def _several(names: str, query: Side, candidate: Side) -> dict[str, Parser]:
    return {name: (query, candidate) for name in names.split()}


def _of_task(modality: str, task: str) -> str:
    return DATASETS[modality, task]


_IMAGE_QUERY, _GROUNDED = "id qry_text image", {"keep_tokens": True}
_TARGET = _side("image_target", "id tgt_text image", newline_without_caption=False, query_first=False)
_FOUND = _side("image_target", "id tgt_text image")
_PAGE, _PAGE_PATH, _DOC, _RANGE = _side("document_page", "id image"), _side("document_page", "id image path"), _side("document_query", "id query"), _side("document_query", "id query corpus_range")

# The datasets, their columns and instructions.
PARSERS: dict[str, Parser] = {
    **_several(_of_task("image", "image_classification"), _side("image_prompt", _IMAGE_QUERY, leading_newline=False), ANSWER),
    **_several("ChartQA ScienceQA GQA DocVQA InfographicsVQA Visual7W TextVQA", _side("image_prompt", _IMAGE_QUERY), ANSWER),
    **_several("A-OKVQA OK-VQA", _side("image_prompt", "id qry_inst qry_text image"), ANSWER),
    "VizWiz": (_side("image_prompt", _IMAGE_QUERY, tidy=True), ANSWER),
    **_several("MSCOCO_i2t VisualNews_i2t", _side("image_prompt", _IMAGE_QUERY), ANSWER),
    **_several("VisualNews_t2i Wiki-SS-NQ MSCOCO_t2i", _side("text_query", "id qry_text"), _FOUND),
    "EDIS": (_side("text_query", "id qry_text", strip_tokens=True), _FOUND),
    "WebQA": (_side("text_query", "id qry_text", strip_tokens=True), _side("image_target", "id tgt_inst tgt_text image")),
    "VisDial": (_side("text_query", "id qry_inst qry_text", dialogue=True), _side("image_target", "id tgt_inst tgt_text tgt_img_path image", block_layout=True)),
    **_several("NIGHTS OVEN FashionIQ RefCOCO-Matching", _side("image_prompt", _IMAGE_QUERY, **_GROUNDED), _TARGET),
    "CIRR": (_side("image_prompt", "id qry_inst qry_text image", **_GROUNDED), _TARGET),
    **_several("Visual7W-Pointing MSCOCO RefCOCO", _side("image_prompt", _IMAGE_QUERY, **_GROUNDED), _side("image_target", "id tgt_text image", newline_without_caption=False, query_first=False, whole_sentence=CROP)),
    "K700": (_side("video_prompt", "id qry_instruction qry_text video video_id video_path", instruction="Recognize the category of the video content."), ANSWER),
    "UCF101": (_side("video_prompt", "id qry_instruction qry_text video video_id video_path", instruction="What activities or sports are being performed by the person in the video?"), ANSWER),
    "HMDB51": (_side("video_prompt", "id qry_instruction qry_text video video_id video_path", instruction="What actions or objects interactions are the person in the video doing?"), ANSWER),
    "Breakfast": (_side("video_prompt", "id qry_instruction qry_text video video_id video_path", instruction="Recognize the breakfast type that the person is cooking in the video. "), ANSWER),
    "SmthSmthV2": (_side("video_prompt", "id pos_text video video_id", instruction="What actions or object interactions are being performed by the person in the video?"), ANSWER),
    "MSR-VTT": (_side("caption", "id caption", instruction="Find a video that contains the following visual content:"), _side("video_seen", "id video_id video")),
    "MSVD": (_side("caption", "id caption", instruction="Find the video snippet that corresponds to the given summary:"), _side("video_seen", "id video_id video")),
    "DiDeMo": (_side("caption", "id caption", instruction="Find a video that includes the following described scenes:"), _side("video_seen", "id video video_path source")),
    "YouCook2": (_side("caption", "id sentence", body="sentence", instruction="Find a video that demonstrates the following action while making a recipe:"), _side("video_seen", "id video source_id segment video_path youtube_id")),
    "VATEX": (_side("caption", "id enCap", body="enCap", instruction="Select a video that fits the description provided:"), _side("video_seen", "id video videoID")),
    **_several("QVHighlight Charades-STA", _side("moment", "id query video", instruction=CLIP), _side("video_seen", "id video", media_needed=False)),
    "MomentSeeker": (
        _side("moment", "id query image video", instruction="Find the clip that corresponds to the given sentence and video segment:", image_instruction="Select the video clip that aligns with the given text and image:", text_instruction="Find the clip that corresponds to the given text:"),
        _side("video_seen", "id video", instruction="Understand the content of the provided video clip.", media_needed=False),
    ),
    "Video-MME": (_side("choices", "id question options video", layout="lines", options=("options",), instruction=QUESTION), ANSWER),
    "NExTQA": (_side("choices", "id question a0 a1 a2 a3 a4 video", options=("a0", "a1", "a2", "a3", "a4"), instruction=QUESTION), _side("answer", "id text", tidy=True)),
    "MVBench": (_side("choices", "id question candidates video", options=("candidates",), instruction=QUESTION), _side("answer", "id text", tidy=True)),
    "EgoSchema": (_side("choices", "id question option video", layout="run_on", options=("option",), instruction=QUESTION), ANSWER),
    "ActivityNetQA": (_side("choices", "id question video", layout="none", suffix="? (A) yes; (B) no.", instruction=QUESTION), ANSWER),
    **_several(_of_task("visdoc", "visdoc_vidore_v1"), _DOC, _PAGE),
    **_several("ViDoRe_tabfquad ViDoRe_tatdqa", _DOC, _PAGE_PATH),
    **_several(_of_task("visdoc", "visdoc_vidore_v2"), _DOC, _PAGE),
    **_several(_of_task("visdoc", "visdoc_visrag"), _DOC, _PAGE_PATH),
    **_several("MMLongBench-page MMLongBench-doc ViDoSeek-page", _RANGE, _PAGE_PATH),
    "ViDoSeek-doc": (_RANGE, _PAGE),
}


def register(name: str, parser: Parser) -> None:
    """A parser of the user's own; a name that is taken and a form that isn't known raise."""
    if name in PARSERS:
        raise ValueError(f"parser {name!r} is registered")
    for side in parser:
        _knobs(side, {})
    PARSERS[name] = parser


def _knobs(side: Side, overrides: Mapping[str, object]) -> dict:
    if side.form not in FORMS:
        raise ValueError(f"unknown form {side.form!r}")
    known = FORMS[side.form][1]
    unknown = sorted(set(side.knobs) - set(known))
    if unknown:
        raise ValueError(f"form {side.form} has no {unknown}")
    return known | dict(side.knobs) | {name: value for name, value in overrides.items() if name in known}


def items(rows: DataFrame, dataset: str, role: str, mode: str = "canonical", **overrides: object) -> DataFrame:
    """id, text, media, repairs, token_allowed, metadata: the queries or candidates of a dataset as items.

    role: query or candidate. overrides: knobs of either side's form; ones that neither has raise, as do
    declared columns that rows lack. media: null, or its kind, how many pictures or frames there are and which
    are taken. A visual token without media, and media without one, raise when rows are read, unless the form allows it.
    """
    if dataset not in PARSERS:
        raise KeyError(f"no parser of {dataset!r}")
    if role not in ("query", "candidate") or mode not in MODES:
        raise ValueError(f"unknown role or mode: {role!r}, {mode!r}")
    sides = PARSERS[dataset]
    unknown = sorted(set(overrides) - {n for s in sides for n in FORMS[s.form][1]})
    if unknown:
        raise ValueError(f"parser {dataset} has no {unknown}")
    side = sides[role == "candidate"]
    lacks = sorted(set(side.columns) - set(rows.columns))
    if lacks:
        raise ValueError(f"{dataset}: the {role} table lacks {lacks}")
    declared = [*side.columns, *[c for c in ("turns",) if c in rows.columns and side.form == "text_query"]]
    rows = rows.select(*[F.col(f"`{c}`") for c in declared])
    k = _knobs(side, overrides)
    r = Row(rows, dataset, role)
    made = FORMS[side.form][0](r, k, mode == "canonical")
    out = rows.select(
        F.col("id").cast("string").alias("id"), made.text.alias("text"), _media(r, made, k).alias("media"),
        F.array_compact(F.array(*[F.when(changed, name) for name, changed in made.repairs])).cast("array<string>").alias("repairs"),
        (F.lit(False) if made.token_allowed is None else F.coalesce(made.token_allowed, F.lit(False))).alias("token_allowed"),
        _metadata(declared, made).alias("metadata"),
    )
    has = F.contains("text", F.lit(IMAGE)) | F.contains("text", F.lit(VIDEO))
    right = (has == F.col("media").isNotNull()) | (has & F.col("token_allowed"))
    said = F.raise_error(F.concat(F.lit(f"{dataset}: token and media differ in {role} "), F.col("id"))).cast("string")
    return out.withColumn("text", F.when(right, F.col("text")).otherwise(said))


def _media(r: Row, made: Made, k: Mapping) -> Column:
    if made.kind is None:
        return F.lit(None).cast("struct<kind: string, total: int, taken: array<bigint>>")
    n = F.size(r.frames())
    taken = F.when(n > k.get("frames", 8), arrays.uniform_indices(n.cast("long"), k.get("frames", 8))).otherwise(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))
    of = lambda kind: F.when(kind == "video", F.struct(kind.alias("kind"), F.size(r.column("video")).alias("total"), taken.alias("taken"))).when(
        kind == "image", F.struct(kind.alias("kind"), F.lit(1).alias("total"), F.array(F.lit(0).cast("long")).alias("taken"))
    )
    return text.let(made.kind, of) if "video" in r.types else F.when(made.kind == "image", F.struct(F.lit("image").alias("kind"), F.lit(1).alias("total"), F.array(F.lit(0).cast("long")).alias("taken")))


def _metadata(declared: Sequence[str], made: Made) -> Column:
    """Declared columns that the form leaves untouched, where they aren't null."""
    rest = [c for c in declared if c not in made.used]
    if not rest:
        return F.create_map().cast("map<string,string>")
    return F.map_filter(F.create_map(*[x for c in rest for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]), lambda name, value: value.isNotNull())

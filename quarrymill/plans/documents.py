"""Training sources of document pages: questions with options, and queries with an instruction for each source."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from .training import IMAGE, LEGACY, NEWLINES

# Instructions by source, of queries and of pages.
QUERY_PROMPTS = {
    "NeurIPS Papers": "This query is about a research paper from NeurIPS, a leading AI/ML conference. The document contains technical discussions, methodologies, and findings. Identify relevant papers and sections that address the query: ",
    "Textbooks": "This query is related to a college-level textbook, which provides structured explanations, definitions, and examples. Find the most relevant concepts or explanations that address the query: ",
    "ICML Papers": "This query is about a research paper from ICML, a leading AI/ML conference. The document contains theoretical insights, experiments, and applications. Identify relevant papers and sections that best answer the query: ",
    "Manuallib": "This query pertains to a product manual, which contains detailed technical specifications, usage instructions, and troubleshooting steps. Find the most relevant section that answers the query: ",
    "ArxivQA": "This query is related to retrieving a relevant figure from an ArXiv research paper. The retrieved figure should contain scientific plots, mathematical visualizations, or experimental results that best address the query: ",
    "ChartQA": "This query is related to retrieving a relevant chart that visually represents numerical or categorical data. The retrieved chart should contain bar graphs, line charts, or other visual elements necessary to analyze trends, compare values, or extract insights related to the query: ",
    "MP-DocVQA": "This query is related to retrieving a relevant page from a multi-page document, such as reports, invoices, or research papers. The retrieved document should contain text, tables, or structured information necessary to answer the query: ",
    "InfoVQA": "This query is related to retrieving an infographic that visually presents statistical or factual information using charts, icons, and structured layouts. The retrieved image should contain the necessary visual elements to provide the best context for answering the query: ",
    "PlotQA": "This query relates to retrieving a relevant plot or chart that visually represents numerical data. The retrieved figure should contain the necessary information to analyze trends, compare values, or extract key insights related to the query: ",
    "SlideVQA": "This query is related to retrieving a relevant presentation slide that visually presents structured information. The retrieved slide should contain the necessary text, charts, or graphics to provide the best answer to the query: ",
}
PAGE_PROMPTS = {
    "Textbooks": "A textbook page with structured educational content and explanations.",
    "ICML Papers": "A research paper from ICML, covering machine learning topics.",
    "NeurIPS Papers": "A research paper from NeurIPS on AI and ML topics.",
    "Manuallib": "A product manual page with technical specifications and instructions.",
    "InfoVQA": "An infographic with structured data, charts, and annotations.",
    "PlotQA": "A numerical data visualization, such as bar charts or line graphs.",
    "SlideVQA": "A presentation slide with text, bullet points, and diagrams.",
    "ArxivQA": "A figure from a research paper, including plots or experimental results.",
    "MP-DocVQA": "A page from a multi-page document with text or tables.",
    "ChartQA": "A statistical chart comparing values or analyzing trends.",
}


def _options(options: Column) -> Column:
    """A list written as text, in single or double quotes, as an array; null if it is none, or has no items."""
    listed = F.from_json(options, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})
    return F.when(F.startswith(F.ltrim(options), F.lit("[")) & (F.size(listed) > 0) & ~F.exists(listed, lambda x: x.isNull()), listed)


def _on_own_line(x: Column) -> Column:
    """The picture's token on a line of its own before a text without older tokens."""
    bare = text.let(text.replace_tokens(x, LEGACY | {"<image>": IMAGE}), lambda v: text.normalize_space(F.replace(v, F.lit(IMAGE), F.lit(""))))
    return text.let(bare, lambda v: F.when(v == "", IMAGE).otherwise(F.concat(F.lit(IMAGE + "\n"), F.regexp_replace(v, r"\A\n+", ""))))


def _checked(rows: DataFrame, name: str) -> Column:
    said = F.raise_error(F.lit(f"{name}: a row has no picture")).cast("boolean")
    return F.when(F.col("image").isNotNull(), F.lit(True)).otherwise(said)


def _sample(query: Column, query_media: Column, positive: Column, positive_media: Column, name: str, notes: list[str]) -> list[Column]:
    side = lambda t, m: F.struct(t.alias("text"), m.alias("has_media"))
    held = F.map_filter(F.create_map(*[x for c in notes for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    return [side(query, query_media).alias("query"), side(positive, positive_media).alias("positive"), side(F.lit(""), F.lit(False)).alias("negative"), F.map_concat(F.create_map(F.lit("dataset_name"), F.lit(name)), held).alias("metadata")]


def question_samples(rows: DataFrame, name: str = "vidore_train", query_end: str = "preserve", answer_end: str = "preserve") -> DataFrame:
    """Questions about a page, with their options, and the answer; an answer by letter becomes the option that it names.

    rows: query, options (a list written as text), answer, image, and source, page, model, answer_type and image_filename
    where they are there. A row without picture raises.
    """
    for end in (query_end, answer_end):
        if end not in NEWLINES:
            raise ValueError(f"unknown newline policy {end!r}")
    none = F.lit("")
    listed, answer = _options(F.col("options").cast("string")), F.coalesce(F.col("answer").cast("string"), none)
    asked = F.concat(F.coalesce("query", none), F.when(listed.isNotNull(), F.concat(F.lit(" Options: "), F.col("options").cast("string"))).otherwise(none))

    def resolved(array: Column) -> Column:
        place = F.array_position(F.array(*map(F.lit, "ABCDE")), answer)
        picked = F.when((place > 0) & (place <= F.size(array)), F.try_element_at(array, F.greatest(place, F.lit(1)).cast("int"))).otherwise(answer)
        bare = F.replace(F.replace(picked, F.concat(answer, F.lit(". ")), none), F.concat(answer, F.lit(") ")), none)
        return text.normalize_space(F.when(array.isNull(), answer).otherwise(bare))

    notes = [c for c in ("source", "page", "model", "answer_type", "image_filename") if c in rows.columns]
    made = _sample(text.trailing_newline(_on_own_line(asked), query_end), F.lit(True), text.trailing_newline(text.let(listed, resolved), answer_end), F.lit(False), name, notes)
    return rows.where(_checked(rows, name)).select(*made)


def source_samples(rows: DataFrame, name: str = "visrag_train", queries: Mapping[str, str] = QUERY_PROMPTS, pages: Mapping[str, str] = PAGE_PROMPTS, separator: str = "none", end: str = "ensure_single") -> DataFrame:
    """Queries and pages with the instructions of their source; a source without one has none. rows: query, source, image."""
    if end not in NEWLINES:
        raise ValueError(f"unknown newline policy {end!r}")
    of = lambda known: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), F.coalesce("source", F.lit(""))), F.lit(""))
    query = text.let(text.join_texts(of(queries), F.coalesce("query", F.lit("")), separator), lambda x: text.trailing_newline(text.normalize_space(x), end))
    page = text.trailing_newline(_on_own_line(of(pages)), end)
    return rows.where(_checked(rows, name)).select(*_sample(query, F.lit(False), page, F.lit(True), name, ["source"]))

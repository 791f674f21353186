"""Text functions as Column expressions; none needs Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize_space(x: Column, final_newline: bool = False) -> Column:
    """Line ends to LF, no blanks at line ends or around the text; blank text becomes empty."""
    x = F.regexp_replace(x, r"\r\n|\r", "\n")
    x = F.regexp_replace(x, r"[ \t]+(?=\n|\z)", "")
    x = F.regexp_replace(x, r"\A[ \t]+", "")
    x = F.when(F.regexp_replace(x, r"\s+", "") == "", "").otherwise(x)
    return F.when(x == "", x).otherwise(trailing_newline(x, "ensure_single")) if final_newline else x


def match_key(x: Column) -> Column:
    """Lower case with white space collapsed, for comparing texts."""
    return F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))


def blank(x: Column) -> Column:
    return F.coalesce(F.regexp_replace(x, r"(?U)\s+", ""), F.lit("")) == ""


def trailing_newline(x: Column, policy: str) -> Column:
    """policy: preserve, strip, ensure_single, or normalize_blank_tail (one line end if there was any)."""
    bare = F.regexp_replace(x, r"\n+\z", "")
    if policy == "preserve":
        return x
    if policy == "strip":
        return bare
    if policy == "ensure_single":
        return F.when(x == "", x).otherwise(F.concat(bare, F.lit("\n")))
    if policy == "normalize_blank_tail":
        return F.when(x.endswith("\n"), F.concat(bare, F.lit("\n"))).otherwise(x)
    raise ValueError(f"unknown newline policy {policy!r}")


def replace_tokens(x: Column, tokens: dict[str, str]) -> Column:
    """Each legacy token replaced by its successor, in the order given."""
    for old, new in tokens.items():
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def token_on_first_line(x: Column, token: str) -> Column:
    """A token that occurs once moves to a line of its own at the start; else the text is only normalized."""
    once = F.size(F.split(x, F.regexp_replace(F.lit(token), r"([\\^$.|?*+()\[\]{}])", r"\\$1"))) == 2
    rest = normalize_space(F.replace(x, F.lit(token), F.lit("")))
    moved = F.when(rest == "", F.lit(token)).otherwise(F.concat(F.lit(token + "\n"), F.regexp_replace(rest, r"\A\n+", "")))
    return F.when(once, moved).otherwise(normalize_space(x))


def ensure_token(x: Column, token: str, where: str = "prepend", separator: str = "\n") -> Column:
    joined = F.concat(F.lit(token + separator), x) if where == "prepend" else F.concat(x, F.lit(separator + token))
    return F.when(F.contains(x, F.lit(token)), x).otherwise(joined)


def ensure_prefix(x: Column, prefix: str) -> Column:
    return F.when(F.startswith(F.ltrim(x), F.lit(prefix)), x).otherwise(F.concat(F.lit(prefix), x))


def recover_question(x: Column, tokens: list[str], prefix: str = "") -> Column:
    """The bare question: without tokens, the prompt's prefix and line ends at the tail."""
    for token in tokens:
        x = F.replace(x, F.lit(token), F.lit(""))
    x = F.trim(x)
    if prefix:
        x = F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)
    return F.regexp_replace(x, r"\n+\z", "")


def join_texts(instruction: Column, body: Column, join: str = "newline") -> Column:
    """Instruction and body; where one is empty, the other alone."""
    between = {"none": "", "space": " ", "newline": "\n"}[join]
    return F.when(F.coalesce(instruction, F.lit("")) == "", F.coalesce(body, F.lit(""))).when(F.coalesce(body, F.lit("")) == "", instruction).otherwise(F.concat(instruction, F.lit(between), body))


def compose_prompt(body: Column, token: str = "", repair: bool = True, extra_blank: bool = False) -> Column:
    x = F.concat(F.lit(token + " " if token else ""), body)
    if repair:
        x = F.replace(x, F.lit(" \n"), F.lit("\n"))
    return F.concat(x, F.lit("\n")) if extra_blank else x


def choice_block(options: Column) -> Column:
    """``(A) first`` and so on, a line for each option."""
    return F.array_join(F.transform(options, lambda x, i: F.concat(F.lit("("), F.char(i + 65), F.lit(") "), x)), "\n")


def strip_choice(x: Column, last: str = "E") -> Column:
    return F.regexp_replace(x, rf"^\([A-{last}]\) ", "")


def answer_text(letter: Column, options: Column) -> Column:
    """The option that an answer letter names, without its ``X. `` or ``X) ``; null if there is none."""
    return F.regexp_replace(F.try_element_at(options, F.ascii(F.upper(letter)) - 64), r"^[A-Z][.)] ", "")


def render(template: str, **values: Column) -> Column:
    """A template with {name} fields."""
    import string

    parts = []
    for literal, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix_ and 16 hexadecimal digits of the SHA-1 of the NUL-joined parts."""
    joined = F.concat_ws("\0", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha1(joined), 1, 16))


def segment_key(video: Column, start: Column | None = None, end: Column | None = None) -> Column:
    if start is None:
        return F.concat(video, F.lit("#full"))
    return F.when(start.isNull() | end.isNull(), F.concat(video, F.lit("#full"))).otherwise(F.format_string("%s#segment=%.3f-%.3f", video, start.cast("double"), end.cast("double")))


def padded_id(prefix: Column, a: Column, b: Column) -> Column:
    return F.format_string("%s_%06d_%06d", prefix, a, b)


def last_number(x: Column) -> Column:
    """The last run of digits, as a number."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).cast("long")


def side(x: Column) -> Column:
    """query, positive, negative or both, from the names in use; others raise."""
    n = F.lower(F.trim(x))
    return F.when(n.isin("query", "qry", "q"), "query").when(n.isin("positive", "pos", "target", "tgt"), "positive").when(n.isin("negative", "neg"), "negative").when(n.isin("both", "all"), "both").otherwise(F.raise_error(F.concat(F.lit("unknown side: "), n)))


def boolean(x: Column) -> Column:
    n = F.lower(F.trim(x))
    return F.when(n.isin("1", "true", "yes", "on"), True).when(n.isin("0", "false", "no", "off"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), n)).cast("boolean"))


def drop_prefix(x: Column, prefix: str) -> Column:
    return F.when(F.startswith(x, F.lit(prefix)), F.substring(x, len(prefix) + 1, 1 << 30)).otherwise(x)


def alias(x: Column, names: dict[str, str]) -> Column:
    """A name by its alias, others as they are."""
    if not names:
        return x
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in names.items() for v in kv]), x), x)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, empty if there is none."""
    return F.lower(F.regexp_extract(basename(path), r".(\.[^.]*)$", 1))


def row_key(name: Column, row: Column) -> Column:
    return F.concat(name, F.lit("#row="), row.cast("string"))


def page_key(name: Column, page: Column) -> Column:
    return F.concat(name, F.lit("#page="), page.cast("string"))


def duration(start: Column, end: Column) -> Column:
    """Length of a segment to a tenth, halves to the even digit."""
    return F.bround(end - start, 1)


def resolve_answer(answer: Column, options: Column) -> Column:
    """The option that an answer names by letter, by place from 0 or by its own text; null if none does."""
    bare = F.trim(answer.cast("string"))
    place = F.array_position(F.transform(options, lambda o: F.lower(F.trim(o))), F.lower(bare))
    letter = F.regexp_extract(bare, r"^\(?([A-Za-z])[).]?$", 1)
    by_letter = F.try_element_at(options, F.ascii(F.upper(letter)) - 64)
    by_place = F.try_element_at(options, F.when(bare.rlike(r"^[0-9]{1,6}$"), bare.cast("int") + 1))
    return F.when(place > 0, F.try_element_at(options, place.cast("int"))).when(letter != "", by_letter).otherwise(by_place)


def own_line(x: Column, token: str, has_media: Column) -> Column:
    """The visual token on a line of its own where there is media, and nowhere where there is none."""
    without = normalize_space(F.replace(x, F.lit(token), F.lit("")))
    shown = lambda b: F.when(has_media, F.when(b == "", F.lit(token)).otherwise(F.concat(F.lit(token + "\n"), b))).otherwise(b)
    return let(F.regexp_replace(without, r"\A\n+|\n+\z", ""), shown)


def restore_if_empty(x: Column, fallback: Column) -> Column:
    return F.when(blank(x), fallback).otherwise(x)


def newline_once(x: Column, mark: str) -> Column:
    """The first occurrence of a mark begins a line."""
    at = F.locate(mark, x)
    head = F.regexp_replace(F.substring(x, F.lit(1), at - 1), r"[ \t]+\z", "")
    moved = F.concat(F.when((head == "") | head.endswith("\n"), head).otherwise(F.concat(head, F.lit("\n"))), F.substring(x, at, F.length(x)))
    return F.when(at > 0, moved).otherwise(x)


def horizontal_tail(x: Column) -> Column:
    """Without blanks at the end of the last line; line ends stay."""
    return F.regexp_replace(x, r"[ \t]+(\n*)\z", "$1")


def sorted_json(x: Column) -> Column:
    """A map of texts as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(x))))

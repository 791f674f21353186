"""Rows of a batch put together as a model takes them: padded ids and masks, aligned fields, joined visual rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload(images: Column | None, media: Column | None) -> Column:
    """kind and content of a sample's media: a list of pictures of older rows, or media (kind, content).

    Both at once, kinds mixed, a kind that isn't known and more than one video raise; without any it is null.
    """
    none = F.lit(None).cast("struct<kind: string, content: array<binary>>")
    fail = lambda said: F.raise_error(F.lit(said)).cast("struct<kind: string, content: array<binary>>")
    made = lambda kind, content: F.struct(kind.alias("kind"), content.alias("content"))
    pictures = F.size(F.filter(images, lambda x: x.isNotNull())) > 0 if images is not None else F.lit(False)
    old = made(F.lit("image"), F.filter(images, lambda x: x.isNotNull())) if images is not None else none
    if media is None:
        return F.when(pictures, old).otherwise(none)
    kinds = F.array_distinct(F.transform(media, lambda m: m["kind"]))
    new = (
        F.when(F.size(kinds) > 1, fail("a sample mixes kinds of media")).when(~F.get(kinds, F.lit(0)).isin("image", "video"), fail("a kind of media that isn't known"))
        .when((F.get(kinds, F.lit(0)) == "video") & (F.size(media) > 1), fail("a sample has more than one video")).otherwise(made(F.get(kinds, F.lit(0)), F.flatten(F.transform(media, lambda m: m["content"]))))
    )
    some = F.coalesce(F.size(media) > 0, F.lit(False))
    return F.when(some & F.coalesce(pictures, F.lit(False)), fail("a sample has both pictures and media")).when(some, new).when(pictures, old).otherwise(none)


def _has(c: str) -> Callable[[Column], Column]:
    return lambda x: x[f"f_{c}"].isNotNull()


def _value(c: str) -> Callable[[Column], Column]:
    return lambda x: x[f"f_{c}"]


def _field(c: str, kind: str, element: str, width: Column, padded: Callable[[Column, int, str], Column]) -> Callable[[Column], Column]:
    """An aligned field of a row, padded; zeros where the row has none."""
    def field(x: Column) -> Column:
        value = F.coalesce(x[f"f_{c}"], F.transform(x["ids"], lambda _: F.lit(0).cast(element)))
        long = F.raise_error(F.concat(F.lit(f"{c} of length "), F.size(value), F.lit(" exceeds the width "), width)).cast(kind)
        return padded(F.when(F.size(value) > width, long).otherwise(value), 0, element)

    return field


def collate(rows: DataFrame, batch: str, slot: str, ids: str, aligned: Sequence[str] = (), joined: Sequence[str] = (), pad: int = 0, side: str = "right") -> DataFrame:
    """One row for each batch, its rows in the order of slot.

    n and width (the longest ids); ids: padded to width; mask: 1 where ids are, 0 at the padding;
    values and offsets: the same ids unpadded, row i from offsets[i] to offsets[i + 1]. aligned: fields with a
    value for each id, padded with zeros; a row's null counts as zeros, one that no row has is null, one longer than
    width raises. joined: arrays put one after another, null where no row has one. A row without ids raises. A
    batch is one value in one task, so batches have to be of a bounded size; rows are dealt by batch only.
    """
    if side not in ("left", "right"):
        raise ValueError(f"unknown side {side!r}")
    said = F.raise_error(F.concat(F.lit("a row without ids in batch "), F.col(batch).cast("string"))).cast(dict(rows.dtypes)[ids])
    packed = F.array_sort(F.collect_list(F.struct(F.col(slot).alias("slot"), F.coalesce(F.col(ids), said).alias("ids"), *[F.col(c).alias(f"f_{c}") for c in (*aligned, *joined)])))
    grouped = rows.groupBy(batch).agg(packed.alias("r"))
    grouped = grouped.select(batch, "r", F.array_max(F.transform("r", lambda x: F.size(x["ids"]))).alias("width"))
    width = F.col("width")

    def padded(x: Column, value: int, kind: str) -> Column:
        fill = F.array_repeat(F.lit(value).cast(kind), width - F.size(x))
        return F.concat(fill, x) if side == "left" else F.concat(x, fill)

    element = lambda c: dict(rows.dtypes)[c].removeprefix("array<").removesuffix(">")
    out = [
        F.col(batch), F.size("r").alias("n"), width, F.transform("r", lambda x: padded(x["ids"], pad, element(ids))).alias("ids"),
        F.transform("r", lambda x: padded(F.transform(x["ids"], lambda _: F.lit(1)), 0, "int")).alias("mask"),
        F.flatten(F.transform("r", lambda x: x["ids"])).alias("values"),
        F.aggregate("r", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.size(x["ids"]))).alias("offsets"),
    ]
    for c in aligned:
        out.append(F.when(F.exists("r", _has(c)), F.transform("r", _field(c, dict(rows.dtypes)[c], element(c), width, padded))).alias(c))
    for c in joined:
        there = F.filter("r", _has(c))
        out.append(F.when(F.size(there) > 0, F.flatten(F.transform(there, _value(c)))).alias(c))
    return grouped.select(*out)

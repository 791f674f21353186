"""Array, sampling and arithmetic functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_indices(n: Column, k: int) -> Column:
    """k whole numbers spread evenly from 0 to n - 1, both included."""
    last = n - 1
    if k == 1:
        return F.array(F.lit(0).cast("long"))
    step = last / F.lit(k - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, last).otherwise(F.floor(i * step)).cast("long"))


def stride_indices(n: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(i * n / F.lit(k)).cast("long"))


def frame_range(start: Column, end: Column, fps: Column, n: Column) -> Column:
    """Frames [first, last) of a segment in seconds, within the n frames there are."""
    first = F.least(F.greatest(F.floor(start * fps), F.lit(0)), n)
    last = F.least(F.greatest(F.ceil(end * fps), first), n)
    return F.struct(first.cast("long").alias("first"), last.cast("long").alias("last"))


def timestamps(indices: Column, fps: Column) -> Column:
    rate = F.when(fps > 0, fps).otherwise(F.lit(1.0))
    return F.transform(indices, lambda i: i / rate)


def clip_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The box inside the image; a box without area raises."""
    x0, y0 = F.least(F.greatest(x, F.lit(0)), width), F.least(F.greatest(y, F.lit(0)), height)
    x1, y1 = F.least(F.greatest(x + w, F.lit(0)), width), F.least(F.greatest(y + h, F.lit(0)), height)
    box = F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return F.when((x1 > x0) & (y1 > y0), box).otherwise(F.raise_error(F.lit("box without area")))


def pick_caption(captions: Column, how: str = "first", seed: Column | None = None) -> Column:
    """The first caption that isn't blank, one chosen by seed, or all joined."""
    real = F.filter(captions, lambda c: F.trim(c) != "")
    if how == "first":
        return F.get(real, F.lit(0))
    if how == "all":
        return F.array_join(real, "; ")
    return F.get(real, F.pmod(F.xxhash64(seed), F.size(real)).cast("int"))


def element(array: Column, i: int, default: Column) -> Column:
    return F.coalesce(F.get(array, F.lit(i)), default)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def language_flops(tokens: Column, layers: int, hidden: int, ffn: int) -> Column:
    """Floating point operations of one forward pass over a text of so many tokens."""
    t = tokens.cast("double")
    return layers * (t * (8.0 * hidden * hidden + 6.0 * hidden * ffn) + 4.0 * hidden * t * t)


def vision_flops(patches: Column, layers: int, hidden: int, ffn: int, window: int = 0) -> Column:
    p = patches.cast("double")
    return layers * (p * (8.0 * hidden * hidden + 4.0 * hidden * ffn) + 4.0 * hidden * p * (F.least(p, F.lit(float(window))) if window else p))

"""Quality rules: adaptive thresholds from mergeable quantile sketches, native functions only.

Each metric of a document is a whole number, so a quantile sketch is a table of
counts by bucket with seven leading binary digits (relative error below 1/64).
Sketches of parts of the corpus merge by adding counts, in any order, to the same
result; one sketch is kept for each language, source and metric, over the rows that
pass the base rules. A document fails a metric when it lies beyond the far fence
Q3 + 6 (Q3 - Q1 + 1) of its own language and source, Q1 being the least and Q3 the
largest value of its bucket. No cutoff is fixed: the metrics
(marks, capitals, length of words) are chosen so that plain text has a spread in
each. A group of fewer than MIN_ROWS rows takes its language's fence, a language of
so few rows that of all rows. Where junk makes up so much of a group that its own
quartiles are junk, the tighter of the group's fence and its language's holds.

Defined results: null texts count as empty and fail the base rules; null language
or source form groups of their own; repeated rows are judged one by one, rows of
equal text, language and source alike; a value equal to its limit passes; texts of
any length are read whole, as one value in one task; an empty table gives an empty
result; further columns are not read by judge and kept as they are by keep_good.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import bloom
from .common import fresh, join_values, word_array, write_table

MIN_WORDS = 50
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: Metrics that the fences judge, in thousandths: marks and capitals by characters of words, characters by words.
METRICS = ("marks", "capitals", "word_len")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FENCE, MIN_ROWS = 6, 64


def base_counts(text: Column) -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = let(word_array(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), repeat_words(w).alias("repeated")))
    chars = F.length(F.translate(text, SPACES, "")).cast("long")
    symbols = (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    dups = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")
    return [words["n"].alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), dups.alias("n_dup_lines"), words["repeated"].alias("n_repeat_words")]


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """How many words lie in a three-word window that the text holds twice or more.

    Windows are compared by 64-bit hash. Sorting hashes with their places puts
    equal windows side by side; the places of repeated windows, sorted again,
    cover three words each less what they overlap.
    """
    n = F.size(words)
    at = F.sequence(F.lit(0), n - 3)
    hashes = F.transform(at, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(placed: Column) -> Column:
        same = lambda x, j: F.get(placed, j)["h"].eqNullSafe(x["h"])
        places = F.transform(F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(F.sort_array(places), start, step, lambda a: a["n"])

    def count(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(placed, covered))

    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(hashes, count))


def width(value: Column) -> Column:
    """Width of the sketch's bucket that holds a value."""
    return F.pow(F.lit(2), F.greatest(F.length(F.bin(value)) - 7, F.lit(0))).cast("long")


def bucket(value: Column) -> Column:
    """Lower edge of the sketch's bucket: the value's seven leading binary digits."""
    return value - F.pmod(value, width(value))


def sketch(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Quantile sketches of each metric by keys: keys, metric, bucket, n. Rows of two sketches merge by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in metrics]))
    return rows.select(*keys, pairs.alias("x")).groupBy(*keys, "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Coarser sketches out of finer ones."""
    return sketches.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketches: DataFrame, keys: list[str], far: int = FENCE) -> DataFrame:
    """keys, metric, fence, rows: Q3 + far * (Q3 - Q1 + 1) of each sketch. A sketch has some thousand buckets at most."""
    whole = W.partitionBy(*keys, "metric")
    ranked = sketches.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("rows", F.sum("n").over(whole))
    quart = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("rows") * q, F.col("bucket")))
    quarts = ranked.groupBy(*keys, "metric").agg(quart(1).alias("q1"), quart(3).alias("q3"), F.max("rows").alias("rows"))
    most = F.col("q3") + width(F.col("q3")) - 1
    return quarts.select(*keys, "metric", (most + far * (most - F.col("q1") + 1)).alias("fence"), "rows")


def _measured(rows: DataFrame) -> DataFrame:
    """text, and what is wanted of it: base counts, base_failed and the metrics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    held = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))).cast("long")
    rows = rows.withColumns({c: x for c, x in zip(BASE, base_counts(F.col("text")), strict=True)}).withColumn("n_marks", held(MARKS)).withColumn("n_capitals", held(CAPITALS))
    return rows.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words")).selectExpr(
        *[c for c in rows.columns if c not in ("n_marks", "n_capitals")],
        "base_failed",
        "1000 * n_marks DIV greatest(word_chars, 1) AS marks",
        "1000 * n_capitals DIV greatest(word_chars, 1) AS capitals",
        "1000 * word_chars DIV greatest(n_words, 1) AS word_len",
    )


def limits(measured: DataFrame) -> DataFrame:
    """lang, source and the limit of each metric: the tighter fence of the group and its language, each if it has rows enough."""
    fine = sketch(measured.where("NOT base_failed"), ["lang", "source"], list(METRICS))
    coarse = merge(fine, ["lang"])
    own = fences(fine, ["lang", "source"])
    wide = fences(coarse, ["lang"]).select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("fence").alias("wide"), F.col("rows").alias("wide_rows"))
    every = fences(merge(coarse, []), []).select(F.col("metric").alias("m2"), F.col("fence").alias("every"))
    both = own.join(wide, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m"))).join(every, F.col("metric") == F.col("m2"))
    wide = F.when(F.col("wide_rows") >= MIN_ROWS, F.col("wide")).otherwise(F.col("every"))
    limit = F.when(F.col("rows") >= MIN_ROWS, F.least("fence", wide)).otherwise(wide)
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, limit)).alias(f"max_{m}") for m in METRICS])


def _verdicts(measured: DataFrame) -> DataFrame:
    """measured (a written table) with the column kept. Large groups meet their limits by broadcast, so no row of theirs is shuffled."""
    own = limits(measured).withColumnRenamed("lang", "l").withColumnRenamed("source", "s")
    sizes = measured.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_rows"))
    groups = sizes.join(own, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left").drop("l", "s")
    joined = join_values(measured, write_table(groups, "limits"), ["lang", "source"], "n_rows", measured.count())
    within = F.lit(True)
    for m in METRICS:
        within = within & (F.col(m) <= F.col(f"max_{m}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(True)))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, the three metrics, kept."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    measured = write_table(_measured(rows).drop("text"), "measured")
    return _verdicts(measured).select("doc_id", *BASE, "base_failed", *METRICS, "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """docs without those that the base rules or the fences reject, all columns as they were.

    The verdict hangs on text, language and source only, so it is tied to rows
    by a digest of the three; a Bloom filter of the rejected digests lets all
    other rows pass without a shuffle.
    """
    key, = fresh(docs, "digest")
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("")) for c in (lang_col, source_col))
    digest = F.sha2(F.concat(lang, F.lit("\n"), source, F.lit("\n"), F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), digest.alias("digest"))
    measured = write_table(_measured(rows).drop("text"), "measured")
    rejected = write_table(_verdicts(measured).where("NOT kept").select("digest").distinct(), "rejected")
    return bloom.anti_join(docs.withColumn(key, digest), rejected, key).drop(key).select(*docs.columns)

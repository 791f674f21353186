"""Filter interaction audit: what each filter removes in every order of the filters.

A document's failures of the five filters are a mask of five bits, so all that any
order does to a part of the corpus follows from how many of its documents have each
of the 32 masks. Those counts, and the counts of labelled documents, are the rows of
a matrix; four fixed matrices of 32 masks by 600 columns (120 orders of five steps)
hold whole numbers, 1 where a document of the mask is kept after the step, removed
in it, removed before it although the filter would have, or failed by that filter
alone. Their products are the audit; the sums of the removed over a filter's columns
are its Shapley value (times 120).

Texts are read once. Which text is equal to one of a smaller id is found as in exact
dedup: a Bloom filter of hashes hit twice, then groups by SHA-256, of which large
ones meet their rows by broadcast. Everything after that works on counts by part and
mask, summed in each task first.

Defined results: a null text is an empty one; a null language is the part of the
empty string, with those whose language is empty; rows with a null id neither fail E
nor make others fail it, and have no labels; rows that repeat an id and a text don't
make each other fail E; of labels that repeat an id any 1 counts, other values count
as 0; texts of any length are read whole; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, textvec
from .common import join_groups, write_table

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(x) for x in permutations(FILTERS)]
MIN_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, SIGNS = 100, 80, 10, "#$%&*|"
A, B, C, D, E = (1 << i for i in range(5))
#: Parts whose products are made at once.
PARTS = 64
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def text_masks(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits A to D of each text."""
    n = len(offsets) - 1
    per = lambda where: np.diff(np.concatenate(([0], np.cumsum(where)))[offsets])
    start, end, doc = textvec.spans(~textvec.SPACE[data], offsets)
    words = np.bincount(doc, minlength=n)
    h = textvec.hashes(data, start, end)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    distinct = np.bincount(doc[first], minlength=n)
    points = per((data & 0xC0) != 0x80)
    capitals = per((data >= ord("A")) & (data <= ord("Z")))
    signs = per(np.isin(data, np.frombuffer(SIGNS.encode(), np.uint8)))
    return A * (words < MIN_WORDS) + B * (100 * distinct < DISTINCT_PERCENT * words) + C * (100 * capitals > CAPITALS_PERCENT * points) + D * (signs > 0)


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in textvec.slices(batch.column(4)):
            rest = [batch.column(k).slice(i, j - i) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(text_masks(data, offsets).astype(np.int32))], names=["doc_id", "part", "h", "sha", "mask"])


def text_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask of every row of docs, with the bit of filter E."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.xxhash64(text).alias("h"), F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    rows = write_table(rows.mapInArrow(_masked, "doc_id long, part string, h long, sha binary, mask int"), "audit-masks")
    n = rows.count()
    bits = bloom.filter_bits(n)
    rows = bloom.probe(rows, F.col("h"), bloom.build_repeated(rows.select("h"), bits), bits, "maybe").drop("h")
    alone, some = rows.where("NOT maybe").drop("maybe", "sha"), rows.where("maybe").drop("maybe")
    groups = write_table(some.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("size")), "audit-groups")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    met = join_groups(some, groups, "sha", "size", n).withColumn("mask", F.col("mask") + F.when(later, E).otherwise(0))
    return alone.unionByName(met.select("doc_id", "part", "mask"))


def histograms(failures: DataFrame, labels: DataFrame) -> DataFrame:
    """part, and by mask the documents, those labelled good and those labelled toxic: three arrays of 32 counts."""
    said = labels.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    is_one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(c)
    said = said.agg(is_one("quality"), is_one("toxic"))
    known = failures.where("doc_id IS NOT NULL").join(said, "doc_id", "left")
    nobody = failures.where("doc_id IS NULL").withColumns({"quality": F.lit(None).cast("int"), "toxic": F.lit(None).cast("int")})
    counts = known.unionByName(nobody).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad"))
    by_mask = lambda c: F.array(*[F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)) for m in range(MASKS)]).alias(c)
    return counts.groupBy("part").agg(by_mask("n"), by_mask("good"), by_mask("bad"))


def matrices() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kept, removed, redundant, unique) of 32 masks by 600 columns, and the filter of each column."""
    steps = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    bit = 1 << steps
    before = (np.cumsum(bit, axis=1) - bit).ravel()
    bit = bit.ravel()
    mask = np.arange(MASKS)[:, None]
    fails, out = (mask & bit) > 0, (mask & before) > 0
    return tuple(x.astype(np.int64) for x in (~fails & ~out, fails & ~out, fails & out, mask == bit)) + (steps.ravel(),)


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, removed, redundant, unique, which = matrices()
    own = np.eye(len(FILTERS), dtype=np.int64)[which]
    orders, steps = np.repeat(ORDERS, len(FILTERS)), np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))
    for batch in batches:
        for i in range(0, batch.num_rows, PARTS):
            some = batch.slice(i, PARTS)
            p = some.num_rows
            stacked = np.concatenate([np.array(some.column(k).to_pylist(), np.int64).reshape(p, MASKS) for k in (1, 2, 3)])
            gone = stacked @ removed  # documents, good ones, toxic ones
            all_of = stacked[:p]
            columns = [all_of @ kept, gone[:p], all_of @ redundant, all_of @ unique, gone[p : 2 * p], gone[2 * p :], (gone[:p] @ own)[:, which]]
            part = pa.array(np.repeat(np.array(some.column(0).to_pylist(), object), len(orders)), pa.string())
            rest = [pa.array(np.tile(orders, p)), pa.array(np.tile(steps, p)), *[pa.array(c.ravel()) for c in columns]]
            yield pa.RecordBatch.from_arrays([part, *rest], names=["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows part, filter_order, step with the counts of COUNTS: 600 for each part."""
    return histograms(text_failures(docs), labels).mapInArrow(_audited, RESULT)

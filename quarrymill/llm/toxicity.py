"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct unigrams, bigrams and one-word skip-grams of a text's
lower-cased words, hashed to 2**20 places; a unigram also counts by its stem, the
first four bytes, so that unseen endings of a known word are known. Training reads a bounded sample of the
labelled rows (``MAX_TOXIC`` and ``MAX_CLEAN`` documents, chosen by hash); the
per-coordinate rates and the L1 term leave few weights, which are broadcast.
Scoring reads every whole text and nothing but the text.

Defined results: null and empty texts are scored by the bias alone; a null id is
never held out; labels of one id that disagree count as toxic; repeated documents
are scored one by one, alike, and learned from as often as they are drawn; texts of
any length are read whole; with no labelled rows at all every score is 0.5; an empty
table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .common import write_table

BITS, STEM = 20, 4
MAX_TOXIC, MAX_CLEAN = 5000, 10000
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 2.0, 0.1, 4
THRESHOLD = 0.7
BIAS = 1 << BITS


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, feature) of every unigram, stem, bigram and skip-gram; they may repeat."""
    data = textvec.LOWER[data]
    start, end, doc = textvec.spans(textvec.WORDLIKE[data], offsets)
    h = textvec.hashes(data, start, end)
    stem = textvec.hashes(data, start, np.minimum(end, start + STEM))
    docs, keys = [doc, doc], [h, stem]
    for gap, step in ((1, 0xA24BAED4963EE407), (2, 0x9FB21C651E98DF25)):
        if len(h) > gap:
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            keys.append(textvec.mix64(h[:-gap][same] * np.uint64(step) + h[gap:][same]))
    return np.concatenate(docs), (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in textvec.slices(batch.column(2)):
            docs, keys = features(data, offsets)
            both = np.unique((docs << BITS) | keys)
            counts = np.bincount(both >> BITS, minlength=j - i)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array((both & (BIAS - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], names=["place", "label", "features"])


def ftrl(rows: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Weights of all places, the bias last."""
    z, n, w = np.zeros(BIAS + 1), np.zeros(BIAS + 1), np.zeros(BIAS + 1)
    for _ in range(EPOCHS):
        for label, at in rows:
            at = np.append(at, BIAS)
            zi, root = z[at], np.sqrt(n[at])
            wi = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            g = 1 / (1 + np.exp(-np.clip(wi.sum(), -35, 35))) - label
            more = np.sqrt(n[at] + g * g)
            z[at] += g - (more - root) / ALPHA * wi
            n[at] += g * g
    root = np.sqrt(n)
    np.copyto(w, np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + root) / ALPHA + L2)))
    return w


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        lists = batch.column(2)
        ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        rows += [(y, flat[a:b].astype(np.int64)) for y, a, b in zip(batch.column(1).to_pylist(), ends[:-1], ends[1:], strict=True)]
    w = ftrl(rows)
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["place", "weight"])


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights) other than zero. docs: doc_id, text; labels: doc_id, toxic, both without held-out rows.

    The sample is bounded by its parameters, so one task can order and learn it.
    """
    said = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in said.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, max_toxic / max(1, n.get(1, 0))).otherwise(max_clean / max(1, n.get(0, 0)))
    drawn = said.withColumn("place", F.xxhash64("doc_id", F.lit(5))).where(F.pmod("place", F.lit(1 << 30)) < share * (1 << 30))
    sample = docs.where("doc_id IS NOT NULL").join(F.broadcast(drawn), "doc_id").select("place", F.col("toxic").cast("long").alias("label"), "text")
    found = write_table(sample.mapInArrow(_featured, "place long, label long, features array<int>"), "toxic-sample")
    weights = found.repartition(1).sortWithinPartitions("place", "features").mapInArrow(_trained, "place long, weight double").toArrow()
    return weights.column(0).to_numpy(), weights.column(1).to_numpy()


def _scorer(places: np.ndarray, weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(BIAS + 1)
        w[places] = weights
        for batch in batches:
            for i, j, data, offsets in textvec.slices(batch.column(1)):
                docs, keys = features(data, offsets)
                used = w[keys] != 0
                both = np.unique((docs[used] << BITS) | keys[used])
                total = w[BIAS] + np.bincount(both >> BITS, weights=w[both & (BIAS - 1)], minlength=j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, score of every document."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_scorer(*model), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """Is the row kept from training? By a checksum of its id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(3)) == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted; trained on the labels that aren't held out."""
    model = train(docs.select("doc_id", "text"), labels.where(~held_out(F.col("doc_id"))).select("doc_id", "toxic"))
    out = score(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))

"""MinHash near-dedup with HyperMinHash registers.

Each text's set of word shingles gives 96 minima. A register keeps 16 bits of a
minimum: its count of leading zeros (6 bits) and the next 10 bits, the mantissa.
Four registers side by side are one band, a long; two sets that share a band are
candidates. At similarity 0.8 a pair misses all 24 bands with probability 3e-6.

Candidates pass three steps: sizes that can't reach the similarity, then the
register estimate corrected for chance collisions (minus five deviations), then
the exact test on the full sets.

Sets that are equal are one class from the start, so copies never meet in pairs.
In each bucket all classes are first tested against the least one; components of
the links found then show which buckets still join different components, and only
pairs across components are left there. Of those, sets with too many shingles of
their own are ruled out, by an exact bound, before any pair is made; the others
are compared pair by pair where a bucket is small and in array blocks of bounded
size where it is large, without a row for a pair that isn't linked. Together that finds the same components as testing every pair of every bucket.

Links are confirmed on full sets of 64-bit shingle hashes; a clash of two shingles
within one pair of texts would count as shared, which has a chance of some 1e-13.

Defined results: null or empty texts have no shingles and link with nothing; a
null id is a component of its own, null; rows that repeat an id are one node; texts of
any length are read whole, one and its set at a time; an empty table gives an empty
result; further columns are ignored by near_duplicates and kept by
drop_near_duplicates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom, graph, textvec
from .common import drop_table, fresh, join_groups, write_table

BANDS, ROWS = 24, 4
REGISTERS = BANDS * ROWS
MANTISSA = 10
#: Buckets up to SMALL rows are paired by a join, larger ones in blocks of about BLOCK rows.
SMALL, BLOCK = 24, 256
#: Pairs of one class that are confirmed together, where no more of its pairs are a larger share of all.
PART = 2048

_rng = np.random.default_rng(20240229)
_A = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, shingle), sorted and distinct: 64-bit hashes of the word shingles of each value.

    A value with fewer words gives its whole sequence as one shingle.
    """
    data = textvec.LOWER[data]
    start, end, doc = textvec.spans(~textvec.SPACE[data], offsets)
    h = textvec.hashes(data, start, end)
    n = len(h)
    counts = np.bincount(doc, minlength=len(offsets) - 1)
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if n >= words:
        at = np.flatnonzero(doc[: n - words + 1] == doc[words - 1 :])
        full = h[at].copy()
        for k in range(1, words):
            full = full * _STEP + h[at + k]
    first = np.cumsum(counts) - counts
    short = np.flatnonzero((counts > 0) & (counts < words))
    whole = np.zeros(len(short), np.uint64)
    for k in range(words - 1):
        more = counts[short] > k
        whole[more] = whole[more] * _STEP + h[first[short[more]] + k] + np.uint64(words - k)
    docs = np.concatenate((doc[at], short))
    keys = textvec.mix64(np.concatenate((full, whole)))
    order = np.lexsort((keys, docs))
    docs, keys = docs[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])
    return docs[new], keys[new]


def registers(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """HyperMinHash registers (sets x REGISTERS, 16 bits) of the runs of keys that begin at starts."""
    out = np.empty((len(starts), REGISTERS), np.uint64)
    for j in range(REGISTERS):
        out[:, j] = np.minimum.reduceat(keys * _A[j] + _B[j], starts)
    out |= np.uint64(1)
    # The bit length by halving, exactly.
    zeros = np.zeros(out.shape, np.uint64)
    rest = out.copy()
    for k in (32, 16, 8, 4, 2, 1):
        low = rest < (np.uint64(1) << np.uint64(64 - k))
        zeros[low] += np.uint64(k)
        rest[low] <<= np.uint64(k)
    mantissa = (rest << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    return ((zeros << np.uint64(MANTISSA)) | mantissa).astype(np.uint16)


def _lists(counts: np.ndarray, values: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sketches(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in textvec.slices(batch.column(1)):
                docs, keys = shingle_sets(data, offsets, words)
                counts = np.bincount(docs, minlength=j - i)
                starts = textvec.groups(docs)
                some = counts > 0
                bands = registers(keys, starts).view(np.uint64) if len(starts) else np.zeros((0, BANDS), np.uint64)
                # Two digests of the whole set: equal sets, equal digests.
                digests = np.zeros((2, j - i), np.uint64)
                if len(starts):
                    digests[0, some] = np.add.reduceat(textvec.mix64(keys), starts)
                    digests[1, some] = np.bitwise_xor.reduceat(textvec.mix64(keys + _STEP), starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts.astype(np.int64)), pa.array(digests[0].view(np.int64)), pa.array(digests[1].view(np.int64)), _lists(some * BANDS, bands.reshape(-1))],
                    names=["doc_id", "n", "d1", "d2", "bands"],
                )

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in textvec.slices(batch.column(1)):
                docs, keys = shingle_sets(data, offsets, words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), _lists(np.bincount(docs, minlength=j - i), keys)], names=["id", "shingles"])

    return run


def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `similarity`, from registers, to rows (a, b, na, nb, ra, rb).

    Unequal minima share a register by chance. For sets of n and m elements, with
    exponential densities and cells of width x / (2**MANTISSA ln 2 * 2) on average,
    that chance is 0.72 / 2**MANTISSA * n m / (n + m)**2; it is taken off.
    """
    for batch in batches:
        ra, rb = (batch.column(k).flatten().to_numpy(zero_copy_only=False).view(np.uint16).reshape(-1, REGISTERS) for k in (4, 5))
        n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (2, 3))
        chance = 0.72 / (1 << MANTISSA) * n * m / (n + m) ** 2
        share = (ra == rb).mean(axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array((share - chance) / (1 - chance))], names=["a", "b", "na", "nb", "similarity"])


def _confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets reach the similarity."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bands").alias(f"r{x}"))
    pairs = write_table(pairs, "pairs")
    # The lead of a large bucket is in all its pairs: such a class meets them by broadcast of its registers.
    partners = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners")).join(side("a"), "a")
    partners, n_pairs = write_table(partners, "partners"), pairs.count()
    near = join_groups(pairs.join(side("b"), "b"), partners, "a", "partners", n_pairs).where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    target = percent / 100
    least = target - 5 * (target * (1 - target) / REGISTERS) ** 0.5
    near = near.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(estimate, "a long, b long, na long, nb long, similarity double")
    near = write_table(near.where(F.col("similarity") >= least).select("a", "b", "na", "nb"), "near-pairs")
    drop_table(partners)
    full = sets(near)
    # The set of b travels with each pair, the set of a to each part of its pairs.
    share = max(PART, near.count() // 10_000)
    parts = near.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > share).select("a", F.ceil(F.col("c") / share).cast("int").alias("parts"))
    parts = write_table(parts, "parts")  # ten thousand at most
    dealt = near.join(F.broadcast(parts), "a", "left").withColumn("part", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    ahead = full.toDF("a", "sa").join(F.broadcast(parts), "a", "left").select("a", "sa", copies)
    both = dealt.join(full.toDF("b", "sb"), "b").join(ahead, ["a", "part"]).withColumn("common", F.size(F.array_intersect("sa", "sb")))
    links = write_table(both.where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b"), "links")
    for table in (pairs, near, full, parts):
        drop_table(table)
    return links


def _block_links(percent: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values(["block", "rep"])
        reps, parts, blocks = (rows[c].to_numpy() for c in ("rep", "component", "block"))
        sets = rows["shingles"].tolist()
        counts = np.array([len(x) for x in sets])
        ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
        starts = np.cumsum(counts) - counts
        first, held = [], np.zeros(ids.max() + 1, bool)
        parts = np.unique(parts, return_inverse=True)[1]
        against = np.arange(len(rows)) if i == j else np.flatnonzero(blocks == j)
        low, high = starts[against[0]], starts[against[-1]] + counts[against[-1]]
        there = ids[low:high]
        for a in np.flatnonzero(blocks == i):
            mine = ids[starts[a] : starts[a] + counts[a]]
            held[mine] = True
            common = np.add.reduceat(held[there], starts[against] - low, dtype=np.int64)
            held[mine] = False
            hit = against[(100 * common >= percent * (counts[a] + counts[against] - common)) & (parts[against] != parts[a])]
            # One link to each other component is enough to join it; both are one from then on, so
            # a group gives the links of a spanning forest of its components.
            for b in hit[np.unique(parts[hit], return_index=True)[1]]:
                first.append((min(reps[a], reps[b]), max(reps[a], reps[b])))
                parts[parts == parts[b]] = parts[a]
        return pd.DataFrame(first, columns=["a", "b"], dtype=np.int64)

    return run


def _linked_in_blocks(rows: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across the components of large buckets, enough in each two blocks to join all that links there join.

    A bucket is dealt into blocks of about BLOCK rows by hash, and every two
    blocks meet in one group of bounded size, where sets are compared in arrays;
    no row is made for a pair that isn't linked.
    """
    count = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), count).cast("int"))
    rows = rows.select("bucket", "rep", "component", "block", F.explode(F.sequence(F.lit(0), count - 1)).alias("k"))
    rows = rows.select("bucket", "rep", "component", "block", F.least("block", "k").alias("i"), F.greatest("block", "k").alias("j"))
    met = rows.join(full.select(F.col("id").alias("rep"), "shingles"), "rep")
    return met.groupBy("bucket", "i", "j").applyInPandas(_block_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    words: words of a shingle; percent: similarity from which two sets are linked.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = write_table(rows.mapInArrow(_sketches(words), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "sketches")
    key = ["n", "d1", "d2"]
    grouped = sketched.where("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("members"))
    grouped = write_table(grouped, "classes")
    reps = sketched.join(grouped.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"], "left_semi")
    classes = write_table(reps.select(F.col("doc_id").alias("rep"), *key, "bands").dropDuplicates(["rep", *key]), "class-sketches")

    def full_sets(ids: DataFrame) -> DataFrame:
        some = bloom.semi_join(rows, ids, "doc_id").mapInArrow(_full_sets(words), "id long, shingles array<long>")
        return write_table(some.join(ids, "id", "left_semi").dropDuplicates(["id", "shingles"]), "full-sets")

    def sets(pairs: DataFrame) -> DataFrame:
        return full_sets(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    banded = classes.select("rep", F.posexplode("bands").alias("band", "bits")).select(F.xxhash64("band", "bits").alias("bucket"), "rep")
    leads = write_table(banded.groupBy("bucket").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1"), "leads")
    entries = BANDS * classes.count()
    held = write_table(join_groups(banded, leads, "bucket", "c", entries), "buckets")
    drop_table(leads)
    stars = held.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    first = _confirmed(stars, classes, sets, percent)
    joined = write_table(graph.components(first), "components")

    # What is left: buckets, without their leads, that still hold more than one component.
    rest = held.where("rep <> lead AND c > 2").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    rest = write_table(rest.select("bucket", "rep", F.coalesce("component", "rep").alias("component")), "rest")
    drop_table(held)
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("bucket", "size")
    mixed = write_table(mixed, "mixed")
    rest = write_table(join_groups(rest, mixed, "bucket", "size", entries).drop("size").join(classes.select("rep", "n"), "rep"), "still-mixed")

    # Shingles that no other set there has can't be shared. A set with p of them has at most n - p in
    # common with any, so some similarities can't be reached whatever the partner: those sets are done.
    full = full_sets(rest.select(F.col("rep").alias("id")).distinct())
    private = full.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("rep"))
    private = private.where("c = 1").groupBy("rep").agg(F.count(F.lit(1)).alias("p"))
    rest = rest.join(private, "rep", "left").withColumn("shared", F.col("n") - F.coalesce("p", F.lit(0)))
    rest = write_table(rest, "shared")
    least = write_table(rest.groupBy("bucket").agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("size")), "least")
    rest = join_groups(rest, least, "bucket", "size", entries).where(f"100 * shared >= {percent} * (greatest(least, shared) + n - shared)")
    rest = write_table(rest.select("bucket", "rep", "component", "n", "shared"), "open")

    sizes = write_table(rest.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")), "sizes")
    rest = write_table(join_groups(rest, sizes, "bucket", "size", entries), "sized")
    left, right = (rest.where(f"size <= {SMALL}").drop("size").toDF("bucket", *[f"{c}_{x}" for c in ("rep", "component", "n", "shared")]) for x in "ab")
    most = "least(shared_a, shared_b, n_a, n_b)"
    close = f"rep_a < rep_b AND component_a <> component_b AND 100 * {most} >= {percent} * (n_a + n_b - {most})"
    across = left.join(right, "bucket").where(close).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()
    second = write_table(_confirmed(across, classes, sets, percent).unionByName(_linked_in_blocks(rest.where(f"size > {SMALL}"), full, percent)).distinct(), "links")
    if second.isEmpty():
        found = joined
    else:
        found = write_table(graph.components(first.unionByName(second)), "components")

    # Equal sets are linked too; only classes with company change a row's component.
    linked = grouped.join(found.withColumnRenamed("node", "rep"), "rep", "left").where("members > 1 OR component IS NOT NULL")
    linked = write_table(linked.select(*key, F.coalesce("component", "rep").alias("component"), "members"), "linked")
    rows = sketched.select("doc_id", *key)
    some = join_groups(rows.where("n > 0 AND doc_id IS NOT NULL"), linked, key, "members", sketched.count(), "left").select("doc_id", "n", "component")
    alone = rows.where("n = 0 OR doc_id IS NULL").select("doc_id", "n", F.lit(None).cast("long").alias("component"))
    out = some.unionByName(alone).withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that have a near copy of smaller id, all columns as they were."""
    judged = near_duplicates(docs, words, percent, id_col, text_col)
    gone = write_table(judged.where("NOT kept").select("doc_id").distinct(), "near-copies")
    key, = fresh(docs, "key")
    return bloom.anti_join(docs.withColumn(key, F.col(id_col).cast("long")), gone, key).drop(key).select(*docs.columns)

"""Approximate nearest neighbours by an inverted multi-index.

Each half of a vector is quantised by itself, with centroids learned from a bounded
sample; a pair of centroids is a cell, and every vector lies in one. A query walks
the pairs by the sum of its two distances, with a heap, until the cells it met hold
as many entries as are wanted; those entries are reranked by their exact distance.

How many are wanted is measured: PROBES vectors are compared with all rows, which is
linear work, and the least share of the rows is taken whose walk finds RECALL of
their true neighbours. On vectors with structure that is little, on random ones much.

Entries lie in shards, runs of cells of about equal size; a cell larger than a shard
is split by hash. Queries are dealt to blocks, a block meets a shard in one task, and
both are bounded in bytes. A task gives each query the k nearest of its shard, a
grouped limit merges those. The driver holds centroids and the sizes of cells, whose
number is bounded, and the probes.

Defined results: vectors that are null, zero, or hold a null, NaN or infinite
component take no part, nor do those of another length than most (ties: the longer)
or with a null id; rows that repeat an id are separate: such a query has a ranking
for each of its rows, and finds its other rows; equal distances go by the smaller id;
with fewer than k candidates all are found; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, write_table

#: Vectors that centroids are learned from (and their bytes), centroids of a half at most, rounds of learning.
SAMPLE, SAMPLE_BYTES, CENTROIDS, ROUNDS = 16_384, 1 << 26, 256, 12
#: Vectors that are compared with all rows, and the share of their neighbours that a walk has to find.
PROBES, RECALL = 128, 0.97
#: Bytes of the vectors of a shard and of a block of queries; entries that a shard has at least, where there are tasks for more.
SHARD_BYTES, SHARD_ROWS = 1 << 26, 2048
#: Queries whose distances to a shard are held at once.
ROWS = 256
RESULT = "query_id long, rank int, vec_id long, score double"
FOUND = "query_row long, query_id long, vec_id long, row long, score double"


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """row, vec_id, vector of the rows that take part, written once so that row stays what it is."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda x: x != 0))
    return write_table(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of x from those of c, up to rounding."""
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * (x @ c.T), 0)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from k of the distinct rows; fewer if there are fewer."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.random.default_rng(7).permutation(len(distinct))[:k]]
    for _ in range(ROUNDS):
        near = squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=len(c)) for d in range(x.shape[1])], 1) if x.shape[1] else np.zeros((len(c), 0))
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def walk(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[int]:
    """Cells (first centroid * number of second ones + second) by growing summed distance, until they hold `wanted` entries."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    da, db, a, b = first[a].tolist(), second[b].tolist(), a.tolist(), b.tolist()
    width, held, out = len(b), 0, []
    heap, reached = [(da[0] + db[0], 0, 0)], [0] * len(a)  # of each row of pairs, how many were met
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        cell = a[i] * width + b[j]
        if sizes[cell]:
            out.append(cell)
            held += sizes[cell]
        # A pair is next when its neighbours nearer in either half have been met.
        if j + 1 < width and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (da[i] + db[j + 1], i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (da[i + 1] + db[j], i + 1, j))
    return out


class Index:
    """Centroids of both halves, entries (row, vec_id, vector, cell) as a table, and how many each cell holds."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding"):
        written = usable(vectors, id_col, vector_col)
        common = written.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
        self.dim, self.n = (common["dim"], common["count"]) if common else (0, 0)
        rows = written.where(F.size("vector") == self.dim)
        if not self.n:
            self.entries = rows.withColumn("cell", F.lit(0))
            return
        most = max(64, min(SAMPLE, SAMPLE_BYTES // (8 * self.dim)))
        drawn = rows.where(F.pmod(F.xxhash64(F.lit(11), "row"), F.lit(1 << 30)) <= min(1.0, most / self.n) * (1 << 30))
        sample = matrix(drawn.select("row", "vector").orderBy("row").limit(2 * most).toArrow().column(1))
        k = int(min(CENTROIDS, max(2, 2 ** round(np.log2(np.sqrt(self.n) / 3)))))
        self.half = self.dim // 2
        self.first, self.second = centroids(sample[:, : self.half], k), centroids(sample[:, self.half :], k)
        self.entries = write_table(rows.mapInArrow(self._placed(), "row long, vec_id long, vector array<double>, cell int"), "entries")
        drop_table(written)
        self.sizes = np.zeros(len(self.first) * len(self.second), np.int64)
        for r in self.entries.groupBy("cell").count().collect():  # as many as there are cells
            self.sizes[r["cell"]] = r["count"]
        self.probes = sample[np.random.default_rng(3).permutation(len(sample))[:PROBES]]

    def _placed(self):
        first, second, half = self.first, self.second, self.half

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column("vector"))
                cell = squares(x[:, :half], first).argmin(1) * len(second) + squares(x[:, half:], second).argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "vec_id", "vector")] + [pa.array(cell.astype(np.int32))], names=["row", "vec_id", "vector", "cell"])

        return run

    def wanted(self, k: int, recall: float = RECALL) -> int:
        """How many entries a walk has to meet: measured with the probes against all rows."""
        probes = self.probes

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best, cells, rows = np.full((len(probes), k + 1), np.inf), np.zeros((len(probes), k + 1), np.int32), np.full((len(probes), k + 1), -1)
            for batch in batches:
                for i in range(0, batch.num_rows, 4096):
                    some = batch.slice(i, 4096)
                    d = np.concatenate((best, squares(probes, matrix(some.column(2)))), 1)
                    c, r = (np.concatenate((old, np.broadcast_to(some.column(j).to_numpy(), (len(probes), some.num_rows))), 1) for old, j in ((cells, 1), (rows, 0)))
                    at = np.argpartition(d, k, axis=1)[:, : k + 1]
                    best, cells, rows = (np.take_along_axis(x, at, 1) for x in (d, c, r))
            there = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(there)[0].astype(np.int32)), pa.array(best[there]), pa.array(cells[there]), pa.array(rows[there])], names=["probe", "d", "cell", "row"])

        found = self.entries.select("row", "cell", "vector").mapInArrow(nearest, "probe int, d double, cell int, row long")
        rank = F.row_number().over(W.partitionBy("probe").orderBy("d", "row"))
        true = found.withColumn("rank", rank).where((F.col("rank") > 1) & (F.col("rank") <= k + 1)).select("probe", "cell").collect()  # PROBES * k at most; the first is the probe itself
        if not true:
            return self.n
        one, two = squares(probes[:, : self.half], self.first), squares(probes[:, self.half :], self.second)
        upto = {}
        for p in {r["probe"] for r in true}:
            order = np.argsort((one[p][:, None] + two[p][None, :]).ravel(), kind="stable")
            upto[p] = np.zeros(len(order), np.int64)
            upto[p][order] = np.cumsum(self.sizes[order])
        need = np.sort([upto[r["probe"]][r["cell"]] for r in true])
        return int(need[min(len(need) - 1, int(np.ceil(recall * len(need))) - 1)])

    def shards(self, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """(shard, parts) of each cell: runs of cells of about `rows` entries; a larger cell has shards of its own, so many parts."""
        shard, parts = np.zeros(len(self.sizes), np.int64), np.ones(len(self.sizes), np.int64)
        now, held = 0, 0
        for cell, n in enumerate(self.sizes.tolist()):
            if n > rows:
                now += held > 0
                shard[cell], parts[cell] = now, -(-n // rows)
                now, held = now + parts[cell], 0
                continue
            if held + n > rows:
                now, held = now + 1, 0
            shard[cell] = now
            held += n
        return shard, parts


def _dealt(index: Index, shard: np.ndarray, parts: np.ndarray, wanted: int):
    """Queries (block, row, vec_id, vector) as a row for each shard that their walk meets, with its cells."""
    first, second, half, sizes = index.first, index.second, index.half, index.sizes.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                x = matrix(some.column(3))
                at, to, cells = [], [], []
                for q, (one, two) in enumerate(zip(squares(x[:, :half], first), squares(x[:, half:], second), strict=True)):
                    met = np.sort(np.array(walk(one, two, sizes, wanted), np.int64))
                    split = np.flatnonzero(np.diff(shard[met], prepend=-1))
                    for run_of in np.split(met, split[1:]):
                        for part in range(int(parts[run_of[0]])):
                            at.append(q)
                            to.append(int(shard[run_of[0]]) + part)
                            cells.append(run_of.astype(np.int32).tobytes())
                taken = [some.column(c).take(pa.array(at, pa.int64())) for c in range(4)]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(to, pa.int32()), pa.array(cells, pa.binary())], names=["block", "row", "vec_id", "vector", "shard", "cells"])

    return run


def _nearest(k: int):
    """The k nearest entries of a shard for each query of a block, by exact distance."""

    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        there = there.sort_by([("cell", "ascending"), ("vec_id", "ascending"), ("row", "ascending")])
        v, cell, ids, rows = matrix(there.column("vector")), *(there.column(c).to_numpy() for c in ("cell", "vec_id", "row"))
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        ends, names = np.append(starts[1:], len(cell)), cell[starts]
        by_row = np.argsort(rows)
        norm = (v * v).sum(1)
        out = [[], [], [], [], []]
        for i in range(0, asked.num_rows if len(v) else 0, ROWS):
            some = asked.slice(i, ROWS)
            x, own, query = matrix(some.column("vector")), some.column("row").to_numpy(), some.column("vec_id").to_numpy()
            met = [np.frombuffer(b, np.int32) for b in some.column("cells").to_pylist()]
            who = np.repeat(np.arange(len(met)), [len(m) for m in met])
            place = np.searchsorted(names, np.concatenate(met))
            here = (place < len(names)) & (names[np.minimum(place, len(names) - 1)] == np.concatenate(met))
            who, place = who[here], place[here]
            d = np.full((len(x), len(v)), np.inf)
            order = np.argsort(place, kind="stable")
            who, place = who[order], place[order]
            cuts = np.flatnonzero(np.diff(place, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(place)), strict=False):
                q, span = who[a:b], slice(starts[place[a]], ends[place[a]])
                d[q, span] = norm[span] - 2 * (x[q] @ v[span].T)
            self_at = by_row[np.minimum(np.searchsorted(rows[by_row], own), len(rows) - 1)]
            mine = rows[self_at] == own
            d[np.flatnonzero(mine), self_at[mine]] = np.inf
            # All that rounding could put among the k nearest is measured again, exactly.
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if d.shape[1] > k else np.full(len(x), np.inf)
            slack = 1e-12 * ((x * x).sum(1) + norm.max() + 1)
            for q in range(len(x)):
                near = np.flatnonzero((d[q] <= kth[q] + slack[q]) & np.isfinite(d[q]))
                score = np.sqrt(((v[near] - x[q]) ** 2).sum(1))
                best = np.lexsort((rows[near], ids[near], score))[:k]
                near, score = near[best], score[best]
                for column, values in zip(out, (np.full(len(near), own[q]), np.full(len(near), query[q]), ids[near], rows[near], score), strict=True):
                    column.append(values)
        kinds = (pa.int64(),) * 4 + (pa.float64(),)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(out, kinds, strict=True)], names=["query_row", "query_id", "vec_id", "row", "score"])

    return run


def search(index: Index, k: int, is_query=None, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the entries that are queries (a Column; all if none is given), themselves left out."""
    spark = index.entries.sparkSession
    asked = index.entries if is_query is None else index.entries.where(is_query)
    n_queries = asked.count()
    if not n_queries:
        return spark.createDataFrame([], RESULT)
    tasks = 2 * spark.sparkContext.defaultParallelism
    fit = max(1, SHARD_BYTES // (8 * index.dim + 32))
    shard, parts = index.shards(min(fit, max(SHARD_ROWS, -(-index.n // tasks))))
    blocks = -(-n_queries // fit)
    table = spark.createDataFrame([(c, int(shard[c]), int(parts[c])) for c in np.flatnonzero(index.sizes).tolist()], "cell int, first int, parts int")
    at = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    there = index.entries.join(F.broadcast(table), "cell").select(copies.alias("block"), at.alias("shard"), "cell", "row", "vec_id", "vector")  # cells are at most CENTROIDS squared
    deal = F.pmod(F.xxhash64(F.lit(5), "row"), F.lit(blocks)).cast("int").alias("block")
    walked = asked.select(deal, "row", "vec_id", "vector").mapInArrow(_dealt(index, shard, parts, max(k + 1, index.wanted(k, recall))), "block int, row long, vec_id long, vector array<double>, shard int, cells binary")
    found = walked.groupBy("block", "shard").cogroup(there.groupBy("block", "shard")).applyInArrow(_nearest(k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def neighbours_of_every(vectors: DataFrame, step: int, k: int) -> DataFrame:
    """The k nearest found of each row whose id is divisible by step, among all rows."""
    return search(Index(vectors), k, F.pmod(F.col("vec_id"), F.lit(step)) == 0)

"""Retrieval evaluation: similarity, top-k, hit, mrr, map, ndcg."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.arrays import dot

#: Bytes of the vectors of a block of queries and of a group of candidates; candidates that are scored at once.
GROUP_BYTES, RUN = 1 << 26, 2048
#: Scored pairs that a task holds before it cuts them to the best; vectors of a block of a pool, fewer aren't dealt further.
PAIRS, RUN_POOL = 1 << 19, 256
#: Pairs of a pool that a task sorts behind its vectors, on average.
PAIRS_BLOCK = 1 << 20
# The metrics of a benchmark by default.
DEFAULTS = tuple(f"{f}@{k}" for f in ("hit", "mrr", "map", "ndcg") for k in (1, 5, 10))
BUILT_IN = ("hit", "mrr", "map", "ndcg")
#: Families that a user has added: what makes the metric at k of gains by rank, gains of all positives (largest first) and k.
ADDED: dict[str, Callable[[Column, Column, int], Column]] = {}


def register_family(name: str, at_k: Callable[[Column, Column, int], Column]) -> None:
    """Add a family of metrics, then known as name@k; a name that is taken or isn't a word raises.

    at_k(gains, ideal, k) gives a double Column from two arrays of doubles: gains holds those of ranks 1 to
    k (0 for what isn't relevant, shorter where fewer are ranked), ideal the k largest of the query's positives.
    It may be made of built-in functions or call a pandas_udf.
    """
    if not re.fullmatch(r"[A-Za-z]\w*", name):
        raise ValueError(f"{name!r} can't name a family of metrics")
    if name in BUILT_IN or name in ADDED:
        raise ValueError(f"family {name!r} is taken")
    ADDED[name] = at_k


def parse_metrics(names: Iterable[str]) -> list[tuple[str, int]]:
    """family@k, each once."""
    out = list(dict.fromkeys((m[1], int(m[2])) for n in names if (m := re.fullmatch(r"(\w+)@([1-9]\d*)", n)) and (m[1] in BUILT_IN or m[1] in ADDED) or _bad(n)))
    if not out:
        raise ValueError("no metrics")
    return out


def _bad(name: str) -> bool:
    raise ValueError(f"unknown metric {name!r}")


def _best(ids: np.ndarray, vectors: np.ndarray, there: np.ndarray, others: np.ndarray, k: int, skip_self: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of query, id, score) of the k best of each query, ties by id; candidates pass in runs, the best so far with them."""
    n = len(ids)
    top, who = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
    order = np.argsort(there, kind="stable")
    there = there[order]
    for a in range(0, len(there), RUN):
        some = others[order[a : a + RUN]].astype(float).T
        for q in range(0, n, 256):
            scores = np.round(vectors[q : q + 256].astype(float) @ some, 9)
            names = np.broadcast_to(there[a : a + RUN], scores.shape)
            if skip_self:
                scores[ids[q : q + 256, None] == names] = -np.inf
            scores, names = np.hstack((top[q : q + 256], scores)), np.hstack((who[q : q + 256], names))
            # Candidates come in the order of their ids, so a stable sort settles ties.
            best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            top[q : q + 256], who[q : q + 256] = np.take_along_axis(scores, best, 1), np.take_along_axis(names, best, 1)
    q, c = np.nonzero(top > -np.inf)
    return q, who[q, c], top[q, c]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows, in the type they came in: no copy of them as Python values."""
    lists = column.combine_chunks()
    lengths = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(lengths) > 1:
        raise ValueError(f"vectors of a dataset have {lengths.tolist()} numbers")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _group_best(k: int, skip_self: bool):
    def run(asked: pa.Table, there: pa.Table) -> pa.Table:
        name, found = None, (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if asked.num_rows and there.num_rows:
            name, ids = asked.column("dataset")[0].as_py(), asked.column("id").to_numpy()
            q, c, score = _best(ids, _matrix(asked.column("vector")), there.column("id").to_numpy(), _matrix(there.column("vector")), k, skip_self)
            found = ids[q], c, score
        names = pa.array([name] * len(found[0]), pa.string())
        return pa.Table.from_arrays([names, *map(pa.array, found)], names=["dataset", "query_id", "candidate_id", "score"])

    return run


def deal(sizes: Sequence[tuple[int, int, int]], tasks: int) -> list[tuple[int, int]]:
    """Blocks of queries and groups of candidates for each dataset of (queries, candidates, bytes of a vector).

    Both are so small that their vectors take GROUP_BYTES at most. Beyond that a dataset gets as many
    groups as its share of all the work (queries times candidates times bytes) is of the tasks, but
    none of fewer than RUN candidates: small datasets stay whole, large ones are spread.
    """
    work = [max(1, q) * max(1, c) * size for q, c, size in sizes]
    out = []
    for (q, c, size), w in zip(sizes, work, strict=True):
        fit = max(1, GROUP_BYTES // (size + 16))
        blocks = max(1, -(-q // fit))
        share = -(-w * tasks // sum(work)) // blocks
        out.append((blocks, max(1, -(-c // fit), min(share, c // RUN))))
    return out


def top_k_each(queries: DataFrame, candidates: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """dataset, query_id, candidate_id, score, rank: the k best candidates of each query within its dataset, ties by id.

    queries and candidates: (dataset string, id long, vector array); a null dataset raises, null ids and vectors
    take no part. All datasets go in one plan: queries of a dataset are dealt to blocks and its candidates to
    groups, as many as `deal` says, every block meets every group of its dataset once, which gives the k best of
    that group, and a grouped limit merges those. The driver sees the sizes of each dataset, no vectors.
    """
    spark = queries.sparkSession
    named = F.coalesce(F.col("dataset"), F.raise_error(F.lit("a dataset without a name")).cast("string")).alias("dataset")
    queries, candidates = (df.toDF("dataset", "id", "vector").where("id IS NOT NULL AND vector IS NOT NULL").select(named, "id", "vector") for df in (queries, candidates))
    sizes: dict[str, list[int]] = {}
    for at, df in enumerate((queries, candidates)):
        number = 4 if df.schema["vector"].dataType.elementType.typeName() == "float" else 8
        for r in df.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).collect():  # a row for each dataset
            own = sizes.setdefault(r["dataset"], [0, 0, 1])
            own[at], own[2] = r["n"], max(own[2], number * r["d"])
    both = {name: x for name, x in sizes.items() if x[0] and x[1]}
    dealt = deal(list(both.values()), spark.sparkContext.defaultParallelism)
    shape = spark.createDataFrame([(name, *x) for name, x in zip(both, dealt, strict=True)], "dataset string, blocks int, groups int")
    pick = lambda many: F.pmod(F.xxhash64("id"), F.col(many)).cast("int")
    copies = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
    asked, there = (df.join(F.broadcast(shape), "dataset") for df in (queries, candidates))
    asked = asked.select("dataset", "id", "vector", pick("blocks").alias("block"), copies("groups").alias("part"))
    there = there.select("dataset", "id", "vector", pick("groups").alias("part"), copies("blocks").alias("block"))
    unit = ["dataset", "block", "part"]
    met = asked.groupBy(*unit).cogroup(there.groupBy(*unit))
    found = met.applyInArrow(_group_best(k, skip_self), "dataset string, query_id long, candidate_id long, score double")
    rank = F.row_number().over(W.partitionBy("dataset", "query_id").orderBy(F.desc("score"), "candidate_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k(queries: DataFrame, candidates: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """query_id, candidate_id, score, rank of the k best candidates of each query, ties by id: top_k_each of one dataset."""
    return top_k_each(_one(queries, "id", "vector"), _one(candidates, "id", "vector"), k, skip_self).drop("dataset")


def _top(q: np.ndarray, c: np.ndarray, score: np.ndarray, kind: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best pairs of each query, ordered by query; kind 0 is NaN (the largest, as Spark has it), 2 no score."""
    order = np.lexsort((c, -np.where(kind == 1, score, 0.0), kind, q))
    own = q[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k]


class _Block:
    """Vectors of some queries and candidates, and the k best pairs of each of these queries that have passed."""

    def __init__(self, k: int):
        self.k, self.came, self.ready, self.held, self.many = k, ([], []), False, [], 0

    def add(self, kind: int, rows: pa.Table) -> None:
        self.came[kind].append(rows)

    def _side(self, kind: int, id_: str) -> tuple[dict, pa.Array, np.ndarray, np.ndarray]:
        """(ids of each dataset with the places of their vectors, ids by place, numbers by dimension, lengths: -1 without a vector)."""
        rows = pa.concat_tables(self.came[kind]).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, [("dataset", "ascending"), (id_, "ascending")]))
        lists = rows.column("vector").combine_chunks()
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        flat, width = lists.flatten().to_numpy(zero_copy_only=False).astype(float), max(0, sizes.max())
        numbers = np.zeros((len(sizes), width))
        numbers[np.arange(width) < sizes[:, None]] = flat
        ids, places = rows.column(id_).combine_chunks(), {}
        names = pc.value_counts(rows.column("dataset").combine_chunks())
        at = 0
        for name, n in zip(names.field(0).to_pylist(), names.field(1).to_pylist(), strict=True):
            runs = pc.value_counts(ids[at : at + n])
            counts = runs.field(1).to_numpy()
            places[name] = runs.field(0), at + np.cumsum(counts) - counts, counts
            at += n
        return places, ids, np.ascontiguousarray(numbers.T), sizes

    def score(self, pairs: pa.Table) -> None:
        if not (self.came[0] and self.came[1]):
            return
        if not self.ready:
            self.q, self.c, self.ready = self._side(0, "query_id"), self._side(1, "candidate_id"), True
            self.least = np.full(len(self.q[1]), -np.inf)
        for name in pc.unique(pairs.column("dataset")).to_pylist():
            if name in self.q[0] and name in self.c[0]:
                self._score(name, pairs.filter(pc.equal(pairs.column("dataset"), name)))

    def _score(self, name: str, pairs: pa.Table) -> None:
        (qs, q_first, q_n), (cs, c_first, c_n) = self.q[0][name], self.c[0][name]
        q, c = (pc.fill_null(pc.index_in(pairs.column(x), value_set=y), -1).to_numpy() for x, y in (("query_id", qs), ("candidate_id", cs)))
        met = (q >= 0) & (c >= 0)
        q, c = q[met], c[met]
        for first, n, which in ((q_first, q_n, 0), (c_first, c_n, 1)):  # an id that a table repeats meets with each of its vectors
            x = (q, c)[which]
            times = n[x]
            if (times > 1).any():
                q, c, x = np.repeat(q, times), np.repeat(c, times), np.repeat(x, times)
                x = first[x] + np.arange(len(x)) - np.repeat(np.cumsum(times) - times, times)
            else:
                x = first[x]
            q, c = (x, c) if which == 0 else (q, x)
        score = np.zeros(len(q))
        for a, b in zip(self.q[2], self.c[2], strict=False):  # in the order of the dimensions, as a sum over arrays goes
            score += a[q] * b[c]
        score = np.where(np.abs(score) < 4e6, np.round(score, 9), score) + 0.0
        one = self.q[3][q]
        kind = np.where((one < 0) | (one != self.c[3][c]), 2, np.where(np.isnan(score), 0, 1))
        near = (kind != 1) | (score >= self.least[q])
        self.held.append((q[near], c[near], score[near], kind[near]))
        self.many += int(near.sum())
        if self.many > PAIRS:
            self._cut()

    def _cut(self) -> None:
        q, c, score, kind = (np.concatenate(x) for x in zip(*self.held, strict=True))
        best = _top(q, c, score, kind, self.k)
        q, c, score, kind = q[best], c[best], score[best], kind[best]
        last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == self.k - 1)
        self.least[q[last]] = np.choose(kind[last], (np.inf, score[last], -np.inf))
        self.held, self.many = [(q, c, score, kind)], len(q)

    def best(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            self._cut()
            q, c, score, kind = self.held[0]
            names = np.empty(len(self.q[1]), dtype=object)
            for name, (_, first, n) in self.q[0].items():
                names[first[0] : first[-1] + n[-1]] = name
            columns = [pa.array(names[q], pa.string()), self.q[1].take(pa.array(q)), self.c[1].take(pa.array(c)), pa.array(score, mask=kind == 2)]
            yield pa.RecordBatch.from_arrays(columns, names=["dataset", "query_id", "candidate_id", "score"])


def _pool_best(k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, _Block(k)
        for batch in batches:
            order = batch.column("order").to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(order)) + 1).tolist(), len(order)]
            for a, b in zip(starts[:-1], starts[1:], strict=True):
                if a == b:
                    continue
                unit, kind = divmod(int(order[a]), 3)
                if unit != now:
                    yield from block.best()
                    now, block = unit, _Block(k)
                rows = pa.Table.from_batches([batch.slice(a, b - a)])
                if kind < 2:
                    block.add(kind, rows.select(["dataset", ("query_id", "candidate_id")[kind], "vector"]))
                else:
                    block.score(rows)
        yield from block.best()

    return run


def pool_blocks(sides: Sequence[tuple[int, int]], pairs: int, tasks: int) -> tuple[int, int]:
    """Blocks of queries and of candidates for two sides of (vectors, bytes of a vector).

    Vectors of a block take a quarter of GROUP_BYTES at most. Beyond that there are as many blocks as keep
    all tasks busy and, together, one for each PAIRS_BLOCK pairs; the more numerous side is cut further.
    """
    asked, held = (max(1, -(-n * size // (GROUP_BYTES // 4)), min(math.isqrt(3 * tasks), n // RUN_POOL)) for n, size in sides)
    (q, _), (c, _) = sides
    need = -(-pairs // PAIRS_BLOCK)
    asked = max(asked, min(q, -(-need // max(held, math.isqrt(need * c // max(1, q))))))
    return asked, max(held, min(c, -(-need // asked)))


def score_pool_each(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, k: int, pairs: int | None = None) -> DataFrame:
    """The exhaustive mode: of qrels (dataset, query_id, candidate_id) the k best pairs of each query, ties by id.

    queries and candidates: (dataset, id, vector). They are dealt to blocks by id and pairs go to the block of both
    their ids, so that no vector travels with a pair. A task gets the vectors of a block, then its pairs as a
    stream, of which it holds the best so far; both are bounded, see pool_blocks. The driver sees three counts;
    pairs, a bound of the rows of qrels, spares the third.
    """
    spark = queries.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    queries, candidates = (df.toDF("dataset", "id", "vector").where("dataset IS NOT NULL AND id IS NOT NULL") for df in (queries, candidates))
    sides = []
    for df in (queries, candidates):
        n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(0))).first()
        sides.append((n, 8 * max(0, size) + 16))
    asked, held = pool_blocks(sides, qrels.count() if pairs is None else pairs, tasks)
    whole = lambda c: F.when(~F.exists(c, lambda x: x.isNull()), F.col(c)).cast("array<double>")
    kind = dict(qrels.dtypes)
    none = F.lit(None)
    at = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    typed = lambda df, c: df.select("dataset", F.col("id").cast(kind[c]).alias("id"), whole("vector").alias("vector"))
    one = typed(queries, "query_id").select("dataset", F.col("id").alias("query_id"), none.cast(kind["candidate_id"]).alias("candidate_id"), "vector", at("id", asked).alias("x"), every(held).alias("y"), F.lit(0).alias("kind"))
    two = typed(candidates, "candidate_id").select("dataset", none.cast(kind["query_id"]).alias("query_id"), F.col("id").alias("candidate_id"), "vector", every(asked).alias("x"), at("id", held).alias("y"), F.lit(1).alias("kind"))
    # Pairs have an empty vector: a null list costs Arrow's writer as many steps as nulls came before it in the batch.
    three = qrels.where("dataset IS NOT NULL AND query_id IS NOT NULL AND candidate_id IS NOT NULL")
    three = three.select("dataset", "query_id", "candidate_id", F.array().cast("array<double>").alias("vector"), at("query_id", asked).alias("x"), at("candidate_id", held).alias("y"), F.lit(2).alias("kind"))
    unit = F.col("x") * held + F.col("y")
    rows = one.unionByName(two).unionByName(three).select("dataset", "query_id", "candidate_id", "vector", (unit * 3 + F.col("kind")).alias("order"))
    dealt = rows.repartitionById(asked * held, F.expr("`order` DIV 3").cast("int")).sortWithinPartitions("order")
    found = dealt.mapInArrow(_pool_best(k), f"dataset string, query_id {kind['query_id']}, candidate_id {kind['candidate_id']}, score double")
    rank = F.row_number().over(W.partitionBy("dataset", "query_id").orderBy(F.desc("score"), "candidate_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def score_pool(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, k: int, pairs: int | None = None) -> DataFrame:
    """query_id, candidate_id, score, rank of the candidates that qrels (query_id, candidate_id) name for a query: score_pool_each of one dataset."""
    return score_pool_each(_one(queries, "id", "vector"), _one(candidates, "id", "vector"), _one(qrels.select("query_id", "candidate_id")), k, pairs).drop("dataset")


def _one(df: DataFrame, *names: str) -> DataFrame:
    """df as the only dataset, its columns renamed if names are given."""
    return (df.toDF(*names) if names else df).select(F.lit("").alias("dataset"), "*")


def relevance(qrels: DataFrame, candidates: DataFrame | None = None, within: Sequence[str] = ()) -> DataFrame:
    """query_id, candidate_id, gain of the positive pairs; of repeated pairs the last counts. within: columns within which ids mean something.

    Null ids are left out, null scores are 0. Arrays of unequal length raise, and
    so does a candidate that isn't among candidates (column id), if those are given.
    Only positive pairs become rows, unless ids are repeated.
    """
    key, ids = [*within, "query_id"], F.col("candidate_ids")
    same = F.size("candidate_ids") == F.size("candidate_scores")
    said = F.raise_error(F.concat(F.lit("ids and scores of unequal length for query "), F.col("query_id").cast("string"))).cast("boolean")
    rows = qrels.where(F.when(F.coalesce(same, F.col("candidate_scores").isNull()), F.lit(True)).otherwise(said))
    if candidates is not None:
        pair = [*within, "candidate_id"]
        named = rows.select(*within, F.explode("candidate_ids").alias("candidate_id")).where("candidate_id IS NOT NULL").distinct()
        lost = named.join(candidates.select(*within, F.col("id").alias("candidate_id")), pair, "left_anti")
        lost = lost.agg(F.min(F.concat_ws(" ", *[F.col(c).cast("string") for c in pair])).alias("__lost"))  # one row
        unknown = F.raise_error(F.concat(F.lit("unknown candidate "), F.col("__lost"))).cast("boolean")
        rows = rows.crossJoin(F.broadcast(lost)).where(F.when(F.col("__lost").isNull(), F.lit(True)).otherwise(unknown))
    kind = qrels.schema["candidate_ids"].dataType.elementType.typeName()
    repeated = F.lit(True) if kind in ("struct", "array", "binary") else F.size(F.array_distinct(ids)) < F.size(ids)  # those would be compared each with each
    many = (F.count(F.lit(1)).over(W.partitionBy(*key)) > 1) | repeated
    zipped = F.arrays_zip(ids.alias("id"), F.coalesce("candidate_scores", F.transform(ids, lambda x: F.lit(0.0))).alias("gain"))
    entries = F.transform(zipped, lambda x, i: F.struct(x["id"].alias("id"), F.coalesce(x["gain"], F.lit(0.0)).alias("gain"), i.alias("pos")))
    rows = rows.select(*key, "candidate_ids", "candidate_scores", many.alias("__many")).select(*key, F.explode(F.filter(entries, lambda x: x["id"].isNotNull() & (F.col("__many") | (x["gain"] > 0)))).alias("x"))
    flat = rows.select(*key, F.col("x.pos").alias("pos"), F.col("x.id").alias("candidate_id"), F.col("x.gain").alias("gain"))
    return flat.groupBy(*key, "candidate_id").agg(F.max_by("gain", "pos").alias("gain")).where("gain > 0")


def rank_by_mode_each(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """Rankings of queries by the mode of their qrels (dataset, query_id, mode, candidate_ids): sparse ones, and those without
    a mode, among all candidates of their dataset, exhaustive ones among their own; other modes raise."""
    mode = F.coalesce("mode", F.lit("sparse"))
    said = F.raise_error(F.concat(F.lit("unknown mode "), mode))
    modes = qrels.select("dataset", "query_id", F.when(mode.isin("sparse", "exhaustive"), mode).otherwise(said).alias("mode"), "candidate_ids")
    queries = queries.toDF("dataset", "id", "vector")
    pick = lambda m: queries.join(modes.where(F.col("mode") == m).select("dataset", F.col("query_id").alias("id")), ["dataset", "id"], "left_semi")
    listed = modes.where("mode = 'exhaustive'")
    own = listed.select("dataset", "query_id", F.explode(F.array_distinct("candidate_ids")).alias("candidate_id"))
    everywhere = top_k_each(pick("sparse"), candidates, k, skip_self)
    pairs = listed.agg(F.coalesce(F.sum(F.when(F.col("candidate_ids").isNotNull(), F.size("candidate_ids"))), F.lit(0))).first()[0]
    return everywhere.unionByName(score_pool_each(pick("exhaustive"), candidates, own, k, pairs))


def rank_by_mode(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """Rankings of queries by the mode of their qrels (query_id, mode, candidate_ids): rank_by_mode_each of one dataset."""
    return rank_by_mode_each(_one(queries, "id", "vector"), _one(candidates, "id", "vector"), _one(qrels), k, skip_self).drop("dataset")


def evaluate(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, metrics: Iterable[str] = DEFAULTS, skip_self: bool = False) -> DataFrame:
    """Metrics of each query of a dataset, from vectors and qrels; ranks beyond the pool add nothing."""
    return _evaluated(_one(queries, "id", "vector"), _one(candidates, "id", "vector"), _one(qrels), metrics, skip_self).drop("dataset")


def _evaluated(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, metrics: Iterable[str], skip_self: bool) -> DataFrame:
    named, within = parse_metrics(metrics), ["dataset"]
    ks = sorted({k for _, k in named})
    ranked = rank_by_mode_each(queries, candidates, qrels, max(ks), skip_self)
    per = query_metrics(ranked, relevance(qrels, candidates, within), queries.select("dataset", F.col("id").alias("query_id")), ks, [f for f, _ in named], within)
    return per.select("dataset", "query_id", *[f"{f}_{k}" for f, k in named])


def evaluate_each(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, metrics: Iterable[str] = DEFAULTS, skip_self: bool = False) -> DataFrame:
    """dataset, query_id and metrics of each query of many datasets, in one plan however many there are.

    queries, candidates: (dataset, id, vector); qrels: (dataset, query_id, mode, candidate_ids, candidate_scores). An id
    means something within its dataset only: everything below goes by both. The checks are those of one
    dataset: unknown modes, candidates that the dataset lacks and arrays of unequal length raise.
    """
    keyed = lambda df: df.toDF("dataset", "id", "vector").select("dataset", F.col("id").cast("long").alias("id"), "vector")
    judged = qrels.select("dataset", F.col("query_id").cast("long").alias("query_id"), "mode", F.col("candidate_ids").cast("array<long>").alias("candidate_ids"), "candidate_scores")
    return _evaluated(keyed(queries), keyed(candidates), judged, metrics, skip_self)


def dataset_results(per_query: DataFrame) -> DataFrame:
    """dataset, metric, value: the mean of each metric over the queries of each dataset, and n of those."""
    names = [c for c in per_query.columns if c not in ("dataset", "query_id")]
    means = per_query.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names])
    return means.select("dataset", "n", F.explode(F.create_map(*[x for c in names for x in (F.lit(c), F.col(c))])).alias("metric", "value")).select("dataset", "metric", "value", "n")


def vector_metrics(queries: DataFrame, candidates: DataFrame, relevant: DataFrame, metrics: Iterable[str] = DEFAULTS, skip_self: bool = False) -> DataFrame:
    """The same from lists of relevant ids (query_id, candidate_ids), all of gain 1; ids that aren't candidates are left out."""
    named = parse_metrics(metrics)
    ks = sorted({k for _, k in named})
    pairs = relevant.select("query_id", F.explode(F.array_distinct("candidate_ids")).alias("candidate_id"), F.lit(1.0).alias("gain"))
    pairs = pairs.join(candidates.toDF("candidate_id", "vector").select("candidate_id"), "candidate_id", "left_semi")
    per = query_metrics(top_k(queries, candidates, max(ks), skip_self), pairs, queries.toDF("query_id", "vector").select("query_id"), ks, [f for f, _ in named])
    return per.select("query_id", *[f"{f}_{k}" for f, k in named])


def label_accuracy(queries: DataFrame, classes: DataFrame, labels: DataFrame, ks: Sequence[int] = (1, 5)) -> DataFrame:
    """Of each query, whether its label (query_id, label) is among the k nearest classes (id, vector)."""
    ranked = top_k(queries, classes, max(ks)).join(labels, "query_id")
    hits = [F.max(((F.col("candidate_id") == F.col("label")) & (F.col("rank") <= k)).cast("double")).alias(f"accuracy_{k}") for k in ks]
    return ranked.groupBy("query_id").agg(*hits)


def query_metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, ks: Sequence[int], families: Iterable[str] = (), within: Sequence[str] = ()) -> DataFrame:
    """hit, mrr, map and ndcg at each k for every query, and the added families that are named; queries without positives score 0.

    within: columns within which ids mean something."""
    key = [*within, "query_id"]
    added = {f: ADDED[f] for f in families if f in ADDED}
    most = max(ks)
    totals = relevant.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("gain"), asc=False).alias("ideal"))
    # The ideal list is cut before it travels on.
    totals = totals.withColumn("ideal", F.slice("ideal", 1, most))
    marked = ranked.join(relevant, [*key, "candidate_id"], "left").withColumn("gain", F.coalesce("gain", F.lit(0.0)))
    w = W.partitionBy(*key).orderBy("rank")
    marked = marked.withColumn("hits", F.sum((F.col("gain") > 0).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    within = lambda k, x: F.when((F.col("rank") <= k) & (F.col("gain") > 0), x)
    sums = []
    for k in ks:
        sums += [F.min(within(k, F.col("rank"))).alias(f"first_{k}"), F.sum(within(k, F.col("hits") / F.col("rank"))).alias(f"ap_{k}"), F.sum(within(k, F.col("gain") / F.log2(F.col("rank") + 1.0))).alias(f"dcg_{k}")]
    if added:
        sums.append(F.array_sort(F.collect_list(F.struct("rank", "gain"))).alias("ranked"))  # as many as the largest k at most
    per = marked.groupBy(*key).agg(*sums)
    out = queries.select(*key).join(per, key, "left").join(totals, key, "left")
    columns = []
    for k in ks:
        ideal = F.aggregate(F.transform(F.slice(F.coalesce("ideal", F.array().cast("array<double>")), 1, k), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
        columns += [
            F.when(F.col(f"first_{k}").isNotNull(), 1.0).otherwise(0.0).alias(f"hit_{k}"),
            F.coalesce(1.0 / F.col(f"first_{k}"), F.lit(0.0)).alias(f"mrr_{k}"),
            F.coalesce(F.col(f"ap_{k}") / F.least(F.greatest("n", F.lit(1)), F.lit(k)), F.lit(0.0)).alias(f"map_{k}"),
            F.coalesce(F.col(f"dcg_{k}") / F.greatest(ideal, F.lit(1e-10)), F.lit(0.0)).alias(f"ndcg_{k}"),
        ]
    gains = lambda c: F.coalesce(c, F.array().cast("array<double>"))
    for f, at_k in added.items():
        columns += [at_k(F.slice(gains(F.col("ranked.gain")), 1, k), F.slice(gains(F.col("ideal")), 1, k), k).cast("double").alias(f"{f}_{k}") for k in ks]
    return out.select(*key, *columns)


def mean_metrics(per_query: DataFrame) -> DataFrame:
    """One row: the mean of each metric over all queries, and their number."""
    names = [c for c in per_query.columns if c != "query_id"]
    return per_query.agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in names])

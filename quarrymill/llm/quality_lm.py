"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text.

Trusted text is what the labels call good. Tokens are runs of word characters or
of signs, lower-cased, kept as 32-bit hashes; a bigram is two of them in a long.
Counts of all trusted text are combined in each task, then summed by key. Both
orders, bigrams and the words' continuation counts, have three discounts of their
own (for counts of one, two, more); what a context's discounts free is its
back-off weight, and what those of the words free is shared evenly by all words,
the unknown one included, so the probabilities after any context sum to one.

A token's log probability is a sum of features: its word's, its context's back-off
weight, and for a bigram that the trusted text holds what that bigram changes. The
most frequent words and bigrams (bounded heads) go to every task. All other
features, the tail, are dealt to shards by hash; a bounded filter of each shard
tells which of a text's features may be there, and only those are sent to it. There
they meet the counts in one cogroup, and partial sums by document come back. A
feature that many documents of a slice need is asked for once for all of them.
Perplexity is then compared with what trusted text of the language reaches that the
model hasn't seen: one trusted document in FOLDS is left out of it.

Where the tail has more than some ten million features the filters fill up and
more features are sent that have no count; results are the same.

Defined results: texts without a token have perplexity 0 and are kept; a perplexity
equal to its limit stays; of labels that repeat an id any 1 makes it trusted; null
language is a language of its own; a null id is never trusted; repeated rows and null
ids are judged row by row; texts of any length are read whole, a task holds one and
its tokens at a time; without trusted text every token is unknown, and without
held-out text there is no limit (null): all documents are kept; an empty table gives
an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import quality_rules, textvec
from .common import drop_table, join_values, write_buckets, write_table

HEAD_WORDS, HEAD_BIGRAMS = 1 << 18, 1 << 20
MAX_BROADCAST_IDS = 1_000_000
#: One trusted document in FOLDS is held out; limits are what REACH of those reach, by language if there are MIN_HELD_OUT.
FOLDS, REACH, MIN_HELD_OUT = 10, 0.99, 50
#: Tokens that a task holds at once, features of a shard, bits of all filters together.
HELD, SHARD_FEATURES, FILTER_BITS = 1 << 22, 1 << 20, 1 << 27
#: A feature that more documents of a slice share is asked for once.
SHARED = 256
#: Features, and sums that come back, are whole numbers of these parts.
FINE_DELTA, FINE_SUM = 1 << 11, 1 << 14
START = np.uint64(1)
LOW = np.uint64(0xFFFFFFFF)
BIGRAM, WORD, CONTEXT = 0, 1, 2
_MARK = np.array([0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, bigram) of each token: the hash of the token before it, or of the start, above its own."""
    data = textvec.LOWER[data]
    kind = np.where(textvec.SPACE[data], 0, np.where(textvec.WORDLIKE[data], 1, 2)).astype(np.int8)
    words, signs = textvec.spans(kind == 1, offsets), textvec.spans(kind == 2, offsets)
    start = np.concatenate((words[0], signs[0]))
    order = np.argsort(start, kind="stable")
    start, end, doc = start[order], np.concatenate((words[1], signs[1]))[order], np.concatenate((words[2], signs[2]))[order]
    h = textvec.hashes(data, start, end) >> np.uint64(32)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[textvec.groups(doc)] = START
    return doc, (before << np.uint64(32)) | h


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def summed() -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    for batch in batches:
        for _, _, data, offsets in textvec.slices(batch.column(0)):
            held.append(bigrams(data, offsets)[1])
            size += len(held[-1])
            if size >= HELD:
                yield summed()
                held, size = [], 0
    if size:
        yield summed()


def feature(kind: int, keys: np.ndarray) -> np.ndarray:
    """56-bit hash of the feature of a kind: a bigram, a last word or a context."""
    return textvec.mix64(keys + _MARK[kind]) >> np.uint64(8)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash."""
    return ((h >> np.uint64(24)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The two bits of a feature in its shard's filter of `size` bits, a power of two."""
    return [((textvec.mix64(h) >> np.uint64(k)) & np.uint64(size - 1)).astype(np.int64) for k in (0, 32)]


def pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes together and so on: small numbers then compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def unpack(packed: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(size, len(packed) // size).T).view(kind).ravel()


def whole(x: np.ndarray, parts: int) -> np.ndarray:
    """Numbers in whole parts, the sign in the lowest bit."""
    n = np.round(x * parts).astype(np.int64)
    return (np.abs(n) << 1 | (n < 0)).astype(np.uint64)


def real(n: np.ndarray, parts: int) -> np.ndarray:
    n = n.astype(np.int64)
    return np.where(n & 1, -1.0, 1.0) * (n >> 1) / parts


def stepped(x: np.ndarray) -> np.ndarray:
    """Features of the heads in the same parts as those of the tail (float32 holds them exactly), so that a sum doesn't hang on where a head ends."""
    return real(whole(x, FINE_DELTA), FINE_DELTA).astype(np.float32)


def _steps(h: np.ndarray) -> bytes:
    """Sorted hashes, packed as differences."""
    return pack(np.diff(h, prepend=np.zeros(1, np.uint64)))


def _places(steps: bytes) -> np.ndarray:
    return np.cumsum(unpack(steps, np.uint64), dtype=np.uint64)


def _dealt(h: np.ndarray, shards: int) -> Iterator[tuple[int, slice]]:
    """(shard, its part) of sorted hashes."""
    which = shard_of(h, shards)
    starts = textvec.groups(which)
    for a, b in zip(starts, np.append(starts[1:], len(h)), strict=False):
        yield int(which[a]), slice(a, b)


def _packed(shards: int):
    """Rows (kind, key, delta) as one row for each shard and run of HELD rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            h, delta = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(h)
            h, delta = h[order], delta[order]
            out = [(s, _steps(h[part]), pack(delta[part])) for s, part in _dealt(h, shards)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "steps", "deltas"])

        for batch in batches:
            if batch.num_rows:
                kind, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                held.append((textvec.mix64(keys + _MARK[kind]) >> np.uint64(8), whole(batch.column(2).to_numpy(), FINE_DELTA)))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield rows()
                    held = []
        if held:
            yield rows()

    return run


def _merged(table: pa.Table) -> pa.Table:
    """One row of a shard: its features in order."""
    h = np.concatenate([_places(x) for x in table.column("steps").to_pylist()])
    delta = np.concatenate([unpack(x, np.uint64) for x in table.column("deltas").to_pylist()])
    order = np.argsort(h)
    out = [[table.column("shard")[0].as_py()], [_steps(h[order])], [pack(delta[order])]]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["shard", "steps", "deltas"])


def _filters(size: int):
    """The filter of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, steps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                filt = np.zeros(size, bool)
                for at in _bits(_places(steps), size):
                    filt[at] = True
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([np.packbits(filt, bitorder="little").tobytes()])], names=["shard", "filter"])

    return run


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts of one, two and more, from how many items have a count of 1 to 4."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    return [min(max(0.05, x), i + 0.95) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]


def _discount(count: str, d: list[float]) -> str:
    return f"CASE {count} WHEN 1 THEN {d[0]}D WHEN 2 THEN {d[1]}D ELSE {d[2]}D END"


def _how_many(table: DataFrame, count: str) -> list[int]:
    """How many rows have a count of 1 to 4, how many there are, and the counts' sum."""
    row = table.agg(*[F.count(F.when(F.col(count) == i, 1)) for i in (1, 2, 3, 4)], F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0))).first()
    return list(row)


class Model:
    """The heads, which go to every task, and the table `features` of the tail: a row for each shard."""

    def __init__(self, trusted: DataFrame):
        spark = trusted.sparkSession
        written = write_table(trusted.mapInArrow(_counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("c")), "lm-bigrams")
        counts = written.selectExpr("key", "shiftrightunsigned(key, 32) AS v", "key & 4294967295 AS w", "c")
        *n, kinds, _ = _how_many(counts, "c")
        d = discounts(n)
        after = counts.groupBy("v").agg(F.sum("c").alias("all"), F.sum(F.expr(_discount("c", d))).alias("freed")).selectExpr("v", "`all`", "freed / `all` AS gamma")
        ahead = write_table(counts.groupBy("w").agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("c")), "lm-words")
        *n, size, _ = _how_many(ahead, "kinds")
        e = discounts(n)
        freed = ahead.agg(F.coalesce(F.sum(F.expr(_discount("kinds", e))), F.lit(1.0))).first()[0]
        self.unknown = float(freed / max(1, kinds) / (size + 1))
        uni = F.expr(f"(kinds - {_discount('kinds', e)}) / {max(1, kinds)} + {self.unknown}D")
        words = ahead.withColumn("uni", uni).join(after, F.col("w") == F.col("v"), "full")
        words = words.selectExpr("coalesce(w, v) AS w", f"ln(coalesce(uni, {self.unknown}D)) AS uni", "ln(coalesce(gamma, 1D)) AS gamma", "coalesce(c, 0) AS c", "`all`")
        words = write_table(words, "lm-model-words")
        drop_table(ahead)
        # Bounded heads, by count; everything rarer is the tail.
        word_cut, bigram_cut = _cut(words, HEAD_WORDS), _cut(counts, HEAD_BIGRAMS)
        head = words.where(F.col("c") >= word_cut).select("w", "uni", "gamma").orderBy("w").toArrow()
        pairs = _deltas(counts.where(F.col("c") >= bigram_cut), words, word_cut, d).toArrow()
        keys = pairs.column(0).to_numpy().view(np.uint64)
        order = np.argsort(keys)
        uni, gamma, delta = (stepped(x) for x in (head.column(1).to_numpy() - np.log(self.unknown), head.column(2).to_numpy(), pairs.column(1).to_numpy()[order]))
        heads = [head.column(0).to_numpy().view(np.uint64), uni, gamma, keys[order], delta]
        del head, pairs, keys, order, uni, gamma, delta
        rest = words.where(F.col("c") < word_cut)
        tail = _deltas(counts.where(F.col("c") < bigram_cut), words, word_cut, d).selectExpr(f"{BIGRAM} AS kind", "key", "delta")
        tail = tail.unionByName(rest.selectExpr(f"{WORD} AS kind", "w AS key", f"uni - ln({self.unknown}D) AS delta")).unionByName(rest.selectExpr(f"{CONTEXT} AS kind", "w AS key", "gamma AS delta"))
        n_tail = kinds + 2 * size
        # Some for each task, so that tasks get about as much.
        self.shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), n_tail // SHARD_FEATURES + 1)
        size = 1 << max(10, (FILTER_BITS // self.shards).bit_length() - 1)
        size = min(size, 1 << max(10, (16 * n_tail // self.shards).bit_length()))
        packed = write_table(tail.mapInArrow(_packed(self.shards), "shard int, steps binary, deltas binary"), "lm-packed")
        drop_table(written)
        drop_table(words)
        merged = packed.groupBy("shard").applyInArrow(_merged, "shard int, steps binary, deltas binary")
        self.features = write_buckets(merged, "lm-features", "shard", int(spark.conf.get("spark.sql.shuffle.partitions")))
        drop_table(packed)
        filters = np.zeros((self.shards, size // 8), np.uint8)
        for shard, filt in self.features.select("shard", "steps").mapInArrow(_filters(size), "shard int, filter binary").toLocalIterator():  # FILTER_BITS at most
            filters[shard] = np.frombuffer(filt, np.uint8)
        self.shared = spark.sparkContext.broadcast([*heads, filters])


def _deltas(counts: DataFrame, words: DataFrame, word_cut: int, d: list[float]) -> DataFrame:
    """key, delta of counts (key, v, w, c). Bigrams of two head words meet them in broadcasts, the others in joins by word."""
    head = words.where(F.col("c") >= word_cut)
    first = lambda t: t.select(F.col("w").alias("v"), "gamma", "all")
    last = lambda t: t.select("w", "uni")
    near = counts.join(F.broadcast(first(head)), "v", "left").join(F.broadcast(last(head)), "w", "left")
    rest = near.where("gamma IS NULL OR uni IS NULL").select("key", "v", "w", "c")
    both = near.where("gamma IS NOT NULL AND uni IS NOT NULL").unionByName(rest.join(first(words), "v").join(last(words), "w"))
    return both.select("key", F.expr(f"ln((c - {_discount('c', d)}) / `all` + exp(gamma + uni)) - gamma - uni").alias("delta"))


def _cut(table: DataFrame, at_most: int) -> int:
    """The least count such that no more than at_most rows have it or more."""
    rows = table.groupBy(quality_rules.bucket(F.col("c")).alias("c")).count().orderBy(F.desc("c")).collect()  # some hundred buckets
    total, cut = 0, (rows[0][0] * 2 + 1 if rows else 1)
    for c, n in rows:
        total += n
        if total > at_most:
            break
        cut = c
    return cut


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


ASKED = "slice long, shard int, steps binary, docs binary, about binary"


def _scorer(shared, shards: int, unknown: float):
    """For each slice of documents, a row about them and a row for each shard that is asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, uni, gamma, pairs, delta, filters = shared.value
        size = filters.shape[1] * 8
        number = TaskContext.get().partitionId() << 32
        unseen = np.log(unknown)
        meta: list[pa.RecordBatch] = []
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        first = tokens = 0

        def scored(data: np.ndarray, offsets: np.ndarray, about: pa.RecordBatch) -> None:
            nonlocal first, tokens
            doc, keys = bigrams(data, offsets)
            v, w = keys >> np.uint64(32), keys & LOW
            log = np.full(len(keys), unseen)
            parts = []
            for kind, key, (at, known), value in ((WORD, w, _find(words, w), uni), (CONTEXT, v, _find(words, v), gamma), (BIGRAM, keys, _find(pairs, keys), delta)):
                if len(value):
                    log += np.where(known, value[at], 0)
                h = feature(kind, key[~known])
                where = shard_of(h, shards)
                may = np.ones(len(h), bool)
                for bit in _bits(h, size):
                    may &= (filters[where, bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                parts.append((h[may], doc[~known][may]))
            asked.append((np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]) + first))
            n = about.num_rows
            logs = np.bincount(doc, weights=log, minlength=n)
            meta.append(pa.RecordBatch.from_arrays([*about.columns, pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(logs.astype(float))], names=["doc_id", "lang", "trusted", "n_tokens", "log"]))
            first += n
            tokens += len(keys)

        def rows() -> pa.RecordBatch:
            nonlocal number, first, tokens, meta, asked
            h, doc = (np.concatenate(x) for x in zip(*asked, strict=True))
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            # A feature that many need is asked for once, as if by a document of its own.
            starts = textvec.groups(h)
            n = np.diff(np.append(starts, len(h)))
            many = np.repeat(n > SHARED, n)
            users, size = doc[many], n[n > SHARED]
            once = h[starts[n > SHARED]]
            h, doc = np.concatenate((h[~many], once)), np.concatenate((doc[~many], first + np.arange(len(once))))
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order].astype(np.uint32)
            out = [(s, _steps(h[part]), pack(doc[part]), None) for s, part in _dealt(h, shards)]
            sink = pa.BufferOutputStream()
            table = pa.Table.from_batches(meta)
            table = table.replace_schema_metadata({b"users": pack(users.astype(np.uint32)), b"sizes": pack(size.astype(np.uint32))})
            with pa.ipc.new_stream(sink, table.schema) as stream:
                stream.write_table(table)
            out.append((number % shards, None, None, sink.getvalue().to_pybytes()))
            got = pa.RecordBatch.from_arrays([pa.array([number] * len(out)), *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)]], names=["slice", "shard", "steps", "docs", "about"])
            number, first, tokens, meta, asked = number + 1, 0, 0, [], []
            return got

        for batch in batches:
            for i, j, data, offsets in textvec.slices(batch.column(3)):
                scored(data, offsets, pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in (0, 1, 2)], names=["doc_id", "lang", "trusted"]))
                if tokens >= HELD:
                    yield rows()
        if meta:
            yield rows()

    return run


def _answered(asked: pa.Table, features: pa.Table) -> pa.Table:
    """What a shard's features add to each document that asked, by slice; rows about documents go through."""
    h, delta = np.zeros(0, np.uint64), np.zeros(0)
    if features.num_rows:
        h, delta = _places(features.column("steps")[0].as_py()), real(unpack(features.column("deltas")[0].as_py(), np.uint64), FINE_DELTA)
    out = []
    for number, steps, docs, about in zip(*(asked.column(c).to_pylist() for c in ("slice", "steps", "docs", "about")), strict=True):
        if about is not None:
            out.append((number, None, None, about))
            continue
        at, known = _find(h, _places(steps))
        who, where = np.unique(unpack(docs, np.uint32)[known], return_inverse=True)
        if len(who):
            out.append((number, _steps(who.astype(np.uint64)), pack(whole(np.bincount(where, weights=delta[at[known]]), FINE_SUM)), None))
    columns = zip(*out, strict=True) if out else ([],) * 4
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["slice", "docs", "sums", "about"])


def _summed(table: pa.Table) -> pa.Table:
    """The documents of a slice with all parts of their log probability."""
    about = next(x for x in table.column("about").to_pylist() if x is not None)
    docs = pa.ipc.open_stream(about).read_all()
    users, sizes = (unpack(docs.schema.metadata[k], np.uint32).astype(np.int64) for k in (b"users", b"sizes"))
    total = np.zeros(docs.num_rows + len(sizes))
    for who, sums in zip(table.column("docs").to_pylist(), table.column("sums").to_pylist(), strict=True):
        if who is not None:
            total[_places(who).astype(np.int64)] += real(unpack(sums, np.uint64), FINE_SUM)
    own = total[: docs.num_rows] + np.bincount(users, weights=np.repeat(total[docs.num_rows :], sizes), minlength=docs.num_rows)
    log = docs.column("log").to_numpy() + own
    return docs.replace_schema_metadata(None).set_column(4, "log", pa.array(log))


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """docs (doc_id, lang, trusted, text) with n_tokens and log_perplexity (thousandths) in place of text."""
    asked = docs.select("doc_id", "lang", "trusted", "text").mapInArrow(_scorer(model.shared, model.shards, model.unknown), ASKED)
    met = asked.groupBy("shard").cogroup(model.features.groupBy("shard"))
    answers = write_table(met.applyInArrow(_answered, "slice long, docs binary, sums binary, about binary"), "lm-answers")
    out = answers.groupBy("slice").applyInArrow(_summed, "doc_id long, lang string, trusted boolean, n_tokens long, log double")
    bits = F.when(F.col("n_tokens") > 0, -F.col("log") / F.col("n_tokens")).otherwise(0.0)
    out = write_table(out.select("doc_id", "lang", "trusted", "n_tokens", F.greatest(F.lit(0), F.round(1000 * bits)).cast("long").alias("log_perplexity")), "lm-perplexity")
    drop_table(answers)
    return out


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, log_perplexity, limit, kept.

    One trusted document in FOLDS, by a checksum of its id, is held out: the model
    doesn't see it. A document stays if its log perplexity is at most what REACH of
    the held-out documents of its language reach, or within their upper fence (the
    upper quartile and one and a half times the quartiles' distance), which few
    documents tell better; a language with fewer than MIN_HELD_OUT of them takes the
    limit of all languages together. Where all together are fewer, that limit lies as far
    beyond the highest of them as the lowest lies below it.
    """
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    if good.count() <= MAX_BROADCAST_IDS:
        good = F.broadcast(good)
    marked = docs.select(F.col("doc_id").cast("long"), F.col("lang"), F.col("text").cast("string"))
    marked = marked.join(good.withColumn("good", F.lit(True)), "doc_id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    aside = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0
    model = Model(marked.where(F.col("good") & ~aside).select("text"))
    scored = perplexities(marked.withColumn("trusted", F.col("good") & aside).drop("good"), model)
    drop_table(model.features)
    model.shared.destroy()

    at = F.percentile_approx("log_perplexity", [0.25, 0.75, REACH], 10000)
    metric = F.greatest(at[2], at[1] + F.floor((at[1] - at[0]) * 1.5))
    unseen = scored.where("trusted AND n_tokens > 0")
    own = unseen.groupBy(F.col("lang").alias("l")).agg(metric.alias("own"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_HELD_OUT).drop("n")
    low, high = F.min("log_perplexity"), F.max("log_perplexity")
    least = unseen.agg(F.when(F.count(F.lit(1)) < MIN_HELD_OUT, 2 * high - low).otherwise(metric).alias("any"))  # one row
    groups = scored.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows")).join(own, F.col("lang").eqNullSafe(F.col("l")), "left").join(F.broadcast(least))
    groups = write_table(groups.select("lang", "n_rows", F.coalesce("own", "any").alias("limit")), "lm-limits")
    out = join_values(scored, groups, ["lang"], "n_rows", scored.count())
    return out.select("doc_id", "n_tokens", "log_perplexity", "limit", F.coalesce((F.col("log_perplexity") <= F.col("limit")) | (F.col("n_tokens") == 0), F.lit(True)).alias("kept"))

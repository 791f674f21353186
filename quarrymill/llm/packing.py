"""Packing: order-preserving dynamic programming over cut points.

Documents, each followed by an end token, form one stream in the order of their
rows. Windows of at most 1024 tokens are cut at document or sentence ends, or
every 16 tokens inside longer sentences. A window costs its padding plus the
penalty of its cut; the cheapest cuts come from

    cost(k) = penalty(k) + size - p(k) + min(cost(i) + p(i) : p(k) - p(i) <= size)

whose minimum over a moving range is held by a monotone queue, so the work is
linear. Every Spark partition packs its own rows; its stream is cut into
stretches of about half a million tokens, so memory is bounded and only the last
window of a stretch can't choose.

Texts are tokenized by distinct chunks: a run of ASCII white space always begins
a new piece of the tokenizer, so equal chunks between such runs have equal ids.

Defined results: a null or empty text is its end token alone; rows that repeat
an id, or have none, are packed like any other; an empty table packs nothing.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec

SIZE = 1024
STRETCH = 1 << 19
SENTENCE_PENALTY, HARD_PENALTY, HARD_STEP = 3, 10, 16
CACHED, JOINED = 1 << 20, 500
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_tokenizers: dict[str, Tokens] = {}


class Tokens:
    """Ids of texts, by a cache of the chunks met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        # Every character of a byte-level token stands for one byte.
        self.bytes = np.array([len(self.tokenizer.id_to_token(i) or " ") for i in range(size)])
        self.ends = np.array([(self.tokenizer.id_to_token(i) or " ")[-1] in ".!?Ċ" for i in range(size)])
        self._clear()

    def _clear(self) -> None:
        self.keys, self.first, self.count, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.int32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, keys: np.ndarray, chunks: list[bytes], joins: np.ndarray) -> None:
        """Ids of new chunks. Those that join (white space first and none last) are encoded many to a
        text, whose tokens' byte lengths tell where each chunk ends."""
        flat, counts = [], np.zeros(len(chunks), np.int64)
        many = np.flatnonzero(joins)
        runs = [many[k : k + JOINED] for k in range(0, len(many), JOINED)]
        for run, ids in zip(runs, self._ids([b"".join([chunks[k] for k in run]).decode("utf-8") for run in runs]), strict=True):
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(chunks[k]) for k in run])) + 1
            counts[run] = np.diff(ends, prepend=0)
            flat.append(ids)
        alone = np.flatnonzero(~joins)
        for k, ids in zip(alone, self._ids([chunks[k].decode("utf-8") for k in alone]), strict=True):
            counts[k] = len(ids)
            flat.append(ids)
        order = np.concatenate((many, alone))
        keys, counts = keys[order], counts[order]
        first = len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate((self.flat, *flat))
        keys, first, counts = np.concatenate((self.keys, keys)), np.concatenate((self.first, first)), np.concatenate((self.count, counts))
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = keys[order], first[order], counts[order]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each value), an end token 0 after each value."""
        n = len(data)
        starts, wide = textvec.SPACE[data], _wide_space_ends(data)
        if n:
            starts[1:] &= ~textvec.SPACE[data[:-1]]
            starts[1:] &= ~((data[:-1] >= 0x80) & wide[:-1])
            begins = offsets[:-1][offsets[:-1] < offsets[1:]]
            starts[begins] = True
        start = np.flatnonzero(starts)
        end = np.append(start[1:], n)
        doc = np.searchsorted(offsets, start, "right") - 1
        h, at, back = np.unique(textvec.hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) > CACHED:
            self._clear()
        place = np.searchsorted(self.keys, h)
        new = np.ones(len(h), bool)
        inside = place < len(self.keys)
        new[inside] = self.keys[place[inside]] != h[inside]
        if new.any():
            raw = data.tobytes()
            fresh, last = at[new], end[at[new]] - 1
            joins = textvec.SPACE[data[start[fresh]]] & ~textvec.SPACE[data[last]] & ~((data[last] >= 0x80) & wide[last])
            self._add(h[new], [raw[start[k] : end[k]] for k in fresh], joins)
            place = np.searchsorted(self.keys, h)
        first, count = self.first[place][back], self.count[place][back]
        per_doc = np.bincount(doc, weights=count, minlength=len(offsets) - 1).astype(np.int64)
        before = np.cumsum(count) - count
        ids = self.flat[np.repeat(first - before, count) + np.arange(int(count.sum()))] if len(count) else np.zeros(0, np.int32)
        return np.insert(ids, np.cumsum(per_doc), 0).astype(np.uint32), per_doc + 1


def _wide_space_ends(data: np.ndarray) -> np.ndarray:
    """Where a character ends that may be white space beyond ASCII (at least there)."""
    one = np.zeros(len(data), bool)
    one[1:] = data[:-1] == 0xC2
    one[2:] |= (data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)
    return one


def cut(points: np.ndarray, penalties: np.ndarray, size: int = SIZE) -> list[int]:
    """Ends of the cheapest windows. points: ascending cut points, none more than `size` from the last; the stream starts at 0."""
    p, pen = [0, *points.tolist()], [0, *penalties.tolist()]
    cost, back = [0] * len(p), [0] * len(p)
    queue = deque([(0, 0, 0)])  # (cost + point, point, index), rising
    for k in range(1, len(p)):
        at = p[k]
        low = at - size
        while queue[0][1] < low:
            queue.popleft()
        best = queue[0]
        cost[k] = here = best[0] + pen[k] + size - at
        back[k] = best[2]
        here += at
        while queue and queue[-1][0] >= here:
            queue.pop()
        queue.append((here, at, k))
    ends, k = [], len(p) - 1
    while k:
        ends.append(p[k])
        k = back[k]
    return ends[::-1]


def cut_points(ids: np.ndarray, doc_ends: np.ndarray, sentence_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut points of a stream with their penalties."""
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[1:][sentence_end[ids]] = SENTENCE_PENALTY
    penalty[doc_ends] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(np.concatenate(([0], at)))
    wide = gaps > HARD_STEP
    if wide.any():
        steps = (gaps[wide] - 1) // HARD_STEP
        begins = at[wide] - gaps[wide]
        nth = np.arange(int(steps.sum())) - np.repeat(np.cumsum(steps) - steps, steps) + 1
        penalty[np.repeat(begins, steps) + nth * HARD_STEP] = HARD_PENALTY
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def _pieces(ids: np.ndarray, counts: np.ndarray, names: pa.Array, sentence_end: np.ndarray, first_sequence: int) -> tuple[pa.RecordBatch, int]:
    doc_ends = np.cumsum(counts)
    ends = np.array(cut(*cut_points(ids, doc_ends, sentence_end)), np.int64)
    begins = np.concatenate(([0], ends[:-1]))
    doc_begins = doc_ends - counts
    at = np.union1d(begins, doc_begins)
    stop = np.append(at[1:], len(ids))
    doc, window = np.searchsorted(doc_begins, at, "right") - 1, np.searchsorted(begins, at, "right") - 1
    raw = memoryview(ids.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), stop.tolist(), strict=True)]
    columns = [names.take(pa.array(doc)), at - doc_begins[doc], stop - at, np.array(crc, np.int64), counts[doc], first_sequence + window, at - begins[window]]
    return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names=[x.split()[0] for x in SCHEMA.split(", ")]), len(ends)


def _packer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = _tokenizers.get(path) or _tokenizers.setdefault(path, Tokens(path))
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for i, j, data, offsets in textvec.slices(batch.column(1)):
                ids, counts = tokens.encode(data, offsets)
                held.append((ids, counts, batch.column(0).slice(i, j - i)))
                size += len(ids)
                if size >= STRETCH:
                    out, n = _pieces(*_joined(held), tokens.ends, sequence)
                    sequence += n
                    held, size = [], 0
                    yield out
        if held:
            yield _pieces(*_joined(held), tokens.ends, sequence)[0]

    return run


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    return np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]), pa.concat_arrays([x[2] for x in held])


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    tokenizer_path: a byte-level BPE file of the tokenizers library, readable on every executor.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(tokenizer_path), SCHEMA)

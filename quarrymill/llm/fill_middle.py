"""Fill-in-middle: texts cut in prefix, middle and suffix at unit borders, and put in another order.

A unit is a word with the white space before it, or white space that ends the text.
One Aho-Corasick automaton reads each text once and reports events only: the ASCII
characters that change the class (white space) and the three sentinels. A gap
between two events holds a word, whatever its length; so the gaps give the number of
units by arithmetic, and the k-th gap's end is where unit k ends. No other
character is looked at again.

The cut and the form hang on a digest of seed and id alone, so a task that is run
again gives the same rows.

Defined results: a null text is an empty one; empty texts and texts that hold a
sentinel stay plain; a null id is digested as no digits; rows that repeat an id are
cut by the same numbers, each in its own text; texts of any length are read whole,
one at a time; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, KEPT_PERCENT, SPM_PERCENT = 42, 50, 80
#: Numbers (two of an event) that are held at once while a text is scanned; characters of a batch of results.
EVENTS, HELD = 1 << 20, 1 << 22
_CLASS, _SENTINEL = 0, 1
RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for c in SPACES:
        out.add_word(c, _CLASS)
    for c in (PREFIX, SUFFIX, MIDDLE):
        out.add_word(c, _SENTINEL)
    out.make_automaton()
    return out


def unit_ends(text: str, automaton: ahocorasick.Automaton) -> tuple[np.ndarray, bool]:
    """Where each unit ends, in code points, and whether the text holds a sentinel."""
    found, held, last = [], False, -1
    events = chain.from_iterable(automaton.iter(text))
    while len(hits := np.fromiter(islice(events, EVENTS), np.int64)):
        place, kind = hits[::2], hits[1::2]
        held |= bool(kind.any())
        place = place[kind == _CLASS]
        if len(place):
            found.append(place[np.diff(place, prepend=last) > 1])
            last = int(place[-1])
    if text:  # the last word, or the white space after it
        found.append(np.array([len(text)]))
    return np.concatenate(found) if found else np.zeros(0, np.int64), held


def _numbers(seed: int, doc_id: int | None) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def transform(text: str, doc_id: int | None, automaton: ahocorasick.Automaton, seed: int, kept_percent: int, spm_percent: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output)."""
    ends, held = unit_ends(text, automaton)
    n = len(ends)
    h = _numbers(seed, doc_id)
    if not n or held or h[2] % 100 >= kept_percent:
        return n, "plain", None, None, text
    a, b = (int(ends[k - 1]) if k else 0 for k in sorted(x % (n + 1) for x in h[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transformed(seed: int, kept_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, rows, size = _automaton(), [], 0
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        names = [x.split()[0] for x in RESULT.split(", ")]

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                rows.append((doc_id, *transform(text, doc_id, automaton, seed, kept_percent, spm_percent)))
                size += len(text)
                if size >= HELD:
                    yield packed()
                    rows, size = [], 0
        if rows:
            yield packed()

    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, kept_percent: int = KEPT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row per document: doc_id, n (units), form, prefix_chars, middle_chars, output.

    About kept_percent of the documents are cut, spm_percent of them with the suffix first.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_transformed(seed, kept_percent, spm_percent), RESULT)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: the parts between its sentinels, in their first order."""
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda *ks: F.concat(*[F.get(parts, F.lit(k)) for k in ks])
    return F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle with digests of the output, and of the text restored from it, in place of the output."""
    hashed = lambda x: F.sha2(x, 256)
    out = fill_in_middle(docs)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", hashed(F.col("output")).alias("output_sha256"), hashed(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))

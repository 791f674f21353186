"""Search for many patterns at once: one automaton finds what could match, the patterns confirm it.

Every pattern with a literal part of three characters or more is looked for by that
part: an Aho-Corasick automaton of all parts reads a text once, however many there are,
and names the lines where a pattern may match. Patterns without such a part are tried on
every line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from re import _constants, _parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST = 3
FOUND = "path string, line long, pattern string"

# What a release must not have.
FORBIDDEN_NAMES = (".env", "checkpoint", "checkpoints", "logs", "wandb", ".pytest_cache", ".ruff_cache", "__pycache__")
FORBIDDEN_SUFFIXES = (".ckpt", ".pt", ".pth", ".bin", ".safetensors", ".pyc")
SKIPPED_FOLDERS = (".git", ".venv", "venv", "__pycache__", ".pytest_cache", ".ruff_cache", ".mypy_cache", "data", "datasets", "outputs", "runs", "tmp")


def folded(text: str) -> str:
    """Lower case, with the two letters that a pattern without case takes for an ASCII one."""
    return text.lower().replace("ſ", "s").replace("ı", "i")


def literal_of(pattern: str) -> str:
    """The longest run of characters that every match must hold, folded; empty if there is none that is long enough."""
    runs, now = [], ""
    for op, value in _parser.parse(pattern, re.IGNORECASE):
        if op is _constants.LITERAL and chr(value).isascii():
            now += chr(value)
        else:
            runs.append(now)
            now = ""
            if op is _constants.SUBPATTERN and not value[1] and not value[2]:  # a plain group: its own runs count
                inner = value[3]
                runs.append("".join(chr(v) for o, v in inner if o is _constants.LITERAL) if all(o is _constants.LITERAL for o, _ in inner) else "")
    best = max([*runs, now], key=len)
    return folded(best) if len(best) >= LEAST and best.isascii() else ""


def _scanner(patterns: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
        automaton, always, holders = ahocorasick.Automaton(), [], {}
        for k, p in enumerate(patterns):
            part = literal_of(p)
            if part:
                holders.setdefault(part, []).append(k)
            else:
                always.append(k)
        for part, ks in holders.items():
            automaton.add_word(part, (len(part), ks))
        if holders:
            automaton.make_automaton()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                lines = text.splitlines()
                maybe = {(n, k) for n in range(len(lines)) for k in always}
                if holders:
                    line, end = -1, 0
                    low = folded(text).splitlines(keepends=True)
                    for at, (size, ks) in automaton.iter("".join(low)):
                        while at >= end:
                            line += 1
                            end += len(low[line])
                        if at - size + 1 >= end - len(low[line]):  # a part lies within one line
                            maybe.update((line, k) for k in ks)
                for n, k in sorted(maybe):
                    if compiled[k].search(lines[n]):
                        for column, value in zip(out, (path, n + 1, patterns[k]), strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["path", "line", "pattern"])

    return run


def find_patterns(files: DataFrame, patterns: Sequence[str], path: str = "path", text: str = "text") -> DataFrame:
    """path, line (from 1), pattern of each line that a pattern matches somewhere, without regard to case; null texts are empty."""
    for p in patterns:
        re.compile(p)
    return files.select(F.col(path).cast("string"), F.col(text).cast("string")).mapInArrow(_scanner(list(dict.fromkeys(patterns))), FOUND)


def release_check(files: DataFrame, patterns: Sequence[str], path: str = "path", content: str = "content", skipped: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """path, line, pattern: files with a forbidden name or suffix (line 0), else lines of UTF-8 files that a pattern matches.

    path is relative; files below a skipped folder don't count.
    """
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    rows = files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, skipped))))
    suffix = F.regexp_extract(name, r".(\.[^.]*)$", 1)
    wrong: Column = F.when(name.isin(*FORBIDDEN_NAMES), "forbidden name").when(suffix.isin(*FORBIDDEN_SUFFIXES), "forbidden suffix")
    named = rows.withColumn("__wrong", wrong)
    readable = named.where("__wrong IS NULL").withColumn("__text", F.try_validate_utf8(F.col(content).cast("string")))
    found = find_patterns(readable, patterns, path, "__text")
    return named.where("__wrong IS NOT NULL").select(F.col(path).cast("string").alias("path"), F.lit(0).cast("long").alias("line"), F.col("__wrong").alias("pattern")).unionByName(found)

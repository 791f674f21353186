"""Leak exclusion: anti joins of training rows against evaluation keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import match_key


def _keys(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys as text, null as empty, so that missing values match each other."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__k{i}") for i, c in enumerate(columns)])


def _match(df: DataFrame, keys: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    return df.join(_keys(keys, keys.columns).distinct(), [F.coalesce(F.col(c).cast("string"), F.lit("")) == F.col(f"__k{i}") for i, c in enumerate(columns)], how)


def exclude(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are no row of keys (same order of columns)."""
    return _match(df, keys, columns, "left_anti")


def excluded(df: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows that exclude() removes, for the audit."""
    return _match(df, keys, columns, "left_semi")


def exclude_either(df: DataFrame, *rules: tuple[DataFrame, str]) -> DataFrame:
    """Rows that match no rule (keys, column): one anti join after another."""
    for keys, column in rules:
        df = exclude(df, keys, column)
    return df


def exclude_any_element(df: DataFrame, keys: DataFrame, row_id: str, array: str) -> DataFrame:
    """Rows none of whose array elements is, as a match key, among the keys."""
    elements = df.select(row_id, F.explode(array).alias("e")).select(row_id, match_key(F.col("e")).alias("key"))
    wanted = keys.select(match_key(F.col(keys.columns[0])).alias("key")).distinct()
    hit = elements.join(wanted, "key", "left_semi").select(row_id).distinct()
    return df.join(hit, row_id, "left_anti")


def require_all(required: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """found restricted to the required keys; required keys without a row raise."""
    gone = required.select(key).distinct().join(found, key, "left_anti").limit(10).collect()
    if gone:
        raise ValueError(f"required rows not found: {gone}")
    return found.join(required.select(key).distinct(), key, "left_semi")


def overlap_keys(qrels: DataFrame, queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """(question, answer) match keys of all positive pairs."""
    pairs = qrels.select("query_id", F.explode(F.arrays_zip("candidate_ids", "candidate_scores")).alias("x")).where("x.candidate_scores > 0")
    pairs = pairs.select("query_id", F.col("x.candidate_ids").alias("candidate_id"))
    joined = pairs.join(queries.select(F.col("id").alias("query_id"), F.col("text").alias("q")), "query_id").join(candidates.select(F.col("id").alias("candidate_id"), F.col("text").alias("a")), "candidate_id")
    return joined.select(match_key(F.col("q")).alias("question"), match_key(F.col("a")).alias("answer")).distinct()


def _normalized(df: DataFrame, on: tuple[str, ...]) -> DataFrame:
    return df.withColumns({f"__norm{i}": match_key(F.col(c)) for i, c in enumerate(on)})


def exclude_normalized(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """Rows whose columns, as normalized text, are none of the keys."""
    marks = [f"__norm{i}" for i in range(len(on))]
    return exclude(_normalized(df, on), _normalized(keys, on).select(*marks), *marks).select(*df.columns)


def excluded_normalized(df: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    marks = [f"__norm{i}" for i in range(len(on))]
    return excluded(_normalized(df, on), _normalized(keys, on).select(*marks), *marks).select(*df.columns)


def exclude_any_pair(df: DataFrame, keys: DataFrame, key: str, question: str, answers: str) -> DataFrame:
    """Rows none of whose (question, answer) pairs, as normalized text, is one of keys (two columns). key names a row."""
    pairs = df.select(key, match_key(F.col(question)).alias("__q"), F.explode(answers).alias("__x")).select(key, "__q", match_key(F.col("__x")).alias("__a"))
    names = keys.toDF("__q", "__a").select(match_key(F.col("__q")).alias("__q"), match_key(F.col("__a")).alias("__a")).distinct()
    hit = pairs.join(names, ["__q", "__a"], "left_semi").select(key).distinct()
    return df.join(hit, key, "left_anti")


def path_keys(paths: Sequence[DataFrame], pattern: str) -> DataFrame:
    """Distinct keys that the pattern's first group finds in paths, each table of one column; paths without a match give none."""
    found = None
    for df in paths:
        keys = df.toDF("__path").select(F.regexp_extract("__path", pattern, 1).alias("key")).where("key <> ''")
        found = keys if found is None else found.unionByName(keys)
    return found.distinct()

"""Lookup joins: declared N:1 enrichment of primary rows."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, declared: Sequence[str]) -> DataFrame:
    """df with the declared columns, in order; all that are missing are named at once."""
    missing = [c for c in declared if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*dict.fromkeys(declared))


def flatten(df: DataFrame, fields: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """The columns to keep, then nested fields as flat columns: {target: path}; a target that a kept column has already raises."""
    clash = sorted({n.lower() for n in fields} & {n.lower() for n in keep})
    if clash:
        raise ValueError(f"column names collide: {clash}")
    return df.select(*keep, *[F.col(path).alias(name) for name, path in fields.items()])


def sql_literal(value: object) -> str:
    """A key as it is written in a SQL condition; what can't be compared safely (null, non-finite floats, other types) raises."""
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return f"{value}L" if not -(1 << 31) <= value < 1 << 31 else str(value)
    if isinstance(value, float) and math.isfinite(value):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"a key of type {type(value).__name__} can't be part of a condition: {value!r}")


def key_condition(column: str, keys: Sequence[object]) -> str:
    """column = key, or column IN (keys), for a scan's condition; each key once, no key at all raises."""
    listed = list(dict.fromkeys(sql_literal(k) for k in keys))
    if not listed:
        raise ValueError("a condition needs a key")
    name = "`" + column.replace("`", "``") + "`"
    return f"{name} = {listed[0]}" if len(listed) == 1 else f"{name} IN ({', '.join(listed)})"


def merge_metadata(dataset: Column, sample: Column) -> Column:
    """Maps merged; the sample's keys win."""
    kept = F.map_filter(dataset, lambda k, v: ~F.array_contains(F.map_keys(sample), k))
    return F.map_concat(kept, sample)


def first_duplicates(df: DataFrame, key: Sequence[str], limit: int = 10) -> list:
    return df.groupBy(*key).count().where("count > 1").limit(limit).collect()


def unique(df: DataFrame, *key: str) -> DataFrame:
    """df; a key that occurs twice raises when the rows are read, in the same grouping that joins need them by."""
    rest = [c for c in df.columns if c not in key]
    said = F.raise_error(F.concat(F.lit(f"duplicate keys in {', '.join(key)}: "), F.to_json(F.struct(*key))))
    one = df.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rest) if rest else F.lit(True)).alias("__row"))
    checked = one.where(F.when(F.col("__n") == 1, F.lit(True)).otherwise(said.cast("boolean")))
    return checked.select(*key, *([f"__row.{c}" for c in rest])).select(*df.columns)


@dataclass(frozen=True)
class Lookup:
    """A side table that extends rows by `key`: Column or name on the left, name on the right.

    missing: error (every key must match) or skip (blank and unmatched keys stay
    without values). rename: side columns to take, under which names.
    """

    side: DataFrame
    key: str | Column
    side_key: str
    rename: Mapping[str, str] = field(default_factory=dict)
    missing: str = "error"


def lookup(df: DataFrame, spec: Lookup) -> DataFrame:
    """df, each row extended by its one match; rows stay as many as they were."""
    names = dict(spec.rename) or {c: c for c in spec.side.columns if c != spec.side_key}
    clash = set(names.values()) & set(df.columns)
    if clash or len(set(names.values())) < len(names):
        raise ValueError(f"column names collide: {sorted(clash) or list(names.values())}")
    columns = [F.col(spec.side_key).alias("__side_key"), *[F.col(c).alias(n) for c, n in names.items()]]
    side = unique(spec.side.where(F.col(spec.side_key).isNotNull()).select(*columns), "__side_key").withColumn("__found", F.lit(True))
    key = F.col(spec.key) if isinstance(spec.key, str) else spec.key
    if spec.missing == "skip":
        key = F.when(F.trim(key.cast("string")) != "", key)
    joined = df.withColumn("__key", key).join(side, F.col("__key") == F.col("__side_key"), "left")
    if spec.missing == "error":
        # A filter on the rows themselves: it stays whatever columns are read later.
        said = F.raise_error(F.concat(F.lit("no match for key "), F.coalesce(F.col("__key").cast("string"), F.lit("null"))))
        joined = joined.where(F.coalesce(F.col("__found"), said.cast("boolean")))
    return joined.drop("__key", "__side_key", "__found")


def lookup_chain(df: DataFrame, specs: Sequence[Lookup]) -> DataFrame:
    """Lookups in order; a later key may come from an earlier one."""
    for spec in specs:
        df = lookup(df, spec)
    return df


def multi_role(df: DataFrame, side: DataFrame, side_key: str, roles: Mapping[str, str], columns: Sequence[str], missing: str = "skip") -> DataFrame:
    """The same side table for several roles: {role: key column}; columns get the role as prefix."""
    return lookup_chain(df, [Lookup(side, key, side_key, {c: f"{role}_{c}" for c in columns}, missing) for role, key in roles.items()])


def routed_lookup(df: DataFrame, sides: Mapping[str, DataFrame], source: str, key: str, side_key: str, missing: str = "error") -> DataFrame:
    """The side table is chosen by each row's source. A key that its table has twice raises.

    missing: error (an unmatched key and a source without a table raise) or skip (such rows stay without values).
    """
    if missing not in ("error", "skip"):
        raise ValueError(f"unknown policy {missing!r}")
    out = None
    for name, side in sides.items():
        tagged = side.where(F.col(side_key).isNotNull()).withColumn("__source", F.lit(name)).withColumnRenamed(side_key, "__side_key")
        out = tagged if out is None else out.unionByName(tagged)
    clash = sorted(set(out.columns) & set(df.columns))
    if clash:
        raise ValueError(f"column names collide: {clash}")
    one = unique(out, "__source", "__side_key").withColumn("__found", F.lit(True))
    joined = df.join(one, (F.col(source) == F.col("__source")) & (F.col(key) == F.col("__side_key")), "left")
    if missing == "error":
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
        said = F.raise_error(F.concat(F.lit("no match for key "), text(key), F.lit(" in "), text(source))).cast("boolean")
        joined = joined.where(F.coalesce(F.col("__found"), said))
    return joined.drop("__source", "__side_key", "__found")


def positional(df: DataFrame, requests: DataFrame, position: str = "row_pos", request: str = "request_pos") -> DataFrame:
    """Rows by ordinal, in the order of the requests; one out of range raises."""
    n = df.count()
    bad = requests.where(F.col(position).isNull() | (F.col(position) < 0) | (F.col(position) >= n)).limit(10).collect()
    if bad:
        raise IndexError(f"positions outside 0..{n - 1}: {bad}")
    return requests.join(df, position).orderBy(request)


def ordered_children(children: DataFrame, parent: str, order: Sequence[str], value: str, out: str = "items") -> DataFrame:
    """Each parent's values as one array in order."""
    packed = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, value]))))
    return children.groupBy(parent).agg(F.transform(packed, lambda x: x[value]).alias(out))


def class_names(df: DataFrame, number: str, names: DataFrame, out: str) -> DataFrame:
    """df with the name of each row's class number, its place from 0 in names (one row, an array); others raise."""
    listed = names.toDF("__names")
    said = F.raise_error(F.concat(F.lit("no class "), F.coalesce(F.col(number).cast("string"), F.lit("null"))))
    name = F.when((F.col(number) >= 0) & (F.col(number) < F.size("__names")), F.get("__names", F.col(number).cast("int"))).otherwise(said)
    return df.join(F.broadcast(listed)).withColumn(out, name).drop("__names")  # one row


def last_by_name(files: DataFrame, name: str, key: str, order: str) -> DataFrame:
    """One key for each name, the last by order."""
    return files.groupBy(name).agg(F.max_by(key, order).alias(key))

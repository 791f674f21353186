"""Helpers shared by the training-data operators."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of the operator contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of df's columns."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        pick = f"__{name}"
        while pick.lower() in have:
            pick += "_"
        have.add(pick.lower())
        out.append(pick)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a local session without the setting gets a folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: cuts lineage and survives lost executors.

    Shuffle files of the plan are deleted once the table is complete, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what write_table or write_buckets wrote, once nothing reads it any more."""
    path = getattr(df, "_written_to", None)
    if path:
        if hasattr(df, "_table"):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {df._table}")
        jvm = df.sparkSession.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def write_buckets(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """df as a table in n buckets by key, in the shared folder: what is joined or grouped with it by key needs no shuffle of it."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_dir(spark)}/{table}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(table)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.table(table)
    out._written_to, out._table = path, table
    return out


def pow2_at_least(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, n))))


def word_array(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def join_groups(rows: DataFrame, groups: DataFrame, on: str | list[str], size: str, total: int, how: str = "inner", share: int = 10_000) -> DataFrame:
    """Join of rows with groups, one row for each key, which has the column `size`: how many rows it has here.

    Keys that hold a `share`-th of all rows or more are at most `share`, so they
    meet their rows by broadcast; what is left to shuffle has no large key.
    how: inner or left. groups is read three times; hand over a written table.
    """
    on = [on] if isinstance(on, str) else on
    least = max(2, total // share)
    large = groups.where(F.col(size) >= least)
    hot = rows.join(F.broadcast(large), on)
    cold = rows.join(F.broadcast(large.select(*on)), on, "left_anti")
    return hot.unionByName(cold.join(groups.where(F.col(size) < least), on, how))


def join_values(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """Left join_groups by columns of any type in which a null is a value like others; of groups the other columns are added."""
    keys = fresh(rows, *on)
    as_key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    groups = groups.select(*[as_key(c).alias(k) for c, k in zip(on, keys, strict=True)], *[c for c in groups.columns if c not in on])
    return join_groups(rows.withColumns({k: as_key(c) for c, k in zip(on, keys, strict=True)}), groups, keys, size, total, "left").drop(*keys)

"""Tables written in one pass: checked before they count, and in files of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a file besides its values: heads, statistics and the footer, for the file and for each column.
FILE_BYTES, COLUMN_BYTES = 4096, 512
# Bytes that Parquet stores for a value of a type.
WIDTHS = {"boolean": 1, "byte": 4, "short": 4, "integer": 4, "long": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def _value_bytes(x: Column, kind: T.DataType) -> Column:
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(x) + 4
    elif isinstance(kind, T.ArrayType):
        inner = WIDTHS.get(kind.elementType.typeName())
        each = F.size(x) * (inner + 1) if inner else F.aggregate(F.transform(x, lambda v: _value_bytes(v, kind.elementType)), F.lit(0).cast("long"), lambda a, b: a + b)
        size = each + 4
    elif isinstance(kind, T.MapType):
        size = _value_bytes(F.map_keys(x), T.ArrayType(kind.keyType)) + _value_bytes(F.map_values(x), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum((_value_bytes(x[f.name], f.dataType) for f in kind), F.lit(0))
    else:
        size = F.lit(WIDTHS.get(kind.typeName(), 16))
    return F.coalesce(size.cast("long"), F.lit(0).cast("long")) + 2  # levels


def row_bytes(df: DataFrame) -> Column:
    """Bytes of a row's values as Parquet stores them plain."""
    return sum((_value_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema), F.lit(0).cast("long"))


def _filled(cap: int, size: int):
    """Rows with the name of their file: rows of a partition fill one file after another, in the order they come in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file, held, n = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            ends = np.cumsum(batch.column(size).to_numpy())
            names, i, done = np.zeros(len(ends), np.int64), 0, 0
            while i < len(ends):
                k = int(np.searchsorted(ends, done + cap - held, "right"))
                if k <= i:  # the next row doesn't fit; if the file is empty it is larger than a file may be, and has one of its own
                    if held:
                        file, held = file + 1, 0
                        continue
                    k = i + 1
                names[i:k] = file
                held, done, i = held + int(ends[k - 1]) - done, int(ends[k - 1]), k
            rest = [batch.column(c) for c in range(batch.num_columns) if c != size]
            place = pa.array(np.arange(n, n + len(ends)))
            n += len(ends)
            label = pa.array([f"{part:05}-{f:06}" for f in names.tolist()])
            yield pa.RecordBatch.from_arrays([*rest, label, place], names=[*[x for c, x in enumerate(batch.schema.names) if c != size], "__file", "__place"])

    return run


class Folder:
    """A folder of a file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.path = self.make(path)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.files.exists(self.path)

    def delete(self) -> None:
        self.files.delete(self.path, True)

    def data(self, path=None) -> list:
        """All data files below; names that begin with _ or . are left out, unless they are those of a value's folder."""
        out = []
        for status in self.files.listStatus(path or self.path):
            name = status.getPath().getName()
            if "=" in name or not name.startswith(("_", ".")):
                out += self.data(status.getPath()) if status.isDirectory() else [status.getPath()]
        return out

    def move(self, source, *below: str) -> None:
        target = self.path
        for name in below[:-1]:
            target = self.make(target, name)
        self.files.mkdirs(target)
        if not self.files.rename(source, self.make(target, below[-1])):
            raise OSError(f"{source} could not be moved")


def _commit(staged: Folder, to: Folder, mode: str) -> None:
    """The staged table in its place: instead of what was there, or its files beside those that are there."""
    if mode == "append" and to.exists():
        base = staged.path.toString().rstrip("/") + "/"
        for file in staged.data():
            at = file.toString().partition(base)[2].split("/") if base in file.toString() else file.toString().partition(staged.path.getName() + "/")[2].split("/")
            to.move(file, *at[:-1], f"{uuid.uuid4().hex[:8]}-{at[-1]}")
        staged.delete()
        return
    if to.exists():
        to.delete()
    to.files.mkdirs(to.path.getParent())
    if not to.files.rename(staged.path, to.path):
        raise OSError(f"{to.path} could not be put in place")


def write_guarded(df: DataFrame, path: str, by: str | None = None, expected: Sequence[str] = (), mode: str = "errorifexists", max_bytes: int | None = None, order: Sequence[str] = ()) -> dict[str, int]:
    """df as a table, checked while it is written; gives how many rows there are, in all ("") and of each expected value.

    One pass: rows are counted as they are written to a folder beside the table, which takes its place once the
    checks hold. A table without rows, and an expected value of `by` (a folder for each of its values) without a
    row, raise, and leave what was there. mode: errorifexists, overwrite or append (later batches).
    max_bytes: no file above it, see write_bounded.
    """
    spark, to = df.sparkSession, Folder(df.sparkSession, path)
    if mode not in ("errorifexists", "overwrite", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "errorifexists" and to.exists():
        raise FileExistsError(path)
    if expected and by is None:
        raise ValueError("expected values need a column")
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("n")] + [F.count_if(F.col(by) == v).alias(f"v{k}") for k, v in enumerate(expected)]
    staged = Folder(spark, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}")
    try:
        if max_bytes is None:
            rows = df.observe(seen, *counts)
            (rows.write.partitionBy(by) if by else rows.write).parquet(staged.path.toString())
        else:
            _write_bounded(df, staged, max_bytes, order, by, (seen, counts))
        got = seen.get
        found = {"": got.get("n", 0)} | {v: got.get(f"v{k}", 0) for k, v in enumerate(expected)}
        if not found[""]:
            raise ValueError(f"no rows for {path}")
        lost = sorted(v for v in expected if not found[v])
        if lost:
            raise ValueError(f"no rows for {lost}")
        _commit(staged, to, mode)
    finally:
        if staged.exists():
            staged.delete()
    return found


def write_bounded(df: DataFrame, path: str, max_bytes: int, order: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """df as Parquet files of max_bytes at most, counted from the bytes of their rows; a row above that is a file of its own.

    With an order, rows are dealt to ranges of it, and the files' names follow it; without one each
    partition of df is written as it comes. Every range begins a file, so files aren't all full. Nothing is
    counted beforehand: a task adds up the rows that pass it. An empty table is a folder with its schema alone.
    """
    to = Folder(df.sparkSession, path)
    if mode == "errorifexists" and to.exists():
        raise FileExistsError(path)
    staged = Folder(df.sparkSession, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}")
    try:
        _write_bounded(df, staged, max_bytes, order, None, None)
        _commit(staged, to, mode)
    finally:
        if staged.exists():
            staged.delete()


def _write_bounded(df: DataFrame, staged: Folder, max_bytes: int, order: Sequence[str], by: str | None, watch: tuple | None) -> None:
    cap = max_bytes - FILE_BYTES - COLUMN_BYTES * len(df.columns)
    if cap <= 0:
        raise ValueError(f"{max_bytes} bytes are too few for a file")
    keys = [*([by] if by else []), *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    sized = dealt.withColumn("__bytes", row_bytes(df))
    schema = T.StructType([*df.schema.fields, T.StructField("__file", T.StringType()), T.StructField("__place", T.LongType())])
    named = sized.mapInArrow(_filled(cap, len(df.columns)), schema)
    if watch:
        named = named.observe(watch[0], *watch[1])
    parts = [*([by] if by else []), "__file"]
    named.sortWithinPartitions(*parts, "__place").drop("__place").write.partitionBy(*parts).parquet(staged.path.toString())
    # A folder for each file, made by the writer that can split rows by a value: the files move up, named by their place.
    moved = staged.data()
    for file in moved:
        folder = file.getParent()
        at = [folder.getParent().getName()] if by else []
        staged.move(file, *at, f"part-{folder.getName().partition('=')[2]}.parquet")
        staged.files.delete(folder, True)
    if not moved:
        staged.delete()
        df.sparkSession.createDataFrame([], df.schema).write.parquet(staged.path.toString())

"""Scans and sinks."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from . import sinks


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None, where: str | None = None, limit: int | None = None, read_columns: Sequence[str] | None = None) -> DataFrame:
    """Parquet rows: only the columns asked for, each once, the predicate pushed to the files.

    columns and read_columns mean the same; both at once and names that aren't text raise.
    """
    if columns is not None and read_columns is not None:
        raise ValueError("columns and read_columns at once")
    columns = read_columns if columns is None else columns
    df = spark.read.parquet(path)
    if where:
        df = df.where(where)
    if columns is not None:
        if isinstance(columns, str) or not all(isinstance(c, str) for c in columns):
            raise TypeError("columns are a list of names")
        df = df.select(*dict.fromkeys(columns))
    return df if limit is None else df.limit(limit)


def _listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that a pattern matches, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = hadoop.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(x.getPath().toString() for x in found or [])


def first_matching(spark: SparkSession, folder: str, patterns: Sequence[str]) -> DataFrame:
    """The shards of the first pattern that any file matches."""
    for pattern in patterns:
        if _listed(spark, f"{folder}/{pattern}"):
            return spark.read.parquet(f"{folder}/{pattern}")
    raise FileNotFoundError(f"{folder}: no file like {', '.join(patterns)}")


def subsets(spark: SparkSession, folder: str, split_files: Sequence[str]) -> list[str]:
    """Names of the directories that hold one of the split files; none at all raises."""
    found = {p.split("/")[-2] for name in split_files for p in _listed(spark, f"{folder}/*/{name}")}
    if not found:
        raise FileNotFoundError(f"{folder}: no directory with {', '.join(split_files)}")
    return sorted(found)


def resolve(name: str, relative: str, roots: Mapping[str, str], overrides: Mapping[str, str] | None = None) -> str:
    """Path of a source: its override, or its place below a declared root; a root that isn't declared raises."""
    if name in (overrides or {}):
        return overrides[name]
    root, _, rest = relative.partition("/")
    if root not in roots:
        raise ValueError(f"unknown root {root!r} of source {name!r}: {sorted(roots)}")
    return f"{roots[root].rstrip('/')}/{rest}" if rest else roots[root]


def dataset_reference(ref: str) -> tuple[str, str | None, str]:
    """(repository, subset, split) of repo::subset/split or repo::split."""
    repo, found, rest = ref.partition("::")
    parts = rest.split("/")
    if not found or not repo or not all(parts) or len(parts) > 2:
        raise ValueError(f"bad reference {ref!r}, expected repo::subset/split")
    return repo, parts[0] if len(parts) == 2 else None, parts[-1]


def local_datasets(spark: SparkSession, refs: Sequence[str], root: str, column: str = "subset") -> DataFrame:
    """Rows of references that lie as Parquet below root, repo/subset/split, with the subset's name (or the split's) as a column."""
    out = None
    for repo, subset, split in map(dataset_reference, refs):
        df = spark.read.parquet("/".join(x for x in (root, repo, subset, split) if x)).withColumn(column, F.lit(subset or split))
        out = df if out is None else out.unionByName(df)
    return out


def row_numbers(df: DataFrame, name: str = "row_index") -> DataFrame:
    """The place of each row in its own file, as Parquet knows it: it stays the same however the scan is split."""
    return df.withColumn("file_name", F.col("_metadata.file_name")).withColumn(name, F.col("_metadata.row_index"))


def with_split(df: DataFrame, name: str = "split") -> DataFrame:
    """The split that a row's file name begins with, up to the first dash."""
    return df.withColumn(name, F.regexp_extract(F.col("_metadata.file_name"), r"^([^-.]+)", 1))


def jsonl(spark: SparkSession, path: str, schema: StructType | str, strict: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. With strict a line that isn't an object of the schema raises, with its file and text."""
    if not strict:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_name").alias("__file"))
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    parsed = F.from_json("value", StructType([*kind.fields, StructField("__bad", StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = lines.withColumn("__row", parsed)
    wrong = F.col("__row").isNull() | F.col("__row.__bad").isNotNull() | ~F.startswith(F.ltrim("value"), F.lit("{"))
    said = F.raise_error(F.concat(F.lit("bad line in "), F.col("__file"), F.lit(": "), F.substring("value", 1, 200))).cast("boolean")
    return rows.where(F.when(~wrong, F.lit(True)).otherwise(said)).select(*[F.col(f"__row.{f.name}").alias(f.name) for f in kind.fields])


def jsonl_like_its_head(spark: SparkSession, path: str, lines: int = 100) -> DataFrame:
    """JSON lines with the schema of the first lines, to which all others are read; a line that doesn't fit raises.

    The head of so many lines is what defines the schema; all lines are read.
    """
    head = [r[0] for r in spark.read.text(path).where(F.trim("value") != "").limit(lines).collect()]
    if not head:
        raise ValueError(f"{path}: no lines")
    return jsonl(spark, path, _schema_of(spark, head), strict=True)


def _schema_of(spark: SparkSession, lines: Sequence[str]) -> StructType:
    """The narrowest schema that all lines fit, by Spark's own inference over one text."""
    whole = F.schema_of_json(F.lit("[" + ",".join(lines) + "]"))
    ddl = spark.range(1).select(whole).first()[0]
    return StructType.fromDDL(f"x {ddl}")["x"].dataType.elementType


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id start end##sentence`` as columns; a line of another form raises."""
    parts = F.split("value", "##", 2)
    head = F.split(F.trim(F.get(parts, F.lit(0))), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "")
    good = (F.size(parts) == 2) & (F.size(head) == 3)
    fail = F.raise_error(F.concat(F.lit("bad line: "), F.col("value")))
    return lines.select(F.when(good, F.get(head, F.lit(0))).otherwise(fail).alias("id"), F.get(head, F.lit(1)).cast("double").alias("start"), F.get(head, F.lit(2)).cast("double").alias("end"), F.trim(F.get(parts, F.lit(1))).alias("sentence"))


def split_list(spark: SparkSession, path: str, by_file: bool = False) -> DataFrame:
    """class, file of lists with a file a line: the class is the file's directory, or what the list's own name begins with."""
    first = F.get(F.split(F.trim("value"), r"\s+"), F.lit(0))
    parent = F.regexp_extract(first, r"([^/]+)/[^/]*$", 1)
    own = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_test_split|_split|\.)", 1)
    return spark.read.text(path).where(F.trim("value") != "").select((own if by_file else parent).alias("class"), first.alias("file"))


def file_bytes(wanted: DataFrame, spark: SparkSession, folder: str, path: str = "path") -> DataFrame:
    """wanted with the bytes of each file below folder, read in tasks; a file that is missing or empty raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    base = _listed(spark, folder)[0].rstrip("/") + "/"
    held = files.select(F.substring("path", len(base) + 1, 1 << 30).alias("__path"), F.col("content").alias("bytes"))
    joined = wanted.join(held, F.col(path) == F.col("__path"), "left")
    said = F.raise_error(F.concat(F.lit("missing or empty file: "), F.col(path))).cast("boolean")
    return joined.where(F.when(F.coalesce(F.length("bytes"), F.lit(0)) > 0, F.lit(True)).otherwise(said)).drop("__path")


def frames(spark: SparkSession, folder: str, natural: bool = True, strict: bool = False) -> DataFrame:
    """Pictures of each directory in order of their names, natural (frame_2 before frame_10) or plain.

    strict: an empty file raises. Scans pass over empty files, so that is a listing.
    """
    if strict:
        at, system = _files(spark, folder)
        listed = system.listFiles(at, True)
        while listed.hasNext():
            entry = listed.next()
            if entry.getLen() == 0:
                raise ValueError(f"empty frame: {entry.getPath().toString()}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    numbers = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    order = [numbers.alias("n"), name.alias("name")] if natural else [name.alias("name")]
    packed = F.array_sort(F.collect_list(F.struct(*order, "content")))
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.transform(packed, lambda x: x["content"]).alias("frames"))


def clips(files: DataFrame, path: str = "path") -> DataFrame:
    """clip, kind, place, frame of paths in either layout: clip/positive_clip/f, clip/negative_clip_3/f, or clip/negative_3_f and clip/positive_f."""
    folder = F.regexp_extract(path, r"(?:^|/)([^/]+)/(positive_clip|negative_clip_\d+)/[^/]+$", 2)
    flat = F.regexp_extract(path, r"(?:^|/)([^/]+)/(positive|negative_\d+)_[^/]*$", 2)
    named = F.when(folder != "", folder).otherwise(flat)
    clip = F.when(folder != "", F.element_at(F.split(path, "/"), -3)).otherwise(F.element_at(F.split(path, "/"), -2))
    rows = files.withColumn("clip", clip).withColumn("kind", F.when(F.startswith(named, F.lit("positive")), "positive").when(named != "", "negative"))
    place = F.regexp_extract(named, r"(\d+)$", 1)
    return rows.withColumn("place", F.when(place != "", place.cast("int"))).where("kind IS NOT NULL")


def write_table(df: DataFrame, path: str, schema: StructType | None = None, overwrite: bool = False, max_records: int | None = None) -> None:
    """A typed table; empty ones keep their schema."""
    if schema is not None:
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.option("maxRecordsPerFile", max_records) if max_records else writer).parquet(path)


def fan_out(df: DataFrame, path: str, by: str, expected: Sequence[str] = ()) -> None:
    """One table per value of a column, in one pass; expected values without a row raise."""
    sinks.write_guarded(df, path, by, expected)


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_nonempty(df: DataFrame, path: str, overwrite: bool = True, append: bool = False) -> None:
    """df as a table, in one pass; one without rows raises and leaves what was there. append: a later batch of the table."""
    sinks.write_guarded(df, path, mode="append" if append else "overwrite" if overwrite else "errorifexists")


def replace_table(df: DataFrame, path: str, keep: int = 1) -> None:
    """df in place of the table at path, whole or not at all: written beside it, then renamed.

    What was there stays as path.bak1, the one before as path.bak2, up to `keep`.
    If the last rename fails the old table comes back.
    """
    spark = df.sparkSession
    staged, files = _files(spark, f"{path}.new-{uuid.uuid4().hex[:8]}")
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    df.write.parquet(staged.toString())
    at, backups = Path(path), [Path(f"{path}.bak{k}") for k in range(1, keep + 1)]
    if files.exists(at):
        if backups:
            files.delete(backups[-1], True)
            for older, newer in zip(reversed(backups), list(reversed(backups))[1:], strict=False):
                if files.exists(newer):
                    files.rename(newer, older)
            files.rename(at, backups[0])
        else:
            files.delete(at, True)
    if not files.rename(staged, at):
        if backups and files.exists(backups[0]):
            files.rename(backups[0], at)
        raise OSError(f"{path} could not be replaced")


def repack(spark: SparkSession, path: str, files: int, out: str | None = None, keep: int = 1) -> None:
    """The table in so many files, at out or in its own place with the old one as backup."""
    df = spark.read.parquet(path).repartition(files)
    if out is not None:
        df.write.parquet(out)
    else:
        replace_table(df, path, keep)


def write_jsonl(df: DataFrame, path: str) -> None:
    """A JSON object a line, null fields included."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.text(path)


def plain(value):
    """A value as JSON can say it: numbers that aren't finite as null, dates and others as text."""
    if hasattr(value, "asDict"):
        value = value.asDict(recursive=True)
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in value]
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if value is None or isinstance(value, (bool, int, float, str)) else str(value)


def write_json(spark: SparkSession, path: str, value) -> None:
    """One small JSON document (metadata, results, an audit) at a path of any file system."""
    at, files = _files(spark, path)
    stream = files.create(at, True)
    try:
        stream.write(bytearray(json.dumps(plain(value), ensure_ascii=False, indent=2, sort_keys=True).encode()))
    finally:
        stream.close()


def results(rows: Mapping[str, Mapping[str, float]], summary: Mapping[str, float], meta: Mapping | None = None) -> dict:
    """What a benchmark gives: its settings, the summary, and each dataset's metrics."""
    return {"meta": dict(meta or {}), "summary": dict(summary), "datasets": {k: dict(v) for k, v in rows.items()}}


def flat_metrics(result: Mapping, prefix: str = "eval") -> dict[str, float]:
    """Metrics by one name each: prefix/dataset/metric, and prefix/summary/metric."""
    out = {f"{prefix}/summary/{k}": v for k, v in result["summary"].items()}
    return out | {f"{prefix}/{name}/{k}": v for name, metrics in result["datasets"].items() for k, v in metrics.items()}


def write_quality(spark: SparkSession, folder: str, found: DataFrame, decided: DataFrame, audited: DataFrame, markdown: str) -> None:
    """Findings and decisions as tables of JSON lines, the audit as JSON, the report as text."""
    write_jsonl(found, f"{folder}/findings")
    write_jsonl(decided, f"{folder}/decisions")
    write_json(spark, f"{folder}/quality_audit.json", audited.first())
    at, files = _files(spark, f"{folder}/quality_report.md")
    stream = files.create(at, True)
    stream.write(bytearray(markdown.encode()))
    stream.close()

"""Members of tar and zip archives as rows.

A logical archive is a list of part files, read as one run of bytes: parts of a split
tar may end anywhere. The data source `archive_index` gives a task to each archive,
which reads headers only (it seeks past the contents) and tells where each member
lies. That index is a table: members are chosen by filters and joins on it. Then
tasks of about TASK_BYTES read the chosen ranges, so that one large archive is read
by many tasks. A compressed tar has no ranges; it is passed through once, by one task.

Files are opened with pyarrow's file systems, so a path may be a URI of any store
that they know; neither archive nor member has to fit in memory or under a limit:
members above PIECE bytes come as several rows.
"""

from __future__ import annotations

import io
import json
import re
import struct
import tarfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..operators.staging import staged

INDEX = "archive string, parts array<string>, member string, kind string, at long, packed long, size long, method int, crc long"
SCHEMA = "archive string, member string, piece int, content binary"
TASK_BYTES, PIECE, HELD, COPIED = 1 << 27, 1 << 30, 1 << 24, 1 << 20
#: How the first bytes of compressed tars begin: gzip, bzip2, xz, zstandard.
PACKED = (b"\x1f\x8b", b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd")
_PART = re.compile(r"^(.+\.(?:tar|zip)(?:\.\w{2,3})?|.+\.t[gbx]z2?)[._-]?(?:part)?[._-]?(\d+|[a-z]{2})$", re.I)


class Parts(io.RawIOBase):
    """Part files as one file that can be sought in; a part is open while it is read."""

    def __init__(self, paths: Sequence[str]):
        self.opened = [pa.fs.FileSystem.from_uri(p) for p in paths]
        infos = [system.get_file_info(p) for system, p in self.opened]
        lost = [p for p, info in zip(paths, infos, strict=True) if info.type != pa.fs.FileType.File]
        if lost:
            raise FileNotFoundError(f"no such archive part: {lost[0]}")
        self.ends, end = [], 0
        for info in infos:
            end += info.size
            self.ends.append(end)
        self.place, self.now, self.file = 0, -1, None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.place

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.place = max(0, offset + {io.SEEK_SET: 0, io.SEEK_CUR: self.place, io.SEEK_END: self.ends[-1]}[whence])
        return self.place

    def readinto(self, buffer) -> int:
        k = next((k for k, end in enumerate(self.ends) if self.place < end), None)
        if k is None:
            return 0
        if k != self.now:
            self._shut()
            system, path = self.opened[k]
            self.file, self.now = system.open_input_file(path), k
        begin = self.ends[k - 1] if k else 0
        self.file.seek(self.place - begin)
        data = self.file.read(min(len(buffer), self.ends[k] - self.place))
        buffer[: len(data)] = data
        self.place += len(data)
        return len(data)

    def _shut(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file, self.now = None, -1

    def close(self) -> None:
        self._shut()
        super().close()


def _opened(parts: Sequence[str]) -> io.BufferedReader:
    return io.BufferedReader(Parts(parts), 1 << 16)


def _entries(archive: str, parts: Sequence[str]) -> Iterator[tuple]:
    """A row of INDEX for each file in the archive."""
    with _opened(parts) as f:
        head = f.read(6)
        f.seek(0)
        if head.startswith(b"PK"):
            with zipfile.ZipFile(f) as z:
                for m in z.infolist():
                    if m.flag_bits & 1:
                        raise ValueError(f"{archive}: {m.filename} is encrypted")
                    if not m.is_dir():
                        yield archive, list(parts), m.filename, "zip", m.header_offset, m.compress_size, m.file_size, m.compress_type, m.CRC
            return
        packed = head.startswith(PACKED)
        with tarfile.open(fileobj=f, mode="r|*" if packed else "r:") as tar:
            for m in tar:
                if m.isfile():
                    if m.issparse():
                        raise ValueError(f"{archive}: {m.name} is stored with holes")
                    yield archive, list(parts), m.name, "stream" if packed else "tar", m.offset_data, m.size, m.size, 0, None


class ArchivePartition(InputPartition):
    def __init__(self, archive: str, parts: Sequence[str]):
        self.archive, self.parts = archive, list(parts)


class ArchiveReader(DataSourceReader):
    def __init__(self, streams: Mapping[str, Sequence[str]]):
        self.streams = streams

    def partitions(self) -> list[ArchivePartition]:
        return [ArchivePartition(name, parts) for name, parts in self.streams.items()]

    def read(self, partition: ArchivePartition) -> Iterator[tuple]:
        return _entries(partition.archive, partition.parts)


class ArchiveIndex(DataSource):
    """Option streams: a JSON object of archives' names and their parts, in order."""

    @classmethod
    def name(cls) -> str:
        return "archive_index"

    def schema(self) -> str:
        return INDEX

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(json.loads(self.options["streams"]))


def split_streams(paths: Sequence[str]) -> dict[str, list[str]]:
    """Archives and their parts in order: x.tar.part-0, x.tar.part-1 .. or x.tar.aa, x.tar.ab .. make x.tar; others are whole.

    Numbers go by value. A whole file beside parts of its name, and numbers that leave a gap, raise.
    """
    out: dict[str, list[tuple[int | str, str]]] = {}
    for path in paths:
        m = _PART.match(path)
        number = m and (int(m[2]) if m[2].isdigit() else m[2].lower())
        out.setdefault(m[1] if m else path, []).append(("" if number is None else number, path))
    for name, parts in out.items():
        numbers = [n for n, _ in parts]
        if len({type(n) for n in numbers}) > 1 or len(set(numbers)) < len(numbers) or ("" in numbers and len(numbers) > 1):
            raise ValueError(f"parts of {name} are ambiguous")
        parts.sort()
        numbers = sorted(numbers)
        at = [n if isinstance(n, int) else 26 * (ord(n[0]) - 97) + ord(n[1]) - 97 for n in numbers if n != ""]
        if at and (at[0] > 1 or at != list(range(at[0], at[0] + len(at)))):
            raise FileNotFoundError(f"parts of {name} are missing: there are {numbers}")
    return {name: [p for _, p in parts] for name, parts in out.items()}


def archive_index(spark: SparkSession, archives: str | Sequence[str] | Mapping[str, Sequence[str]]) -> DataFrame:
    """Where each member lies, for a path that Spark can list (globs too), a list of paths, or names with their parts."""
    if isinstance(archives, str):
        archives = sorted(r["path"] for r in spark.read.format("binaryFile").load(archives).select("path").collect())  # names only
    streams = dict(archives) if isinstance(archives, Mapping) else split_streams(archives)
    spark.dataSource.register(ArchiveIndex)
    return staged(spark.read.format("archive_index").option("streams", json.dumps(streams)).load(), "archive-index")


class _Contents:
    """Reads members of rows that come by archive and place; a compressed tar is passed through once."""

    def __init__(self, piece: int):
        self.piece, self.name, self.file, self.tar = piece, None, None, None

    def _turn_to(self, row: dict) -> None:
        if self.name != row["archive"]:
            self.close()
            self.name, self.file = row["archive"], _opened(row["parts"])
            self.tar = tarfile.open(fileobj=self.file, mode="r|*") if row["kind"] == "stream" else None

    def pieces(self, row: dict) -> Iterator[tuple[int, bytes]]:
        self._turn_to(row)
        if row["kind"] == "tar":
            self.file.seek(row["at"])
            data = self.file.read(row["packed"])
            if len(data) < row["packed"]:
                raise EOFError(f"{self.name} ends within {row['member']}")
            yield row["piece"], data
            return
        held, number, size = [], 0, 0
        for data in self._stream(row) if row["kind"] == "stream" else self._unzipped(row):
            while size + len(data) > self.piece:
                cut = self.piece - size
                yield number, b"".join([*held, data[:cut]])
                data, held, number, size = data[cut:], [], number + 1, 0
            held.append(data)
            size += len(data)
        if size or not number:
            yield number, b"".join(held)

    def _stream(self, row: dict) -> Iterator[bytes]:
        member = next((m for m in self.tar if m.offset_data == row["at"]), None)
        if member is None:
            raise EOFError(f"{self.name} has no {row['member']} at {row['at']} any more")
        file = self.tar.extractfile(member)
        while data := file.read(COPIED):
            yield data

    def _unzipped(self, row: dict) -> Iterator[bytes]:
        f = self.file
        f.seek(row["at"])
        head = f.read(30)
        if head[:4] != b"PK\x03\x04" or row["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{self.name}: {row['member']} can't be read, method {row['method']}")
        f.seek(row["at"] + 30 + sum(struct.unpack("<HH", head[26:30])))
        unpack = zlib.decompressobj(-15) if row["method"] == zipfile.ZIP_DEFLATED else None
        left, crc, size = row["packed"], 0, 0
        while left:
            raw = f.read(min(COPIED, left))
            if not raw:
                break
            left -= len(raw)
            while raw:
                data = unpack.decompress(raw, COPIED) if unpack else raw
                raw = unpack.unconsumed_tail if unpack else b""
                crc, size = zlib.crc32(data, crc), size + len(data)
                yield data
        data = unpack.flush() if unpack else b""
        if left or size + len(data) != row["size"] or zlib.crc32(data, crc) != row["crc"]:
            raise ValueError(f"{self.name}: {row['member']} is damaged")
        if data:
            yield data

    def close(self) -> None:
        for x in (self.tar, self.file):
            if x is not None:
                x.close()


def _reader(piece: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, rows, size = _Contents(piece), [], 0

        def packed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["archive", "member", "piece", "content"])

        for batch in batches:
            for row in batch.to_pylist():
                for number, data in contents.pieces(row):
                    rows.append((row["archive"], row["member"], number, data))
                    size += len(data)
                    if size >= HELD:
                        yield packed()
                        rows, size = [], 0
        if rows:
            yield packed()
        contents.close()

    return run


def read_members(index: DataFrame, piece_bytes: int = PIECE, task_bytes: int = TASK_BYTES) -> DataFrame:
    """archive, member, piece, content of the rows of an index; a member of more than piece_bytes comes as numbered pieces.

    Ranges are dealt to tasks by archive and place, about task_bytes to each.
    """
    spark = index.sparkSession
    total = index.agg(F.coalesce(F.sum("packed"), F.lit(0))).first()[0]
    plain = F.col("kind") == "tar"
    last = F.when(plain, F.greatest(F.lit(0), F.expr(f"(size - 1) DIV {piece_bytes}"))).otherwise(0)
    rows = index.withColumn("piece", F.explode(F.sequence(F.lit(0), last.cast("int"))))
    ahead = F.when(plain, F.col("piece").cast("long") * piece_bytes).otherwise(0)
    rows = rows.withColumn("at", F.col("at") + ahead).withColumn("packed", F.when(plain, F.least(F.lit(piece_bytes), F.col("size") - ahead)).otherwise(F.col("packed")))
    run = F.when(F.col("kind") == "stream", F.lit(0)).otherwise(F.floor(F.col("at") / task_bytes))
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    return rows.withColumn("run", run).repartition(tasks, "archive", "run").sortWithinPartitions("archive", "at").mapInArrow(_reader(piece_bytes), SCHEMA)


def members(spark: SparkSession, path: str, suffixes: Sequence[str] = ("",)) -> DataFrame:
    """archive, member, content of the files in tar (plain, split or compressed) and zip archives, those with the suffixes; one above PIECE raises."""
    wanted = F.lit(False)
    for suffix in suffixes:
        wanted = wanted | F.col("member").endswith(suffix)
    found = read_members(archive_index(spark, path).where(wanted))
    said = F.raise_error(F.concat("member", F.lit(" is larger than one row holds: use read_members"))).cast("binary")
    return found.select("archive", "member", F.when(F.col("piece") > 0, said).otherwise(F.col("content")).alias("content"))


def selected(found: DataFrame, wanted: DataFrame, key: str = "member") -> DataFrame:
    """The wanted rows of an index or of members; one that no archive has raises when it is read.

    On an index, contents of other members are never read.
    """
    held = found.join(wanted.select(key).distinct(), key, "right")
    fail = F.raise_error(F.concat(F.lit("no archive has "), F.col(key))).cast("string")
    return held.withColumn("archive", F.coalesce("archive", fail)).where("archive IS NOT NULL").select(*found.columns)


def write_tars(rows: DataFrame, folder: str, archive: str = "archive", member: str = "member", content: str = "content") -> DataFrame:
    """Rows put into plain tars, one for each value of archive, members in order of their names: archive, path, n_members.

    A task writes its tar beside its name and moves it there when it is complete, so a task that is run again does no harm.
    """
    to = folder.rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = pa.fs.FileSystem.from_uri(to)
        system.create_dir(base, recursive=True)
        name, tar, sink, n, made = None, None, None, 0, []

        def shut() -> None:
            if tar is not None:
                tar.close()
                sink.close()
                system.move(f"{base}/.{name}-{mark}", f"{base}/{name}")
                made.append((name, f"{to}/{name}", n))

        for batch in batches:
            for a, m, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if a != name:
                    shut()
                    name, mark, n = a, uuid.uuid4().hex, 0
                    sink = system.open_output_stream(f"{base}/.{name}-{mark}")
                    tar = tarfile.open(fileobj=sink, mode="w|")
                info = tarfile.TarInfo(m)
                info.size = len(data or b"")
                tar.addfile(info, io.BytesIO(data or b""))
                n += 1
        shut()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["archive", "path", "n_members"])

    dealt = rows.select(F.col(archive).alias("archive"), F.col(member).alias("member"), F.col(content).cast("binary").alias("content"))
    return dealt.repartition("archive").sortWithinPartitions("archive", "member").mapInArrow(run, "archive string, path string, n_members long")


def json_members(found: DataFrame, schema: StructType | str) -> DataFrame:
    """archive, member and the fields of JSON members; a bad document raises."""
    parsed = F.from_json(F.col("content").cast("string"), schema, {"mode": "FAILFAST"})
    return found.select("archive", "member", parsed.alias("x")).select("archive", "member", "x.*")


def paired_samples(found: DataFrame, n_classes: int, label: str = "cls", media: Sequence[str] = ("jpg", "jpeg", "png", "webp")) -> DataFrame:
    """archive, stem, label, image of samples whose label and picture are members with one stem.

    Samples without one of the two, and labels outside 0 .. n_classes - 1, raise.
    """
    kind = F.lower(F.regexp_extract("member", r"\.([^./]+)$", 1))
    stem = F.regexp_replace("member", r"\.[^./]+$", "")
    rows = found.select("archive", stem.alias("stem"), kind.alias("kind"), "content").where(F.col("kind").isin(label, *media))
    text = F.trim(F.max(F.when(F.col("kind") == label, F.col("content").cast("string"))))
    pairs = rows.groupBy("archive", "stem").agg(text.cast("int").alias("label"), F.max(F.when(F.col("kind") != label, F.col("content"))).alias("image"))
    good = F.col("label").between(0, n_classes - 1) & F.col("image").isNotNull()
    fail = F.raise_error(F.concat(F.lit("bad sample "), F.col("stem"))).cast("int")
    return pairs.withColumn("label", F.when(good, F.col("label")).otherwise(fail))

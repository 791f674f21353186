"""Archives of every kind: ranges read by many tasks, split and large ones, damaged and missing members."""

import io
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrymill.sources import archives


def contents(n=60):
    rng = random.Random(3)
    out = {f"d/{i:03}.bin": rng.randbytes(rng.choice([0, 1, 511, 512, 513, 5_000, 40_000])) for i in range(n)}
    return out | {"d/" + "long" * 60 + ".bin": b"x" * 700, "d/unicode-é.bin": b"y"}  # names that need headers of their own


def tar_bytes(files, mode="w", form=tarfile.PAX_FORMAT):
    data = io.BytesIO()
    with tarfile.open(fileobj=data, mode=mode, format=form) as tar:
        folder = tarfile.TarInfo("d")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        for name, content in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            tar.addfile(info, io.BytesIO(content))
    return data.getvalue()


def whole(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["member"], r["piece"])):
        out[r["member"]] = out.get(r["member"], b"") + bytes(r["content"])
    return out


@pytest.mark.parametrize("kind", ["pax", "gnu", "gz", "bz2", "xz", "zip", "stored"])
def test_every_kind_gives_its_members_in_pieces_and_whole(spark, tmp_path, kind):
    files, path = contents(), tmp_path / ("a.zip" if kind in ("zip", "stored") else "a.tar")
    if kind in ("zip", "stored"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED if kind == "zip" else zipfile.ZIP_STORED) as z:
            z.mkdir("d")
            for name, content in files.items():
                z.writestr(name, content)
    else:
        path.write_bytes(tar_bytes(files, "w" if kind in ("pax", "gnu") else f"w:{kind}", tarfile.GNU_FORMAT if kind == "gnu" else tarfile.PAX_FORMAT))
    index = archives.archive_index(spark, str(path))
    assert {r["member"]: r["size"] for r in index.collect()} == {k: len(v) for k, v in files.items()}
    assert whole(archives.read_members(index).collect()) == files
    pieces = archives.read_members(index, piece_bytes=1000, task_bytes=20_000).withColumn("task", F.spark_partition_id()).collect()
    assert whole(pieces) == files and max(len(r["content"]) for r in pieces) == 1000
    assert len({r["task"] for r in pieces}) == 1 if kind in ("gz", "bz2", "xz") else len({r["task"] for r in pieces}) > 3


@pytest.mark.parametrize("cuts", [[700], [100, 513, 5_000, 5_001, 90_000]])
def test_split_tar_is_one_run_of_bytes(spark, tmp_path, cuts):
    files = contents()
    for mode, name in (("w", "x.tar"), ("w:gz", "y.tar.gz")):
        data = tar_bytes(files, mode)
        ends = [*cuts, len(data)]
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            (tmp_path / f"{name}.part-{k}").write_bytes(data[a:b])
    (tmp_path / "other.tar").write_bytes(tar_bytes({"z": b"1"}))
    index = archives.archive_index(spark, str(tmp_path / "*"))
    by = {r[0].rpartition("/")[2]: r[1] for r in index.groupBy("archive").count().collect()}
    assert by == {"x.tar": len(files), "y.tar.gz": len(files), "other.tar": 1}
    for name in ("x.tar", "y.tar.gz"):
        assert whole(archives.read_members(index.where(F.col("archive").endswith(name))).collect()) == files


def test_names_of_parts():
    names = [f"/d/v.tar.{k}" for k in (10, 9, 8, *range(8))]
    assert archives.split_streams(names) == {"/d/v.tar": [f"/d/v.tar.{k}" for k in range(11)]}
    assert archives.split_streams(["b.tar.ab", "b.tar.aa", "c.tgz", "shard-0001.tar"]) == {"b.tar": ["b.tar.aa", "b.tar.ab"], "c.tgz": ["c.tgz"], "shard-0001.tar": ["shard-0001.tar"]}
    for bad in (["v.tar.0", "v.tar.2"], ["v.tar.part-2", "v.tar.part-3"]):
        with pytest.raises(FileNotFoundError):
            archives.split_streams(bad)
    for bad in (["v.tar", "v.tar.0"], ["v.tar.0", "v.tar.aa"], ["v.tar.0", "v.tar.00"]):
        with pytest.raises(ValueError):
            archives.split_streams(bad)


def test_archive_beyond_two_gigabytes(spark, tmp_path):
    """A file with a hole: a member of 5 GB of zeros between small ones; only what is wanted is read."""
    with open(tmp_path / "large.tar", "wb") as f:
        for name, size, content in (("first", 5, b"first"), ("hole", 5 << 30, None), ("last", 600, b"l" * 600)):
            info = tarfile.TarInfo(name)
            info.size = size
            f.write(info.tobuf(tarfile.GNU_FORMAT))
            f.seek(size, 1) if content is None else f.write(content)
            f.seek(-size % 512, 1)
        f.write(bytes(1024))
    index = archives.archive_index(spark, [str(tmp_path / "large.tar")])
    assert {r["member"]: r["size"] for r in index.collect()} == {"first": 5, "hole": 5 << 30, "last": 600}
    some = archives.selected(index, spark.createDataFrame([("last",), ("first",)], "member string"))
    assert whole(archives.read_members(some).collect()) == {"first": b"first", "last": b"l" * 600}
    hole = archives.read_members(index.where("member = 'hole'"), piece_bytes=1 << 27)
    read = hole.select("piece", F.length("content").alias("n"), F.spark_partition_id().alias("task"))
    assert tuple(read.agg(F.sum("n"), F.count("piece"), F.min(F.col("task") >= 0)).first()) == (5 << 30, 40, True)
    assert read.select("task").distinct().count() > 1


def test_missing_and_damaged(spark, tmp_path):
    files = {"a": b"1" * 3000, "b": b"2" * 3000}
    data = tar_bytes(files)
    (tmp_path / "short.tar").write_bytes(data[: data.index(b"2" * 100) + 50])
    with pytest.raises(Exception, match="unexpected end of data"):
        archives.archive_index(spark, [str(tmp_path / "short.tar")]).collect()
    (tmp_path / "a.tar").write_bytes(data)
    index = archives.archive_index(spark, [str(tmp_path / "a.tar")])
    wanted = spark.createDataFrame([("a",), ("nowhere",)], "member string")
    with pytest.raises(Exception, match="no archive has nowhere"):
        archives.read_members(archives.selected(index, wanted)).collect()
    with pytest.raises(Exception, match="no such archive part"):
        archives.archive_index(spark, [str(tmp_path / "none.tar")]).collect()
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("m", random.Random(1).randbytes(4000))
    raw = bytearray((tmp_path / "z.zip").read_bytes())
    raw[2000] ^= 1
    (tmp_path / "z.zip").write_bytes(raw)
    with pytest.raises(Exception, match="damaged|error"):
        archives.read_members(archives.archive_index(spark, [str(tmp_path / "z.zip")])).collect()
    (tmp_path / "a.tar").write_bytes(data[:2000])  # cut after the index was made
    with pytest.raises(Exception, match="ends within"):
        archives.read_members(index).collect()

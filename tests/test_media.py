"""Pictures walked through to their end: whole ones pass, every cut and (where there are checksums) every changed byte is found."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import media, quality


def segment(mark, body):
    return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body


def jpeg(scan=b"\x12\xff\x00\x34\xff\xd0\x56\xff\xd1\x78", end=b"\xff\xd9"):
    frame = struct.pack(">BHHB", 8, 24, 32, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])
    codes = bytes([0]) + bytes([0, 2] + [0] * 14) + b"\x01\x02"
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + segment(0xDB, bytes(65)) + segment(0xC0, frame) + segment(0xC4, codes) + b"\xff" + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + scan + end


GIF = b"GIF89a" + struct.pack("<HHBBB", 3, 2, 0x80, 0, 0) + bytes(6) + b"!\xf9\x04\0\0\0\0\0" + b"," + struct.pack("<HHHHB", 0, 0, 3, 2, 0) + b"\x02\x03\x84\x1d\x05\0" + b";"
LOSSLESS = b"RIFF\x1a\0\0\0WEBPVP8L\r\0\0\0/\0\0\0\x10\x07\x10\x11\x11\x88\x88\xfe\x07\0"
_VP8 = struct.pack("<I", 1 << 5 | 0x10)[:3] + b"\x9d\x01\x2a" + struct.pack("<HH", 40, 30) + bytes(6)
LOSSY = b"RIFF" + struct.pack("<I", 12 + len(_VP8)) + b"WEBPVP8 " + struct.pack("<I", len(_VP8)) + _VP8
PNG = media.png_of(bytes(range(250)) * 9, 100)


def interlaced():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    sizes = [(-(-(5 - x) // dx), -(-(3 - y) // dy)) for x, y, dx, dy in media.PNG_PASSES]
    lines = b"".join(bytes(1 + 3 * w) * h for w, h in sizes if w > 0 and h > 0)
    return PNG[:8] + chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 3, 8, 2, 0, 0, 1)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", zlib.compress(lines)[:5]) + chunk(b"IDAT", zlib.compress(lines)[5:]) + chunk(b"IEND", b"")


WHOLE = {"png": (PNG, 100, 23), "png of passes": (interlaced(), 5, 3), "jpeg": (jpeg(), 32, 24), "gif": (GIF, 3, 2), "webp": (LOSSY, 40, 30), "webp lossless": (LOSSLESS, 1, 1)}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_pictures_pass_and_every_cut_is_found(name):
    data, width, height = WHOLE[name]
    assert media.check_picture(data) == (name.split()[0], width, height, None, None, None)
    for n in range(len(data)):
        reason, place = media.check_picture(data[:n])[3:5]
        assert reason in ("empty",) if n == 0 else reason in ("truncated", "unknown_format") or name.startswith("webp"), n
        assert reason is not None and place <= len(data)


@pytest.mark.parametrize("name", ["png", "png of passes"])
def test_every_changed_byte_of_a_png_is_found(name):
    data = WHOLE[name][0]
    for n in range(len(data)):
        for bit in (1, 0x80):
            assert media.check_picture(data[:n] + bytes([data[n] ^ bit]) + data[n + 1 :])[3] is not None, n


def test_changed_heads_of_other_formats_are_found():
    for wrong in (jpeg(scan=b"\xff\xd0\x01\xff\xd2"), jpeg(scan=b"\xff\x05"), jpeg().replace(b"\xff\xc4", b"\xff\xc2", 1), b"\xff\xd8\xff\xd9", jpeg(end=b"\xff\xda")):
        assert media.check_picture(wrong)[3] in ("structure", "truncated")
    for data, at in ((GIF, 27), (GIF, len(GIF) - 1), (LOSSLESS, 12), (LOSSLESS, 20), (LOSSY, 23), (LOSSLESS, 4)):
        assert media.check_picture(data[:at] + bytes([data[at] ^ 0x55]) + data[at + 1 :])[3] is not None
    assert media.check_picture(None) == (None,) * 6
    assert media.check_picture(b"plain text")[3] == "unknown_format"
    bomb = PNG[:8] + b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in ((b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(bytes(1 << 22))), (b"IEND", b"")))
    assert "not 2" in media.check_picture(bomb)[5]  # more pixels than the head says


def test_bad_media_rows(spark):
    rows = [(1, [PNG, jpeg()]), (2, [PNG[:90], None]), (3, []), (4, None), (5, [b"", GIF[:-1]])]
    df = spark.createDataFrame(rows, "id long, frames array<binary>").withColumn("key", F.concat(F.lit("k"), "id")).withColumn("path", F.lit("p"))
    found = media.bad_media(df, "frames", "d", "train", "id", "key", "path")
    assert found.columns == ["dataset", "split", "source_key", "frame_unit_key", "reason", "error", "source_path"]
    got = sorted((r["source_key"], r["reason"], r["error"].split(":")[0]) for r in found.collect())
    assert got == [("2", "missing_frame", "frame 1 is null"), ("2", "truncated", "frame 0, byte 41"), ("3", "no_frames", "no frames"), ("4", "no_frames", "no frames"), ("5", "empty", "frame 0, byte 0"), ("5", "truncated", f"frame 1, byte {len(GIF) - 1}")]
    single = media.bad_media(df.select("id", "key", "path", F.get("frames", F.lit(0)).alias("image")), "image", "d", "train", "id", "key", "path")
    assert {r["source_key"] for r in single.collect()} == {"2", "3", "4", "5"}


def test_findings_of_truncated_pictures(spark):
    df = spark.createDataFrame([("s1", [PNG, PNG[:-3]], ["a1", "a2"]), ("s2", [jpeg()], ["a3"])], "sample_id string, images array<binary>, asset_ids array<string>")
    assert quality.broken_media(df, "d").count() == 0  # by the first bytes only
    (found,) = quality.broken_media(df, "d", whole=True).collect()
    assert (found["sample_id"], found["asset_id"]) == ("s1", "a2") and found["message"].startswith("Unreadable media payload at index 1: ")


def test_pictures_that_python_made_are_checked_where_they_were_made(spark):
    made = F.pandas_udf(lambda ids: ids.map(lambda i: [PNG, None, PNG[: 20 + i]]), "array<binary>")
    df = spark.range(3).select("id", made("id").alias("frames"))
    found = media.bad_media(df, "frames", "d", "train", "id", "id", "id")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted((r["source_key"], r["reason"]) for r in found.collect()) == sorted((str(i), x) for i in range(3) for x in ("missing_frame", "truncated"))

"""Structure of pictures, checked without a decoder: every length, checksum and end mark of the file.

A walker goes through a format's parts from the first byte to the last: PNG chunks with
their CRC and the length of what they inflate to, JPEG segments and scans to the end
mark, GIF blocks, WebP chunks. It tells size and format, or what is wrong and where.
A changed byte inside a JPEG scan or a WebP bit stream can go unseen, as these have no
checksum; in a PNG none can.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHECK = "format string, width int, height int, reason string, place long, error string"
INFLATED = 1 << 20


class Damaged(ValueError):
    """reason: empty, unknown_format, truncated, checksum or structure."""

    def __init__(self, reason: str, place: int, what: str):
        super().__init__(what)
        self.reason, self.place = reason, place


def _need(data: memoryview, at: int, n: int, what: str) -> memoryview:
    if at + n > len(data):
        raise Damaged("truncated", at, f"{what} ends after {len(data) - at} of {n} bytes")
    return data[at : at + n]


def _expect(right: bool, at: int, what: str) -> None:
    if not right:
        raise Damaged("structure", at, what)


# Bits that each colour type of a PNG may have, and its channels; where the passes of an interlaced one begin and how they step.
PNG_BITS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
PNG_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png(data: memoryview) -> tuple[int, int]:
    at, width, height, wanted, got = 8, 0, 0, 0, 0
    inflate = zlib.decompressobj()
    while True:
        size, kind = struct.unpack(">I4s", _need(data, at, 8, "a chunk's head"))
        _expect(kind.isalpha() and size < 1 << 31, at, "no chunk begins here")
        body = _need(data, at + 8, size + 4, f"chunk {kind.decode()}")[:size]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise Damaged("checksum", at, f"chunk {kind.decode()} has another checksum")
        _expect((kind == b"IHDR") == (at == 8), at, "IHDR must come first, once")
        if kind == b"IHDR":
            _expect(size == 13, at, "IHDR has another length")
            width, height, bits, colour, packing, filters, interlace = struct.unpack(">IIBBBBB", body)
            _expect(width > 0 and height > 0 and bits in PNG_BITS.get(colour, ()) and packing == filters == 0 and interlace < 2, at, "IHDR has values that no picture has")
            row = lambda w: 1 + (w * bits * PNG_CHANNELS[colour] + 7) // 8  # noqa: E731, B023
            passes = [(-(-(width - x) // dx), -(-(height - y) // dy)) for x, y, dx, dy in PNG_PASSES] if interlace else [(width, height)]
            wanted = sum(h * row(w) for w, h in passes if w > 0 and h > 0)
        elif kind == b"IDAT":
            raw = bytes(body)
            try:
                while raw:
                    got += len(inflate.decompress(raw, INFLATED))
                    raw = inflate.unconsumed_tail
            except zlib.error as e:
                raise Damaged("structure", at, f"pixels can't be inflated: {e}") from None
        elif kind == b"IEND":
            _expect(inflate.eof and got == wanted, at, f"{got} bytes of pixels, not {wanted}")
            return width, height
        at += 12 + size


def _jpeg(data: memoryview) -> tuple[int, int]:
    whole = data.obj
    at, shape, scans = 2, None, 0
    while True:
        _expect(_need(data, at, 1, "the picture")[0] == 0xFF, at, "no segment begins here")
        while _need(data, at + 1, 1, "a marker")[0] == 0xFF:
            at += 1
        mark = data[at + 1]
        if mark == 0xD9:
            _expect(scans > 0, at, "the picture ends before its first scan")
            return shape
        if mark == 0x01:
            at += 2
            continue
        _expect(mark >= 0xC0 and not 0xD0 <= mark <= 0xD8, at, f"marker {mark:02x} can't stand here")
        size = struct.unpack(">H", _need(data, at + 2, 2, "a segment's length"))[0]
        _expect(size >= 2, at, "a segment has no length")
        body = _need(data, at + 4, size - 2, f"segment {mark:02x}")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            _expect(len(body) >= 6 and len(body) == 6 + 3 * body[5] and body[5] > 0, at, "a frame's head has another length")
            shape = struct.unpack(">HH", body[1:5])[::-1]
            _expect(shape[0] > 0, at, "a frame has no width")
        elif mark == 0xC4:
            place = 0
            while place < len(body):
                _expect(place + 17 <= len(body), at, "a table of codes ends early")
                place += 17 + sum(body[place + 1 : place + 17])
            _expect(place == len(body), at, "a table of codes has another length")
        elif mark == 0xDB:
            place = 0
            while place < len(body):
                place += 129 if body[place] >> 4 else 65
            _expect(place == len(body), at, "a table of steps has another length")
        at += 2 + size
        if mark == 0xDA:
            _expect(shape is not None and len(body) >= 1 and len(body) == 4 + 2 * body[0], at, "a scan without a frame, or with another length")
            scans, turn = scans + 1, None
            while True:
                at = whole.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    raise Damaged("truncated", len(data), "a scan has no end mark")
                after = data[at + 1]
                if 0xD0 <= after <= 0xD7:
                    _expect(turn is None or after == 0xD0 + (turn + 1) % 8, at, "restart marks out of turn")
                    turn = after - 0xD0
                elif after not in (0x00, 0xFF):
                    break
                at += 1 if after == 0xFF else 2


def _blocks(data: memoryview, at: int) -> int:
    while size := _need(data, at, 1, "a block")[0]:
        _need(data, at + 1, size, "a block")
        at += 1 + size
    return at + 1


def _gif(data: memoryview) -> tuple[int, int]:
    width, height, flags = struct.unpack("<HHB", _need(data, 6, 7, "the screen's head")[:5])
    at, frames = 13 + (3 << (flags & 7) + 1 if flags & 0x80 else 0), 0
    while True:
        kind = _need(data, at, 1, "the picture")[0]
        if kind == 0x3B:
            _expect(frames > 0 and width > 0 and height > 0, at, "there is no frame")
            return width, height
        if kind == 0x2C:
            flags = _need(data, at, 10, "a frame's head")[9]
            at += 10 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
            _expect(2 <= _need(data, at, 1, "a frame")[0] <= 11, at, "codes of a frame have another size")
            at, frames = _blocks(data, at + 1), frames + 1
        else:
            _expect(kind == 0x21, at, "no block begins here")
            _need(data, at, 2, "an extension")
            at = _blocks(data, at + 2)


def _webp(data: memoryview) -> tuple[int, int]:
    end = 8 + struct.unpack("<I", _need(data, 4, 4, "the container's head"))[0]
    _need(data, 0, end, "the container")
    at, shape, canvas = 12, None, None
    while at < end:
        kind, size = struct.unpack("<4sI", _need(data[:end], at, 8, "a chunk's head"))
        body = _need(data[:end], at + 8, size, f"chunk {bytes(kind)!r}")
        if kind == b"VP8X":
            _expect(size == 10, at, "VP8X has another length")
            canvas = tuple(1 + int.from_bytes(body[k : k + 3], "little") for k in (4, 7))
        elif kind == b"ANMF":
            _expect(size > 24, at, "a frame is too short")
            shape = shape or tuple(1 + int.from_bytes(body[k : k + 3], "little") for k in (6, 9))
        elif kind == b"VP8 ":
            _expect(size >= 10 and bytes(body[3:6]) == b"\x9d\x01\x2a", at, "a key frame has no start code")
            first = int.from_bytes(body[:3], "little")
            _expect(not first & 1 and first >> 5 <= size - 10, at, "the first partition is larger than the frame")
            shape = tuple(x & 0x3FFF for x in struct.unpack("<HH", body[6:10]))
        elif kind == b"VP8L":
            _expect(size >= 5 and body[0] == 0x2F, at, "a lossless frame has no signature")
            bits = int.from_bytes(body[1:5], "little")
            _expect(bits >> 29 == 0, at, "a lossless frame of an unknown version")
            shape = 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        at += 8 + size + size % 2
    _expect(shape is not None and min(shape) > 0, at, "there is no frame")
    return canvas or shape


FORMATS: tuple[tuple[str, bytes, Callable[[memoryview], tuple[int, int]]], ...] = (("png", b"\x89PNG\r\n\x1a\n", _png), ("jpeg", b"\xff\xd8", _jpeg), ("gif", b"GIF87a", _gif), ("gif", b"GIF89a", _gif), ("webp", b"RIFF", _webp))


def check_picture(data: bytes | None) -> tuple[str | None, int | None, int | None, str | None, int | None, str | None]:
    """(format, width, height, reason, place, error); the last three are null for a picture that is whole, all six for null."""
    if data is None:
        return (None,) * 6
    name = None
    try:
        if not data:
            raise Damaged("empty", 0, "no bytes")
        for name, magic, walk in FORMATS:  # noqa: B007
            if data.startswith(magic) and (name != "webp" or data[8:12] == b"WEBP"):
                return (name, *walk(memoryview(data)), None, None, None)
        name = None
        if any(m.startswith(data) for _, m, _ in FORMATS):
            raise Damaged("truncated", len(data), "the signature ends early")
        raise Damaged("unknown_format", 0, "no known signature")
    except Damaged as e:
        return name, None, None, e.reason, e.place, str(e)


def _checked(pictures: pd.Series) -> pd.DataFrame:
    rows = [check_picture(None if p is None else bytes(p)) for p in pictures]
    return pd.DataFrame(rows, columns=["format", "width", "height", "reason", "place", "error"]).astype({"width": "Int32", "height": "Int32", "place": "Int64"})


def picture_check(picture: Column) -> Column:
    """What check_picture says of a column of bytes: a struct of CHECK."""
    return F.pandas_udf(_checked, CHECK)(picture.cast("binary"))


def _checked_arrays(units: pd.Series) -> pd.Series:
    names = [x.split()[0] for x in CHECK.split(", ")]
    one = lambda p: None if p is None else dict(zip(names, check_picture(bytes(p)), strict=True))
    return units.map(lambda pictures: None if pictures is None else [one(p) for p in pictures])


def bad_media(df: DataFrame, media: str, dataset: str, split: str, source_key: str, frame_unit_key: str, source_path: str, keep: Sequence[str] = ()) -> DataFrame:
    """dataset, split, source_key, frame_unit_key, reason, error, source_path of each picture, single or in an array, that isn't whole.

    The error tells the place in the array and in the picture; nulls in an array count as missing frames, an
    empty array and a null field as a unit without frames.
    """
    kind = dict(df.dtypes)[media]
    many = F.col(media) if kind.startswith("array") else F.when(F.col(media).isNotNull(), F.array(media))
    names = dict.fromkeys([source_key, frame_unit_key, source_path, *keep])
    # Arrays are checked whole: no picture goes back to Spark, and pictures that Python made stay in the worker that made them.
    checked = df.select(*names, F.pandas_udf(_checked_arrays, f"array<struct<{CHECK.replace(' ', ':').replace(',:', ',')}>>")(many.cast("array<binary>")).alias("__checks"))
    rows = checked.select(*names, F.posexplode_outer("__checks").alias("__at", "__check"))
    c = F.col("__check")
    reason = F.when(F.col("__at").isNull(), "no_frames").when(c.isNull(), "missing_frame").otherwise(c["reason"])
    error = F.when(c["reason"].isNotNull(), F.concat(F.lit("frame "), F.col("__at"), F.lit(", byte "), c["place"], F.lit(": "), c["error"])).otherwise(F.coalesce(F.concat(F.lit("frame "), F.col("__at"), F.lit(" is null")), F.lit("no frames")))
    text = lambda x: F.col(x).cast("string")
    out = rows.withColumn("reason", reason).where("reason IS NOT NULL")
    return out.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), text(source_key).alias("source_key"), text(frame_unit_key).alias("frame_unit_key"), "reason", error.alias("error"), text(source_path).alias("source_path"), *keep)


def png_of(rows: bytes, width: int) -> bytes:
    """A grey PNG of rows of width bytes; the last row is filled up with zeros."""
    height = max(1, -(-len(rows) // width))
    rows = rows.ljust(height * width, b"\0")
    lines = b"".join(b"\0" + rows[k : k + width] for k in range(0, len(rows), width))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return FORMATS[0][1] + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")

"""Containers of videos read without a decoder: MP4 boxes, Matroska elements, AVI chunks.

A walker reads the container's tree and tells size, rate, how many frames there are and
which are key frames, or what is wrong and where. Contents of frames are skipped.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .media import Damaged, _expect, _need

PROBE = "format string, width int, height int, frames long, fps double, duration double, keyframes array<bigint>, reason string, place long, error string"
Probe = tuple[int, int, int, float, float, list[int]]


def _boxes(data: memoryview, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, begin, end) of the contents of each MP4 box."""
    while at < end:
        size, kind = struct.unpack(">I4s", _need(data[:end], at, 8, "a box's head"))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", _need(data[:end], at + 8, 8, "a box's head"))[0], 16
        size = size or end - at
        _expect(size >= head, at, "a box is shorter than its head")
        _need(data[:end], at, size, f"box {bytes(kind)!r}")
        yield bytes(kind), at + head, at + size
        at += size


def _full(data: memoryview, a: int, b: int, layout: str) -> tuple:
    """Fields of a box with version and flags, which come first."""
    return struct.unpack(f">I{layout}", _need(data[:b], a, struct.calcsize(f">I{layout}"), "a box"))


def _mp4(data: memoryview) -> Probe:
    tracks: dict[int, dict] = {}
    fragments: dict[int, list[tuple[int, int]]] = {}
    defaults: dict[int, int] = {}

    def track(a: int, b: int) -> None:
        t: dict = {"kind": b"", "stts": [], "stss": None, "size": None, "scale": 0, "shape": (0, 0), "id": 0}
        todo = [(a, b)]
        while todo:
            for kind, x, y in _boxes(data, *todo.pop()):
                if kind in (b"mdia", b"minf", b"stbl"):
                    todo.append((x, y))
                elif kind == b"tkhd":
                    long = data[x] == 1
                    t["id"] = struct.unpack(">I", _need(data[:y], x + (20 if long else 12), 4, "a track's head"))[0]
                    t["shape"] = tuple(v >> 16 for v in struct.unpack(">II", _need(data[:y], y - 8, 8, "a track's head")))
                elif kind == b"mdhd":
                    t["scale"] = struct.unpack(">I", _need(data[:y], x + (20 if data[x] == 1 else 12), 4, "a medium's head"))[0]
                elif kind == b"hdlr":
                    t["kind"] = bytes(_need(data[:y], x + 8, 4, "a handler"))
                elif kind in (b"stts", b"stss"):
                    n = _full(data, x, y, "I")[1]
                    width = 2 if kind == b"stts" else 1
                    values = struct.unpack(f">{width * n}I", _need(data[:y], x + 8, 4 * width * n, "a table of samples"))
                    t[kind.decode()] = list(zip(values[::2], values[1::2], strict=True)) if width == 2 else [v - 1 for v in values]
                elif kind == b"stsz":
                    t["size"] = _full(data, x, y, "II")[2]
        tracks[t["id"]] = t

    def fragment(a: int, b: int) -> None:
        number = step = 0
        for kind, x, y in _boxes(data, a, b):
            flags = struct.unpack(">I", _need(data[:y], x, 4, "a box"))[0] & 0xFFFFFF if kind in (b"tfhd", b"trun") else 0
            if kind == b"tfhd":
                number = _full(data, x, y, "I")[1]
                at = x + 8 + 8 * bool(flags & 1) + 4 * bool(flags & 2)
                step = struct.unpack(">I", _need(data[:y], at, 4, "a fragment's head"))[0] if flags & 8 else defaults.get(number, 0)
            elif kind == b"trun":
                n = _full(data, x, y, "I")[1]
                at, each = x + 8 + 4 * bool(flags & 1) + 4 * bool(flags & 4), 4 * bin(flags & 0xF00).count("1")
                _need(data[:y], at, n * each, "a run of samples")
                steps = sum(struct.unpack(">I", data[at + k * each : at + k * each + 4])[0] for k in range(n)) if flags & 0x100 else n * step
                fragments.setdefault(number, []).append((n, steps))

    top, open_ = {}, False
    for kind, a, b in _boxes(data, 0, len(data)):
        top[kind] = True
        open_ = kind == b"moof" or open_ and kind != b"mdat"
        if kind == b"moov":
            for inner, x, y in _boxes(data, a, b):
                if inner == b"trak":
                    track(x, y)
                elif inner == b"mvex":
                    for kind2, p, q in _boxes(data, x, y):
                        if kind2 == b"trex":
                            number, _, step = _full(data, p, q, "III")[1:]
                            defaults[number] = step
        elif kind == b"moof":
            for inner, x, y in _boxes(data, a, b):
                if inner == b"traf":
                    fragment(x, y)
    if open_:
        raise Damaged("truncated", len(data), "a fragment has no samples")
    _expect(b"moov" in top and (b"mdat" in top or b"moof" in top), len(data), "the tables or the samples are missing")
    found = next((t for t in tracks.values() if t["kind"] == b"vide"), None)
    _expect(found is not None, 0, "there is no video track")
    frames, steps = sum(n for n, _ in found["stts"]), sum(n * d for n, d in found["stts"])
    _expect(found["size"] in (None, frames), 0, f"{found['size']} samples have sizes, {frames} have times")
    keys = found["stss"] if found["stss"] is not None else list(range(frames))
    for n, d in fragments.get(found["id"], []):
        keys = [*keys, frames]  # a fragment begins with a key frame
        frames, steps = frames + n, steps + d
    _expect(all(0 <= k < frames for k in keys), 0, "a key frame that isn't there")
    seconds = steps / found["scale"] if found["scale"] else 0.0
    return (*found["shape"], frames, frames / seconds if seconds else 0.0, seconds, keys)


def _avi(data: memoryview) -> Probe:
    shape, rate, scale, video, number, frames, keys, indexed = (0, 0), 0, 1, None, -1, 0, [], False

    def walk(at: int, end: int) -> None:
        nonlocal shape, rate, scale, video, number, frames, indexed
        while at + 8 <= end:
            kind, size = struct.unpack("<4sI", _need(data[:end], at, 8, "a chunk's head"))
            body = at + 8
            _need(data[:end], body, size, f"chunk {bytes(kind)!r}")
            if kind in (b"RIFF", b"LIST"):
                walk(body + 4, body + size)
            elif kind == b"avih":
                shape = struct.unpack("<II", _need(data[:end], body + 32, 8, "the main head"))
            elif kind == b"strh":
                number += 1
                if bytes(_need(data[:end], body, 4, "a stream's head")) == b"vids" and video is None:
                    video = number
                    scale, rate = struct.unpack("<II", _need(data[:end], body + 20, 8, "a stream's head"))
            elif video is not None and bytes(kind[:2]) == b"%02d" % video and bytes(kind[2:]) in (b"dc", b"db"):
                frames += 1
            elif kind == b"idx1":
                indexed, place = True, 0
                for k in range(0, size - 15, 16):
                    name, flags = struct.unpack("<4sI", data[body + k : body + k + 8])
                    if video is not None and bytes(name[:2]) == b"%02d" % video:
                        if flags & 0x10:
                            keys.append(place)
                        place += 1
                _expect(place == frames, at, f"{place} frames in the index, {frames} in the file")
            at = body + size + size % 2

    walk(0, len(data))
    _expect(video is not None and frames > 0, len(data), "there is no video stream")
    fps = rate / scale if scale else 0.0
    return (*shape, frames, fps, frames / fps if fps else 0.0, keys if indexed else list(range(frames)))


# Elements of Matroska that hold others.
_HOLD = {0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0xAE, 0xE0, 0xA0}


def _number(data: memoryview, at: int, keep: bool) -> tuple[int, int, bool]:
    """(value, bytes, all ones) of a number of variable length; keep: with its length mark, as in ids."""
    first = _need(data, at, 1, "an element")[0]
    _expect(first > 0, at, "no element begins here")
    n = 9 - first.bit_length()
    whole = int.from_bytes(_need(data, at, n, "an element's head"), "big")
    bare = whole & ((1 << 7 * n) - 1)
    return whole if keep else bare, n, bare == (1 << 7 * n) - 1


def _matroska(data: memoryview) -> Probe:
    at, unit, length, tracks, now, cluster, times, keys, block = 0, 1_000_000, 0.0, {}, {}, 0, [], [], None
    video = None
    while at < len(data):
        begin = at
        kind, n, _ = _number(data, at, True)
        size, m, unknown = _number(data, at + n, False)
        at += n + m
        if not unknown:
            _need(data, at, size, f"element {kind:x}")
        if kind in _HOLD:
            _expect(not unknown or kind in (0x18538067, 0x1F43B675), begin, "an element without a size")
            now = {} if kind == 0xAE else now
            block = None if kind in (0xA0, 0x1F43B675) else block
            continue
        _expect(not unknown, begin, "an element without a size")
        body = data[at : at + size]
        value = int.from_bytes(body, "big") if size <= 8 else 0
        if kind == 0x2AD7B1:
            unit = value
        elif kind == 0x4489:
            length = struct.unpack(">f" if size == 4 else ">d", body)[0]
        elif kind in (0xD7, 0x83, 0x23E383, 0xB0, 0xBA):
            now[kind] = value
            if 0xD7 in now:
                tracks[now[0xD7]] = now
        elif kind == 0xE7:
            cluster = value
        elif kind in (0xA3, 0xA1):
            video = video if video is not None else next((k for k, t in tracks.items() if t.get(0x83) == 1), None)
            owner, k, _ = _number(body, 0, False)
            if owner == video:
                offset, flags = struct.unpack(">hB", _need(body, k, 3, "a block's head"))
                times.append(cluster + offset)
                if kind == 0xA1:
                    block = len(times) - 1
                    keys.append(block)  # a key frame unless it refers to another
                elif flags & 0x80:
                    keys.append(len(times) - 1)
        elif kind == 0xFB and block is not None and keys and keys[-1] == block:
            keys.pop()
        at += size
    found = tracks.get(video)
    _expect(found is not None and bool(times), len(data), "there is no video track, or no frame")
    span = (max(times) - min(times)) * unit / 1e9
    fps = 1e9 / found[0x23E383] if found.get(0x23E383) else (len(times) - 1) / span if span else 0.0
    seconds = length * unit / 1e9 if length else len(times) / fps if fps else 0.0
    return found.get(0xB0, 0), found.get(0xBA, 0), len(times), fps, seconds, keys


def probe(data: bytes | None) -> tuple:
    """The values of PROBE; the last three are null for a container that is whole, all for null. A rate that isn't told is 1."""
    if data is None:
        return (None,) * 10
    name = None
    try:
        if not data:
            raise Damaged("empty", 0, "no bytes")
        view = memoryview(data)
        if data[4:8] == b"ftyp":
            name, walk = "mp4", _mp4
        elif data[:4] == b"RIFF" and data[8:12] == b"AVI ":
            name, walk = "avi", _avi
        elif data[:4] == b"\x1a\x45\xdf\xa3":
            name, walk = "matroska", _matroska
        else:
            raise Damaged("unknown_format", 0, "no known container")
        width, height, frames, fps, seconds, keys = walk(view)
        return name, width, height, frames, fps if fps > 0 else 1.0, seconds, keys, None, None, None
    except Damaged as e:
        return name, None, None, None, None, None, None, e.reason, e.place, str(e)


def _probed(videos: pd.Series) -> pd.DataFrame:
    names = [x.split()[0] for x in PROBE.split(", ")]
    rows = [probe(None if v is None else bytes(v)) for v in videos]
    return pd.DataFrame(rows, columns=names).astype({"width": "Int32", "height": "Int32", "frames": "Int64", "place": "Int64"})


def probe_video(video: Column) -> Column:
    """What probe says of a column of bytes: a struct of PROBE."""
    return F.pandas_udf(_probed, PROBE)(video.cast("binary"))


def seek_plan(indices: Column, keyframes: Column) -> Column:
    """For each frame that is wanted (index), the key frame from which decoding has to begin (from). keyframes: a column that is there, not a call of probe_video."""
    begin = lambda i: F.coalesce(F.array_max(F.filter(keyframes, lambda k: k <= i)), F.lit(0).cast("long"))
    return F.transform(indices, lambda i: F.struct(i.alias("index"), begin(i).alias("from")))


def bad_videos(df: DataFrame, video: str, dataset: str, split: str, source_key: str, frame_unit_key: str, source_path: str, keep: Sequence[str] = ()) -> DataFrame:
    """dataset, split, source_key, frame_unit_key, reason, error, source_path of each video that is null or not whole."""
    rows = df.select(*dict.fromkeys([source_key, frame_unit_key, source_path, *keep]), probe_video(F.col(video)).alias("__p"), F.col(video).isNull().alias("__none"))
    text = lambda x: F.col(x).cast("string")
    out = rows.withColumn("reason", F.when(F.col("__none"), "no_video").otherwise(F.col("__p.reason"))).where("reason IS NOT NULL")
    error = F.coalesce(F.concat(F.lit("byte "), F.col("__p.place"), F.lit(": "), F.col("__p.error")), F.lit("no video"))
    return out.select(F.lit(dataset).alias("dataset"), F.lit(split).alias("split"), text(source_key).alias("source_key"), text(frame_unit_key).alias("frame_unit_key"), "reason", error.alias("error"), text(source_path).alias("source_path"), *keep)


def avi_of(frames: Sequence[bytes], rate: int, every: int, width: int = 16, height: int = 16) -> bytes:
    """An AVI of frames as they are, each `every`-th a key frame."""
    chunk = lambda kind, body: kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    main = struct.pack("<10I16x", 1_000_000 // rate, 0, 0, 0x10, len(frames), 0, 1, 0, width, height)
    stream = b"vids" + struct.pack("<4xIHHIIIIIIII8x", 0, 0, 0, 0, 1, rate, 0, len(frames), 0, 0, 0)
    head = b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream))
    body, index, at = b"movi", b"", 4
    for k, frame in enumerate(frames):
        body += chunk(b"00dc", frame)
        index += b"00dc" + struct.pack("<III", 0 if k % every else 0x10, at, len(frame))
        at = len(body)
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", head) + chunk(b"LIST", body) + chunk(b"idx1", index))

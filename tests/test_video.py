"""Video containers made by hand: what they say, and every cut of them."""

import struct

import pytest
from pyspark.sql import functions as F

from quarrymill.operators import video
from quarrymill.plans.catalogue import QUERIES


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, layout, *values, version=0, flags=0):
    return box(kind, struct.pack(">I" + layout, version << 24 | flags, *values))


def track(number, handler, samples, keys=None, scale=600, shape=(64, 48), sizes=None):
    tkhd = box(b"tkhd", struct.pack(">I5I", 0, 0, 0, number, 0, 0) + bytes(52) + struct.pack(">II", shape[0] << 16, shape[1] << 16))
    stts = full(b"stts", f"I{2 * len(samples)}I", len(samples), *[v for s in samples for v in s])
    stss = full(b"stss", f"I{len(keys)}I", len(keys), *[k + 1 for k in keys]) if keys is not None else b""
    n = sum(s[0] for s in samples) if sizes is None else sizes
    stbl = box(b"stbl", stts, stss, full(b"stsz", "II", 7, n))
    return box(b"trak", tkhd, box(b"mdia", full(b"mdhd", "4I", 0, 0, scale, 0), full(b"hdlr", "I4s", 0, handler), box(b"minf", stbl)))


SOUND = track(1, b"soun", [(99, 10)])
MP4 = box(b"ftyp", b"isom") + box(b"moov", SOUND, track(2, b"vide", [(5, 20), (5, 40)], [0, 4, 8])) + box(b"mdat", bytes(70))
LATE = box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"mdat", 16 + 30) + bytes(30) + box(b"moov", track(1, b"vide", [(6, 25)], scale=25 * 25))
FRAGMENTED = (
    box(b"ftyp", b"iso5") + box(b"moov", track(3, b"vide", [], [], scale=100), box(b"mvex", full(b"trex", "5I", 3, 1, 4, 0, 0)))
    + b"".join(box(b"moof", box(b"traf", full(b"tfhd", "I", 3), full(b"trun", f"I{n}I", n, *[9] * n, flags=0x200))) + box(b"mdat", bytes(9 * n)) for n in (10, 5))
)


def element(kind, body, size=None):
    head = kind.to_bytes((kind.bit_length() + 7) // 8, "big")
    return head + (b"\x01" + len(body).to_bytes(7, "big") if size is None else size) + body


def matroska(unknown=False):
    whole = b"\x01" + b"\xff" * 7 if unknown else None
    info = element(0x1549A966, element(0x2AD7B1, (1_000_000).to_bytes(3, "big")) + element(0x4489, struct.pack(">d", 400.0)))
    entry = lambda number, kind, more=b"": element(0xAE, element(0xD7, bytes([number])) + element(0x83, bytes([kind])) + more)
    tracks = element(0x1654AE6B, entry(1, 2) + entry(2, 1, element(0xE0, element(0xB0, b"\x01\x40") + element(0xBA, b"\xf0"))))
    block = lambda number, at, flags: bytes([0x80 | number]) + struct.pack(">hB", at, flags) + b"frame"
    group = lambda at, refers: element(0xA0, element(0xA1, block(2, at, 0)) + (element(0xFB, b"\x01") if refers else b""))
    first = element(0x1F43B675, element(0xE7, b"\0") + element(0xA3, block(2, 0, 0x80)) + element(0xA3, block(1, 10, 0x80)) + element(0xA3, block(2, 40, 0)), whole)
    second = element(0x1F43B675, element(0xE7, b"\x50") + group(0, False) + group(40, True), whole)
    return element(0x1A45DFA3, element(0x4282, b"webm")) + element(0x18538067, info + tracks + first + second, whole)


AVI = video.avi_of([b"abc", b"de", b"f", b"ghij", b"k"], 25, 2)
WHOLE = {
    "mp4": (MP4, "mp4", 64, 48, 10, 20.0, 0.5, [0, 4, 8]), "mp4 tables last": (LATE, "mp4", 64, 48, 6, 25.0, 0.24, list(range(6))), "mp4 fragments": (FRAGMENTED, "mp4", 64, 48, 15, 25.0, 0.6, [0, 10]),
    "matroska": (matroska(), "matroska", 320, 240, 4, 25.0, 0.4, [0, 2]), "matroska of unknown sizes": (matroska(True), "matroska", 320, 240, 4, 25.0, 0.4, [0, 2]), "avi": (AVI, "avi", 16, 16, 5, 25.0, 0.2, [0, 2, 4]),
}


@pytest.mark.parametrize("name", WHOLE)
def test_whole_containers_and_their_cuts(name):
    data, *want = WHOLE[name]
    got = video.probe(data)
    assert got[7:] == (None, None, None), got
    assert list(got[:4]) == want[:4] and got[6] == want[6] and got[4:6] == (pytest.approx(want[4]), pytest.approx(want[5]))
    for n in range(len(data)):
        cut = video.probe(data[:n])
        if cut[7] is None:  # only whole boxes or clusters of a stream that has no end may go unseen
            assert name in ("mp4 fragments", "matroska of unknown sizes") and cut[3] < got[3], n


def test_damaged_tables():
    assert video.probe(None) == (None,) * 10 and video.probe(b"")[7] == "empty" and video.probe(b"plain text of some length")[7] == "unknown_format"
    other = box(b"ftyp", b"isom") + box(b"moov", track(1, b"vide", [(5, 20)], sizes=6)) + box(b"mdat")
    assert video.probe(other)[7] == "structure" and "6 samples have sizes" in video.probe(other)[9]
    assert video.probe(box(b"ftyp", b"isom") + box(b"moov", SOUND) + box(b"mdat"))[7] == "structure"
    assert video.probe(box(b"ftyp", b"isom") + box(b"moov", track(1, b"vide", [(5, 20)], [7])) + box(b"mdat"))[9] == "a key frame that isn't there"
    assert video.probe(AVI.replace(b"00dc", b"00dx", 1))[7] == "structure"
    still = box(b"ftyp", b"isom") + box(b"moov", track(1, b"vide", [(1, 0)])) + box(b"mdat")
    assert video.probe(still)[3:6] == (1, 1.0, 0.0)  # a rate that isn't told is 1


def test_bad_videos_and_where_to_seek(spark):
    df = spark.createDataFrame([("a", MP4), ("b", MP4[:-5]), ("c", None), ("d", AVI)], "k string, video binary").withColumn("path", F.concat(F.lit("p/"), "k"))
    got = {(r["source_key"], r["reason"], r["error"].split(":")[0]) for r in video.bad_videos(df, "video", "d", "train", "k", "k", "path").collect()}
    assert got == {("b", "truncated", f"byte {len(MP4) - 78}"), ("c", "no_video", "no video")}
    keys = df.where("k = 'a'").select(video.probe_video(F.col("video"))["keyframes"].alias("keys"))
    found = keys.select(video.seek_plan(F.array(*[F.lit(i).cast("long") for i in (0, 3, 4, 9)]), F.col("keys")).alias("s")).first()["s"]
    assert [(x["index"], x["from"]) for x in found] == [(0, 0), (3, 0), (4, 4), (9, 8)]


def test_work_on_rows_of_one_small_file_is_spread(spark):
    found = QUERIES["video_probe"](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= 4

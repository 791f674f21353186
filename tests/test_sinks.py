"""Sinks: one pass, checked before they count, files of bounded size."""

import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarrymill.sources import files, sinks


def sizes(path):
    return {f: os.path.getsize(f"{path}/{f}") for f in sorted(os.listdir(path)) if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(2)
    data = [(i, rng.randbytes(rng.choice([0, 10, 3_000, 20_000])), [rng.random()] * (i % 3), {"k": "v" * (i % 5)}, (i, None)) for i in range(600)]
    data[77] = (77, rng.randbytes(300_000), None, None, None)  # larger than a file may be
    rng.shuffle(data)
    return spark.createDataFrame(data, "id long, body binary, a array<double>, m map<string,string>, s struct<x: long, y: string>").repartition(5)


@pytest.mark.parametrize("cap", [60_000, 200_000])
def test_no_file_is_above_the_cap_and_names_follow_the_order(spark, rows, tmp_path, cap):
    path = str(tmp_path / "t")
    sinks.write_bounded(rows, path, cap, ["id"])
    held = {f: pq.read_table(f"{path}/{f}").column("id").to_pylist() for f in sizes(path)}
    assert [i for ids in held.values() for i in ids] == list(range(600))
    above = [f for f, n in sizes(path).items() if n > cap]
    assert [held[f] for f in above] == [[77]]
    assert len(held) <= 2.2 * sum(sizes(path).values()) / cap + 8  # files are filled, but for the last of each range and those before large rows
    assert spark.read.parquet(path).orderBy("id").collect() == rows.orderBy("id").collect()
    with pytest.raises(FileExistsError):
        sinks.write_bounded(rows, path, cap)


def test_bounded_without_order_empty_and_appended(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_bounded(rows.where("id <> 77"), path, 100_000)
    assert max(sizes(path).values()) <= 100_000 and spark.read.parquet(path).count() == 599
    sinks.write_bounded(rows.where("id = 77"), path, 400_000, mode="append")
    assert spark.read.parquet(path).count() == 600
    sinks.write_bounded(rows.where("false"), str(tmp_path / "none"), 100_000)
    assert spark.read.parquet(str(tmp_path / "none")).columns == rows.columns
    with pytest.raises(ValueError, match="too few"):
        sinks.write_bounded(rows, str(tmp_path / "u"), 1000)
    assert not os.path.exists(tmp_path / "u")


def read_once(spark, tmp_path, name="once"):
    """Rows that leave a mark each time they are read."""
    mark = str(tmp_path / name)

    def run(batches):
        for batch in batches:
            with open(mark, "a") as f:
                f.write(f"{batch.num_rows}\n")
            yield batch

    return spark.range(100).repartition(1).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS s").mapInArrow(run, "id long, s string"), lambda: sum(map(int, open(mark).read().split()))


def test_guarded_sinks_read_their_input_once(spark, tmp_path):
    df, n = read_once(spark, tmp_path)
    assert sinks.write_guarded(df, str(tmp_path / "t"), "s", ["a", "b"]) == {"": 100, "a": 34, "b": 66}
    assert n() == 100
    assert spark.read.parquet(str(tmp_path / "t")).groupBy("s").count().orderBy("s").collect() == [("a", 34), ("b", 66)]
    df, n = read_once(spark, tmp_path, "again")
    files.write_nonempty(df, str(tmp_path / "u"))
    assert n() == 100


def test_what_was_there_stays_when_a_check_fails(spark, tmp_path):
    df, path = spark.range(10).selectExpr("id", "'x' AS s"), str(tmp_path / "t")
    files.write_nonempty(df, path)
    with pytest.raises(ValueError, match="no rows"):
        files.write_nonempty(df.where("false"), path)
    with pytest.raises(ValueError, match=r"no rows for \['y', 'z'\]"):
        sinks.write_guarded(df, path, "s", ["z", "x", "y"], mode="overwrite")
    with pytest.raises(FileExistsError):
        sinks.write_guarded(df, path)
    with pytest.raises(ValueError):
        sinks.write_guarded(df, path, mode="other")
    assert spark.read.parquet(path).count() == 10 and os.listdir(tmp_path) == ["t"]
    files.write_nonempty(df, path, append=True)
    files.write_nonempty(df.withColumn("id", F.col("id") + 100), path, append=True)
    assert spark.read.parquet(path).count() == 30
    fan = str(tmp_path / "fan")
    for _ in range(2):
        sinks.write_guarded(df, fan, "s", ["x"], mode="append")
    assert spark.read.parquet(fan).where("s = 'x'").count() == 20


def test_guarded_and_bounded_at_once(spark, rows, tmp_path):
    path = str(tmp_path / "t")
    tagged = rows.where("id <> 77").withColumn("source", F.concat(F.lit("s"), F.col("id") % 3))
    assert sinks.write_guarded(tagged, path, "source", ["s0", "s1", "s2"], max_bytes=80_000, order=["id"]) == {"": 599, "s0": 200, "s1": 200, "s2": 199}
    for s in range(3):
        at = f"{path}/source=s{s}"
        assert max(sizes(at).values()) <= 80_000
        assert [i for f in sizes(at) for i in pq.read_table(f"{at}/{f}", partitioning=None).column("id").to_pylist()] == [i for i in range(s, 600, 3) if i != 77]
    with pytest.raises(ValueError, match=r"no rows for \['s9'\]"):
        sinks.write_guarded(tagged, str(tmp_path / "v"), "source", ["s9"], max_bytes=80_000)

"""Conditions on keys, flattening and lookups routed by source."""

import pytest

from quarrymill.operators import lookup


def test_conditions_on_keys_select_just_those_rows(spark):
    texts = ["plain", "it's", "back\\slash", "new\nline", "100%", "\\'", "", "ünï"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, `odd ``name` string")
    for t in texts:
        assert [r[1] for r in df.where(lookup.key_condition("odd `name", [t])).collect()] == [t]
    assert {r[1] for r in df.where(lookup.key_condition("odd `name", texts[:3] * 2)).collect()} == set(texts[:3])
    assert [r["i"] for r in df.where(lookup.key_condition("i", [3, 1 << 40])).collect()] == [3]
    assert lookup.key_condition("x", [True]) == "`x` = TRUE" and lookup.key_condition("x", [0.5, 2.0]) == "`x` IN (0.5D, 2.0D)"
    for bad in (None, float("nan"), float("inf"), b"x", [1]):
        with pytest.raises(TypeError):
            lookup.key_condition("x", [bad])
    with pytest.raises(ValueError):
        lookup.key_condition("x", [])
    scan = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").where(lookup.key_condition("o_orderkey", [5, 7]))
    assert "In(o_orderkey, [5,7])" in scan._jdf.queryExecution().executedPlan().toString()  # reaches the scan


def test_flatten_refuses_names_that_a_row_has(spark):
    df = spark.createDataFrame([(1, ("a", 2))], "id long, s struct<x: string, y: int>")
    assert lookup.flatten(df, {"x": "s.x", "z": "s.y"}, keep=["id"]).collect() == [(1, "a", 2)]
    with pytest.raises(ValueError, match="collide"):
        lookup.flatten(df, {"ID": "s.x"}, keep=["id"])


def test_routed_lookup(spark):
    rows = spark.createDataFrame([(1, "a", 10), (2, "b", 10), (3, "a", 11), (4, "c", 10), (5, "a", None), (6, None, 10)], "i long, src string, k long")
    a, b = spark.createDataFrame([(10, "a10"), (11, "a11"), (None, "none")], "key long, v string"), spark.createDataFrame([(10, "b10"), (12, "b12")], "key long, v string")
    got = {r["i"]: r["v"] for r in lookup.routed_lookup(rows, {"a": a, "b": b}, "src", "k", "key", missing="skip").collect()}
    assert got == {1: "a10", 2: "b10", 3: "a11", 4: None, 5: None, 6: None}
    assert lookup.routed_lookup(rows.where("i < 4"), {"a": a, "b": b}, "src", "k", "key").count() == 3
    for wrong in (4, 5, 6):
        with pytest.raises(Exception, match="no match for key"):
            lookup.routed_lookup(rows.where(f"i = {wrong}"), {"a": a, "b": b}, "src", "k", "key").collect()
    twice = a.union(spark.createDataFrame([(10, "again")], "key long, v string"))
    with pytest.raises(Exception, match="duplicate keys"):
        lookup.routed_lookup(rows.where("i = 1"), {"a": twice, "b": b}, "src", "k", "key").collect()
    with pytest.raises(ValueError, match="collide"):
        lookup.routed_lookup(rows.withColumnRenamed("i", "v"), {"a": a}, "src", "k", "key")

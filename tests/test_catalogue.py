"""Every query of the catalogue against its SQL, on the smallest tables."""

import duckdb
import pytest

from quarrymill.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 5)
    if isinstance(value, (list, tuple)) or type(value).__name__ == "ndarray":
        return tuple(plain(x) for x in value)
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.execute(catalogue.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


def test_weighted_interleave_covers_and_keeps_blocks_pure(spark):
    found = catalogue.QUERIES["weighted_shuffled_interleave"](spark, SF).collect()
    documents = {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert {r["doc_id"] for r in found} == documents
    by_block = {}
    for r in found:
        by_block.setdefault(r["block"], set()).add(r["lang"])
    assert all(len(x) == 1 for x in by_block.values())


def test_token_layout_moves_the_token_to_the_first_line(spark):
    assert all(r["text"].startswith("<image>") for r in catalogue.QUERIES["token_layout"](spark, SF).collect() if r["turn"] % 3 != 1)

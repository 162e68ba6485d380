import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import buckets as B

SCHEMA = "doc_id bigint, text string, n int"


def files(path) -> dict:
    """Data files and their times, by bucket."""
    out: dict = {}
    for d, _, names in os.walk(path):
        for name in names:
            if name.endswith(".parquet"):
                out.setdefault(os.path.basename(d), {})[name] = os.stat(f"{d}/{name}").st_mtime_ns
    return out


@pytest.fixture
def held(spark, tmp_path):
    table = B.Buckets(spark, f"file://{tmp_path}/t", SCHEMA, rows_per_bucket=20)
    table.replace(spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("old "), "id").alias("text"), F.lit(1).alias("n")))
    return table


def test_one_document_rewrites_one_bucket(spark, held, tmp_path):
    assert held.layout() == (0, 10)
    before = files(tmp_path / "t/rows-0")
    touched = held.replace(spark.createDataFrame([(7, "new 7", 2), (7, "more 7", 3)], SCHEMA))
    after = files(tmp_path / "t/rows-0")
    assert len(touched) == 1 and [b for b in before if before[b] != after[b]] == [f"bucket={touched[0]}"]
    got = {(r.doc_id, r.text) for r in held.read().collect()}
    assert got == {(i, f"old {i}") for i in range(200) if i != 7} | {(7, "new 7"), (7, "more 7")}


def test_deletes_and_empty_buckets(spark, held):
    everything = held.read().select("doc_id")
    held.replace(spark.createDataFrame([(3, "kept", 9)], SCHEMA), everything)
    assert [(r.doc_id, r.text) for r in held.read().collect()] == [(3, "kept")]
    held.replace(spark.createDataFrame([], SCHEMA), spark.createDataFrame([(3,)], "doc_id bigint"))
    assert held.read().count() == 0 and held.layout() == (0, 10)
    assert held.replace(spark.createDataFrame([], SCHEMA)) == []


@pytest.mark.parametrize("lost", ["_mark", "_apply", "_write"])
def test_lost_jobs(spark, held, monkeypatch, lost):
    """A change is lost at some point; the next call leaves all of it or nothing of it, and loses no other row."""
    old = {(r.doc_id, r.text) for r in held.read().collect()}
    change = spark.createDataFrame([(i, f"new {i}", 2) for i in range(0, 200, 3)], SCHEMA)

    def fail(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(B.Buckets, lost, fail)
    with pytest.raises(RuntimeError):
        held.replace(change)
    monkeypatch.undo()
    held.recover()
    new = {(i, f"new {i}" if i % 3 == 0 else f"old {i}") for i in range(200)}
    assert {(r.doc_id, r.text) for r in held.read().collect()} == (old if lost == "_mark" else new)
    held.replace(change)
    assert {(r.doc_id, r.text) for r in held.read().collect()} == new


def test_growth_and_null_keys(spark, held):
    held.replace(spark.range(200, 1300).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit(1).alias("n")))
    assert held.layout() == (1, 65) and held.read().count() == 1300
    nulls = spark.createDataFrame([(None, "a", 1), (None, "b", 1)], SCHEMA)
    held.replace(nulls)
    held.replace(nulls.where("text = 'b'"))
    assert [r.text for r in held.read().where("doc_id IS NULL").collect()] == ["b"] and held.read().count() == 1301


def test_empty_table(spark, tmp_path):
    table = B.Buckets(spark, f"file://{tmp_path}/none", SCHEMA)
    assert table.replace(spark.createDataFrame([], SCHEMA)) == [] and table.read().count() == 0 and table.layout() is None

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from corpusloom.llm import exact
from corpusloom.llm.queries import ORACLES, QUERIES


def test_directory_doubles_where_buckets_overflow(spark):
    done, deeper = exact.split({0b0000: 5, 0b0001: 5, 0b1000: 1}, 0, 0, 4, 5)
    assert sorted(done, key=lambda b: b[0] << 4 - b[1]) == [(0b0000, 4), (0b0001, 4), (0b001, 3), (0b01, 2), (0b1, 1)] and not deeper
    assert exact.split({0b0000: 9}, 0, 0, 4, 5)[1] == [(0, 4)]  # to be counted by its next bits
    assert exact.split({}, 0, 0, 4, 5) == ([(0, 0)], [])
    # keys that share their first 20 bits: counted again and again, until they part
    keys = [(i << 40,) for i in range(16)] + [(1 << 62,), (-5,)]
    keyed = spark.createDataFrame(keys, "key long")
    buckets = exact.directory(keyed, 4)
    assert max(local for _, local in buckets) > 18
    assert sum(1 << 64 - local for _, local in buckets) == 1 << 64  # every key has one bucket
    assert exact.directory(keyed.limit(0), 4) == [(0, 0)]


def test_equal_keys_stop_splitting(spark):
    assert exact.directory(spark.createDataFrame([(7,)] * 9 + [(8,)], "key long"), 1)


@pytest.mark.parametrize("more", [{}, {"capacity": 20}, {"capacity": 4}])
def test_groups_equal_sql(spark, sf, duck, more):
    ours = exact.exact_groups(spark.read.parquet(f"{sf}/documents.parquet"), **more).toPandas()
    assert rows_of(ours) == rows_of(duck.execute(ORACLES["op7_exact_dedup"]).df())


def test_buckets_split_at_the_size_checked(spark):
    import glob

    docs = spark.range(60_000).selectExpr("id AS doc_id", "concat('text ', id div 2) AS text")
    rows, chains = exact.index(docs)
    buckets = {r.bucket: r.n for r in chains.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    assert len(buckets) > 2 and max(buckets.values()) <= 1.15 * exact.CAPACITY  # counts are approximate
    # Buckets are key ranges, with a file each.
    ranges = [tuple(r) for r in chains.selectExpr("bucket", "conv(hex(shiftrightunsigned(key, 32)), 16, 10) AS k").selectExpr("bucket", "cast(k AS long) AS k").groupBy("bucket").agg(F.min("k"), F.max("k")).orderBy("bucket").collect()]
    assert all(a[2] <= b[1] for a, b in zip(ranges, ranges[1:]))
    folder = chains.inputFiles()[0].split("bucket=")[0].removeprefix("file://")
    assert all(len(glob.glob(f"{folder}bucket={b}/*.parquet")) == 1 for b in buckets)
    assert chains.selectExpr("explode(chain) AS e").select("e.group_size").distinct().collect()[0][0] == 2
    assert exact.exact_groups(docs).where("kept").count() == 30_000


def test_query(spark, sf, duck):
    assert rows_of(QUERIES["op7_exact_dedup"](spark, sf).toPandas()) == rows_of(duck.execute(ORACLES["op7_exact_dedup"]).df())


def test_edges(edge, none):
    rows = exact.exact_groups(edge).collect()
    assert len(rows) == edge.count()
    same = [r for r in rows if r.doc_id in (5, 6)]
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in same} == {(5, 6, 3, False), (6, 6, 3, True)}
    empty = [r for r in rows if r.keep_id == 2]
    assert {r.doc_id for r in empty} == {1, 2, None} and {r.group_size for r in empty} == {3}
    assert [r.kept for r in rows if r.doc_id is None and r.keep_id is None] == [True]
    assert exact.exact_groups(none).count() == 0
    kept = exact.deduplicate(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [2, 3, 4, 6, None, 7, 8, 9, 10, 11, 12]))
    assert exact.deduplicate(none).count() == 0


def test_no_python(edge):
    plan = exact.exact_groups(edge)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import ivf
from corpusloom.operators import retrieve as R
from corpusloom.plans import queries as Q


@pytest.fixture(scope="module")
def index(spark, sf, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('ivf')}/index"
    rows, asked = Q.vectors(spark, sf)
    ivf.build(rows, path)
    return ivf.read(spark, path), rows, asked


def test_recall_by_probes(spark, index):
    """Recall grows with the probes, is 0.95 or more at those that tune() finds, and whole with all lists; these vectors have no clusters."""
    held, rows, asked = index
    exact = R.top_k(rows.select("id", "embedding"), asked, 10).cache()
    probes, curve = ivf.tune(held)
    by = {n: ivf.recall(ivf.search(held, asked, 10, n), exact) for n in (1, 4, 8, probes, None)}
    assert by[1] <= by[4] + 1e-9 and by[4] <= by[8] + 1e-9 and curve == sorted(curve) and curve[probes - 1] >= 0.97 > curve[probes - 2]
    assert by[probes] >= 0.95 and by[None] == 1.0 and probes < len(held[1])
    every = [(r.query_id, r.rank, r.id, round(r.distance, 5)) for r in ivf.search(held, asked, 10, None).orderBy("query_id", "rank").collect()]
    assert every == [(r.query_id, r.rank, r.id, round(r.distance, 5)) for r in exact.orderBy("query_id", "rank").collect()]


def test_query(spark, sf):
    got = Q.QUERIES["topk_ivf"](spark, sf)
    assert ivf.recall(got, R.top_k(Q.vectors(spark, sf)[0].select("id", "embedding"), Q.vectors(spark, sf)[1], 10)) >= 0.95
    assert got.groupBy("query_id").count().where("count <> 10").count() == 0


def test_probed_lists_alone_are_read(index):
    """Brute force over the probed lists; folders of other lists are pruned."""
    (held, centroids), rows, asked = index
    assert held.count() == rows.count() and "list" in held.columns
    some = asked.limit(1)
    found = ivf.search((held, centroids), some, 10, 2)
    q = np.array(some.first().embedding, float)
    near = np.argsort(-(centroids @ (q / np.linalg.norm(q))), kind="stable")[:2].tolist()
    mine = held.where(F.col("list").isin(near)).collect()
    order = sorted((1 - np.dot(r.embedding, q) / np.linalg.norm(r.embedding) / np.linalg.norm(q), r.id) for r in mine)[:10]
    assert [r.id for r in found.orderBy("rank").collect()] == [i for _, i in order]
    assert "dynamicpruning" in found._jdf.queryExecution().optimizedPlan().toString()


def test_clustered_vectors_take_few_probes(spark, tmp_path):
    """Forty clusters of vectors: one or two lists of many hold what a query looks for."""
    dice = np.random.default_rng(3)
    centers = dice.normal(size=(40, 16))
    points = np.concatenate([c + 0.05 * dice.normal(size=(30, 16)) for c in centers])
    table = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, embedding array<float>")
    ivf.build(table, f"file://{tmp_path}/index")
    index = ivf.read(spark, f"file://{tmp_path}/index")
    probes, _ = ivf.tune(index)
    asked = table.where("id % 50 = 0").withColumnRenamed("id", "query_id")
    assert probes <= 4 and ivf.recall(ivf.search(index, asked, 10, probes), R.top_k(table, asked, 10)) >= 0.95


def test_edges(spark, tmp_path):
    rows = [(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "a"), (2, [0.0, 2.0], None), (3, None, "c"), (4, [0.0, 0.0], "d"), (None, [1.0, 1.0], "e"), (5, [1.0], "f"), (6, [-1.0, 0.0], "g")]
    table = spark.createDataFrame(rows, "id long, embedding array<float>, distance string")
    path = f"file://{tmp_path}/index"
    ivf.build(table.withColumnRenamed("distance", "document"), path, lists=2)
    held, centroids = ivf.read(spark, path)
    assert held.count() == len(rows) and {r.id for r in held.where("list = -1").collect()} == {3, 4, 5}
    asked = spark.createDataFrame([(9, [2.0, 0.0]), (8, [0.0, 0.0]), (7, None), (6, [1.0])], "query_id long, embedding array<float>")
    got = ivf.search((held, centroids), asked, 3, None).collect()
    assert [(r.query_id, r.rank, r.id, r.document) for r in sorted(got, key=lambda r: r.rank)] == [(9, 1, 1, "a"), (9, 2, 1, "a"), (9, 3, None, "e")]
    assert ivf.search((held, centroids), asked, 3, None, F.col("document") == "g").first().id == 6
    ivf.build(table.limit(0).withColumnRenamed("distance", "document"), path + "0")
    assert ivf.search(ivf.read(spark, path + "0"), asked, 3).count() == 0


def test_blocks_of_queries(index):
    held, rows, asked = index
    key = lambda df: sorted((r.query_id, r.rank, r.id) for r in df.collect())
    assert key(ivf.search(held, asked, 5, 3, max_queries=2)) == key(ivf.search(held, asked, 5, 3))


def test_lists_of_a_collection(spark, tmp_path):
    """Questions answered through lists give the hits of the exact search when all lists are probed."""
    from corpusloom.operators.embed import embed_hashed
    from corpusloom.operators.state import Store
    from corpusloom.plans import index as P

    docs = spark.createDataFrame([(f"d{i}", f"word{i % 7} text about thing{i}", f"p{i}", None, None) for i in range(40)], "id string, document string, relative_path string, page int, section string")
    root = f"file://{tmp_path}/store"
    Store(spark, root).write("c", embed_hashed(docs, "document"))
    lists = P.build_lists(spark, root, "c")
    asked = spark.createDataFrame([(1, "thing3 word3"), (2, "nothing of this")], "query_id long, question string")
    exact, through = (P.ask(spark, root, asked, 3, "c", lists=x, probes=None)[1].orderBy("query_id").collect() for x in (None, lists))
    assert exact == through and exact[0].n_chunks == 3


def test_queries_are_held_once(index, monkeypatch):
    """However many lists a query probes, one packed block of queries is broadcast, not a row for each probe."""
    from corpusloom.operators import nearest

    (held, centroids), rows, asked = index
    made, pairs = [], nearest.pairs
    monkeypatch.setattr(nearest, "pairs", lambda a, b, k: made.append(b.count()) or pairs(a, b, k))
    found = ivf.search((held, centroids), asked, 5, len(centroids))
    assert made == [1] and len(centroids) > 1
    assert sorted((r.query_id, r.id) for r in found.collect()) == sorted((r.query_id, r.id) for r in R.top_k(rows.select("id", "embedding"), asked, 5).collect())

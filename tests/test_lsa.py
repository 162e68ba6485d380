import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import lsa
from corpusloom.operators import retrieve as R
from corpusloom.operators.embed import embed_hashed
from corpusloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")


def dense(docs, features):
    """All rows as one matrix, the plain way."""
    rows = docs.select("doc_id", lsa.terms(F.col("text"), features).alias("t")).orderBy("doc_id").collect()
    count = np.zeros((len(rows), features))
    for i, r in enumerate(rows):
        for t in r.t:
            count[i, t] += 1
    df = (count > 0).sum(axis=0)
    idf = np.where(df >= 2, np.log((len(rows) + 1) / (df + 1)) + 1, 0)
    a = np.where(count > 0, 1 + np.log(np.maximum(count, 1)), 0) * idf
    length = np.linalg.norm(a, axis=1, keepdims=True)
    return np.divide(a, length, out=np.zeros_like(a), where=length > 0)


def test_against_exact_svd(docs):
    """Orthonormal vectors, singular values and the error of the projection within one percent of the best there is, given passes enough for a slow decay."""
    model = lsa.fit(docs.repartition(3), dimensions=20, features=2048, passes=8)
    a = dense(docs, 2048)
    exact = np.linalg.svd(a, compute_uv=False)
    assert np.allclose(model.vectors.T @ model.vectors, np.eye(20), atol=1e-8)
    assert np.isclose(model.total, (a**2).sum())
    assert np.allclose(model.sigma[:10], exact[:10], rtol=0.01)
    lost = ((a - a @ model.vectors @ model.vectors.T) ** 2).sum()
    assert np.isclose(lost / model.total, model.error, atol=1e-5) and lost <= 1.01 * (exact[20:] ** 2).sum()


def test_rows_equal_the_plain_way(docs):
    model = lsa.fit(docs, dimensions=16, features=2048)
    got = np.array([r.embedding for r in lsa.embed(docs, model).orderBy("doc_id").collect()])
    want = dense(docs, 2048) @ model.vectors
    length = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(got, np.divide(want, length, out=np.zeros_like(want), where=length > 1e-12), atol=1e-5)


def test_repeatable_whatever_the_partitions(docs):
    one, other = lsa.fit(docs.coalesce(1), dimensions=8, features=1024), lsa.fit(docs.repartition(5), dimensions=8, features=1024)
    assert np.allclose(np.abs(one.vectors.T @ other.vectors), np.eye(8), atol=1e-3)


def test_better_than_hashing(docs):
    """Every tenth text asks for others of its language; a text of 30 words, so few of its words are in any one answer."""
    short = docs.where("lang IS NOT NULL").select("doc_id", "lang", F.array_join(F.slice(F.split("text", r"\s+"), 1, 30), " ").alias("text"))
    model = lsa.fit(docs, dimensions=32)

    def precision(embedded):
        rows = embedded.select(F.col("doc_id").alias("id"), "embedding", "lang")
        asked = rows.where("id % 10 = 0").select(F.col("id").alias("query_id"), "embedding", F.col("lang").alias("wanted"))
        hits = R.top_k(rows, asked.drop("wanted"), 11).where("id <> query_id").join(asked.select("query_id", "wanted"), "query_id")
        return hits.agg(F.avg((F.col("lang") == F.col("wanted")).cast("int"))).first()[0]

    learned, hashed = precision(lsa.embed(short, model)), precision(embed_hashed(short, size=32))
    assert learned > hashed + 0.05, (learned, hashed)


def test_edges(spark, docs, tmp_path):
    rows = [(1, None, 1.0), (2, "", 2.0), (3, "same words here", None), (3, "same words here", None), (4, "once", 0.0), (None, "words " * 50_000, 1.0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, terms double")
    model = lsa.fit(table, dimensions=4, features=64)
    lsa.save(spark, model, f"file://{tmp_path}/model")
    again = lsa.load(spark, f"file://{tmp_path}/model")
    got = lsa.embed(table, again).collect()
    assert len(got) == len(rows) and [r.terms for r in got] == [r[2] for r in rows]
    by = {r.text: np.array(r.embedding) for r in got}
    assert not by[None].any() and not by[""].any() and not by["once"].any() and np.isclose(np.linalg.norm(by["same words here"]), 1)
    nothing = lsa.fit(table.limit(0), dimensions=4, features=64)
    assert nothing.error == 0 and lsa.embed(table.limit(0), nothing).count() == 0 and not any(any(r.embedding) for r in lsa.embed(table, nothing).collect())


def test_texts_are_read_once(spark, sf):
    """The query takes its embeddings from the table of counts, not from the documents again; they equal those of the separate calls."""
    got = QUERIES["embed_lsa"](spark, sf)
    assert not any("documents.parquet" in f for f in got.inputFiles())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want = lsa.embed(docs, lsa.fit(docs)).orderBy("doc_id").collect()
    rows = got.orderBy("doc_id").collect()
    assert [r.doc_id for r in rows] == [r.doc_id for r in want]
    a, b = (np.array([r.embedding for r in x]) for x in (rows, want))
    assert np.allclose(np.abs((a * b).sum(axis=1)), (b**2).sum(axis=1), atol=1e-3)

"""Exact search in blocks: no row for each pair, ties, awkward vectors."""

import numpy as np
from pyspark.sql import functions as F

from corpusloom.operators import nearest
from corpusloom.operators import retrieve as R


def sequential(a: list, b: list) -> float:
    """1 - cosine, term by term."""
    dot = left = right = 0.0
    for x, y in zip(a, b):
        dot, left, right = dot + x * y, left + x * x, right + y * y
    return 1.0 - max(-1.0, min(1.0, dot / np.sqrt(left * right)))


def test_blocks_equal_brute_force(spark, monkeypatch):
    """Small blocks, many copies and multiples: the rows of brute force, in its order, and no join that forms all pairs."""
    monkeypatch.setattr(nearest, "ROW_BYTES", 800)
    monkeypatch.setattr(nearest, "LEAST_ROWS", 50)
    dice = np.random.default_rng(1)
    points = dice.normal(size=(300, 8)).astype(np.float32)
    points[::3] = points[0]
    points[1::30] = 2 * points[0]
    table = spark.createDataFrame([(f"v{i:03}", [float(x) for x in p]) for i, p in enumerate(points)], "id string, embedding array<float>")
    asked = table.where("id LIKE '%0'").withColumnRenamed("id", "query_id")
    found = R.top_k(table, asked, 7, max_queries=16)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.id))
    wide = [[float(x) for x in p] for p in points]
    for q in range(0, 300, 10):
        assert got[f"v{q:03}"] == sorted((sequential(wide[q], v), f"v{i:03}") for i, v in enumerate(wide))[:7]


def test_vectors_without_matches(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [1.0]), (7, [float("nan"), 1.0]), (8, [-1.0, 0.0])]
    table = spark.createDataFrame(rows, "id long, embedding array<float>")
    got = R.top_k(table, table.withColumnRenamed("id", "query_id"), 5).orderBy("query_id", "rank").select("query_id", "id").collect()
    assert [tuple(r) for r in got] == [(1, 1), (1, 8), (1, 7), (6, 6), (7, 1), (7, 7), (7, 8), (8, 8), (8, 1), (8, 7)]
    assert R.top_k(table.where("id = 2"), table.withColumnRenamed("id", "query_id"), 5).where(F.col("rank") > 0).count() == 0

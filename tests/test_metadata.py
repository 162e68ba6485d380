import json

from pyspark.sql import functions as F

from corpusloom.operators import index as I
from corpusloom.operators import metadata as V


def flat(spark, doc, chunk, **core):
    """The flattened metadata of one document and chunk, as name to (kind, value)."""
    table = spark.createDataFrame([(1, doc, chunk)], "id long, d string, c string")
    rows = V.listed(table, ["id"], V.flattened({k: F.lit(v) for k, v in core.items()}, V.parse(F.col("d")), V.parse(F.col("c"))))
    return {r["name"]: (r.kind, r.value) for r in rows.collect()}


def test_precedence_and_kinds(spark):
    got = flat(spark, json.dumps({"a": 1, "b": "x", "page": 3, "c": [1, {"z": None}], "gone": None}), json.dumps({"b": None, "page": "7", "section": 5, "d": False, "e": 1.5}), doc_id="d", a="core")
    assert got == {"doc_id": ("text", "d"), "a": ("number", "1"), "page": ("number", "7"), "section": ("text", "5"), "c": ("json", '[1,{"z":null}]'), "d": ("boolean", "false"), "e": ("number", "1.5")}


def test_spans(spark):
    for span, want in (([2, 5], {"paragraph_start": ("number", "2"), "paragraph_end": ("number", "5")}), ([1], {"paragraph_span": ("text", "[1]")}), ([1, 2, 3], {"paragraph_span": ("text", "[1,2,3]")}), ("3-4", {"paragraph_span": ("text", "3-4")}), ({"x": 1}, {"paragraph_span": ("text", '{"x":1}')}), (None, {}), ([1, "b"], {"paragraph_span": ("text", '[1,"b"]')}), (7, {"paragraph_span": ("text", "7")})):
        assert flat(spark, None, json.dumps({"paragraph_span": span})) == want


def test_what_is_no_object(spark):
    for text in (None, "", "not json", "[1]", "3", "null", "{}"):
        assert flat(spark, text, text, doc_id="d") == {"doc_id": ("text", "d")}


def test_profile_types(spark):
    rows = [("a", '{"x": 1, "y": "t"}'), ("a", '{"x": 2.5, "z": [1]}'), ("b", '{"x": null}'), ("b", None), (None, '{"x": true}')]
    table = spark.createDataFrame(rows, "kind string, props string").select("kind", V.parse(F.col("props")).alias("m"))
    got = {(r.kind, r["name"]): (r.n, r.type) for r in V.profile(table, ["kind"], F.col("m")).collect()}
    assert got[("a", "x")][0] == 2 and got[("a", "x")][1].startswith("DECIMAL") and got[("a", "y")] == (1, "STRING") and got[("a", "z")] == (1, "ARRAY<BIGINT>")
    assert got[("b", "x")] == (1, "VOID") and got[(None, "x")] == (1, "BOOLEAN")
    assert V.profile(table.limit(0), ["kind"], F.col("m")).count() == 0


def test_bottom_sample_is_repeatable(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(0).alias("chunk_index"))
    take = lambda df, salt="": sorted(r.doc_id for r in I.bottom_sample(df, 20, ["doc_id", "chunk_index"], salt).collect())
    assert take(rows) == take(rows.repartition(7)) == take(rows.coalesce(1)) != take(rows, "other")
    assert len(take(rows.limit(3))) == 3 and take(rows.limit(0)) == []
    # merging two samples gives the sample of both
    two = I.bottom_sample(rows.where("doc_id < 500"), 20, ["doc_id"]).union(I.bottom_sample(rows.where("doc_id >= 500"), 20, ["doc_id"]))
    assert sorted(r.doc_id for r in I.bottom_sample(two, 20, ["doc_id"]).collect()) == sorted(r.doc_id for r in I.bottom_sample(rows, 20, ["doc_id"]).collect())

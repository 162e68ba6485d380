"""Each job against its SQL, over growing input, and with awkward rows."""

import hashlib
import json

import pytest
from helpers import rows_of

from jobs import chunk_feed, common, prompt_batch
from jobs.queries import ORACLES, QUERIES

DOCS = "doc_id long, text string, source string, lang string, batch long, content_hash string"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_job_equals_sql(spark, sf, duck, name):
    settings = lambda: {r.key: r.value for r in spark.sql("SET").collect()}
    before = settings()
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert len(ours) and rows_of(ours) == rows_of(theirs)
    assert settings() == before


def test_feed_takes_only_what_is_new(spark, sf, tmp_path):
    """Two runs over a growing copy equal one run over the last state; the second reads the new file alone."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60").select("doc_id", "text", "source")
    root, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    first, second = docs.where("doc_id < 40"), docs.where("doc_id >= 30")
    changed = second.selectExpr("doc_id", "CASE WHEN doc_id < 35 THEN concat(text, ' More of it.') ELSE text END AS text", "source")
    first.coalesce(1).write.mode("append").parquet(root)
    a = chunk_feed.run(spark, root, out)
    assert (a["rows_read"], a["documents_written"]) == (40, 40)
    files = {r.path: r.modificationTime for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/chunks").select("path", "modificationTime").collect()}
    changed.coalesce(1).write.mode("append").parquet(root)
    b = chunk_feed.run(spark, root, out)
    assert (b["rows_read"], b["documents_written"]) == (30, 25)  # 30 to 34 changed, 35 to 39 did not, 40 to 59 are new
    later = {r.path: r.modificationTime for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{out}/chunks").select("path", "modificationTime").collect()}
    assert all(later[p] == t for p, t in files.items())  # nothing of the first run is written again
    assert chunk_feed.run(spark, root, out)["batches"] == 0
    whole = f"file://{tmp_path}/whole"
    first.where("doc_id < 30").union(changed).write.parquet(whole)
    chunk_feed.run(spark, whole, f"file://{tmp_path}/once")
    key = lambda df: sorted(map(tuple, df.drop("batch").collect()), key=str)
    assert key(chunk_feed.current(spark, out)) == key(chunk_feed.current(spark, f"file://{tmp_path}/once"))


def test_feed_back_to_an_old_text(spark, tmp_path):
    """A text that changes and changes back is written three times, and the last one counts."""
    root, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    for text in ("one", "two", "one"):
        spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string").write.mode("append").parquet(root)
        assert chunk_feed.run(spark, root, out)["documents_written"] == 1
        assert [r.text for r in chunk_feed.current(spark, out).collect()] == [text]


def test_feed_batch_runs_again(spark, tmp_path):
    """A batch that was written but not marked as done (lost job) replaces its own rows."""
    root, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    for i in range(2):
        spark.createDataFrame([(i, f"text {i}", "s")], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(root)
        chunk_feed.run(spark, root, out)
    (tmp_path / "out/checkpoint/commits/1").unlink()
    (tmp_path / "out/checkpoint/commits/.1.crc").unlink(missing_ok=True)
    again = chunk_feed.run(spark, root, out)
    assert again["documents_written"] == 1
    assert sorted(r.text for r in chunk_feed.current(spark, out).collect()) == ["text 0", "text 1"]


def test_feed_edges(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, null and odd sources, columns with clashing names."""
    root, out = f"file://{tmp_path}/docs", f"file://{tmp_path}/out"
    rows = [(1, None, "a"), (2, "", None), (None, "lost", "a"), (3, "same", "b/c=d"), (3, "same", "b/c=d"), (4, "x y z. " * 3000, "a"), (5, "one", "a"), (5, "two", "a")]
    spark.createDataFrame([(*r, "xx", 7, "h") for r in rows], DOCS).write.parquet(root)
    total = chunk_feed.run(spark, root, out)
    assert (total["rows_read"], total["rejected"], total["documents_written"]) == (8, 1, 5)
    held = chunk_feed.current(spark, out).collect()
    texts = {r.doc_id: r.text for r in held}
    assert texts[1] == texts[2] == "" and texts[3] == "same"
    assert texts[5] == max("one", "two", key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    assert {r.source for r in held} == {"a", None, "b/c=d"} and sum(r.doc_id == 4 for r in held) > 100
    spark.createDataFrame([], DOCS).write.parquet(f"file://{tmp_path}/none")
    assert chunk_feed.run(spark, f"file://{tmp_path}/none", f"file://{tmp_path}/out2")["documents_written"] == 0
    assert chunk_feed.current(spark, f"file://{tmp_path}/out2").count() == 0


def test_prompts_edges(spark, tmp_path):
    vectors = [(0, [1.0, 0.0], 1), (50, [0.0, 0.0], None), (100, None, 2), (1, [1.0, 0.1], 1), (2, [0.0, 1.0], 1), (3, None, 1), (4, [1.0, 0.2], 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"file://{tmp_path}/v")
    spark.createDataFrame([(0, "zero", "s", "en", 1, "h"), (1, None, None, None, 1, "h"), (4, "four", "s", None, 1, "h")], "doc_id long, text string, source string, lang string, rank long, context string").write.parquet(f"file://{tmp_path}/d")
    out = f"file://{tmp_path}/out"
    for _ in range(2):
        assert prompt_batch.run(spark, f"file://{tmp_path}/v", f"file://{tmp_path}/d", out)["prompts_written"] == 3
    got = {r.query_id: r for r in prompt_batch.read(spark, out).collect()}
    assert got[0].n_chunks == 3 and "[1] (/s | section: en)\nzero" in got[0].system_prompt and got[0].sources.startswith("  [1] /s (dist: 0.0000)")
    assert got[50].n_chunks == got[100].n_chunks == 0 and got[50].context is None and got[50].label is None and got[100].label == 2
    spark.read.parquet(f"file://{tmp_path}/v").limit(0).write.parquet(f"file://{tmp_path}/v0")
    assert prompt_batch.run(spark, f"file://{tmp_path}/v0", f"file://{tmp_path}/d", f"file://{tmp_path}/o0")["prompts_written"] == 0


def test_settings(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"k": 9}))
    assert common.settings(spark, f"file://{tmp_path}/c.json", prompt_batch.DEFAULTS) == prompt_batch.DEFAULTS | {"k": 9}
    (tmp_path / "d.json").write_text(json.dumps({"kk": 9}))
    with pytest.raises(ValueError, match="kk"):
        common.settings(spark, f"file://{tmp_path}/d.json", prompt_batch.DEFAULTS)


def test_command_line(spark, sf, tmp_path, monkeypatch):
    """The command line starts a session of its own; here it gets one that it may not stop."""
    import sys

    monkeypatch.setattr(sys, "argv", ["prompt_batch", f"{sf}/embeddings.parquet", f"{sf}/documents.parquet", f"file://{tmp_path}/out"])
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    common.main(prompt_batch.__doc__, ["embeddings", "documents"], prompt_batch.CONFIG, prompt_batch.run)
    assert prompt_batch.read(spark, f"file://{tmp_path}/out").count() > 0

"""Carry-over of vectors by chunk digest, and range filters."""

from pyspark.sql import functions as F

from corpusloom.operators import carry
from corpusloom.operators import retrieve as R
from corpusloom.operators.embed import embed_hashed

SCHEMA = "doc_id string, chunk_index int, text string"


def digested(spark, rows, model="m"):
    return spark.createDataFrame(rows, SCHEMA).withColumn("digest", carry.digest(F.col("text"), model))


def rows_with_marks(spark, rows):
    """Old rows whose vectors can be told from freshly made ones."""
    return digested(spark, rows).withColumn("embedding", F.array(F.lit(7.0).cast("float")))


def counts(df):
    return {r.doc_id: (r.n_reused, r.n_embedded, r.n_deleted) for r in df.collect()}


OLD = [("a", 0, "one"), ("a", 1, "two"), ("a", 2, "two"), ("b", 0, "one"), (None, 0, None), ("gone", 0, "x")]
NEW = [("a", 0, "new"), ("a", 1, "one"), ("a", 2, "two"), ("a", 3, "two"), ("c", 0, "one"), (None, 0, ""), ("b", 0, "other")]


def test_only_new_texts_are_embedded(spark):
    old, new = rows_with_marks(spark, OLD), digested(spark, NEW)
    asked = []

    def embed(rows):
        asked.extend(r.text for r in rows.collect())
        return rows.withColumn("embedding", F.array(F.lit(1.0).cast("float")))

    out = carry.complete(carry.match(old, new), embed).collect()
    assert sorted(asked) == ["new", "one", "other"]
    assert len(out) == len(NEW)
    assert all(r.embedding == ([7.0] if r.carried else [1.0]) for r in out)
    assert counts(carry.changes(old, new)) == {"a": (3, 1, 0), "b": (0, 1, 1), "c": (0, 1, 0), None: (1, 0, 0), "gone": (0, 0, 1)}


def test_carried_rows_equal_embedding_everything(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(0).alias("chunk_index"), "text")
    new = docs.withColumn("digest", carry.digest(F.col("text"), "m"))
    old = embed_hashed(new.where("cast(doc_id AS int) % 2 = 0"))
    ours = {r.doc_id: r.embedding for r in carry.complete(carry.match(old, new), embed_hashed).collect()}
    assert ours == {r.doc_id: r.embedding for r in embed_hashed(docs).collect()}


def test_states_without_rows_vectors_or_the_same_model(spark):
    old, new = rows_with_marks(spark, OLD), digested(spark, NEW)
    assert carry.match(old.limit(0), new).where("embedding IS NOT NULL").count() == 0
    assert carry.match(old, new.limit(0)).count() == 0
    assert carry.changes(old.limit(0), new.limit(0)).count() == 0
    failed = old.withColumn("embedding", F.lit(None).cast("array<float>"))
    assert carry.match(failed, new).where("embedding IS NOT NULL").count() == 0
    assert counts(carry.changes(failed, new))["a"] == (0, 4, 0)
    assert carry.match(old, digested(spark, NEW, "other model")).where("embedding IS NOT NULL").count() == 0


def test_columns_of_the_new_rows_win(spark):
    old = rows_with_marks(spark, OLD).withColumn("_key", F.lit("old")).withColumn("page", F.lit(1))
    new = digested(spark, NEW).withColumn("page", F.lit(2)).withColumn("embedding", F.lit(None).cast("array<float>"))
    out = carry.match(old, new)
    assert out.columns == ["doc_id", "chunk_index", "text", "digest", "page", "embedding"]
    assert {r.page for r in out.collect()} == {2}


def test_ranges_reach_the_scan_and_readers_are_whole_names(spark, tmp_path):
    rows = spark.createDataFrame([(1, 3, "2024-01-02", "team, staff", "x"), (2, None, None, None, "x"), (3, 9, "2024-02-01", "teams", "x"), (4, 5, "2024-01-09", "staff", "y")], "id int, page int, timestamp string, acl_read string, kind string")
    rows.write.parquet(str(tmp_path / "t"))
    held = spark.read.parquet(str(tmp_path / "t"))
    ids = lambda **f: sorted(r.id for r in held.where(R.filters(**f)).collect())
    assert ids(reader="team") == [1] and ids(acl="team") == [1, 3] and ids(reader="staff") == [1, 4]
    assert ids(page_from=4) == [3, 4] and ids(page_to=5) == [1, 4] and ids(since="2024-01-05", until="2024-01-31") == [4]
    assert ids(kind="x", page_from=1, page_to=9, since="2024-01-01", reader="staff") == [1]
    before = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    plan = held.where(R.filters(kind="x", page_from=4, since="2024-01-05"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.maxMetadataStringLength", before)
    assert all(f in plan for f in ("EqualTo(kind,x)", "GreaterThanOrEqual(page,4)", "GreaterThanOrEqual(timestamp,2024-01-05)"))


def test_reindexing_embeds_changed_chunks_only(spark, tmp_path):
    from corpusloom.operators import state
    from corpusloom.plans.index import COLLECTION, IndexConfig, build_index
    from corpusloom.plans.ingest import IngestConfig, ingest, read_chunks

    root, out, idx = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "idx")
    root.mkdir()
    for n in range(3):
        (root / f"f{n}.txt").write_text(f"Text number {n}.")
    (root / "bad.docx").write_bytes(b"no document")
    report = ingest(spark, IngestConfig(str(root), out))
    assert (report["processed"], report["skipped"], report["failed"], report["total_chunks"]) == (3, 0, 1, read_chunks(spark, out).count())
    build_index(spark, IndexConfig(out, idx))
    store = state.Store(spark, idx)
    assert counts(store.read("changes")) == {f"f{n}-txt": (0, 1, 0) for n in range(3)}
    (root / "f1.txt").write_text("Quite another text.")
    report = ingest(spark, IngestConfig(str(root), out))
    assert (report["processed"], report["skipped"], report["failed"], report["total_chunks"]) == (1, 2, 1, 1)
    assert build_index(spark, IndexConfig(out, idx)) == {"indexed_docs": 3, "indexed_chunks": 3, "skipped_docs": 0, "failed_chunks": 0}
    assert counts(store.read("changes")) == {"f0-txt": (1, 0, 0), "f1-txt": (0, 1, 1), "f2-txt": (1, 0, 0)}
    held = store.read(COLLECTION)
    assert {r.id: r.embedding for r in held.collect()} == {r.id: r.embedding for r in embed_hashed(held.drop("embedding"), "document").collect()}


def test_counters_of_a_write_equal_its_rows(spark, tmp_path):
    from corpusloom.operators import state

    store = state.Store(spark, str(tmp_path / "s"))
    rows = spark.range(1000).repartition(7)
    n = F.count(F.lit(1))
    assert store.write_observed("t", rows, n=n, odd=F.count_if(F.col("id") % 2 == 1)) == {"n": 1000, "odd": 500}
    assert store.read("t").count() == 1000
    assert store.write_observed("t", rows.where("id < 0"), n=n) == {"n": 0}
    assert store.write_observed("t", spark.createDataFrame([], "id long"), n=n) == {"n": 0}

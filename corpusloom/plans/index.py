"""Indexing runs and question answering over an indexed collection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answer as A
from corpusloom.operators import carry
from corpusloom.operators import index as I
from corpusloom.operators import ivf
from corpusloom.operators import retrieve as R
from corpusloom.operators import state
from corpusloom.operators.embed import embed_hashed
from corpusloom.plans.ingest import read_chunks

#: Fixed value: the default collection.
COLLECTION = "pilot-docs"
META = "ingestion_timestamp string, acl_read string, acl_write string, title string, author string, source_type string"


@dataclass(frozen=True)
class IndexConfig:
    chunks_root: str
    index_root: str
    collection: str = COLLECTION
    doc_filter: list | None = None
    purge: bool = False  # also drop documents that left the manifest
    model: str | None = None  # names the model of ``embed``; without a name no vector is carried over


def build_index(spark: SparkSession, config: IndexConfig, embed=embed_hashed) -> dict:
    """Delete-by-document and upsert in one replacement; rows whose embedding failed keep the old state of their document.

    Vectors of chunks whose text the collection already holds are carried over;
    the table ``changes`` beside the collection says for each document how many
    chunks were reused, embedded and deleted.
    """
    source, target = state.Store(spark, config.chunks_root), state.Store(spark, config.index_root)
    manifest = source.read("manifest").withColumn("metadata", F.from_json("metadata", META))
    chosen, missing = I.select_docs(manifest, config.doc_filter)
    chunks = read_chunks(spark, config.chunks_root)
    rows = I.flatten(chosen, chunks)
    model = config.model or ("hashed" if embed is embed_hashed else None)
    rows = rows.withColumn("digest", carry.digest(F.col("text"), model) if model else F.lit(None).cast("string"))
    held = target.read(config.collection) if target.exists(config.collection) else None
    known = rows.limit(0).withColumn("embedding", F.lit(None).cast("array<float>")) if held is None or "digest" not in held.columns else held
    target.write("matched", carry.match(known, rows))
    matched = target.read("matched")
    # Only what the run indexes is compared; the chosen documents' own old chunks are those that may be deleted.
    target.write("changes", carry.changes(known.select("doc_id", "digest", "embedding").join(chosen.select("doc_id"), "doc_id", "left_semi"), matched))
    embedded = carry.complete(matched, embed).drop("carried")
    if "embedding_error" not in embedded.columns:
        embedded = embedded.withColumn("embedding_error", F.lit(None).cast("string"))
    embedded = embedded.withColumnRenamed("chunk_id", "id").withColumnRenamed("text", "document")
    target.write("staged", embedded)
    staged = target.read("staged")
    failed = staged.where("embedding IS NULL")
    bad_docs = failed.select("doc_id").distinct()
    good = staged.join(bad_docs, "doc_id", "left_anti").drop("embedding_error")
    old = good.limit(0) if held is None else held
    if config.purge:
        old = old.join(manifest.select("doc_id"), "doc_id", "left_semi")
    target.write(config.collection, state.replace_by_key(old, good))
    skipped = missing.count() + chosen.join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").count()
    return {"indexed_docs": good.select("doc_id").distinct().count(), "indexed_chunks": good.count(), "skipped_docs": skipped, "failed_chunks": failed.count()}


def build_lists(spark: SparkSession, index_root: str, collection: str = COLLECTION, lists: int | None = None) -> str:
    """Inverted lists of the collection as it is now, beside it; returns their folder."""
    store = state.Store(spark, index_root)
    path = f"{store.path(collection)}-lists"
    ivf.build(store.read(collection), path, lists)
    return path


def ask(spark: SparkSession, index_root: str, questions: DataFrame, k: int | None = None, collection: str = COLLECTION, embed=embed_hashed, where=None, default_k: int = 5, lists: str | None = None, probes: int = 8) -> tuple:
    """(hits, prompts) for questions (query_id, question); exact, or through the inverted lists in a folder of build_lists()."""
    embedded = embed(questions.withColumn("text", F.col("question"))).select("query_id", "embedding")
    k = R.effective_k(k, default_k)
    if lists:
        hits = ivf.search(ivf.read(spark, lists), embedded, k, probes, where)
    else:
        hits = R.top_k(state.Store(spark, index_root).read(collection), embedded, k, where)
    hits = hits.withColumnRenamed("document", "text")
    return hits, A.contexts(hits, questions)

"""Ingestion: discover, skip what is unchanged, parse, normalise, chunk, and replace by key."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import state
from corpusloom.operators.buckets import Buckets
from corpusloom.operators.chunk import ChunkConfig, chunks
from corpusloom.operators.normalize import NormalizationConfig, normalize
from corpusloom.sources.files import discover, load

CHUNKS = "chunk_id string, doc_id string, chunk_index int, text string, token_estimate int, paragraph_start int, paragraph_end int, chunk_char_count int, chunk_token_count int, page int, section string, source_page_count int, source_title string"


@dataclass(frozen=True)
class IngestConfig:
    input_root: str
    output_root: str
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    normalization: NormalizationConfig | None = field(default_factory=NormalizationConfig)
    cleanup_orphans: bool = False
    fail_fast: bool = False
    retry_failed: bool = False
    parsers: dict | None = None


class SlugCollision(ValueError):
    """Two paths give one doc_id."""


def ingest(spark: SparkSession, config: IngestConfig) -> dict:
    """One run; returns the report.  Unchanged files (by content hash) are not parsed again.

    Only the buckets of chunks that hold a changed document are rewritten; manifest
    and failures are one write each; a run that finds no files writes nothing.
    """
    began = time.time()
    store = state.Store(spark, config.output_root)
    files = discover(spark, config.input_root)
    if config.retry_failed:
        again = store.read("failures", state.FAILURES)
        files = state.retry_set(files.withColumn("source_path", F.col("path")), again).drop("source_path")
    found = files.select("path", "relative_path", T.slug(F.col("relative_path")).alias("doc_id"), F.sha2("content", 256).alias("content_hash")).cache()
    try:
        total = found.count()
        report = {"processed": 0, "skipped": 0, "failed": 0, "cleaned_up": 0, "total_chunks": 0}
        if not total:
            return report | {"duration": time.time() - began}
        twice = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("a"), F.max("path").alias("b")).where("n > 1").first()
        if twice:
            raise SlugCollision(f"{twice.a} and {twice.b} are both {twice.doc_id}")
        manifest = store.read("manifest", state.MANIFEST)
        fresh = state.changed(found, manifest)
        documents, failures = load(files.join(fresh.select("path"), "path", "left_semi"), config.parsers)
        # Parsed documents and failures are written once, before any table they depend on is replaced.
        store.write("new_documents", documents)
        failed = store.write_observed("failures", failures, n=F.count(F.lit(1)))["n"]
        documents, failures = store.read("new_documents"), store.read("failures")
        if config.fail_fast and failed:
            bad = failures.first()
            raise RuntimeError(f"{bad.source_path}: {bad.error_message}")
        text = documents
        if config.normalization is not None:
            text = normalize(documents, config.normalization).withColumn("text", F.col("normalized.text"))
        carried = text.withColumnRenamed("page_count", "source_page_count").withColumn("source_title", F.col("title"))
        made = chunks(carried.select("doc_id", "text", "source_page_count", "source_title"), config.chunk, carry=["source_page_count", "source_title"])
        # The new chunks are written once, and counted as they are written; every document has a chunk 0.
        n = store.write_observed("new_chunks", made, chunks=F.count(F.lit(1)), documents=F.count_if(F.col("chunk_index") == 0))
        made = store.read("new_chunks")
        counts = made.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        meta = F.to_json(F.struct(*(c for c in documents.columns if c not in ("text", "doc_id", "content_hash", "path", "relative_path", "file_extension"))))
        rows = documents.select("doc_id", "content_hash", F.col("path").alias("source_path"), "relative_path", "file_extension", F.col("ingestion_timestamp").alias("last_ingested"), meta.alias("metadata")).join(counts, "doc_id")
        new_manifest = rows.select("doc_id", "content_hash", "chunk_count", "source_path", "relative_path", "file_extension", "last_ingested", "metadata")
        merged = state.replace_by_key(manifest, new_manifest)
        lost = state.orphans(merged, found.select(F.col("path").alias("source_path"))) if config.cleanup_orphans and not config.retry_failed else None
        if lost is not None:
            report["cleaned_up"] = lost.count()
            merged = state.clean(merged, lost)
        report["processed"], report["total_chunks"], report["failed"] = n["documents"], n["chunks"], failed
        report["skipped"] = total - report["processed"] - report["failed"]
        if report["processed"] or report["cleaned_up"]:
            chunk_table(spark, config.output_root).replace(made, lost)
            store.write("manifest", merged)
        report["duration"] = time.time() - began
        store.write("report", spark.createDataFrame([tuple(report.values())], ", ".join(f"{k} {'double' if k == 'duration' else 'long'}" for k in report)))
        return report
    finally:
        found.unpersist()


def chunk_table(spark: SparkSession, output_root: str) -> Buckets:
    return Buckets(spark, f"{output_root.rstrip('/')}/chunks", CHUNKS)


def read_chunks(spark: SparkSession, output_root: str) -> DataFrame:
    return chunk_table(spark, output_root).read()

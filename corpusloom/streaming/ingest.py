"""Structured Streaming: chunk files as they arrive; each batch replaces its documents in the buckets that hold them.

Ids come from paths below the root and texts go through the normaliser, as in a
batch run, so both can fill one store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import state
from corpusloom.operators.chunk import ChunkConfig, chunks
from corpusloom.operators.normalize import NormalizationConfig, normalize
from corpusloom.plans.ingest import chunk_table
from corpusloom.sources.files import TEXT, decode, describe

FILES = "path string, modificationTime timestamp, length long, content binary"


def read_files(spark: SparkSession, root: str, pattern: str = "*.{md,txt}") -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)


def stream_chunks(spark: SparkSession, root: str, output_root: str, checkpoint: str, config: ChunkConfig | None = None, once: bool = True, normalization: NormalizationConfig | None = NormalizationConfig()):
    """Starts the query.  The file source tracks paths; content hashes still decide what is chunked again, so a
    repeated batch after a failure changes nothing."""
    store = state.Store(spark, output_root)

    def batch(files: DataFrame, number: int) -> None:
        text, _ = decode(F.col("content"))
        docs = describe(files, root, TEXT).select(T.slug(F.col("relative_path")).alias("doc_id"), F.col("path").alias("source_path"), F.sha2("content", 256).alias("content_hash"), T.basic(text).alias("text"), "last_modified")
        docs = docs.groupBy("doc_id").agg(F.max_by(F.struct(*docs.columns), "last_modified").alias("r")).select("r.*")
        manifest = store.read("manifest", state.MANIFEST)
        fresh = state.changed(docs, manifest)
        cleaned = fresh if normalization is None else normalize(fresh, normalization).withColumn("text", F.col("normalized.text"))
        made = chunks(cleaned.withColumn("source_page_count", F.lit(None).cast("int")).withColumn("source_title", F.lit(None).cast("string")), config, carry=["source_page_count", "source_title"])
        store.write("new_chunks", made)
        made = store.read("new_chunks")
        counts = made.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
        rows = fresh.join(counts, "doc_id").select("doc_id", "content_hash", "chunk_count", "source_path")
        chunk_table(spark, output_root).replace(made)
        store.write("manifest", state.replace_by_key(manifest, rows).select(*[c.split()[0] for c in state.MANIFEST.split(", ")]))

    writer = read_files(spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

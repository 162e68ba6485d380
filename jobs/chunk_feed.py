"""Keep a table of chunks in step with a growing folder of documents: only new files are read, only new or changed documents are cut.

    python -m jobs.chunk_feed DOCUMENTS OUT [--config jobs/chunk_feed.json]

DOCUMENTS is a folder (or file) of Parquet files with doc_id, text and source, to
which files are added.  A file stream with a checkpoint takes each file once and
ends when all are taken (availableNow).  A document whose content hash is the one
the manifest holds is skipped; others are normalised, cut into overlapping chunks
and written.

OUT/chunks      partitioned by batch and source; each batch owns its partitions,
                so a batch that runs again after a failure replaces its own files
                and touches no others (dynamic partition overwrite)
OUT/manifest    partitioned by batch: doc_id, content_hash, n_chunks
OUT/checkpoint  what the stream has taken; it belongs to the two tables, so delete
                all three or none

``current`` joins both: the chunks of each document's last batch.  A batch costs
its own rows, and one pass over the manifest's ids and hashes.

Cases: a null text is empty and gives one empty chunk; rows without a doc_id are
counted as rejected; of several rows of one document in one batch, the one with
the greatest content hash counts, as they have no order; a run without new files
writes nothing.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.chunk import ChunkConfig, chunks
from corpusloom.operators.normalize import NormalizationConfig, normalize
from corpusloom.operators.state import read_or_empty
from jobs import common

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "chunk_feed.json")
DEFAULTS = {"normalization": "default", "chunk_size": 400, "overlap": 0.15, "max_files_per_batch": 64}
MANIFEST = "doc_id bigint, content_hash string, n_chunks bigint, batch bigint"
CHUNKS = (
    "chunk_id string, doc_id bigint, chunk_index int, text string, token_estimate int, paragraph_start int, paragraph_end int, chunk_char_count int, "
    "page int, section string, content_hash string, batch bigint, source string"
)


def latest(spark: SparkSession, out: str, before: int | None = None) -> DataFrame:
    """doc_id, content_hash, batch of every document's last batch (of those before a given one)."""
    manifest = read_or_empty(spark, f"{out}/manifest", MANIFEST)
    if before is not None:
        manifest = manifest.where(F.col("batch") < before)
    return manifest.groupBy("doc_id").agg(F.max_by("content_hash", "batch").alias("content_hash"), F.max("batch").alias("batch"))


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of all documents as they were last delivered."""
    held = read_or_empty(spark, f"{out}/chunks", CHUNKS)
    return held.join(latest(spark, out).select("doc_id", "batch"), ["doc_id", "batch"])


def fresh(rows: DataFrame, held: DataFrame) -> DataFrame:
    """One row for each document whose content is not what ``held`` has: doc_id, text, source, content_hash."""
    text = F.coalesce("text", F.lit(""))
    rows = rows.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), "source", F.sha2(text, 256).alias("content_hash"))
    one = rows.groupBy("doc_id").agg(F.max(F.struct("content_hash", "text", "source")).alias("r")).select("doc_id", "r.*")
    known = held.select("doc_id", F.col("content_hash").alias("_held"))
    return one.join(known, "doc_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("_held"))).drop("_held")


def run(spark: SparkSession, documents: str, out: str, config: str = CONFIG) -> dict:
    """Takes all files that came since the last run; returns what was read and written."""
    given = common.settings(spark, config, DEFAULTS)
    rules, size = NormalizationConfig.preset(given["normalization"]), ChunkConfig(given["chunk_size"], given["overlap"])
    total = {"batches": 0, "rows_read": 0, "rejected": 0, "documents_written": 0, "chunks_written": 0}

    def take(rows: DataFrame, number: int) -> None:
        session = rows.sparkSession
        docs = fresh(rows, latest(session, out, before=number))
        if rules is not None:
            docs = normalize(docs, rules).withColumn("text", F.col("normalized.text")).drop("normalized")
        made = chunks(docs, size, carry=["content_hash", "source"]).withColumn("batch", F.lit(number).cast("bigint"))
        writer = lambda df, *by: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", *by)
        writer(made.select(*(c.split()[0] for c in CHUNKS.split(", "))), "source").parquet(f"{out}/chunks")
        written = read_or_empty(session, f"{out}/chunks", CHUNKS).where(F.col("batch") == number)
        entries = written.groupBy("doc_id", "content_hash", "batch").agg(F.count(F.lit(1)).alias("n_chunks"))
        writer(entries.select("doc_id", "content_hash", "n_chunks", "batch")).parquet(f"{out}/manifest")
        read = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("doc_id").isNull()).alias("bad")).first()
        wrote = read_or_empty(session, f"{out}/manifest", MANIFEST).where(F.col("batch") == number).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).first()
        for name, n in zip(total, (1, read.n, read.bad, wrote.docs, wrote.chunks)):
            total[name] += n
        common.LOG.info("batch %d: read %d rows of %s (%d without an id); wrote %d documents as %d chunks to %s", number, read.n, documents, read.bad, wrote.docs, wrote.chunks, out)

    schema = spark.read.parquet(documents).schema
    place = documents.rstrip("/")
    place = f"{place[:-1]}[{place[-1]}]"  # as a pattern it may name a file as well as a folder
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", given["max_files_per_batch"]).option("maxFileAge", "36500d").parquet(place)
    query = files.select("doc_id", "text", "source").writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    common.LOG.info("done: %s", total)
    return total


if __name__ == "__main__":
    common.main(__doc__, ["documents"], CONFIG, run)

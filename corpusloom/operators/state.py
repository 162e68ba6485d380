"""Manifest, chunk tables, failures, orphans and run reports as keyed tables.

Tables are replaced by key with one anti-join and one write.  ``Store`` writes a
new version beside the old one and then a new pointer, so readers see either
state and a lost job leaves the old one.  Pointers are numbered and never
rewritten: each is written aside and renamed, and the highest number counts.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

MANIFEST = "doc_id string, content_hash string, chunk_count int, source_path string, relative_path string, file_extension string, last_ingested string, metadata string"
FAILURES = "source_path string, error_type string, error_message string, traceback string, timestamp string, doc_id string"


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder name nobody uses, under the cluster's shared folder; where none is set and all tasks run here, under one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at a path; an empty one where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def changed(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose (doc_id, content_hash) the manifest does not have."""
    return docs.join(manifest.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")


def up_to_date(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    return docs.join(manifest.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_semi")


def replace_by_key(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``old`` whose key is not in ``new``, and all of ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Replace by key, keeping of equal keys in ``new`` the row that comes last in ``order``."""
    last = new.groupBy(key).agg(F.max_by(F.struct(*new.columns), order).alias("_r")).select("_r.*")
    return replace_by_key(old, last, key)


def delete_where(table: DataFrame, **equal) -> DataFrame:
    """Rows for which not all given columns equal the given values."""
    condition = F.lit(True)
    for name, value in equal.items():
        condition = condition & F.col(name).eqNullSafe(F.lit(value))
    return table.where(~condition)


def orphans(manifest: DataFrame, current: DataFrame, exists: DataFrame | None = None, path: str = "source_path") -> DataFrame:
    """Manifest rows whose path is neither among the current ones nor on disk (``exists``: paths that are)."""
    gone = manifest.join(current.select(path).distinct(), path, "left_anti")
    return gone if exists is None else gone.join(exists.select(path).distinct(), path, "left_anti")


def clean(table: DataFrame, lost: DataFrame, key: str = "doc_id") -> DataFrame:
    """The table without the orphans."""
    return table.join(lost.select(key).distinct(), key, "left_anti")


def clear_failure(failures: DataFrame, source_path: str) -> DataFrame:
    return failures.where(~F.col("source_path").eqNullSafe(F.lit(source_path)))


def retry_set(sources: DataFrame, failures: DataFrame) -> DataFrame:
    """Only the sources that failed before."""
    return sources.join(failures.select("source_path").distinct(), "source_path", "left_semi")


def run_report(outcomes: DataFrame) -> DataFrame:
    """One row from outcomes (status: processed, skipped or failed; chunks)."""
    n = lambda s: F.count_if(F.col("status") == s)
    return outcomes.agg(n("processed").alias("processed"), n("skipped").alias("skipped"), n("failed").alias("failed"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("bigint").alias("total_chunks"))


class Store:
    """Versioned tables in a folder of any file system that Spark writes."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _pointers(self, name: str) -> list:
        """Numbers of the table's pointers, the current one last."""
        fs, path = self._fs(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        names = (re.fullmatch(r"pointer-(\d+)\.json", s.getPath().getName()) for s in fs.listStatus(path))
        return sorted(int(m[1]) for m in names if m)

    def exists(self, name: str) -> bool:
        return bool(self._pointers(name))

    def path(self, name: str, number: int | None = None) -> str:
        if number is None:
            found = self._pointers(name)
            if not found:
                raise FileNotFoundError(f"no table {name} in {self.root}")
            number = found[-1]
        fs, path = self._fs(f"{self.root}/{name}/pointer-{number}.json")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return f"{self.root}/{name}/{json.loads(text)['version']}"

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        """The table; one that was never written is empty if a schema is given.  An unreadable pointer is an error."""
        if schema is not None and not self.exists(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(self.path(name))

    def write(self, name: str, df: DataFrame, partition_by: list | None = None) -> None:
        """A whole new version, then its pointer; the version replaced stays for its readers, older ones go."""
        before = self._pointers(name)
        version = uuid.uuid4().hex[:12]
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.root}/{name}/{version}")
        fs, aside = self._fs(f"{self.root}/{name}/{version}.tmp")
        stream = fs.create(aside, True)
        try:
            stream.write(bytearray(json.dumps({"version": version}).encode()))
        finally:
            stream.close()
        pointer = self._fs(f"{self.root}/{name}/pointer-{before[-1] + 1 if before else 0}.json")[1]
        if not fs.rename(aside, pointer):
            raise OSError(f"{pointer.toString()} exists: another run replaced {name}")
        for number in before[:-1]:
            for gone in (self.path(name, number), f"{self.root}/{name}/pointer-{number}.json"):
                fs.delete(self._fs(gone)[1], True)

    def write_observed(self, name: str, df: DataFrame, **metrics: Column) -> dict:
        """Writes the table and returns aggregates of its rows, taken by the tasks that write them.

        The write's own tasks count, and a task counts when it has succeeded, so
        a task that is run again on another executor is not counted twice.
        """
        seen = Observation(f"{name}-{uuid.uuid4().hex[:12]}")
        self.write(name, df.observe(seen, *(column.alias(c) for c, column in metrics.items())))
        return seen.get

    def tables(self) -> list:
        fs, path = self._fs(self.root)
        if not fs.exists(path):
            return []
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and self.exists(s.getPath().getName()))


def export_jsonl(table: DataFrame, path: str) -> None:
    """JSON lines, partitioned by a hash bucket of doc_id, never one folder per document."""
    table.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(64))).write.partitionBy("bucket").mode("overwrite").json(path)

"""Shared helpers of the training-data operators.

Conventions used by every operator of this subpackage:

* inputs are narrowed to the columns an operator needs before anything else
  happens, so extra columns (even with clashing names) never matter;
* a null text counts as the empty text unless an operator says otherwise;
* a null ``doc_id`` hashes like the empty string for hold-out purposes;
* intermediate tables go to the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_BATCH = 1024

_OWN_DIRS: list = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches to a few MB; long documents make row counts a poor proxy."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of our own only where it is unset and all tasks run on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/corpusloom-{label}-{uuid.uuid4().hex[:12]}"
    if not _OWN_DIRS:
        atexit.register(_clean)
    _OWN_DIRS.append((spark, path))
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _clean() -> None:
    while _OWN_DIRS:
        spark, path = _OWN_DIRS.pop()
        try:
            remove_path(spark, path)
        except Exception:  # the session may be gone when the interpreter ends
            return


def materialize(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends in files all executors see; ``by``: a folder for each of its values."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_buckets(df: DataFrame, label: str, key: str, count: int) -> DataFrame:
    """As materialize, in ``count`` buckets of ``key``: joins by it read these rows without an exchange. For one file a bucket, df comes dealt by repartition(count, key)."""
    spark = df.sparkSession
    path = new_path(spark, label)
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    df.write.format("parquet").bucketBy(count, key).option("path", path).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay, and the frame keeps its buckets
    return found


def remainder(col_name: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(F.col(col_name).cast("string"), F.lit(""))), F.lit(n))


def text_bytes(col_name: str = "text") -> Column:
    return F.coalesce(F.col(col_name).cast("binary"), F.lit(b"").cast("binary"))


def input_partitions(df: DataFrame) -> int:
    return max(1, df.rdd.getNumPartitions())


def hashes_of(strings):
    """XXH64 of every string, read from the array's buffers."""
    import numpy as np
    import xxhash

    n = len(strings)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    ends = np.frombuffer(strings.buffers()[1], dtype=np.int32)[strings.offset : strings.offset + n + 1].tolist()
    data, digest = strings.buffers()[2].to_pybytes(), xxhash.xxh64_intdigest
    return np.array([digest(data[a:b]) for a, b in zip(ends[:-1], ends[1:])], dtype=np.uint64)


def tidied(run):
    """The same batch function; when its task ends, memory it no longer needs goes back to the system.

    Python workers outlive their tasks, and what an allocator keeps would count against the executor.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except OSError:  # another C library has its own ways
                pass

    return wrapped

"""A keyed table in hash buckets, of which a change rewrites only those it touches.

    path/layout     one row for each generation: its number and its count of buckets
    path/rows-<g>   the rows of generation g, partitioned by bucket
    path/staged     the new content of the buckets that the last change touched
    path/marks      which changes are staged completely (ready) and which are applied (done)

A change reads the touched buckets (partition pruning), puts their new content
into ``staged``, marks it as ready, overwrites exactly these partitions (dynamic
partition overwrite) and marks it as done.  If the job is lost before ``ready``, the
table is as it was; after it, the next call applies the staged content again, so
no bucket stays half-written.  Readers during the overwrite may see some buckets
before and some after the change; use ``state.Store`` where they must not.

The count of buckets comes from the rows of the first write, ROWS_PER_BUCKET each;
when they hold GROWTH times as many, the table is dealt out anew into the next
generation, which readers see when its layout row is written.

Cases: a null key is a key of its own; rows that repeat a key are kept as they
are; a bucket that becomes empty keeps one row that is not live, which readers
never see; an empty change touches nothing; a key that is both new and gone is new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.state import read_or_empty

ROWS_PER_BUCKET, MAX_BUCKETS, GROWTH = 200_000, 4096, 4


class Buckets:
    def __init__(self, spark: SparkSession, path: str, schema: str, key: str = "doc_id", rows_per_bucket: int = ROWS_PER_BUCKET):
        self.spark, self.path, self.key, self.rows_per_bucket = spark, path.rstrip("/"), key, rows_per_bucket
        self.columns = [c.strip().split(" ")[0] for c in schema.split(", ")]
        self.schema = f"{schema}, _live boolean, bucket int"

    # -------------------------------------------------------- state
    def layout(self) -> tuple | None:
        """(generation, count of buckets), or None before the first write."""
        last = read_or_empty(self.spark, f"{self.path}/layout", "generation int, buckets int").agg(F.max(F.struct("generation", "buckets")).alias("r")).first().r
        return tuple(last) if last else None

    def _rows(self, generation: int) -> DataFrame:
        return read_or_empty(self.spark, f"{self.path}/rows-{generation}", self.schema)

    def read(self) -> DataFrame:
        now = self.layout()
        rows = self._rows(now[0]) if now else self.spark.createDataFrame([], self.schema)
        return rows.where("_live").select(*self.columns)

    def _last(self, state: str) -> int:
        marks = read_or_empty(self.spark, f"{self.path}/marks", "at timestamp, change int, state string")
        return marks.where(F.col("state") == state).agg(F.coalesce(F.max("change"), F.lit(0))).first()[0]

    def _mark(self, change: int, state: str) -> None:
        self.spark.range(1).select(F.current_timestamp().alias("at"), F.lit(change).alias("change"), F.lit(state).alias("state")).write.mode("append").partitionBy("change", "state").parquet(f"{self.path}/marks")

    # -------------------------------------------------------- changes
    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, generation: int) -> None:
        rows.hint("rebalance", F.col("bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows-{generation}")

    def _deal(self, rows: DataFrame, generation: int, buckets: int) -> None:
        """A whole generation; its layout row makes it the current one."""
        self._write(rows.select(*self.columns, F.lit(True).alias("_live"), self._bucket(buckets).alias("bucket")), generation)
        self.spark.createDataFrame([(generation, buckets)], "generation int, buckets int").write.mode("append").parquet(f"{self.path}/layout")

    def recover(self) -> None:
        """Applies a change that was staged, but perhaps not written whole."""
        ready = self._last("ready")
        if ready > self._last("done"):
            self._apply(ready)

    def _apply(self, change: int) -> None:
        generation, _ = self.layout()
        self._write(read_or_empty(self.spark, f"{self.path}/staged", self.schema), generation)
        self._mark(change, "done")

    def replace(self, new: DataFrame, gone: DataFrame | None = None) -> list:
        """Rows whose key is in ``new`` give way to those of ``new``, rows whose key is in ``gone`` go; returns the buckets written."""
        self.recover()
        new = new.select(*self.columns)
        now = self.layout()
        if now is None:
            size = new.count()
            if size:
                self._deal(new, 0, max(1, min(MAX_BUCKETS, -(-size // self.rows_per_bucket))))
            return list(range(self.layout()[1])) if size else []
        generation, buckets = now
        keys = new.select(self.key)
        keys = keys if gone is None else keys.union(gone.select(self.key))
        keys = keys.distinct().withColumn("bucket", self._bucket(buckets))
        touched = sorted(r.bucket for r in keys.select("bucket").distinct().collect())  # at most MAX_BUCKETS numbers
        if not touched:
            return []
        old = self._rows(generation).where(F.col("bucket").isin(touched) & F.col("_live"))
        gone_keys = keys.select(F.col(self.key).alias("_gone"))
        kept = old.join(gone_keys, F.col(self.key).eqNullSafe(F.col("_gone")), "left_anti")
        fresh = new.withColumn("_live", F.lit(True)).withColumn("bucket", self._bucket(buckets))
        blank = self.spark.createDataFrame([(b,) for b in touched], "bucket int").withColumn("_live", F.lit(False))
        kept.unionByName(fresh).unionByName(blank, allowMissingColumns=True).write.mode("overwrite").parquet(f"{self.path}/staged")
        change = self._last("ready") + 1
        self._mark(change, "ready")
        self._apply(change)
        size = self.read().count()
        if buckets < MAX_BUCKETS and size > GROWTH * buckets * self.rows_per_bucket:
            self._deal(self.read(), generation + 1, min(MAX_BUCKETS, -(-size // self.rows_per_bucket)))
        return touched

"""A learned embedding: randomised truncated SVD of weighted document-term rows, computed by Spark.

Words are hashed to FEATURES columns; a document's row holds (1 + log tf) * idf,
scaled to length one.  The right singular vectors V of all rows A come from
repeated passes of the range finder: each pass computes A' (A Q) for a thin Q,
partition by partition, adds the parts up by blocks of terms in a shuffle, and
orthonormalises the sum on the driver.  What the driver and each task hold is
FEATURES * (dimensions + OVERSAMPLE) numbers (10 MB at the defaults), whatever the
number of documents.  There is one task a core, so the sums that travel are as many
as the cores, not as the partitions.  The documents are read once, their feature
numbers and counts are written to the shared folder, and each pass reads those;
``fit_embed`` takes the embeddings of the same rows from them too.  Tasks multiply
blocks of rows as dense matrices over the features that the block has.

A text is embedded as its row times V, scaled to length one.  The squared error of
the projection is what is left of the rows' squares: total - sum of sigma squared.

Cases: a null or empty text, or one without a word that the corpus has twice, has
a vector of zeros; repeated rows count as often as they come; an empty table gives
a model without words, and zeros; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.state import new_folder

FEATURES, DIMENSIONS, OVERSAMPLE, PASSES, SEED = 1 << 14, 64, 10, 3, 42
TERMS_PER_BLOCK = 256
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Model:
    idf: np.ndarray  # by feature; zero for features that fewer than two documents have
    vectors: np.ndarray  # feature x dimension, orthonormal columns
    sigma: np.ndarray  # singular values, largest first
    total: float  # sum of squares of all rows

    @property
    def error(self) -> float:
        """Share of the rows' squares that the projection loses."""
        return 1 - float((self.sigma**2).sum()) / self.total if self.total else 0.0


def terms(text: Column, features: int = FEATURES) -> Column:
    """Feature numbers of the words of a text, repeats included."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int"))


def _counted(lists: pa.Array, features: int) -> tuple:
    """(row, feature, count) of a batch of term lists, sorted by row and feature."""
    owner, flat = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()
    kind = np.int32 if len(lists) * features < 1 << 31 else np.int64  # the shorter sorts faster
    key, count = np.unique(owner.astype(kind) * kind(features) + flat.astype(kind), return_counts=True)
    return key // features, key % features, count


def _weighted(counted: tuple, rows: int, idf: np.ndarray) -> tuple:
    """(row, feature, weight) of the weights above zero, rows scaled to length one."""
    row, feature, count = counted
    weight = (1 + np.log(count)) * idf[feature]
    length = np.sqrt(np.bincount(row, weight**2, minlength=rows))[row]
    keep = weight > 0
    return row[keep], feature[keep], (weight[keep] / length[keep]).astype(np.float32)


def _dense(matrix: tuple, rows: int, features: int) -> tuple:
    """(features that the batch has, its rows as a dense matrix over these)."""
    row, feature, weight = matrix
    has = np.zeros(features, bool)
    has[feature] = True
    place = np.cumsum(has) - 1
    out = np.zeros((rows, int(has.sum())), np.float32)
    out[row, place[feature]] = weight
    return np.flatnonzero(has), out


def _lists(batch: pa.RecordBatch, at: int) -> tuple:
    """((row, feature, count), rows) of some rows of the table of counts, whose last columns these are."""
    lists, counts = (batch.column(k)[at : at + ROWS_AT_ONCE] for k in (batch.num_columns - 2, batch.num_columns - 1))
    return (np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy(), counts.flatten().to_numpy()), len(lists)


def _unit(found: np.ndarray) -> pa.Array:
    """Rows scaled to length one, or zeros, as lists."""
    length = np.linalg.norm(found, axis=1, keepdims=True)
    found = np.divide(found, length, out=np.zeros_like(found), where=length > 1e-12).astype(np.float32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def _counts_table(docs: DataFrame, column: str, features: int, keep: tuple = ()) -> DataFrame:
    """The columns of ``keep``, and feature numbers and counts of every text, written once: each pass reads them instead of the texts."""
    spark = docs.sparkSession

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                lists = part.column(len(keep))
                row, feature, count = _counted(lists, features)
                ends = pa.array(np.r_[0, np.cumsum(np.bincount(row, minlength=len(lists)))].astype(np.int32))
                found = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (feature, count)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *found], names=[*keep, "_features", "_counts"])

    path = new_folder(spark, "lsa-terms")
    schema = _schema(docs.select(*keep), "_features array<int>", "_counts array<int>")
    docs.select(*keep, terms(F.col(column), features).alias("_terms")).mapInArrow(run, schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def _frequencies(held: DataFrame, features: int) -> np.ndarray:
    """Documents that have each feature."""

    def run(batches):
        total = np.zeros(features, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=features)
        t = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(total[t])], names=["t", "n"])

    counts = np.zeros(features)
    for r in held.select("_features").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # at most ``features`` rows
        counts[r.t] = r.n
    return counts


def _summed(parts: DataFrame, blocks: int) -> np.ndarray:
    """Matrices that tasks emitted as (block, body), added up block by block and put together; body: float32 by block of terms, float64 for a single block."""
    kind = np.float32 if blocks > 1 else np.float64

    def add(batches):
        held: dict = {}
        for batch in batches:
            for block, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(body, kind).astype(np.float64)
                held[block] = held[block] + part if block in held else part
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.astype(kind).tobytes() for x in held.values()], pa.binary())], names=["block", "body"])

    rows = {r.block: np.frombuffer(r.body, kind).astype(np.float64) for r in parts.repartition(min(blocks, 64), "block").mapInArrow(add, "block int, body binary").collect()}
    size = len(next(iter(rows.values()))) if rows else 0
    return np.concatenate([rows.get(b, np.zeros(size)) for b in range(blocks)]) if rows else np.zeros(0)


def _pass(docs: DataFrame, idf: np.ndarray, q: np.ndarray, blocks: int, make: Callable) -> DataFrame:
    """(block, body) from each task's sum of make(features of a batch, its dense rows, rows times q) over its batches."""
    kind = np.float32 if blocks > 1 else np.float64
    shared = docs.sparkSession.sparkContext.broadcast((idf, q.astype(np.float32)))

    def run(batches):
        total, (idf, q) = None, shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                counted, rows = _lists(batch, at)
                has, dense = _dense(_weighted(counted, rows, idf), rows, len(idf))
                total = make(has, dense, dense @ q[has], total)
        if total is not None:
            pieces = np.array_split(total.astype(kind), range(TERMS_PER_BLOCK, len(total), TERMS_PER_BLOCK)) if blocks > 1 else [total]
            for n, piece in enumerate(pieces):
                if piece.any():
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["block", "body"])

    return docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "block int, body binary")


def fit(docs: DataFrame, column: str = "text", dimensions: int = DIMENSIONS, features: int = FEATURES, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> Model:
    """The model of all rows of ``docs``."""
    return _fit(_counts_table(docs, column, features), dimensions, features, oversample, passes, seed)


def _fit(held: DataFrame, dimensions: int, features: int, oversample: int, passes: int, seed: int) -> Model:
    held = held.select("_features", "_counts")
    n = held.count()
    counts = _frequencies(held, features)
    idf = np.where(counts >= 2, np.log((n + 1) / (counts + 1)) + 1, 0.0)
    width = min(dimensions + oversample, features)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(features, width)))[0]
    blocks = -(-features // TERMS_PER_BLOCK)

    def back(has, dense, product, total):
        """Adds A' (A q) of a batch."""
        total = np.zeros((features, width)) if total is None else total
        total[has] += dense.T @ product
        return total

    def square(has, dense, product, total):
        """Adds (A q)' (A q) of a batch, and the sum of its squares in a row of its own."""
        part = np.zeros((width + 1, width))
        product = product.astype(np.float64)
        part[:width] = product.T @ product
        part[width, 0] = float(np.einsum("ij,ij->", dense, dense, dtype=np.float64))
        return part if total is None else total + part

    for _ in range(passes):
        found = _summed(_pass(held, idf, q, blocks, back), blocks)
        if not len(found):
            return Model(idf, np.zeros((features, dimensions)), np.zeros(dimensions), 0.0)
        q = np.linalg.qr(found.reshape(features, width))[0]
    small = _summed(_pass(held, idf, q, 1, square), 1).reshape(width + 1, width)
    values, turns = np.linalg.eigh(small[:width])
    best = np.argsort(values)[::-1][:dimensions]
    return Model(idf, q @ turns[:, best], np.sqrt(np.maximum(values[best], 0)), float(small[width, 0]))


def embed(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """Adds embedding array<float>: the text's row times the model's vectors, of length one, or zeros."""
    names = df.columns
    shared = df.sparkSession.sparkContext.broadcast((model.idf, model.vectors))

    def run(batches):
        idf, vectors = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                has, dense = _dense(_weighted(_counted(part.column(len(names)), len(idf)), part.num_rows, idf), part.num_rows, len(idf))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], _unit(dense @ vectors[has])], names=[*names, "embedding"])

    given = df.withColumn("_terms", terms(F.col(column), len(model.idf)))
    return given.mapInArrow(run, _schema(df, "embedding array<float>"))


def fit_embed(docs: DataFrame, keep: tuple, column: str = "text", dimensions: int = DIMENSIONS, features: int = FEATURES, oversample: int = OVERSAMPLE, passes: int = PASSES, seed: int = SEED) -> DataFrame:
    """The columns of ``keep`` and the embedding of every row by the model of all rows: ``embed(docs, fit(docs))``, with the texts read and cut into words once."""
    held = _counts_table(docs, column, features, keep)
    model = _fit(held, dimensions, features, oversample, passes, seed)
    shared = docs.sparkSession.sparkContext.broadcast((model.idf, model.vectors))

    def run(batches):
        idf, vectors = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_AT_ONCE):
                counted, rows = _lists(batch, at)
                has, dense = _dense(_weighted(counted, rows, idf), rows, len(idf))
                yield pa.RecordBatch.from_arrays([*(c.slice(at, ROWS_AT_ONCE) for c in batch.columns[: len(keep)]), _unit(dense @ vectors[has])], names=[*keep, "embedding"])

    return held.mapInArrow(run, _schema(docs.select(*keep), "embedding array<float>"))


def save(spark: SparkSession, model: Model, path: str) -> None:
    table = [(i, float(model.idf[i]), model.vectors[i].tolist()) for i in range(len(model.idf))]
    spark.createDataFrame(table, "feature int, idf double, vector array<double>").write.mode("overwrite").parquet(f"{path}/features")
    spark.createDataFrame([(model.sigma.tolist(), model.total)], "sigma array<double>, total double").write.mode("overwrite").parquet(f"{path}/sigma")


def load(spark: SparkSession, path: str) -> Model:
    rows = sorted(spark.read.parquet(f"{path}/features").collect())
    one = spark.read.parquet(f"{path}/sigma").first()
    return Model(np.array([r.idf for r in rows]), np.array([r.vector for r in rows]), np.array(one.sigma), one.total)

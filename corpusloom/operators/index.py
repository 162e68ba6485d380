"""Indexing: manifest with chunks, flat metadata, keyed replacement, verification, health."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What every indexed chunk must have, and may have.
REQUIRED = ("doc_id", "source_path", "chunk_index", "timestamp")
OPTIONAL = ("page", "section")


def select_docs(manifest: DataFrame, wanted: list | None) -> tuple:
    """(manifest rows of the wanted ids, ids that the manifest lacks); all rows and none without a filter."""
    if not wanted:
        return manifest, manifest.select("doc_id").limit(0)
    asked = manifest.sparkSession.createDataFrame([(w,) for w in dict.fromkeys(wanted)], "doc_id string")
    return manifest.join(F.broadcast(asked), "doc_id", "left_semi"), asked.join(manifest, "doc_id", "left_anti")


def present(value: Column, kind: T.DataType) -> Column:
    """Neither null nor the empty text."""
    return value.isNotNull() & (value != "") if isinstance(kind, T.StringType) else value.isNotNull()


def flatten(manifest: DataFrame, chunks: DataFrame, doc_meta: str | None = "metadata") -> DataFrame:
    """Chunk rows with document columns, later sources winning: core, document, chunk.

    manifest: doc_id, source_path, relative_path, file_extension, content_hash and
    optionally a struct ``metadata``.  Documents without chunks drop out.
    """
    core = ["doc_id", *(c for c in ("source_path", "relative_path", "file_extension", "content_hash") if c in manifest.columns)]
    kind = manifest.schema[doc_meta].dataType if doc_meta and doc_meta in manifest.columns else None
    fields = [f.name for f in kind.fields] if isinstance(kind, T.StructType) else []
    docs = manifest.select(*core, *(F.col(f"{doc_meta}.{f}").alias(f"_d_{f}") for f in fields))
    joined = chunks.join(docs, "doc_id")
    out: dict = {c: F.col(c) for c in core}
    for c in chunks.columns:
        if c != "doc_id":
            out[c] = F.coalesce(F.col(c), F.col(f"_d_{c}")) if c in fields else F.col(c)
    for f in fields:
        if f not in out:
            out[f] = F.coalesce(F.col(f"_d_{f}"), F.col(f)) if f in core else F.col(f"_d_{f}")
    if "ingestion_timestamp" in fields:
        stamp = F.nullif(F.col("_d_ingestion_timestamp"), F.lit(""))
        out["timestamp"] = F.coalesce(F.col("_d_timestamp"), stamp) if "timestamp" in fields else stamp
    return joined.select(*(v.alias(k) for k, v in out.items()))


def sanitize(df: DataFrame, keep: list | None = None) -> DataFrame:
    """Scalar columns as they are, all others as JSON text; nulls stay null and drop out of to_json."""
    keep = keep or []
    scalar = (T.StringType, T.NumericType, T.BooleanType)
    return df.select(*(F.col(f.name) if f.name in keep or isinstance(f.dataType, scalar) else F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name).cast("string").alias(f.name) for f in df.schema.fields))


def coverage(rows: DataFrame, required: tuple = REQUIRED, optional: tuple = OPTIONAL) -> DataFrame:
    """I13 in long form: field, required, n_present, pct (one decimal, half to even), over all rows given."""
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    has = lambda c: present(F.col(c), kinds[c]) if c in kinds else F.lit(False)
    counts = rows.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(has(c)).alias(f"n_{c}") for c in (*required, *optional)))
    entry = lambda c, r: F.struct(F.lit(c).alias("field"), F.lit(r).alias("required"), F.col(f"n_{c}").alias("n_present"))
    spread = counts.select("n", F.explode(F.array(*(entry(c, True) for c in required), *(entry(c, False) for c in optional))).alias("e"))
    return spread.where("n > 0").select("e.field", "e.required", "e.n_present", F.bround(F.col("e.n_present") / F.col("n") * 100, 1).alias("pct"))


def bottom_sample(rows: DataFrame, size: int, key: list, salt: str = "") -> DataFrame:
    """The ``size`` rows of smallest key hash: the same ones on every run and in any partitioning; each task keeps ``size`` rows before they meet.

    Null keys hash like the empty text; rows that repeat a key stand together, so the limit may take some of them only.
    """
    names = F.concat_ws("\n", F.lit(salt), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key))
    return rows.orderBy(F.md5(names), *key).limit(size)


def verify(rows: DataFrame, sample_size: int = 100, salt: str = "", key: list | None = None) -> DataFrame:
    """verified_chunks, missing_fields and the coverage map of a repeatable sample; one row; key: id, or else those of doc_id and chunk_index that there are."""
    key = key or (["id"] if "id" in rows.columns else [c for c in ("doc_id", "chunk_index") if c in rows.columns])
    sample = bottom_sample(rows, sample_size, key, salt)
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    complete = F.lit(True)
    for c in REQUIRED:
        complete = complete & (present(F.col(c), kinds[c]) if c in kinds else F.lit(False))
    pct = {c: F.bround(F.count_if(present(F.col(c), kinds[c]) if c in kinds else F.lit(False)) / F.count(F.lit(1)) * 100, 1) for c in (*REQUIRED, *OPTIONAL)}
    flat = [x for c, v in pct.items() for x in (F.lit(c), v)]
    return sample.agg(F.count(F.lit(1)).alias("verified_chunks"), F.count_if(~complete).alias("missing_fields"), F.create_map(*flat).alias("field_coverage"))


@dataclass(frozen=True)
class Health:
    healthy: bool
    message: str
    collection_count: int | None = None
    document_count: int | None = None


def health(store, collection: str | None = None) -> Health:
    """Is the folder there, is the collection there, how many rows."""
    fs, path = store._fs(store.root)
    if not fs.exists(path):
        return Health(False, f"path does not exist: {store.root}")
    tables = store.tables()
    if collection is None:
        return Health(True, f"{len(tables)} collection(s) available", len(tables))
    if collection not in tables:
        return Health(False, f"collection '{collection}' not found", len(tables))
    n = store.read(collection).count()
    return Health(True, f"collection '{collection}' has {n} documents", len(tables), n)

"""Chunk-level carry-over: vectors of unchanged chunks are kept, only new texts are embedded.

A chunk is known by its document and the digest of its text and of the model's
name, so a chunk that only moved within its document keeps its vector, and a new
model embeds everything again.

Cases: a null text counts as empty; a null document is a document of its own;
chunks that repeat within a document share one vector; rows of the old state
without a vector give none, so failed chunks are tried again; with an empty old
state everything is embedded; other columns are those of the new rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def digest(text: Column, model: str) -> Column:
    """SHA-256 of the model's name and the text."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), F.coalesce(text.cast("string"), F.lit(""))), 256)


def match(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """New rows (key, digest, ...) with the ``embedding`` that an old row of the same key and digest has, else null.

    One exchange of each side by (key, digest): a document that holds a third of
    all rows is spread by its digests, and chunks that repeat are matched to a
    single old row.
    """
    known = old.where("embedding IS NOT NULL").groupBy(F.col(key).alias("_key"), F.col("digest").alias("_digest")).agg(F.any_value("embedding").alias("embedding"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))
    return new.drop("embedding").join(known, same, "left").drop("_key", "_digest")


def complete(matched: DataFrame, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All matched rows with vectors, and ``carried``: was the vector there before?  ``matched`` is read twice, so give it as a written table."""
    kept = matched.where("embedding IS NOT NULL").withColumn("carried", F.lit(True))
    made = embed(matched.where("embedding IS NULL").drop("embedding")).withColumn("carried", F.lit(False))
    return kept.unionByName(made, allowMissingColumns=True)


def changes(old: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_reused, n_embedded, n_deleted of every document of either state.

    Reused and embedded are new rows with and without an old vector; deleted are
    old rows whose text the new state of the document lacks.
    """
    one, none = F.lit(1), F.lit(0)
    before = old.select(key, "digest", one.alias("_old"), none.alias("_new"), F.col("embedding").isNotNull().alias("_known"))
    after = new.select(key, "digest", none.alias("_old"), one.alias("_new"), F.lit(False).alias("_known"))
    texts = before.unionByName(after).groupBy(key, "digest").agg(F.sum("_old").alias("_old"), F.sum("_new").alias("_new"), F.bool_or("_known").alias("_known"))
    total = lambda column, when: F.sum(F.when(when, F.col(column)).otherwise(0)).alias
    return texts.groupBy(key).agg(total("_new", F.col("_known"))("n_reused"), total("_new", ~F.col("_known"))("n_embedded"), total("_old", F.col("_new") == 0)("n_deleted"))

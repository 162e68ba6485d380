"""Token-bounded chunks with overlap, page and section context.

Texts are cut into units (paragraphs, else sentences, else packed words) with
native expressions.  Packing is a sequential decision over token counts, so it
is the one Arrow function here: it sees integers only and returns unit ranges.
Chunk texts are slices of the unit array.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.functions.tokens import Estimate

DEFAULT_SIZE, DEFAULT_OVERLAP = 400, 0.15
MIN_OVERLAP, MAX_OVERLAP = 0.10, 0.20
RANGES = "array<struct<first:int,last:int>>"


@dataclass(frozen=True)
class ChunkConfig:
    size: int = DEFAULT_SIZE
    overlap: float = DEFAULT_OVERLAP

    def __post_init__(self):
        if self.size <= 0:
            raise ValueError("the chunk size must be positive")

    @property
    def overlap_tokens(self) -> int:
        """The overlap is held between 10 and 20 per cent; its whole tokens may be zero."""
        return int(self.size * min(MAX_OVERLAP, max(MIN_OVERLAP, self.overlap)))


def pack_units(tokens: list, size: int, overlap: int) -> list:
    """Ranges [first, last] of units: a range ends before the unit that would exceed size; the next
    starts at the shortest tail of whole units with ``overlap`` tokens or more (all of it if there is none)."""
    sums = np.r_[0, np.cumsum(np.asarray(tokens, dtype=np.int64))]
    out, start = [], 0
    for i in range(len(tokens)):
        if i > start and sums[i + 1] - sums[start] > size:
            out.append((start, i - 1))
            if overlap <= 0:
                start = i
            else:  # the largest j with sums[i] - sums[j] >= overlap, not before start
                start = max(start, min(i - 1, int(np.searchsorted(sums, sums[i] - overlap, side="right")) - 1))
    if tokens is not None and len(tokens):
        out.append((start, len(tokens) - 1))
    return out


def pack_words(tokens: list, size: int) -> list:
    """Ranges of words: one more token for each word after the first; an over-long word stands alone."""
    out, start, held = [], None, 0
    for i, n in enumerate(tokens):
        if n > size:
            if start is not None:
                out.append((start, i - 1))
            out.append((i, i))
            start, held = None, 0
        elif held + n + 1 > size:
            if start is not None:
                out.append((start, i - 1))
            start, held = i, n
        else:
            if start is None:
                start = i
            held += n + 1
    if start is not None:
        out.append((start, len(tokens) - 1))
    return out


def _ranges(tokens: Column, function) -> Column:
    @F.pandas_udf(RANGES)
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda x: [] if x is None else [{"first": a, "last": b} for a, b in function(list(x))])

    return run(tokens)


def chunk_ranges(tokens: Column, config: ChunkConfig) -> Column:
    size, overlap = config.size, config.overlap_tokens
    return _ranges(tokens, lambda x: pack_units(x, size, overlap))


def word_ranges(tokens: Column, size: int) -> Column:
    return _ranges(tokens, lambda x: pack_words(x, size))


def units(df: DataFrame, size: int, column: str = "text", tokens=None) -> DataFrame:
    """Adds ``units``: array of (text, tokens).

    Paragraphs that fit stay whole; longer ones become sentences; sentences that
    still do not fit are packed from words.  Only those reach the word packer.
    """
    tokens = tokens or Estimate()
    pair = lambda t, n: F.struct(t.alias("text"), n.alias("tokens"))
    out = df.withColumn("_u_paragraphs", T.paragraphs(F.col(column)))
    out = out.withColumn("_u_counts", tokens.many(F.col("_u_paragraphs")))
    parts = F.flatten(F.zip_with("_u_paragraphs", "_u_counts", lambda p, n: F.when(n <= size, F.array(p)).otherwise(T.sentences(p))))
    out = out.withColumn("_u_parts", T.fence(parts)).withColumn("_u_counts", tokens.many(F.col("_u_parts")))
    out = out.withColumn("_u_parts", F.zip_with("_u_parts", "_u_counts", pair))
    # Word packing, for the parts that are still too long.
    words = F.transform(F.filter("_u_parts", lambda p: p["tokens"] > size), lambda p: T.words(p["text"]))
    out = out.withColumn("_u_words", T.fence(words)).withColumn("_u_flat", F.flatten("_u_words"))
    out = out.withColumn("_u_flat", tokens.many(F.col("_u_flat")))

    @F.pandas_udf("array<" + RANGES + ">")
    def pack(lengths: pd.Series, counts: pd.Series) -> pd.Series:
        def one(sizes, flat):
            at, found = 0, []
            for n in sizes:
                found.append([{"first": a, "last": b} for a, b in pack_words(list(flat[at : at + n]), size)])
                at += n
            return found

        return pd.Series([one(a, b) for a, b in zip(lengths, counts)])

    packed = F.when(F.size("_u_words") > 0, pack(F.transform("_u_words", F.size), F.col("_u_flat"))).otherwise(F.array().cast(f"array<{RANGES}>"))
    out = out.withColumn("_u_ranges", packed)
    joined = F.zip_with("_u_words", "_u_ranges", lambda ws, rs: F.transform(rs, lambda r: F.array_join(F.slice(ws, r["first"] + 1, r["last"] - r["first"] + 1), " ")))
    out = out.withColumn("_u_packed", T.fence(joined))
    # Each long part gives way to its packed words; the k-th long part owns the k-th list.
    spots = F.filter(F.transform("_u_parts", lambda p, i: F.when(p["tokens"] > size, i)), lambda i: i.isNotNull())
    out = out.withColumn("_u_spots", T.fence(spots))
    merged = F.flatten(F.transform("_u_parts", lambda p, i: F.when(p["tokens"] > size, F.try_element_at("_u_packed", F.array_position("_u_spots", i).cast("int"))).otherwise(F.array(p["text"]))))
    out = out.withColumn("_u_merged", F.when(F.size("_u_words") == 0, F.transform("_u_parts", lambda p: p["text"])).otherwise(merged))
    out = out.withColumn("_u_counts", F.when(F.size("_u_words") == 0, F.transform("_u_parts", lambda p: p["tokens"])).otherwise(tokens.many(F.col("_u_merged"))))
    return out.withColumn("units", T.fence(F.zip_with("_u_merged", "_u_counts", pair))).select(*df.columns, "units")


def chunks(docs: DataFrame, config: ChunkConfig | None = None, tokens=None, carry: list | None = None) -> DataFrame:
    """One row per chunk of docs (doc_id, text):

    chunk_id, doc_id, chunk_index, text, token_estimate, paragraph_start, paragraph_end,
    chunk_char_count, chunk_token_count, page, section, and the columns in ``carry``
    (such as source_page_count, source_title).

    A chunk carries the page and section of the unit that closed it (the unit
    after its last).  Where none is known yet, the chunk's own text is searched
    once, and what is found there holds until a unit says otherwise.  A null or
    empty text gives one empty chunk.  Nothing here shuffles: context is looked
    up in the row's own list of markers.
    """
    config = config or ChunkConfig()
    tokens = tokens or Estimate()
    carry = carry or []
    base = docs.select("doc_id", *carry, F.coalesce("text", F.lit("")).alias("text"))
    base = units(base, config.size, tokens=tokens).drop("text")
    base = base.withColumn("ranges", chunk_ranges(F.transform("units", lambda u: u["tokens"]), config))

    def marks(read) -> Column:
        return F.filter(F.transform("units", lambda u, i: F.struct(i.alias("at"), read(u["text"]).alias("x"))), lambda m: m["x"].isNotNull())

    base = base.withColumn("_pages", T.fence(marks(T.page_marker))).withColumn("_sections", T.fence(marks(T.section)))

    def known(column: str, r: Column) -> Column:
        """The last mark up to the unit after range r."""
        return F.when(F.size(column) > 0, F.try_element_at(F.filter(column, lambda m: m["at"] <= r["last"] + 1), F.lit(-1))["x"])

    raw = lambda r: T.strip(F.array_join(F.transform(F.slice("units", r["first"] + 1, r["last"] - r["first"] + 1), lambda u: u["text"]), "\n\n"))
    made = F.transform("ranges", lambda r, i: F.struct(i.alias("n"), r["first"].alias("first"), r["last"].alias("last"), raw(r).alias("raw"), known("_pages", r).alias("page"), known("_sections", r).alias("section")))
    base = base.withColumn("_made", T.fence(made)).select("doc_id", *carry, "_made")

    def fallback(name: str, read) -> Column:
        """The first chunk without context whose own text has a mark."""
        own = F.transform("_made", lambda c: F.when(c[name].isNull(), F.struct(c["n"].alias("n"), read(c["raw"]).alias("x"))))
        return F.try_element_at(F.filter(own, lambda o: o.isNotNull() & o["x"].isNotNull()), F.lit(1))

    base = base.withColumn("_page", fallback("page", T.page_marker)).withColumn("_section", fallback("section", T.section))
    rows = base.select("doc_id", *carry, "_page", "_section", F.explode("_made").alias("c")).withColumn("text", T.strip_markers(F.col("c.raw")))
    rows = rows.withColumn("_tokens", tokens.one(F.col("text")))
    return rows.select(
        F.format_string("%s::chunk-%04d", F.col("doc_id").cast("string"), "c.n").alias("chunk_id"),
        "doc_id",
        F.col("c.n").alias("chunk_index"),
        "text",
        F.col("_tokens").alias("token_estimate"),
        F.col("c.first").alias("paragraph_start"),
        F.col("c.last").alias("paragraph_end"),
        F.length("text").alias("chunk_char_count"),
        F.col("_tokens").alias("chunk_token_count"),
        F.coalesce("c.page", F.when(F.col("_page.n") <= F.col("c.n"), F.col("_page.x"))).alias("page"),
        F.coalesce("c.section", F.when(F.col("_section.n") <= F.col("c.n"), F.col("_section.x"))).alias("section"),
        *carry,
    )

"""Exact top-k cosine retrieval, filters, hit rendering and retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import nearest


def effective_k(k: int | None, default: int = 5) -> int:
    """R3 of the chain: zero means the default."""
    return k or default


def top_k(collection: DataFrame, queries: DataFrame, k: int, where: Column | None = None, id_column: str = "id", max_queries: int = 10_000) -> DataFrame:
    """R2: query_id, rank, distance and the collection's columns of the k nearest rows of every query.

    collection: id_column, embedding; queries: query_id, embedding.  ``where``
    filters the collection before the search (R5).  Ties go to the smaller id.

    Distances come from blocks of rows against blocks of queries (``nearest``), so the
    exchange holds k rows per query and task.  Queries are a stated set: their blocks
    are broadcast, at most ``max_queries`` rows a pass.
    """
    rows = collection if where is None else collection.where(where)
    held = nearest.spread(rows.select(id_column, "embedding"), id_column)
    total = queries.count()
    passes = max(1, -(-total // max_queries))
    order = Window.partitionBy("query_id").orderBy("distance", id_column)
    found = None
    for n in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == n)
        pairs = nearest.pairs(nearest.blocks(held, id_column), nearest.blocks(part, "query_id", nearest.QUERY_BYTES), k)
        best = pairs.select("query_id", F.col("key").alias(id_column), "distance").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = best if found is None else found.unionByName(best)
    rest = [c for c in rows.columns if c not in (id_column, "embedding")]
    if not rest:
        return found
    return found.join(rows.select(id_column, *rest), id_column)


def filters(page_from: int | None = None, page_to: int | None = None, since: str | None = None, acl: str | None = None, until: str | None = None, reader: str | None = None, **equal) -> Column:
    """Equality on any column, page and timestamp ranges, acl_read containing a text (acl) or listing a reader (commas between names).

    Nulls pass no condition on their column.  Equality and ranges reach the Parquet scan.
    """
    out = F.lit(True)
    for name, value in equal.items():
        out = out & (F.col(name) == value)
    if page_from is not None:
        out = out & (F.col("page") >= page_from)
    if page_to is not None:
        out = out & (F.col("page") <= page_to)
    if since is not None:
        out = out & (F.col("timestamp") >= since)
    if until is not None:
        out = out & (F.col("timestamp") <= until)
    if reader is not None:
        out = out & F.array_contains(F.transform(F.split("acl_read", ","), lambda name: F.trim(name)), reader)
    return out & F.col("acl_read").contains(acl) if acl is not None else out


# ------------------------------------------------------------ rendering
def snippet(text: Column, max_chars: int) -> Column:
    """One line; longer texts are cut to max_chars - 3 and get dots."""
    flat = F.replace(T.strip(text), F.lit("\n"), F.lit(" "))
    cut = F.regexp_replace(F.substring(flat, 1, max(0, max_chars - 3)), rf"[{T.SPACE}]+\z", "")
    return F.when(F.length(flat) > max_chars, F.concat(cut, F.lit("..."))).otherwise(flat)


def four_places(x: Column) -> Column:
    """'%.4f' as C and Python round it: the binary value, not its shortest decimal, which format_string takes."""
    smallest = F.concat(F.when(x < 0, "-").otherwise(""), F.lit("0.0001"))  # format_number takes 0.00005 itself for a tie
    return F.when((F.abs(x) >= 0.00005) & (F.abs(x) < 0.0001), smallest).otherwise(F.call_function("format_number", x, F.lit("0.0000")))


def hit_text(rank: Column, text: Column, meta: dict, distance: Column, max_chars: int = 240) -> Column:
    """Header, place, time and snippet of a hit; meta maps names to columns (null means absent)."""
    get = lambda name: meta.get(name, F.lit(None).cast("string"))
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    head = F.concat(F.lit("["), rank.cast("string"), F.lit("] doc_id="), shown(get("doc_id")), F.lit(" chunk_id="), shown(get("chunk_id")), F.lit(" path="), shown(F.coalesce(F.nullif(get("relative_path"), F.lit("")), get("source_path"))))
    head = F.concat(head, F.when(distance.isNotNull(), F.concat(F.lit(" | distance="), four_places(distance))).otherwise(""))
    section = get("section")
    section = F.when(F.length(section) > 40, F.concat(F.substring(section, 1, 37), F.lit("..."))).otherwise(section)
    place = F.concat_ws(
        ", ",
        F.concat(F.lit("page "), get("page").cast("string")),
        F.concat(F.lit('section "'), section, F.lit('"')),
        F.concat(F.lit("paragraphs "), get("paragraph_start").cast("string"), F.lit("-"), get("paragraph_end").cast("string")),
    )
    stamp = F.nullif(get("timestamp").cast("string"), F.lit(""))
    return F.concat(head, F.when(place != "", F.concat(F.lit("\n    ["), place, F.lit("]"))).otherwise(""), F.coalesce(F.concat(F.lit("\n    indexed: "), stamp), F.lit("")), F.lit("\n    "), snippet(text, max_chars))


def hit_json(rank: Column, chunk_id: Column, distance: Column, metadata: Column, text: Column) -> Column:
    """R6."""
    return F.to_json(F.struct(rank.alias("rank"), chunk_id.alias("chunk_id"), distance.alias("distance"), metadata.alias("metadata"), text.alias("text")))


def source_line(rank: Column, text: Column, relative_path: Column, page: Column, distance: Column) -> Column:
    """R11."""
    where = F.coalesce(F.concat(F.lit(" (page "), page.cast("string"), F.lit(")")), F.lit(""))
    short = F.concat(F.replace(F.substring(text, 1, 100), F.lit("\n"), F.lit(" ")), F.lit("..."))
    return F.concat(F.lit("  ["), rank.cast("string"), F.lit("] "), F.coalesce(relative_path, F.lit("unknown")), where, F.lit(" (dist: "), F.coalesce(four_places(distance), F.lit("null")), F.lit(")"), F.lit("\n      "), short)


def sources_json(text: Column, metadata: Column, distance: Column) -> Column:
    """The first 200 characters, dots if there are more."""
    short = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.lit("..."))).otherwise(text)
    return F.to_json(F.struct(short.alias("text"), metadata.alias("metadata"), distance.alias("distance")))


# ------------------------------------------------------------ evaluation
def evaluate(hits: DataFrame, expected: DataFrame, max_distance: float = 1.0) -> DataFrame:
    """Q1: per query: query_id, query_type, expected_id, found_at_rank, distance, passed, reciprocal_rank.

    hits: query_id, rank, id, distance; expected: query_id, query_type, expected_id.
    """
    joined = expected.join(hits.select("query_id", F.col("id").alias("expected_id"), "rank", "distance"), ["query_id", "expected_id"], "left")
    best = joined.groupBy("query_id", "query_type", "expected_id").agg(F.min("rank").alias("found_at_rank"), F.min("distance").alias("distance"))
    passed = F.col("found_at_rank").isNotNull() & (F.col("distance") <= max_distance)
    return best.withColumn("passed", passed).withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("found_at_rank"), F.lit(0.0)))


def pass_rates(results: DataFrame) -> DataFrame:
    """Share passed and mean reciprocal rank by query type."""
    return results.groupBy("query_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_passed"), F.round(F.avg(F.col("passed").cast("int")), 6).alias("hit_rate"), F.round(F.avg("reciprocal_rank"), 6).alias("mrr"))

"""Exact deduplication with an extendible-hash index, in DataFrame operations only.

1. *Directory.*  Keys are the XXH64 of texts.  A bucket owns the keys that share
   its leading bits, its local depth.  Distinct keys are counted (approximately,
   one row for each bucket and next bits, never one for each key); a bucket above
   ``capacity`` is split, and halves that are still too full are counted and split
   again, to whatever depth that takes.  The directory doubles with the deepest
   bucket.  Copies of one text count once, so a hot text splits nothing.
2. *Entries.*  One hash aggregate compares whole texts as bytes wherever keys
   meet, so texts that collide are entries of their own.  Copies are
   pre-aggregated before the exchange: a hot text moves once per input task, not
   once per row.
3. *Index files.*  The directory names the owner: each owner task takes the
   entries of whole buckets, that is of key ranges, chains those of one key in
   the order of their digests, and writes a file for each of its buckets to the
   shared folder.
4. *Lookup.*  Every row asks its bucket for the chain of its key and takes the
   entry with its digest; the hot side is split at run time by the adaptive skew
   join.

Cases: a null text counts as empty; rows with a null doc_id count in their
group but are kept only if no row of the group has an id; rows that repeat both
text and doc_id are all marked kept (they are one document twice), and
``deduplicate`` keeps one of them; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

CAPACITY = 1 << 13  # distinct keys of a bucket; tables of ten thousand texts split already
STEP = 6  # bits that one count looks ahead
DEEPEST = 62  # of the 64 bits of a key: beyond, texts collide


def lead(key: Column, depth: Column | int) -> Column:
    """The leading bits of a key."""
    if isinstance(depth, int):
        return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("bigint")
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", key, (64 - depth).cast("int")))


def split(counts: dict, prefix: int, depth: int, ahead: int, capacity: int) -> tuple:
    """(buckets that hold, buckets that may need a closer count) of one bucket; counts: keys by the next ``ahead`` bits."""
    done, deeper = [], []
    todo = [(prefix, depth)]
    while todo:
        here, local = todo.pop()
        shift = depth + ahead - local
        n = sum(c for bits, c in counts.items() if bits >> shift == here)
        if n <= capacity or local >= DEEPEST:
            done.append((here, local))
        elif not shift:
            deeper.append((here, local))
        else:
            todo += [(here << 1, local + 1), (here << 1 | 1, local + 1)]
    return done, deeper


def directory(keyed: DataFrame, capacity: int) -> list:
    """The buckets as (leading bits, local depth), in key order; a count for every STEP bits of depth."""
    done, todo = [], [(0, 0)]
    while todo:
        depth = todo[0][1]  # all that are still open have one depth
        ahead = min(STEP, DEEPEST - depth)
        wanted = keyed.withColumn("prefix", lead(F.col("key"), depth))
        if depth:
            opened = keyed.sparkSession.createDataFrame([(p,) for p, _ in todo], "prefix long")
            wanted = wanted.join(F.broadcast(opened), "prefix", "left_semi")  # a row for each capacity keys at most
        rows = wanted.groupBy("prefix", lead(F.col("key"), depth + ahead).alias("bits")).agg(F.approx_count_distinct("key").alias("n")).collect()
        counts: dict = {}
        for r in rows:
            counts.setdefault(r.prefix, {})[r.bits] = r.n
        later = []
        for prefix, _ in todo:
            whole, deeper = split(counts.get(prefix, {}), prefix, depth, ahead, capacity)
            done += whole
            later += deeper
        todo = later
    return sorted(done, key=lambda b: b[0] << (64 - b[1]))


def bucket_of(key: Column, buckets: list) -> Column:
    """The directory's answer for a key: the slot of its leading bits, as a lookup in a literal array."""
    depth = max(local for _, local in buckets)
    if not depth:
        return F.lit(0)
    slots = [number for number, (_, local) in enumerate(buckets) for _ in range(1 << (depth - local))]
    listed = F.split(F.lit(",".join(map(str, slots))), ",").cast("array<int>") if len(slots) > 1 else F.array(F.lit(0))
    return F.element_at(listed, (lead(key, depth) + 1).cast("int"))


def index(docs: DataFrame, capacity: int = CAPACITY) -> tuple:
    """(rows, chains): keyed documents, and the index (bucket, key, chain of (digest, keep_id, group_size)) read from its files."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("body")).withColumn("key", F.xxhash64("body"))
    bucket = bucket_of(F.col("key"), directory(keyed.select("key"), capacity))
    entries = keyed.groupBy("key", "body").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    entries = entries.select(bucket.alias("bucket"), "key", F.struct(F.sha2("body", 256).alias("digest"), "keep_id", "group_size").alias("entry"))
    owned = entries.repartition("bucket")  # the owner of a bucket takes all of its entries, which capacity bounds
    chains = owned.groupBy("bucket", "key").agg(F.array_sort(F.collect_list("entry")).alias("chain"))
    chains = materialize(chains, "exact-index", by="bucket")
    rows = keyed.select("doc_id", bucket.alias("bucket"), "key", F.sha2("body", 256).alias("digest"))
    return rows, chains


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per document."""
    rows, chains = index(docs, capacity)
    found = rows.join(chains, ["bucket", "key"]).withColumn("entry", F.filter("chain", lambda e: e["digest"] == F.col("digest"))[0])
    return found.select(
        "doc_id", "entry.keep_id", "entry.group_size", F.col("doc_id").eqNullSafe(F.col("entry.keep_id")).alias("kept"), F.col("digest").alias("text_sha256")
    )


def deduplicate(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, with all their columns; rows that repeat both id and text stay once."""
    groups = exact_groups(docs, capacity)
    gone = groups.where("not kept").select(F.concat_ws(":", "doc_id", "text_sha256").alias("_exact_key")).distinct()
    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    marked = docs.withColumn("_exact_key", F.concat_ws(":", F.col("doc_id").cast("bigint"), digest))
    return marked.join(gone, "_exact_key", "left_anti").dropDuplicates(["_exact_key"]).select(*docs.columns)

"""Prefix trie of conversations, built as a Patricia trie and then expanded.

A node is a distinct sequence of the first d turns (role, text); the root has
none.  Turns are known by hashes, a prefix by the sum of hashes of (place, turn)
(128 bits together), so all prefixes of a conversation come from one running sum.

1. Rows of all conversations are sorted by prefix (a hash aggregate with partial
   sums on the map side), and only *points* are created: prefixes where some
   conversation ends or where two different turns follow.  An edge joins a point
   to the next point above it; what lies between are unary nodes with the same
   members as the point below.
2. The points whose smallest member is conversation c form a *chain* on the path
   of c, deepest part first; above it hangs on a point of another chain.  So a
   subtree's sum is the rest of the own chain, plus the totals of the chains of
   all other conversations that pass the point: one join and one aggregate, and
   no loop over levels.
3. Unary nodes are expanded edge by edge; the code points below a node within its
   edge are the difference of two running sums (the edge's suffix sum).

Running sums are taken in blocks of BLOCK places with the totals of the blocks
before, so one endless conversation is many tasks' work; groups of copies are
aggregated before they are exchanged; lists of conversation ids are packed into
strings of bounded size in order before the task that digests a node sees them.

Cases: a null conv_id is no conversation and builds nothing; null role or text is
empty; a null turn comes first; turns with one number follow one another by role,
then text (such ties of one conversation and number are sorted in one task);
repeated rows are turns of their own; other columns never matter; an empty table
gives no nodes, as no conversation is there to be a member of the root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, tidied

BLOCK = 4096
UNROLL = 8192
PACK_BYTES = 1 << 16


def running(rows: DataFrame, keys: list, place: str, sums: dict) -> DataFrame:
    """Adds running sums of columns over ``place`` (a number) within the keys; sums: new name to column, all before and at the row."""
    held = rows.withColumn("_block", F.expr(f"{place} div {BLOCK}"))
    near = Window.partitionBy(*keys, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    far = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = held.groupBy(*keys, "_block").agg(*(F.sum(c).alias(f"_t_{n}") for n, c in sums.items()))
    before = totals.select(*keys, "_block", *(F.sum(f"_t_{n}").over(far).alias(f"_b_{n}") for n in sums)).where(F.col(f"_b_{next(iter(sums))}").isNotNull())
    local = held.select(*held.columns, *(F.sum(c).over(near).alias(n) for n, c in sums.items()))
    joined = local.join(before, [*keys, "_block"], "left")
    return joined.select(*rows.columns, *((F.col(n) + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums))


# ------------------------------------------------------------ turns
def turns(conversations: DataFrame) -> DataFrame:
    """(conv, place from 1, h1, h2, chars): the turns of every conversation in order."""
    held = conversations.select(F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = held.where("conv IS NOT NULL").withColumn("_block", F.coalesce(F.expr(f"turn div {BLOCK}"), F.lit(-(2**63))))
    near = Window.partitionBy("conv", "_block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    far = Window.partitionBy("conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = held.groupBy("conv", "_block").agg(F.count(F.lit(1)).alias("n")).select("conv", "_block", F.sum("n").over(far).alias("_before")).where("_before IS NOT NULL")
    numbered = held.withColumn("place", F.row_number().over(near).cast("bigint")).select(
        "conv", "_block", "place", F.xxhash64(F.lit(1), "role", F.lit("\n"), "text").alias("h1"), F.xxhash64(F.lit(2), "role", F.lit("\n"), "text").alias("h2"), F.length("text").cast("bigint").alias("chars")
    )
    return numbered.join(before, ["conv", "_block"], "left").select("conv", (F.col("place") + F.coalesce("_before", F.lit(0))).alias("place"), "h1", "h2", "chars")


def whole(rows: DataFrame) -> tuple:
    """(paths, members) of conversations as they are; rows: as turns() gives them."""
    members = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("total"))
    paths = rows.join(members, "conv").select("conv", F.col("place").alias("depth"), "h1", "h2", "chars", (F.col("place") == F.col("total")).alias("last"))
    return paths, members


def rebuilt(rows: DataFrame, group: int = 100, most: int = 6) -> tuple:
    """(paths, members): conversation c gets the first h turns of c - c % group before its own turns after its first h; h = crc32(c) % most.

    Of a conversation that others begin with, only its first ``most - 1`` turns are
    exchanged, to fewer than 2 * group conversations, so no key is hot here.
    """
    own = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    base = own.where(F.col("conv") % group == 0).select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    h = F.crc32(F.col("conv").cast("string")) % most
    joined = own.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % group).alias("base")).join(base, "base", "left")
    take = F.least("h", F.coalesce("n_base", F.lit(0)))
    members = joined.select("conv", "base", "h", take.alias("take"), (take + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total"))
    rest = rows.join(members, "conv").where("place > h").select("conv", (F.col("take") + F.col("place") - F.col("h")).alias("depth"), "h1", "h2", "chars", "total")
    heads = rows.where((F.col("conv") % group == 0) & (F.col("place") < most)).withColumnRenamed("conv", "base")
    begin = heads.join(members.where("take > 0"), "base").where("place <= take").select("conv", F.col("place").alias("depth"), "h1", "h2", "chars", "total")
    paths = rest.unionByName(begin)
    return paths.select("conv", F.col("depth").cast("bigint").alias("depth"), "h1", "h2", "chars", (F.col("depth") == F.col("total")).alias("last")), members.select("conv", "total")


# ------------------------------------------------------------ the trie
def key(part: int, depth: Column, s1: Column, s2: Column) -> Column:
    """Half of a prefix's name."""
    return F.xxhash64(F.lit(part), depth.cast("bigint"), s1.cast("decimal(38,0)"), s2.cast("decimal(38,0)"))


def prefixes(paths: DataFrame) -> DataFrame:
    """(conv, depth, chars, last, cum, next, k1, k2, p1, p2): running sums, names of the prefix and of the one above, the turn that follows."""
    number = lambda part: F.xxhash64(F.lit(part), "depth", "h1", "h2").cast("decimal(20,0)")
    rows = paths.select("conv", "depth", "chars", "last", F.xxhash64("h1", "h2").alias("h"), number(3).alias("f1"), number(4).alias("f2"), F.lit(False).alias("_ghost"))
    # The first row of a block stands once more at the end of the block before, for the turn that follows.
    both = rows.withColumn("_block", F.expr(f"depth div {BLOCK}")).unionByName(rows.where(F.col("depth") % BLOCK == 0).withColumn("_ghost", F.lit(True)).withColumn("_block", F.expr(f"depth div {BLOCK} - 1")))
    order = Window.partitionBy("conv", "_block").orderBy("depth")
    near = order.rowsBetween(Window.unboundedPreceding, 0)
    far = Window.partitionBy("conv").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    local = both.select("conv", "depth", "chars", "last", "_block", "_ghost", "f1", "f2", F.sum("f1").over(near).alias("s1"), F.sum("f2").over(near).alias("s2"), F.sum("chars").over(near).alias("cum"), F.lead("h").over(order).alias("next")).where("NOT _ghost")
    totals = rows.withColumn("_block", F.expr(f"depth div {BLOCK}")).groupBy("conv", "_block").agg(F.sum("f1").alias("t1"), F.sum("f2").alias("t2"), F.sum("chars").alias("t3"))
    before = totals.select("conv", "_block", *(F.sum(f"t{k}").over(far).alias(f"b{k}") for k in (1, 2, 3))).where("b3 IS NOT NULL")
    found = local.join(before, ["conv", "_block"], "left")
    s1, s2, cum = (F.col(c) + F.coalesce(b, F.lit(0)) for c, b in (("s1", "b1"), ("s2", "b2"), ("cum", "b3")))
    found = found.select("conv", "depth", "chars", "last", "next", cum.alias("cum"), s1.alias("s1"), s2.alias("s2"), (s1 - F.col("f1")).alias("r1"), (s2 - F.col("f2")).alias("r2"))
    names = [key(part, F.col("depth") - up, F.col(a), F.col(b)).alias(n) for n, part, up, a, b in (("k1", 1, 0, "s1", "s2"), ("k2", 2, 0, "s1", "s2"), ("p1", 1, 1, "r1", "r2"), ("p2", 2, 1, "r1", "r2"))]
    return found.select("conv", "depth", "chars", "last", "next", "cum", *names)


def points(rows: DataFrame) -> DataFrame:
    """Branch, end and leaf points: k1, k2, depth, cum, low (smallest member), n, ends, leaf."""
    sorted_ = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low"), F.count_if("last").alias("ends"), F.min("next").alias("_a"), F.max("next").alias("_b"), F.min("depth").alias("depth"), F.min("cum").alias("cum"))
    return sorted_.where("ends > 0 OR _a <> _b").select("k1", "k2", "depth", "cum", "low", "n", "ends", F.col("_a").isNull().alias("leaf"))


def chains(rows: DataFrame) -> DataFrame:
    """For each conversation that is the smallest member of a prefix: the point above the shallowest of these, as low, up (u_depth, u1, u2, u_cum)."""
    nodes = rows.groupBy("k1", "k2").agg(F.min("conv").alias("low"), F.min(F.struct((F.col("depth") - 1).alias("u_depth"), F.col("p1").alias("u1"), F.col("p2").alias("u2"), (F.col("cum") - F.col("chars")).alias("u_cum"))).alias("up"))
    return nodes.groupBy("low").agg(F.min("up").alias("up"))


def edges(held: DataFrame, tops: DataFrame) -> DataFrame:
    """Points with the point above them (u_depth, u1, u2, u_cum) and the edge's own saving; the last point before in the chain, or what the chain hangs on."""
    rows = held.withColumn("_block", F.expr(f"depth div {BLOCK}"))
    order = Window.partitionBy("low", "_block").orderBy("depth")
    me = F.struct(F.col("depth").alias("u_depth"), F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("cum").alias("u_cum"))
    far = Window.partitionBy("low").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("low", "_block").agg(F.max(me).alias("_m")).select("low", "_block", F.max("_m").over(far).alias("_before")).where("_before IS NOT NULL")
    found = rows.withColumn("_near", F.lag(me).over(order)).join(before, ["low", "_block"], "left").join(tops, "low").withColumn("_up", F.coalesce("_near", "_before", "up"))
    found = found.select(*held.columns, "_up.*")
    return found.withColumn("saved", (F.col("n") - 1) * (F.col("cum") - F.col("u_cum")))


def digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, digest): SHA-256 of the ascending ids, comma-joined; ends: k1, k2, conv.

    Ids are sorted by ranges and packed into strings first, so one node's ids reach
    their task as a few rows; that task updates one digest and holds one string.
    """

    def pack(batches):
        held, first, text = None, 0, ""
        for batch in batches:
            out = []
            for k1, k2, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if held == (k1, k2) and len(text) < PACK_BYTES:
                    text += f",{conv}"
                    continue
                if held:
                    out.append((*held, first, text))
                held, first, text = (k1, k2), conv, str(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "first", "ids"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, first, text), (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "first", "ids"])

    def digest(batches):
        held, state = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if held == (k1, k2):
                    state.update(b",")
                else:
                    if held:
                        out.append((*held, state.hexdigest()))
                    held, state = (k1, k2), hashlib.sha256()
                state.update(ids.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "digest"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "digest"])

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = ends.select("k1", "k2", "conv").repartitionByRange(parts, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv").mapInArrow(tidied(pack), "k1 long, k2 long, first long, ids string")
    return packed.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(tidied(digest), "k1 long, k2 long, digest string")


def trie(paths: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    paths: conv, depth (from 1), h1, h2, chars, last; members: conv, total (turns of the path, also 0).
    """
    spark = paths.sparkSession
    rows = materialize(prefixes(paths), "trie-paths")
    held = materialize(points(rows), "trie-points")
    linked = materialize(edges(held, chains(rows)), "trie-edges")

    # Sums over subtrees: the rest of the own chain, and the whole of chains that hang below.
    whole_chain = linked.groupBy("low").agg(F.sum("saved").alias("c_saved"), F.count_if("leaf").alias("c_leaves"), F.min("u_depth").alias("c_depth"))
    passing = rows.join(whole_chain, rows.conv == whole_chain.low).where("depth <= c_depth").select("k1", "k2", F.col("c_saved").alias("saved"), F.col("c_leaves").alias("leaves"), F.lit(0).cast("bigint").alias("children"))
    below = linked.select(F.col("u1").alias("k1"), F.col("u2").alias("k2"), F.lit(0).cast("bigint").alias("saved"), F.lit(0).cast("bigint").alias("leaves"), F.lit(1).cast("bigint").alias("children"))
    hanging = passing.unionByName(below).groupBy("k1", "k2").agg(F.sum("saved").alias("h_saved"), F.sum("leaves").alias("h_leaves"), F.sum("children").alias("children"))
    own = running(linked, ["low"], "depth", {"c_upto": F.col("saved")}).join(whole_chain, "low").join(hanging, ["k1", "k2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    summed = own.select(
        *linked.columns, zero("children").alias("children"), (F.col("c_leaves") + zero("h_leaves")).alias("leaves"), (F.col("c_saved") - F.col("c_upto") + zero("h_saved")).alias("below")
    )  # below: the saving of the subtree without the edge of the point itself

    # Names of parents and digests of ends.
    lows = held.select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("low").alias("u_low"))
    total = members.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("low"), F.count_if(F.col("total") == 0).alias("ends")).first()
    named = summed.where("u_depth > 0").join(lows, ["u1", "u2"]).unionByName(summed.where("u_depth = 0").withColumn("u_low", F.lit(total.low).cast("bigint")))
    root = [key(part, F.lit(0), F.lit(0), F.lit(0)) for part in (1, 2)]
    ends = rows.where("last").select("k1", "k2", "conv").unionByName(members.where("total = 0").select(root[0].alias("k1"), root[1].alias("k2"), "conv"))
    digested = materialize(digests(ends), "trie-ends")
    named = named.join(digested, ["k1", "k2"], "left")

    # Unary nodes: each place of an edge, with the running sum of its smallest member there.
    spans = named.withColumn("_from", F.explode(F.sequence(F.col("u_depth") + 1, F.col("depth"), F.lit(UNROLL))))
    spans = spans.withColumn("x", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + (UNROLL - 1), F.col("depth")))))
    at = rows.select(F.col("conv").alias("low"), F.col("depth").alias("x"), (F.col("cum") - F.col("chars")).alias("_before"))
    point, empty = F.col("x") == F.col("depth"), F.lit(hashlib.sha256(b"").hexdigest())
    nodes = spans.join(at, ["low", "x"]).select(
        F.col("low").alias("conv_id"), F.col("x").alias("depth"), F.when(F.col("x") == F.col("u_depth") + 1, F.col("u_low")).otherwise(F.col("low")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        F.when(point, F.col("children")).otherwise(1).cast("bigint").alias("n_children"), F.col("leaves").cast("bigint").alias("n_leaves"), ((F.col("n") - 1) * (F.col("cum") - F.col("_before")) + F.col("below")).cast("bigint").alias("saved_tokens"),
        F.when(point, F.coalesce("digest", empty)).otherwise(empty).alias("ends_sha256"),
    )
    if not total.n:
        return nodes
    sums = linked.agg(F.sum("saved").alias("saved"), F.count_if("leaf").alias("leaves"), F.count_if(F.col("u_depth") == 0).alias("children")).first()
    top = digested.where((F.col("k1") == root[0]) & (F.col("k2") == root[1])).first()
    values = (total.low, 0, None, total.n, sums.children, sums.leaves or 1, int(sums.saved or 0), top.digest if top else hashlib.sha256(b"").hexdigest())
    return nodes.unionByName(spark.createDataFrame([values], nodes.schema))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of conversations as they are: conv_id, turn, role, text."""
    return trie(*whole(materialize(turns(conversations), "trie-turns")))

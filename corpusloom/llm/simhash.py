"""SimHash near-duplicate components, searched with BK-trees.

Fingerprints are 64-bit majority votes over XXH64 hashes of word shingles.
Two fingerprints link when they differ in at most ``radius`` bits; the result
is the connected component of every document.

A BK-tree over random 64-bit words prunes little at radius 4, so the trees are
sharded by exact pigeonhole: the 64 bits are cut into ``blocks`` pieces, and
fingerprints within the radius agree on at least ``blocks - radius`` of them.
For every choice of that many pieces there is one family of shards, keyed by
the agreed bits; each linked pair shares at least one shard, so no link is
lost.  A shard is a BK-tree (children keyed by the integer Hamming distance to
the parent, searched along edges within the radius).  Shards travel to their
tasks through a shuffle, not through the driver: broadcasting them would mean
collecting the fingerprints of all documents.

Hot shards (a large group of near copies agrees on everything) would make a
tree quadratic.  Above ``tree_limit`` members a shard is joined through
midpoints instead: two words within 2r bits of each other share a word within
r bits of both, and words that share such a midpoint all link, so only the
sorted list of midpoints is needed; it is cut into passes of bounded memory.

Cases: null text = no words = fingerprint zero (linked like any other); a null
doc_id takes part and keeps a null id in the result, but never names a
component unless no other id is in it; repeated rows give repeated results;
empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, small_batches, text_bytes, tidied
from corpusloom.llm.lm import scramble

SEED = 42
MIDPOINTS_PER_PASS = 4_000_000


# ------------------------------------------------------------ fingerprints
def fingerprint(text: bytes, width: int = 4) -> int:
    """Unsigned 64-bit SimHash of the lower-cased words of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], dtype="<u8")
    else:
        ends = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = [0, *(ends[: len(words) - width] + 1).tolist()]
        ends = [*ends[width - 1 :].tolist(), len(joined)]
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (votes * 2 > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes().alias("body")).mapInArrow(tidied(run), "doc_id long, fp long")


# ------------------------------------------------------------ shards
class BKTree:
    """Nodes are integers; the children of a node are keyed by their distance to it."""

    def __init__(self):
        self.root = None

    def insert(self, word: int) -> None:
        if self.root is None:
            self.root = (word, {})
            return
        node = self.root
        while True:
            distance = (node[0] ^ word).bit_count()
            if not distance:
                return
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = (word, {})
                return
            node = child

    def within(self, word: int, radius: int) -> list:
        return [value for _, value in self.near(word, radius)]

    def near(self, word: int, radius: int) -> list:
        """(distance, value) of all values within the radius."""
        found, todo = [], [self.root] if self.root else []
        while todo:
            value, children = todo.pop()
            distance = (value ^ word).bit_count()
            if distance <= radius:
                found.append((distance, value))
            if children:
                low, high = distance - radius, distance + radius
                todo.extend(child for edge, child in children.items() if low <= edge <= high)
        return found


class Forest:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def union(self, a, b):
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def tree_links(words: list, radius: int, forest: Forest) -> None:
    tree = BKTree()
    for word in words:
        for other in tree.within(word, radius):
            forest.union(word, other)
        tree.insert(word)


def midpoint_links(words: np.ndarray, radius: int, free: list, forest: Forest) -> None:
    """Link words of one shard through shared midpoints; ``free`` lists the bits that may differ.

    Exact for even radii; for odd ones the links within ``radius - 1`` come from
    midpoints and the rest from one more flipped bit on one side.
    """
    half = radius // 2
    masks = [0]
    for n in range(1, half + 1):
        masks += [sum(1 << b for b in bits) for bits in combinations(free, n)]
    near = np.array(masks, dtype=np.uint64)
    far = near
    if radius % 2:
        far = np.array(masks + [sum(1 << b for b in bits) for bits in combinations(free, half + 1)], dtype=np.uint64)
    passes = max(1, -(-len(words) * (len(near) + len(far) * (radius % 2)) // MIDPOINTS_PER_PASS))
    mix = np.uint64(0x9E3779B97F4A7C15)
    for k in range(passes):
        mids, owners, sides = [], [], []
        for side, flips in ((0, near), (1, far)) if radius % 2 else ((0, near),):
            for flip in flips:
                m = words ^ flip
                keep = np.flatnonzero(((m * mix) >> np.uint64(40)) % np.uint64(passes) == np.uint64(k))
                mids.append(m[keep])
                owners.append(keep)
                sides.append(np.full(len(keep), side, dtype=np.int8))
        mids, owners, sides = np.concatenate(mids), np.concatenate(owners), np.concatenate(sides)
        order = np.lexsort((sides, mids))
        mids, owners, sides = mids[order], owners[order], sides[order]
        starts = np.flatnonzero(np.r_[True, mids[1:] != mids[:-1]])
        first = np.repeat(starts, np.diff(np.r_[starts, len(mids)]))
        link = (owners[first] != owners) & (sides[first] == 0)  # a near word of the midpoint, if it has one
        pairs = np.unique(np.stack([owners[first][link], owners[link]]), axis=1)
        for a, b in zip(words[pairs[0]].tolist(), words[pairs[1]].tolist()):
            forest.union(a, b)


def choices(blocks: int, radius: int) -> list:
    """For each family of shards: the mask of the agreed bits."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    pieces = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    return [sum(c) for c in combinations(pieces, blocks - radius)]


def blocks_for(n: int, radius: int) -> int:
    """Pieces for n fingerprints: the fewest whose agreed bits exceed log2(n), so random shards stay small."""
    for blocks in range(radius + 1, 65):
        if 64 * (blocks - radius) // blocks >= max(12, n.bit_length()):
            return blocks
    return 64


def links(prints: DataFrame, radius: int = 4, blocks: int | None = None, tree_limit: int = 4096) -> DataFrame:
    """(a, b): a spanning forest of each shard over the distinct fingerprints in column fp, a > b as unsigned."""
    spark = prints.sparkSession
    prints = prints.select("fp").distinct()
    if radius == 0:
        return spark.createDataFrame([], "a long, b long")
    if blocks is None:
        blocks = blocks_for(prints.count(), radius)
    masks = choices(blocks, radius)

    def route(batches):
        for batch in batches:
            words = batch.column(0).to_numpy().view(np.uint64)
            for n, mask in enumerate(masks):
                keys = (words & np.uint64(mask)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(words), n, dtype=np.int32)), pa.array(keys), pa.array(words.view(np.int64))], names=["family", "key", "fp"])

    def shard(batches):
        """Rows come sorted by (family, key); shards may cross batches."""
        held: list = []
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy() for i in range(3)]
            same = held and all(held[-1][i][-1] == new[i][0] and new[i][0] == new[i][-1] for i in (0, 1))
            held.append(new)
            if same:
                continue
            part = [np.concatenate(x) for x in zip(*held)]
            change = np.flatnonzero((part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1])) + 1
            held = [part]
            if len(change):
                yield from solve([x[: change[-1]] for x in part])
                held = [[x[change[-1] :] for x in part]]
        if held:
            yield from solve([np.concatenate(x) for x in zip(*held)])

    def solve(part):
        family, key, fp = part
        starts = np.r_[0, np.flatnonzero((family[1:] != family[:-1]) | (key[1:] != key[:-1])) + 1]
        sizes = np.diff(np.r_[starts, len(fp)])
        a, b = [], []
        for s, n in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
            forest, words = Forest(), fp[s : s + n].view(np.uint64)
            if n <= tree_limit:
                tree_links(words.tolist(), radius, forest)
            else:
                free = [x for x in range(64) if not masks[family[s]] >> x & 1]
                midpoint_links(words, radius, free, forest)
            for word in list(forest.up):
                a.append(word)
                b.append(forest.find(word))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (a, b)], names=["a", "b"])

    routed = prints.mapInArrow(tidied(route), "family int, key long, fp long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = routed.repartition(parts, "family", "key").sortWithinPartitions("family", "key")
    return dealt.mapInArrow(tidied(shard), "a long, b long").distinct()


# ------------------------------------------------------------ components
def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the edges (a, b), by alternating large and small stars.

    Every round is two aggregates and two joins on the edges alone; a hub's
    edges are pre-aggregated, and its side of the join can be split at run time.
    """
    edges = materialize(edges.select("a", "b").where("a <> b"), "edges")
    before = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        edges = materialize(small, "edges")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4, blocks: int | None = None, tree_limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest linked doc_id), component_fp."""
    prints = materialize(fingerprints(docs, width), "prints")
    ids = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    rooted = components(links(ids, radius, blocks, tree_limit))
    ids = ids.join(rooted, ids.fp == rooted.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    ids = materialize(ids, "roots")
    least = ids.groupBy("root").agg(F.min("low").alias("component_id"))
    named = ids.join(least, "root").select("fp", "component_id", F.col("root").alias("component_fp"))
    return prints.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", F.lpad(F.lower(F.hex("component_fp")), 16, "0").alias("component_fp")
    )


# ------------------------------------------------------------ near copies of a given similarity
# A radius of 4 in 64 bits means nearly equal texts only: at a Jaccard similarity of 0.8 a seventh of the bits
# differ.  For a given similarity, fingerprints of WIDE words of 64 bits only find candidates, and every link is then
# decided by the exact Jaccard similarity of the two sets of shingles.
#
# Shards are keyed by sampled bits, as many as the table needs to keep random shards small, and as many samples as it
# takes to bring a pair of just that similarity together with probability ``RECALL`` or more; closer pairs meet almost surely.
# The radius leaves room for three standard deviations of the distance at that similarity.
#
# First search: joins most of every group at little cost.  A shard is searched with BK-trees of BLOCK members, and every
# text keeps the ``NEAREST`` of what it finds.  Texts that find something, or that stood in a shard of more than one
# block, go on with the group that the exact similarity gave them.
#
# Second search: complete.  All pairs of a shard that are in different groups are compared; the members of a shard's
# largest group leave asking to the others, so a shard of one group costs nothing.  Askers and others are dealt out in
# stripes of CELL, each pair of stripes is one cell for some task, and no pair within the radius is left out but those
# that cannot link: every shingle sets one of SKETCH bits, and two sets differ in at least as many shingles as their
# sketches differ in bits.  Sets of shingles then follow the pairs that are left from cell to cell, so a set travels
# once for all its pairs of a cell.
WIDE = 4
RECALL = 0.99
BLOCK = 128
NEAREST = 3
CELL = 256
SKETCH = 2048


def wide_fingerprint(text: bytes, width: int = 5) -> np.ndarray:
    """WIDE unsigned 64-bit words; the first is fingerprint()."""
    words = text.lower().split()
    if not words:
        return np.zeros(WIDE, dtype=np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        hashes = np.array([digest(joined, SEED)], dtype="<u8")
    else:
        spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
        starts = [0, *(spaces[: len(words) - width] + 1).tolist()]
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, [*spaces[width - 1 :].tolist(), len(joined)])], dtype="<u8")
    out = np.zeros(WIDE, dtype=np.uint64)
    for k in range(WIDE):
        votes = np.zeros(64, dtype=np.int64)
        for at in range(0, len(hashes), 65536):
            part = hashes[at : at + 65536]
            part = part if not k else scramble(part + np.uint64(k))
            votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits((votes * 2 > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0]
    return out


def radius_for(similarity: float, sigmas: float) -> int:
    """Bits of WIDE words by which texts of that Jaccard similarity differ, and so many standard deviations more."""
    share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(64 * WIDE * share + sigmas * np.sqrt(64 * WIDE * share * (1 - share)))


def samples_for(n: int, similarity: float, recall: float = RECALL) -> np.ndarray:
    """Bit positions, one row for each family of shards; n: fingerprints.

    A pair one standard deviation further apart than the mean at that similarity meets with probability ``recall``:
    texts that resemble one another share their nearly undecided bits, so whole groups lie beyond the mean together.
    """
    bits = max(8, n.bit_length() - 4)
    agree = (1 - radius_for(similarity, 1) / (64 * WIDE)) ** bits
    families = int(np.ceil(np.log(1 - recall) / np.log(1 - agree)))
    rng = np.random.default_rng(SEED)
    return np.stack([rng.choice(64 * WIDE, bits, replace=False) for _ in range(families)])


def proposals(words: list, ids: list, radius: int) -> list:
    """(id, id of the nearest word before it within the radius, distance) for the members of one block of a shard; ids distinct."""
    tree, owner, out = BKTree(), {}, []
    for word, name in zip(words, ids):
        best = min(((d, owner[w]) for d, w in tree.near(word, radius)), default=None)
        if best:
            out.append((name, best[1], best[0]))
        owner[word] = name
        tree.insert(word)
    return out


def routed(rows: DataFrame, samples: np.ndarray, carry: list) -> DataFrame:
    """(key, and the columns ``carry``, all long): every row once in each family; keys hold the family and the sampled bits; rows: also w0 .. w3."""
    weights = (1 << np.arange(samples.shape[1], dtype=np.int64)).astype(np.int64)
    names = ["key", *carry]

    def route(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                words = np.stack([c.to_numpy().view(np.uint64) for c in part.columns[len(carry) :]], axis=1)
                bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").astype(np.int64)
                for n, spots in enumerate(samples):
                    keys = (bits[:, spots] @ weights) | np.int64(n) << np.int64(48)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *part.columns[: len(carry)]], names=names)

    return rows.select(*carry, *(F.col(f"w{k}") for k in range(WIDE))).mapInArrow(tidied(route), ", ".join(f"{x} long" for x in names))


def first_candidates(rows: DataFrame, samples: np.ndarray, radius: int, nearest: int = NEAREST) -> DataFrame:
    """(x, y): for each id the ``nearest`` of the best in each of its blocks; y is null for ids that only stood in crowded shards; rows: id, w0 .. w3."""
    spark = rows.sparkSession

    def search(batches):
        """Rows come sorted by key, then in an order that differs from family to family; a block ends with its shard, or after BLOCK members."""
        held, before = None, [None]
        for batch in batches:
            if batch.num_rows:
                new = [c.to_numpy() for c in batch.columns]
                part = [np.concatenate(x) for x in zip(held, new)] if held else new
                cuts = block_starts(part[0])
                held = [x[cuts[-1] :] for x in part]
                yield from solve([x[: cuts[-1]] for x in part], cuts, before)
        if held:
            yield from solve(held, np.r_[block_starts(held[0]), len(held[0])], before)

    def block_starts(key):
        fresh = np.r_[True, key[1:] != key[:-1]]
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(key)), 0))
        return np.flatnonzero((np.arange(len(key)) - first) % BLOCK == 0)

    def solve(part, cuts, before):
        out = []
        keys, ids = part[0], part[1].tolist()
        raw = np.ascontiguousarray(np.stack(part[2:], axis=1)).tobytes()
        number = int.from_bytes
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if e - s > 1:
                out += proposals([number(raw[8 * WIDE * i : 8 * WIDE * (i + 1)], "little") for i in range(s, e)], ids[s:e], radius)
            if e - s == BLOCK or keys[s] == before[0]:
                out += [(i, None, None) for i in ids[s:e]]
            before[0] = keys[s]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*out)], names=["x", "y", "d"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = routed(rows, samples, ["id", *(f"w{k}" for k in range(WIDE))]).repartition(parts, "key").sortWithinPartitions("key", F.xxhash64("key", "id")).mapInArrow(tidied(search), "x long, y long, d long")
    best = found.groupBy("x").agg(F.slice(F.array_sort(F.collect_set(F.when(F.col("y").isNotNull(), F.struct("d", "y")))), 1, nearest).alias("best"))
    return best.select("x", F.explode_outer("best.y").alias("y"))


def all_candidates(rows: DataFrame, samples: np.ndarray, radius: int, similarity: float) -> DataFrame:
    """(a, b, cell), a > b: all pairs of ids of different groups that share a shard, lie within the radius and can have the similarity; cell: one of those that found it.

    rows: id, comp, w0 .. w3, size and sketch of the set of shingles.
    """
    spark = rows.sparkSession
    held = routed(rows, samples, ["id", "comp"])
    groups = held.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    shards = groups.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).where("n > top.n")
    shards = shards.select("key", F.ceil(F.col("n") / CELL).alias("others"), F.ceil((F.col("n") - F.col("top.n")) / CELL).alias("askers"), F.col("top.comp").alias("top"))
    placed = held.join(shards, "key")
    stripe = lambda n: F.pmod(F.xxhash64("id", "key"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    ask = placed.where("comp <> top").select("key", stripe("askers").alias("i"), every("others").alias("j"), F.lit(0).alias("side"), "id")
    told = placed.select("key", every("askers").alias("i"), stripe("others").alias("j"), F.lit(1).alias("side"), "id")
    cells = ask.unionByName(told).select(F.xxhash64("key", "i", "j").alias("cell"), "side", "id")
    words = [f"w{k}" for k in range(WIDE)]

    def compare(batches):
        """Rows come sorted by cell, askers first."""
        cell, askers, mine, fixed = None, [], None, False
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns[:-1]]
            columns.append(np.frombuffer(b"".join(batch.column(batch.num_columns - 1).to_pylist()), np.uint64).reshape(-1, SKETCH // 64))
            at, side = columns[0], columns[1]
            cuts = np.r_[0, np.flatnonzero((at[1:] != at[:-1]) | (side[1:] != side[:-1])) + 1, len(at)] if len(at) else []
            out = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                part = [c[s:e] for c in columns[2:]]
                if at[s] != cell:
                    cell, askers, fixed = at[s], [], False
                if not side[s]:
                    askers.append(part)
                    continue
                if not fixed:
                    mine, fixed = [np.concatenate(x) for x in zip(*askers)] if askers else None, True
                if mine is None:
                    continue
                for k in range(0, len(part[0]), 1024):
                    x, y = mine, [c[k : k + 1024] for c in part]
                    distance = sum(np.bitwise_count(a.view(np.uint64)[:, None] ^ b.view(np.uint64)[None, :]).astype(np.int16) for a, b in zip(x[2:-2], y[2:-2]))
                    p, q = np.nonzero((distance <= radius) & (x[1][:, None] != y[1][None, :]))
                    for h in range(0, len(p), 8192):
                        out += possible(x, y, p[h : h + 8192], q[h : h + 8192], cell)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["a", "b", "cell"])

    def possible(x, y, p, q, cell):
        """Of sets that share c and differ in d shingles, c >= similarity * (c + d); sizes add up to 2 c + d."""
        sizes = x[-2][p] + y[-2][q]
        most = (1 - similarity) / (1 + similarity) * sizes + 1e-6
        differ = np.maximum(np.bitwise_count(x[-1][p] ^ y[-1][q]).sum(axis=1, dtype=np.int64), np.abs(x[-2][p] - y[-2][q]))
        good = differ <= most
        p, q = p[good], q[good]
        return [(np.maximum(x[0][p], y[0][q]), np.minimum(x[0][p], y[0][q]), np.full(len(p), cell))] if len(p) else []

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    filled = cells.join(rows.select("id", "comp", *words, "size", "sketch"), "id").select("cell", "side", "id", "comp", *words, "size", "sketch")
    found = filled.repartition(parts, "cell").sortWithinPartitions("cell", "side").mapInArrow(tidied(compare), "a long, b long, cell long")
    return found.groupBy("a", "b").agg(F.min("cell").alias("cell"))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles of the lower-cased words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(max(1, len(words) - width + 1))], dtype=np.uint64))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles binary, size, sketch binary) of docs (id, body)."""

    def sketch(shingles):
        bits = np.zeros(SKETCH, np.uint8)
        bits[(scramble(shingles) % np.uint64(SKETCH)).astype(np.int64)] = 1
        return np.packbits(bits, bitorder="little").tobytes()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, width) for t in batch.column(1)[at : at + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[at : at + 256], pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary())],
                    names=["id", "shingles", "size", "sketch"],
                )

    return docs.select("id", "body").mapInArrow(tidied(run), "id long, shingles binary, size long, sketch binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is at least ``similarity``; sets: id, shingles."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("s"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("t"))

    def run(batches):
        for batch in batches:
            good = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                least, most = sorted((len(x), len(y)))
                if least < similarity * most:
                    good.append(False)
                    continue
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                good.append(common >= similarity * (least + most - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "s", "t").mapInArrow(tidied(run), "a long, b long")


def similar_in_cells(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The same for pairs (a, b, cell): a set goes to each cell that needs it, once."""
    wanted = pairs.select("cell", F.col("a").alias("id")).union(pairs.select("cell", F.col("b").alias("id"))).distinct()
    carried = wanted.join(sets.select("id", "shingles"), "id").select("cell", F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), "shingles")
    rows = carried.unionByName(pairs.select("cell", "a", "b", F.lit(None).cast("binary").alias("shingles")))

    def run(batches):
        """Rows come sorted by cell, its sets first."""
        cell, held = None, {}
        for batch in batches:
            good = []
            for at, a, b, shingles in zip(*(c.to_pylist() for c in batch.columns)):
                if at != cell:
                    cell, held = at, {}
                if b is None:
                    held[a] = np.frombuffer(shingles, np.uint64)
                    continue
                x, y = held[a], held[b]
                least, most = sorted((len(x), len(y)))
                if least >= similarity * most:
                    both = np.concatenate([x, y])
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    if common >= similarity * (least + most - common):
                        good.append((a, b))
            if good:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*good)], names=["a", "b"])

    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "cell").sortWithinPartitions("cell", F.col("b").isNotNull())
    return dealt.mapInArrow(tidied(run), "a long, b long")


def similar_groups(least: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root) of the ids that link; least: id, near_key, w0 .. w3 (ids distinct); texts: near_key, body."""
    samples, radius = samples_for(least.count(), similarity), radius_for(similarity, 3)
    names = [f"w{k}" for k in range(WIDE)]
    first = materialize(first_candidates(least.select("id", *names), samples, radius), "near-first")
    pairs = first.where("y IS NOT NULL").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()
    ids = first.select(F.col("x").alias("id")).union(first.where("y IS NOT NULL").select(F.col("y").alias("id"))).distinct()
    taking = materialize(least.join(ids, "id", "left_semi"), "near-taking")
    wanted = texts.join(taking.select("id", "near_key"), "near_key").dropDuplicates(["id"])
    sets = materialize(shingle_sets(wanted, width), "near-sets")
    rooted = components(similar(pairs, sets, similarity))
    rows = taking.join(rooted, taking.id == rooted.node, "left").join(sets.select("id", "size", "sketch"), "id")
    rows = materialize(rows.select("id", F.coalesce("root", "id").alias("comp"), *names, "size", "sketch"), "near-groups")
    more = materialize(all_candidates(rows, samples, radius, similarity).join(pairs, ["a", "b"], "left_anti"), "near-pairs")
    links = materialize(similar_in_cells(more, sets, similarity), "near-links")
    if links.isEmpty():
        return rooted
    return components(rooted.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def deduplicate(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of similar texts stays, with all its columns: the smallest doc_id, then the smallest text digest.

    Groups are components of links between texts whose Jaccard similarity of word shingles is at least ``similarity``
    (candidates are found by fingerprints, links decided exactly; texts with one fingerprint are one).  Null ids come
    last; rows that repeat both id and text count as one.  Only keys, fingerprints and the shingles of candidates
    travel until the final join.
    """
    small_batches(docs.sparkSession)
    names = [f"w{k}" for k in range(WIDE)]

    def run(batches):
        for batch in batches:
            prints = np.array([wide_fingerprint(t, width) for t in batch.column(1).to_pylist()], dtype=np.uint64).reshape(-1, WIDE)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(WIDE))], names=["near_key", *names])

    digest = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    place = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(str(2**63)).cast("decimal(20,0)")) + F.lit(str(2**63)).cast("decimal(20,0)")
    key = F.concat_ws(":", F.lpad(place.cast("string"), 20, "0"), digest)  # sorts as the id does
    texts = docs.select(key.alias("near_key"), text_bytes().alias("body"))
    prints = texts.mapInArrow(tidied(run), "near_key string, " + ", ".join(f"{n} long" for n in names))
    prints = materialize(prints.withColumn("id", F.xxhash64(*names)), "prints")
    least = materialize(prints.groupBy("id", *names).agg(F.min("near_key").alias("near_key")), "wide-prints")
    rooted = similar_groups(least, texts, width, similarity)
    best = least.join(rooted, least.id == rooted.node, "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("near_key").alias("_near_key"))
    return docs.withColumn("_near_key", key).join(best.select("_near_key"), "_near_key", "left_semi").dropDuplicates(["_near_key"]).select(*docs.columns)

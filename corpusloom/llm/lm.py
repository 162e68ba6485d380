"""Language-model scoring from a log-frequency Bloom filter.

Counting.  Tasks turn words into 64-bit hashes and pre-aggregate unigram and
bigram counts over blocks of documents.  Counts are dealt to slices by hash,
packed as sorted arrays (one shuffle row per block and slice), and merged there;
a frequent word moves once per block, so no slice is hot.

Filter.  Each slice inserts its n-grams into its own piece of the Bloom filter:
an n-gram of count c goes in once for each level 1..q(c), where level l stands
for counts from ``BASE**(l-1)``.  A count is read back by probing level 1, 2, ...
until a probe misses or the piece's highest level is passed.  A level costs 8
bits at any size of the corpus (false positives about 2 %).  Pieces are broadcast
in runs of at most ``max_filter_bytes`` (a larger piece runs alone).  With one run
texts are scored as they are probed; with more, each run is a pass over the
documents that carries the levels probed so far, and passes end in tables, so that
a task holds one run at a time.

Score.  p(w | v) = (c(v, w) + mu * p(w)) / (c(v) + mu), p(w) = (c(w) + 1) / (N + V + 1), with
every c read by probes.  ``score`` is the sum of log10 p over words and end.

The exact unigram base needs exact counts.  They stay in a table in the shared
folder and are broadcast in runs of at most ``max_slice`` words.  One run is read
as the texts are scored; with more, each is a pass over the documents that ends in
a table, so what is broadcast and held is bounded while every word is counted.

Cases: null = empty text = only the end token; a null doc_id hashes like the
empty string; without training rows N = V = 0 and every p is 1; empty tables
give empty results; a text of any length is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import input_partitions, materialize, new_path, remove_path, small_batches, text_bytes, tidied

BASE = 1.5
PROBES = 4
BITS_PER_LEVEL = 8
MU = 100.0
BLOCK_TOKENS = 2_000_000
CACHE_WORDS = 300_000
END = b"\n"  # no word holds a line feed
MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX1
    x = (x ^ (x >> np.uint64(29))) * MIX2
    return x ^ (x >> np.uint64(32))


def salt(level: int) -> np.uint64:
    return np.uint64(level * int(MIX1) & 0xFFFFFFFFFFFFFFFF)


def bigrams(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return scramble(left * MIX2 + scramble(right ^ MIX1))


def levels(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1; one more for each factor BASE."""
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def expected(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: 0 for level 0, else the middle of its whole counts."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(BASE ** np.asarray(level, dtype=float) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


class Words:
    """Word -> hash, remembered for the frequent ones."""

    def __init__(self):
        self.known: dict = {}

    def hashes(self, words: list) -> np.ndarray:
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            return np.array([known[w] for w in words], dtype=np.uint64)
        except KeyError:
            digest = xxhash.xxh64_intdigest
            for w in words:
                if w not in known:
                    known[w] = digest(w)
            return np.array([known[w] for w in words], dtype=np.uint64)


def tokens(text: bytes) -> list:
    out = text.lower().split()
    out.append(END)
    return out


def pairs_of(hashes: np.ndarray, ends: np.ndarray) -> tuple:
    """(previous, current) of every token; the token before a text's first is the end token."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[0] = np.uint64(xxhash.xxh64_intdigest(END))
    return before, hashes


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


# ------------------------------------------------------------ counting
COUNTED = "slice int, n int, keys binary, counts binary"


def count_ngrams(docs: DataFrame, slices: int) -> DataFrame:
    """(slice, n, keys, counts): packed partial counts of words (n = 1) and bigrams (n = 2)."""
    small_batches(docs.sparkSession)

    def run(batches):
        words = Words()
        held: list = []
        size = 0

        def flush():
            hashes = np.concatenate(held)
            before, now = pairs_of(hashes, None)
            for n, keys in ((1, hashes), (2, bigrams(before, now))):
                keys, counts = np.unique(keys, return_counts=True)
                owner = (scramble(keys) % np.uint64(slices)).astype(np.int64)
                order = np.argsort(owner, kind="stable")
                keys, counts, owner = keys[order], counts[order].astype(np.uint32), owner[order]
                cuts = np.searchsorted(owner, np.arange(slices + 1))
                full = [k for k in range(slices) if cuts[k] < cuts[k + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([n] * len(full), pa.int32()),
                        pa.array([keys[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()),
                        pa.array([counts[cuts[k] : cuts[k + 1]].tobytes() for k in full], pa.binary()),
                    ],
                    names=["slice", "n", "keys", "counts"],
                )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(words.hashes(tokens(text)))
                size += len(held[-1])
                if size >= BLOCK_TOKENS:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.select(text_bytes().alias("body")).mapInArrow(tidied(run), COUNTED)


def build_slices(counted: DataFrame, bits_per_level: int = BITS_PER_LEVEL) -> DataFrame:
    """One row per slice: its exact word counts, totals, and its piece of the filter."""
    schema = "slice int, keys binary, counts binary, n_words long, n_tokens long, n_levels long, top long, bits long, filter binary"

    def build(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = {1: ([], []), 2: ([], [])}
        for part in parts:
            for n, k, c in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist()):
                by[n][0].append(np.frombuffer(k, dtype=np.uint64))
                by[n][1].append(np.frombuffer(c, dtype=np.uint32).astype(np.int64))
        grams = [merged(np.concatenate(k), np.concatenate(c)) if k else (np.zeros(0, np.uint64), np.zeros(0, np.int64)) for k, c in by.values()]
        total = int(sum(levels(c).sum() for _, c in grams))
        size = max(64, total * bits_per_level)
        bits = np.zeros(-(-size // 8) * 8, dtype=bool)
        for keys, counts in grams:
            top = levels(counts)
            for level in range(1, int(top.max(initial=0)) + 1):
                for spot in spots(keys[top >= level], level, size):
                    bits[spot] = True
        keys, counts = grams[0]
        yield pa.RecordBatch.from_pylist(
            [{"slice": key[0].as_py(), "keys": keys.tobytes(), "counts": counts.tobytes(), "n_words": len(keys), "n_tokens": int(counts.sum()), "n_levels": total, "top": max(int(levels(c).max(initial=0)) for _, c in grams), "bits": size, "filter": np.packbits(bits, bitorder="little").tobytes()}],
            schema=pa.schema([("slice", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_levels", pa.int64()), ("top", pa.int64()), ("bits", pa.int64()), ("filter", pa.binary())]),
        )

    return counted.groupBy("slice").applyInArrow(build, schema)


def spots(keys: np.ndarray, level, size):
    """The bit positions of keys at a level, one array for each hash function."""
    base = scramble(keys + salt(level))
    step = scramble(base ^ MIX2) | np.uint64(1)
    for i in range(PROBES):
        yield (base + np.uint64(i) * step) % np.asarray(size, dtype=np.uint64)


# ------------------------------------------------------------ model
@dataclass
class Filter:
    """The pieces of slices, one after the other, byte-aligned; slices that are left out have size 0."""

    slices: int
    sizes: np.ndarray
    tops: np.ndarray
    starts: np.ndarray
    data: np.ndarray
    n_tokens: int
    n_words: int
    n_levels: int
    cache: dict = field(default_factory=dict, repr=False)

    @property
    def bits_per_level(self) -> float:
        return float(self.sizes.sum() / max(1, self.n_levels))

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Quantised counts."""
        return expected(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels, by probing until one misses; 0 for keys of slices that are left out."""
        owner = (scramble(keys) % np.uint64(self.slices)).astype(np.int64)
        sizes, starts, tops = self.sizes[owner], self.starts[owner], self.tops[owner]
        level = np.zeros(len(keys), dtype=np.int64)
        alive = np.flatnonzero(sizes > 0)
        at = 1
        while len(alive := alive[tops[alive] >= at]):
            base = scramble(keys[alive] + salt(at))
            step = scramble(base ^ MIX2) | np.uint64(1)
            for i in range(PROBES):
                spot = ((base + np.uint64(i) * step) % sizes[alive].astype(np.uint64)).astype(np.int64)
                hit = (self.data[starts[alive] + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 > 0
                alive, base, step = alive[hit], base[hit], step[hit]
                if not len(alive):
                    break
            level[alive] = at
            at += 1
        return level


@dataclass
class Model:
    table: DataFrame  # one row per slice
    slices: int
    meta: list  # the totals of each slice, in order
    max_filter_bytes: int

    @property
    def slice_words(self) -> list:
        return [(r.slice, r.n_words) for r in self.meta]

    @property
    def slice_bytes(self) -> list:
        return [(r.slice, -(-r.bits // 8)) for r in self.meta]

    @property
    def n_tokens(self) -> int:
        return sum(r.n_tokens for r in self.meta)

    @property
    def n_words(self) -> int:
        return sum(r.n_words for r in self.meta)

    def load(self, run: list) -> Filter:
        """The filter of some slices."""
        sizes, tops = np.zeros(self.slices, dtype=np.int64), np.zeros(self.slices, dtype=np.int64)
        held = [r for r in self.meta if r.slice in set(run)]
        for r in held:
            sizes[r.slice], tops[r.slice] = r.bits, r.top
        starts = np.r_[0, np.cumsum(-(-sizes // 8))]
        data = np.zeros(int(starts[-1]), dtype=np.uint8)
        for r in self.table.where(F.col("slice").isin(run)).select("slice", "filter").toLocalIterator():
            data[starts[r.slice] : starts[r.slice + 1]] = np.frombuffer(bytes(r.filter), dtype=np.uint8)
        return Filter(self.slices, sizes, tops, starts[:-1], data, self.n_tokens, self.n_words, sum(r.n_levels for r in held))

    @property
    def filter(self) -> Filter:
        """All of it; for small models."""
        return self.load([r.slice for r in self.meta])


def train(docs: DataFrame, max_filter_bytes: int = 128 << 20, slices: int | None = None, bits_per_level: int = BITS_PER_LEVEL) -> Model:
    """Count the whole of docs and build the filter; nothing is sampled.  max_filter_bytes bounds what is broadcast at once."""
    slices = slices or max(32, 4 * input_partitions(docs))
    pieces = materialize(build_slices(count_ngrams(docs, slices), bits_per_level), "lm-slices")
    meta = pieces.select("slice", "bits", "top", "n_words", "n_tokens", "n_levels").collect()
    return Model(pieces, slices, sorted(meta, key=lambda r: r.slice), max_filter_bytes)


def runs(slice_words: list, most: int):
    """Slices, in order, in runs of at most ``most`` words or bytes (a larger slice runs alone)."""
    run, held = [], 0
    for number, n in slice_words:
        if run and held + n > most:
            yield run
            run, held = [], 0
        run.append(number)
        held += n
    if run:
        yield run


def exact_counts(model: Model, run: list) -> tuple:
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in model.table.where(F.col("slice").isin(run)).select("keys", "counts").toLocalIterator():
        keys.append(np.frombuffer(bytes(r["keys"]), dtype=np.uint64))
        counts.append(np.frombuffer(bytes(r["counts"]), dtype=np.int64))
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys)
    return keys[order], counts[order]


# ------------------------------------------------------------ scoring
def score(docs: DataFrame, model: Model, mu: float = MU, max_slice: int = 6_000_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, held_out, body)."""
    spark = docs.sparkSession
    small_batches(spark)
    pieces = list(runs(model.slice_bytes, model.max_filter_bytes)) or [[]]
    whole = len(pieces) == 1
    sent_filter = spark.sparkContext.broadcast(model.load(pieces[0])) if whole else None
    n, v = model.n_tokens, model.n_words
    out = docs.select("doc_id", "held_out", "body", *(F.lit(0).cast(t).alias(c) for c, t in (("n_tokens", "bigint"), ("n_known", "bigint"), ("hits", "double"), ("score", "double"))))
    schema = out.schema
    todo, path = list(runs(model.slice_words, max_slice)) or [[]], None
    for number, run in enumerate(todo):
        sent = spark.sparkContext.broadcast(exact_counts(model, run))

        def add(batches, sent=sent, last=whole and number == len(todo) - 1):
            words = Words()
            keys, exact = sent.value
            seen = sent_filter.value if last else None
            for batch in batches:
                bodies, known, hits, old_score = (batch.column(i).to_pylist() for i in (2, 4, 5, 6))
                hashes = [words.hashes(tokens(t)) for t in bodies]
                sizes = np.array([len(h) for h in hashes], dtype=np.int64)
                flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
                starts = np.r_[0, np.cumsum(sizes)[:-1]].astype(np.int64)
                distinct, inverse = np.unique(flat, return_inverse=True)
                spot = np.searchsorted(keys, distinct)
                spot[spot == len(keys)] = 0
                counts = np.where(keys[spot] == distinct, exact[spot], 0) if len(keys) else np.zeros(len(distinct), np.int64)
                logs = np.log10(counts + 1.0)
                if len(flat):
                    known = np.asarray(known) + np.add.reduceat((counts > 0).astype(np.int64)[inverse], starts)
                    hits = np.asarray(hits) + np.add.reduceat(logs[inverse], starts)
                scores = np.asarray(old_score, dtype=float)
                if last and len(flat):
                    scores = np.add.reduceat(conditional(seen, flat, distinct, inverse, mu), starts)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i) for i in range(3)), pa.array(sizes), pa.array(known, pa.int64()), pa.array(hits, pa.float64()), pa.array(scores, pa.float64())], names=schema.names
                )

        out = out.mapInArrow(tidied(add), schema)
        if len(todo) > 1 and (number < len(todo) - 1 or whole):  # each pass ends in a table: a task holds one run at a time
            done, path = path, new_path(spark, "lm-counts")
            out.write.parquet(path)
            out = spark.read.schema(schema).parquet(path)
            sent.destroy()
            if done:
                remove_path(spark, done)
    if not whole:
        out = probed(out, model, pieces, mu)
    total = float(np.log10(n + v + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"), (F.col("hits") - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score"
    )


def probed(docs: DataFrame, model: Model, pieces: list, mu: float) -> DataFrame:
    """docs with ``score`` filled in: a pass for each run of the filter, then the probabilities."""
    spark = docs.sparkSession
    n, v = model.n_tokens, model.n_words
    docs = docs.withColumn("levels", F.lit(None).cast("binary"))
    names, schema, path = docs.columns, docs.schema, None
    for run in pieces:
        sent = spark.sparkContext.broadcast(model.load(run))

        def probe(batches, sent=sent):
            words = Words()
            for batch in batches:
                hashes = [words.hashes(tokens(t)) for t in batch.column("body").to_pylist()]
                if not hashes:
                    continue
                distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
                left, right, back = neighbours(np.concatenate(hashes), distinct, inverse)
                single = sent.value.levels(distinct)[inverse].astype(np.uint8)
                double = sent.value.levels(bigrams(distinct[left], distinct[right]))[back].astype(np.uint8)
                packed, at = [], 0
                for h, old in zip(hashes, batch.column("levels").to_pylist()):
                    new = np.concatenate([single[at : at + len(h)], double[at : at + len(h)]])
                    packed.append((np.maximum(new, np.frombuffer(old, dtype=np.uint8)) if old else new).tobytes())
                    at += len(h)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=names)

        done, path = path, new_path(spark, "lm-pass")
        docs.mapInArrow(tidied(probe), schema).write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        sent.destroy()
        if done:
            remove_path(spark, done)

    def add(batches):
        for batch in batches:
            scores = []
            for packed in batch.column("levels").to_pylist():
                single, joint = expected(np.frombuffer(packed, dtype=np.uint8).astype(np.int64).reshape(2, -1))
                scores.append(float(smoothed(joint, np.r_[single[-1], single[:-1]], single, n, v, mu).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(scores, pa.float64()) if x == "score" else batch.column(x) for x in names[:-1]], names=names[:-1])

    return docs.mapInArrow(tidied(add), docs.drop("levels").schema)


def smoothed(joint: np.ndarray, left: np.ndarray, right: np.ndarray, n: int, v: int, mu: float) -> np.ndarray:
    """log10 p of the right word given the left one, from counts."""
    base = (right + 1.0) / (n + v + 1.0)
    joint = np.minimum(joint, np.minimum(right, left))  # a bigram is no more frequent than its words
    return np.log10((joint + mu * base) / (left + mu))


def neighbours(flat: np.ndarray, distinct: np.ndarray, inverse: np.ndarray) -> tuple:
    """(left, right) of the distinct bigrams as places in ``distinct``, and the bigram of each token."""
    before, now = pairs_of(flat, None)
    context = np.empty(len(flat), dtype=np.int64)
    context[1:] = inverse[:-1]
    context[0] = np.flatnonzero(distinct == before[0])[0]
    code = context * len(distinct) + inverse  # a bigram within this batch
    each, back = np.unique(code, return_inverse=True)
    return each // len(distinct), each % len(distinct), back


def conditional(seen: Filter, flat: np.ndarray, distinct: np.ndarray, inverse: np.ndarray, mu: float) -> np.ndarray:
    """log10 p of every token given the one before it."""
    unigram = seen.counts(distinct)
    left, right, back = neighbours(flat, distinct, inverse)
    joint = seen.counts(bigrams(distinct[left], distinct[right]))
    return smoothed(joint, unigram[left], unigram[right], seen.n_tokens, seen.n_words, mu)[back]

"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A text is cut by the vocabulary's pattern; each match is encoded by itself.
The bytes of a match form a linked list; for every neighbouring pair that has a
merge, its position lies in the bucket of the merge's rank.  A bitmap of
two levels (512 bits a word, as integers here have any length) says which buckets
hold anything, so find-first-set names the best rank in two steps whatever the length; positions of one rank leave leftmost first;
entries whose pair has changed meanwhile are skipped.  A match of n bytes costs
O(n log n) at worst, so pre-tokens of millions of bytes are no special case.

The ids are those of the tiktoken library for the same ranks and pattern
(tested against it), special tokens being ordinary text.

Cases: a null or empty text has no ids; texts are read as UTF-8, and a byte
sequence that is not UTF-8 counts as U+FFFD, as Python's ``replace`` does;
decoding a null list gives no bytes, and an id outside the vocabulary is an
error; repeated rows give repeated results; other columns never matter; empty
tables give empty results.  Texts of any length are encoded whole: matches are
taken from them piece by piece.
"""

from __future__ import annotations

import base64
import gc
from array import array
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import tokenbin
from corpusloom.llm.common import small_batches, text_bytes, tidied

#: Bounds of memory in a Python worker: bytes of remembered texts, the longest match that is remembered, matches of a long text taken at a time, bytes of texts in one batch.
CACHE_BYTES, LONGEST_KEPT, LONG, MATCHES, BATCH_BYTES = 12 << 20, 64, 1 << 20, 65_536, 2 << 20
#: Bits of a word of the bitmap, as a power of two.
WORD = 9
MASK = (1 << WORD) - 1
BIT = [1 << b for b in range(1 << WORD)]


def load(path: str) -> list:
    """Tokens by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    return [ranks.get(i) for i in range(max(ranks) + 1)]


class Encoder(tokenbin.Encoder):
    """The word tables of the token files' encoder (each distinct word of a batch is looked up once), over merges of our own."""

    def __init__(self, tokens: list, pattern: str):
        if len(tokens) > 1 << 2 * WORD:
            raise ValueError("at most 262,144 ranks")
        self.tokens = tokens
        self.ranks = {token: rank for rank, token in enumerate(tokens) if token is not None}
        self.bytes = [self.ranks[bytes([b])] for b in range(256)]
        self.piecewise, self.added = pattern == tokenbin.PIECES, []  # the rule about spaces belongs to that pattern
        self.pattern = regex.compile(pattern)
        self.buckets, self.low = {}, [0] * (1 << WORD)
        self.known: dict = {}
        self.bare: dict = {}
        self.held = 0  # bytes of the texts in both

    def encode_all(self, texts: list) -> list:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.bare.clear()
            self.held = 0
        if self.piecewise and not any(len(t) > LONG and not self._simple(t) for t in texts):
            return super().encode_all(texts)
        return [np.frombuffer(b"".join(self._parts(t)), dtype="<u4") for t in texts]

    def _parts(self, text: str) -> Iterator[bytes]:
        matches = (m[0] for m in self.pattern.finditer(text))
        while words := list(islice(matches, MATCHES)):
            yield b"".join(map(self._match, words))

    def _match(self, match: str) -> bytes:
        ids = self.bare.get(match)
        if ids is None:
            ids = self.piece(match.encode())
            if len(match) <= LONGEST_KEPT:
                self.bare[match] = ids
                self.held += len(match)
        return ids

    def _pieces(self, pieces: list) -> list:
        """Of first words, which no space precedes, and of other texts that are cut elsewhere."""
        return [b"".join(map(self._match, self.pattern.findall(text))) for text in pieces]

    def _learn(self, new: set) -> None:
        known, findall, rest = self.known, self.pattern.findall, []
        for word in new:
            if word.isalpha():
                known[word] = self.piece(b" " + word.encode())
                self.held += len(word)
            else:
                rest.append(word)
        for word in rest:
            out = []
            for part in findall(" " + word):
                if part[0] == " " and part[1:].isalpha():
                    ids = known.get(part[1:])
                    if ids is None:
                        ids = known[part[1:]] = self.piece(part.encode())
                        self.held += len(part)
                else:
                    ids = self._match(part)
                out.append(ids)
            known[word] = b"".join(out)
            self.held += len(word)

    def piece(self, body: bytes) -> bytes:
        """Ids of one match."""
        whole = self.ranks.get(body)
        return array("I", self.merged(body) if whole is None else (whole,)).tobytes()

    def merged(self, body: bytes) -> list:
        """Ids of bytes that are no token themselves.

        The rank queue is written out here, as a call for each step would double its cost.  buckets: places by rank,
        a heap each; low: a bit for each rank that has a bucket; top: a bit for each word of low that is not zero.
        All of them are empty between calls.
        """
        n, tokens, get, low, buckets = len(body), self.tokens, self.ranks.get, self.low, self.buckets
        top = 0
        ids = [*map(self.bytes.__getitem__, body)]
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        pair = [get(body[i : i + 2], -1) for i in range(n)]  # rank of the pair that starts here now
        pair[-1] = -1
        for i, rank in enumerate(pair):
            if rank >= 0:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    buckets[rank] = [i]
                    low[rank >> WORD] |= BIT[rank & MASK]
                    top |= BIT[rank >> WORD]
        while top:
            a = (top & -top).bit_length() - 1
            word = low[a]
            rank = a << WORD | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[a] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale
            j = after[i]
            after[i] = k = after[j]
            ids[i], pair[j], body = rank, -1, tokens[rank]
            if k < n:
                before[k] = i
                pair[i] = found = get(body + tokens[ids[k]], -1)
                if found >= 0:
                    if found in buckets:
                        heappush(buckets[found], i)
                    else:
                        buckets[found] = [i]
                        low[found >> WORD] |= BIT[found & MASK]
                        top |= BIT[found >> WORD]
            else:
                pair[i] = -1
            h = before[i]
            if h >= 0:
                found = get(tokens[ids[h]] + body, -1)
                if pair[h] != found:
                    pair[h] = found
                    if found >= 0:
                        if found in buckets:
                            heappush(buckets[found], h)
                        else:
                            buckets[found] = [h]
                            low[found >> WORD] |= BIT[found & MASK]
                            top |= BIT[found >> WORD]
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out


def _lists(ids: list) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32)))


def _blocks(sizes: list, limit: int) -> Iterator[tuple]:
    """(start, end) of runs of rows whose sizes stay within the limit, one row at least."""
    start, total = 0, 0
    for n, size in enumerate(sizes):
        if n > start and total + size > limit:
            yield start, n
            start, total = n, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


_LAST: list = []


def _encoder(tokens: list, pattern: str) -> Encoder:
    """The encoder of the worker's last task, with all that it remembers, if it is for the same vocabulary."""
    if not _LAST or _LAST[0].tokens is not tokens or _LAST[0].pattern.pattern != pattern:
        _LAST[:] = [Encoder(tokens, pattern)]
    return _LAST[0]


def encode(docs: DataFrame, tokens: list, pattern: str, keep: list) -> DataFrame:
    """The columns ``keep`` and ids array<int> of every whole text; tokens: by rank, as load() gives them."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(tokens)  # a public vocabulary, not data

    def run(batches):
        encoder = _encoder(shared.value, pattern)
        gc.disable()  # the remembered tuples are many and make no cycles
        try:
            for batch in batches:
                texts = batch.column(len(keep))
                for a, b in _blocks([len(x.as_buffer()) for x in texts], BATCH_BYTES):
                    ids = encoder.encode_all([t.decode("utf-8", "replace") for t in texts[a:b].to_pylist()])
                    yield pa.RecordBatch.from_arrays([*(batch.column(i)[a:b] for i in range(len(keep))), _lists(ids)], names=[*keep, "ids"])
        finally:
            gc.enable()

    given = docs.select(*keep, text_bytes().alias("_body"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), "ids array<int>"])
    return given.mapInArrow(tidied(run), schema)


def decode(encoded: DataFrame, tokens: list, keep: list) -> DataFrame:
    """The columns ``keep`` and decoded binary: the bytes of column ids."""
    spark = encoded.sparkSession
    shared = spark.sparkContext.broadcast(tokens)

    def run(batches):
        table = pa.array(shared.value, pa.binary())
        for batch in batches:
            lists = pc.fill_null(batch.column(len(keep)), [])
            try:
                found = table.take(lists.flatten())
            except pa.ArrowIndexError as wrong:
                raise ValueError("an id is not in the vocabulary") from wrong
            if found.null_count:
                raise ValueError("an id is not in the vocabulary")
            sizes = pc.list_value_length(lists).to_numpy()
            ends = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
            bodies = pc.binary_join(pa.ListArray.from_arrays(ends, found), b"")
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), bodies], names=[*keep, "decoded"])

    given = encoded.select(*keep, "ids")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1]), "decoded binary"])
    return given.mapInArrow(tidied(run), schema)


def decimals(ids: Column) -> Column:
    """The ids as decimals with one space between them."""
    return F.array_join(ids.cast("array<string>"), " ")

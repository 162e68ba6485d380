"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items go into one automaton.  A document
is streamed through it once: after each word the state is the longest suffix of
the document read so far that occurs in an item, and its length.  A length of
at least ``window`` words means that the last ``window`` words are a window of
an item; shorter items count as one window and are found on the suffix links.

Items are dealt to shards of at most ``max_words`` words.  The texts of one shard
are broadcast, and each Python worker builds that shard's automaton once, for all
its tasks.  With one shard (the usual case) documents are read once; with more,
each shard is a pass over the documents that carries their hit spans and ends in
a table, so no task and no driver holds more than one shard.

Cases: null or empty texts have no words; items without words are ignored;
repeated items count by their item_id once; items without an item_id count as one
item, whose id is left out of lists and digests; an item longer than ``max_words``
has a shard of its own; empty tables give documents without hits or an empty
result; a null doc_id is carried through.
"""

from __future__ import annotations

import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import new_path, remove_path, small_batches, text_bytes, tidied

#: Lower-cases A-Z, keeps digits, letters and all bytes of other characters, blanks the rest.
FOLD = bytes((c + 32) if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
MAX_WORDS = 200_000  # words of a shard; its automaton takes about 200 MB in a worker


def words_of(text: bytes) -> list:
    return text.translate(FOLD).split()


class SuffixAutomaton:
    """Generalised over items; answers which windows end at the current state."""

    def __init__(self, items: list, window: int):
        self.window, self.ids = window, {}
        self.next, self.link, self.length = [{}], [-1], [0]
        owners: dict = {}
        short: dict = {}
        for item_id, words in items:
            last = 0
            for n, word in enumerate(words):
                last = self._extend(last, self.ids.setdefault(word, len(self.ids)))
                if n + 1 >= window:
                    owners.setdefault(last, set()).add(item_id)
            if len(words) < window:
                short.setdefault(last, set()).add((len(words), item_id))
        self._finish(owners, short)

    def _clone(self, state: int, length: int) -> int:
        new = len(self.length)
        self.next.append(dict(self.next[state]))
        self.link.append(self.link[state])
        self.length.append(length)
        return new

    def _extend(self, last: int, word: int) -> int:
        grown = self.length[last] + 1
        seen = self.next[last].get(word)
        if seen is not None:
            if self.length[seen] == grown:
                return seen
            copy = self._clone(seen, grown)
            self._redirect(last, word, seen, copy)
            self.link[seen] = copy
            return copy
        new = len(self.length)
        self.next.append({})
        self.link.append(0)
        self.length.append(grown)
        at = last
        while at != -1 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at != -1:
            target = self.next[at][word]
            if self.length[target] == self.length[at] + 1:
                self.link[new] = target
            else:
                copy = self._clone(target, self.length[at] + 1)
                self._redirect(at, word, target, copy)
                self.link[target] = self.link[new] = copy
        return new

    def _redirect(self, at: int, word: int, old: int, new: int) -> None:
        while at != -1 and self.next[at].get(word) == old:
            self.next[at][word] = new
            at = self.link[at]

    def _finish(self, owners: dict, short: dict) -> None:
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        gathered = [owners.get(s, ()) for s in range(len(self.length))]
        for s in reversed(order):  # a state's items pass to the suffixes that are long enough
            up = self.link[s]
            if gathered[s] and up > 0 and self.length[up] >= self.window:
                gathered[up] = {*gathered[up], *gathered[s]}
        self.base = [0] * len(self.length)
        self.short = [()] * len(self.length)
        for s in order:
            up = self.link[s]
            self.base[s] = self.base[up] if self.length[up] >= self.window else s
            self.short[s] = self.short[up] + tuple(short.get(s, ()))
        self.items = {s: frozenset(gathered[s]) for s in set(self.base) if gathered[s]}

    def spans(self, words: list) -> tuple:
        """(merged hit spans [first, last], item ids) of a document's words."""
        get, following, link, length = self.ids.get, self.next, self.link, self.length
        window, short, base = self.window, self.short, self.base
        found: list = []
        items: set = set()
        state = matched = 0
        for at, name in enumerate(words):
            word = get(name)
            if word is None:
                state = matched = 0
                continue
            step = following[state].get(word)
            while step is None and state:
                state = link[state]
                matched = length[state]
                step = following[state].get(word)
            if step is None:
                continue
            state = step
            matched += 1
            first = at + 1
            if matched >= window:
                first = at - window + 1
                items |= self.items[base[state]]
            if short[state]:
                for n, item in short[state]:
                    if n <= matched:
                        items.add(item)
                        first = min(first, at - n + 1)
            if first <= at:
                while found and found[-1][0] >= first:
                    found.pop()
                if found and found[-1][1] >= first - 1:
                    found[-1] = (found[-1][0], at)
                else:
                    found.append((first, at))
        return found, items


def merge(spans: list) -> list:
    out: list = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def shards(benchmark: DataFrame, max_words: int):
    """Lists of (item_id, text), each of at most max_words words, read by id range one after the other."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text_bytes().alias("body"))
    part, held = [], 0
    for row in items.orderBy("item_id").toLocalIterator():
        text = bytes(row.body).translate(FOLD)
        n = len(text.split())
        if not n:
            continue
        if part and held + n > max_words:
            yield part
            part, held = [], 0
        part.append((row.item_id, text))
        held += n
    if part:
        yield part


_BUILT: dict = {}


def built(key: str, items: list, window: int) -> SuffixAutomaton:
    """The automaton of a shard, made once in each Python worker; the one before it goes."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = SuffixAutomaton([(item_id, text.split()) for item_id, text in items], window)
    return _BUILT[key]


def in_order(items: set) -> list:
    """Item ids in ascending order, a missing one first."""
    return sorted(items, key=lambda x: (x is not None, x))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_words: int = MAX_WORDS, keep: list | None = None) -> DataFrame:
    """One row per document: the columns ``keep`` (default doc_id), _hit_body, _hit_words, _hit_spans, _hit_items."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = keep or ["doc_id"]
    out = docs.select(*keep, text_bytes().alias("_hit_body"), F.lit(0).cast("bigint").alias("_hit_words"), F.lit(None).cast("array<struct<first:bigint,last:bigint>>").alias("_hit_spans"), F.lit(None).cast("array<bigint>").alias("_hit_items"))
    schema = out.schema
    path, todo = None, shards(benchmark, max_words)
    items = next(todo, [])
    while items is not None:
        following = next(todo, None)
        sent, key = spark.sparkContext.broadcast(items), uuid.uuid4().hex

        def run(batches, sent=sent, key=key):
            for batch in batches:
                automaton = built(key, sent.value, window)
                body, old_spans, old_items = (batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("_hit_body", "_hit_spans", "_hit_items"))
                counts, spans, items = [], [], []
                for text, had, was in zip(body, old_spans, old_items):
                    words = words_of(text)
                    found, who = automaton.spans(words)
                    if had:
                        found = merge(found + [(x["first"], x["last"]) for x in had])
                    counts.append(len(words))
                    spans.append([{"first": a, "last": b} for a, b in found])
                    items.append(in_order(who | set(was or ())))
                n = len(keep)
                kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n + 1)), pa.array(counts, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.int64()))], names=batch.schema.names)

        out = out.mapInArrow(tidied(run), schema)
        if following is not None or path:
            done, path = path, new_path(spark, "decontam-pass")
            out.write.parquet(path)
            out = spark.read.schema(schema).parquet(path)
            sent.destroy()
            if done:
                remove_path(spark, done)
        items = following
    return out


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of hits(); items_sha256 of a document without hits is that of the empty string."""
    ids = F.array_join(F.array_sort(F.transform("_hit_items", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("_hit_spans", F.lit(0).cast("bigint"), lambda a, x: a + x["last"] - x["first"] + 1)
    return found.select("doc_id", F.col("_hit_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_hit_items").cast("bigint").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove(docs: DataFrame, benchmark: DataFrame, window: int = 10, max_coverage: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """The documents with contaminated spans cut out of their texts, all other columns kept.

    A document whose hit words exceed ``max_coverage`` of its words is dropped.
    A cut joins what stands before and after it by one space; white space elsewhere and clean texts are untouched.
    """
    columns = docs.columns
    found = hits(docs, benchmark, window, max_words, keep=columns)
    schema = docs.schema

    def run(batches):
        for batch in batches:
            texts = batch.column(columns.index("text")).to_pylist()
            spans = batch.column(batch.schema.get_field_index("_hit_spans")).to_pylist()
            counts = batch.column(batch.schema.get_field_index("_hit_words")).to_pylist()
            kept, new = [], []
            for text, found, n in zip(texts, spans, counts):
                hit = sum(x["last"] - x["first"] + 1 for x in found)
                kept.append(not hit or hit <= max_coverage * n)
                new.append(cut(text, [(x["first"], x["last"]) for x in found]) if hit and kept[-1] else text)
            arrays = [pa.array(new, pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns).filter(pa.array(kept, pa.bool_()))

    return found.mapInArrow(tidied(run), schema)


def cut(text: str, spans: list) -> str:
    """Remove the words numbered in spans, with what stands between them."""
    body = text.encode()
    folded = body.translate(FOLD)
    ends, at = [], 0
    for word in folded.split():
        at = folded.index(word, at)
        ends.append((at, at + len(word)))
        at += len(word)
    parts, at = [], 0
    for n, (first, last) in enumerate(spans):
        part = body[at : ends[first][0]].decode()
        parts.append(part.strip() if n else part.rstrip())
        at = ends[last][1]
    parts.append(body[at:].decode().lstrip())
    return " ".join(x for x in parts if x)


def item_digest(ids: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()

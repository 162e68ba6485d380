"""Toxicity scores after noisy-channel deobfuscation.

Restoring.  A token with digits or signs among its letters, or a letter three
times in a row, or a run of single characters set apart by spaces, is a lattice:
each character was meant as itself, as a letter it resembles, or as nothing (a
separator or a repeat).  Viterbi over a character trigram model, learned from
the training texts, finds the likeliest reading.  Tokens of plain letters have
one path and pass unchanged.  All trigrams of all training texts count, labelled
or not.

Scoring.  Features are words and word beginnings of restored tokens.  On a
bounded sample of labelled rows a feature is picked if it hardly occurs in clean
texts and its toxic occurrences are too many for chance.  Support is counted in
distinct contexts (the words before and after), as copies of one toxic text
would otherwise make every rare word in it look toxic.  A greedy cover then adds
features for toxic texts that no picked one explains.  The score is a noisy-or
over the words of a text: 1 - (1 - leak) * prod(1 - p), with p the precision of
the word's best feature.

Bounds: at most ``max_train`` labelled rows (by a hash of the id) are read for
the features; at most ``max_features`` features come to the driver.  The trigrams
come to it without a bound: their number follows the scripts, not the texts.

Cases: null text = empty text, scored by the leak alone; labels without a row,
with null ids or null marks are ignored; a row labelled more than once counts
as toxic if any label says so; without labels every score is the leak; texts of
any length are scored whole.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, small_batches, tidied

CACHE_TOKENS = 300_000
PREFIXES = (4, 5, 6, 7)
#: Letters that digits and signs stand for.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "gp",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "&": "a", "#": "h", "%": "x",
}
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
EDGE_KEEP = re.compile(r"^(?:(?![@$€£])[\W_])+|(?:(?![@$€£])[\W_])+$|^([\W_])\1+|([\W_])\2+$")
PLAIN = re.compile(r"[^\W\d_]+\Z")
TRIPLE = re.compile(r"(.)\1\1")
SPACED = re.compile(r"(?<!\S)(?:[^\s] ){2,}[^\s](?!\S)")
PARTS = re.compile(r"[^\W\d_]{2,}")
COST_LOOK, COST_SKIP, COST_REPEAT, COST_UNKNOWN = 1.5, 1.0, 0.4, 6.0


class CharModel:
    """Trigram log probabilities over letters; ^ starts a word and $ ends it."""

    def __init__(self, trigrams: dict):
        pairs: Counter = Counter()
        letters = set()
        for t, n in trigrams.items():
            pairs[t[:2]] += n
            letters.add(t[2])
        size = max(2, len(letters))
        self.cost3 = {t: -math.log((n + 0.1) / (pairs[t[:2]] + 0.1 * size)) for t, n in trigrams.items()}
        self.cost2 = {p: -math.log(0.1 / (n + 0.1 * size)) for p, n in pairs.items()}
        self.cost1 = math.log(size)

    def cost(self, pair: str, letter: str) -> float:
        found = self.cost3.get(pair + letter)
        return found if found is not None else self.cost2.get(pair, self.cost1)

    def word(self, word: str) -> float:
        text = "^^" + word + "$"
        return sum(self.cost(text[i - 2 : i], text[i]) for i in range(2, len(text)))


def restore(token: str, model: CharModel) -> tuple:
    """(likeliest letters, its cost): Viterbi over the lattice of a lower-cased token."""
    states = {"^^": (0.0, None)}
    before, run = "", 0
    for c in token:
        run = run + 1 if c == before else 1
        meant = [(c, 0.0)] if c.isalpha() else [(x, COST_LOOK) for x in LOOKALIKES.get(c, "")]
        skip = COST_REPEAT if run >= 2 and c.isalpha() else None if c.isalpha() else 0.3 if c.isspace() else COST_SKIP if c not in LOOKALIKES or run >= 2 or before == "" else COST_SKIP + 2.0
        if c.isdigit() and skip is not None:
            skip += COST_UNKNOWN
        before = c
        new: dict = {}
        for pair, (cost, path) in states.items():
            for letter, extra in meant:
                total = cost + extra + model.cost(pair, letter)
                key = pair[1] + letter
                if key not in new or total < new[key][0]:
                    new[key] = (total, (letter, path))
            if skip is not None:
                total = cost + skip
                if pair not in new or total < new[pair][0]:
                    new[pair] = (total, path)
        states = new
    pair, (cost, path) = min(((p, (c + model.cost(p, "$"), w)) for p, (c, w) in states.items()), key=lambda x: x[1][0])
    letters = []
    while path is not None:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters)), cost


def readings(token: str, model: CharModel) -> list:
    """The words that a whitespace-separated, lower-cased token stands for."""
    if PLAIN.match(token) and not TRIPLE.search(token):
        return [token]
    core = EDGE.sub("", token)
    if PLAIN.match(core) and not TRIPLE.search(core):
        if core == token or not any(c in LOOKALIKES for c in (token[0], token[-1])):
            return [core]
        inner = EDGE_KEEP.sub("", token)
        if inner == core:
            return [core]
        return [core, restore(inner, model)[0]]
    inner = EDGE_KEEP.sub("", token)
    if not inner:
        return []
    found = [*PARTS.findall(core), restore(inner, model)[0]]
    return [w for w in dict.fromkeys(found) if w]


def features(word: str) -> list:
    """The word, and its beginnings."""
    return ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def spaced_runs(text: str, model: CharModel) -> list:
    """(word, start, end): words hidden in runs of three or more single characters, where joining reads better than leaving them."""
    out = []
    for m in SPACED.finditer(text):
        run = m[0]
        joined, cost = restore(run, model)
        if len(joined) > 2 and cost < sum(model.word(c) for c in run.split(" ")):
            out.append((joined, m.start(), m.end()))
    return out


def spaced_words(text: str, model: CharModel) -> list:
    return [word for word, _, _ in spaced_runs(text, model)]


def contexts(text: str, model: CharModel, known: dict) -> dict:
    """{feature: number of its first context} of all words that a text stands for."""
    tokens = text.lower().split()
    out: dict = {}
    for token, at in dict(zip(reversed(tokens), range(len(tokens) - 1, -1, -1))).items():
        found = known.get(token)
        if found is None:
            if len(known) > CACHE_TOKENS:
                known.clear()
            found = known[token] = [f for w in readings(token, model) for f in features(w)]
        if found:
            around = zlib.crc32("\n".join(tokens[max(0, at - 1) : at + 2 : 2] if at else tokens[1:2]).encode())
            for f in found:
                out.setdefault(f, around)
    low = text.lower()
    for word, start, end in spaced_runs(low, model):
        around = zlib.crc32("\n".join(low[max(0, start - 200) : start].split()[-1:] + low[end : end + 200].split()[:1]).encode())
        for f in features(word):
            out.setdefault(f, around)
    return out


# ------------------------------------------------------------ fitting
def fit(docs: DataFrame, labels: DataFrame, max_train: int = 20_000, max_features: int = 50_000, min_support: int = 3, min_precision: float = 0.95) -> dict:
    """The model: trigrams, weights {feature: p}, leak. docs has doc_id and text, labels doc_id and toxic."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    train = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("doc_id", "toxic", "text")
    train = materialize(train, "toxic-train")

    def trigrams(batches):
        words: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words.update(PARTS.findall(text.lower()))
            if len(words) > CACHE_TOKENS:
                yield counted(words)
                words.clear()
        yield counted(words)

    def counted(words):
        found: Counter = Counter()
        for word, n in words.items():
            padded = "^^" + word + "$"
            for i in range(len(padded) - 2):
                found[padded[i : i + 3]] += n
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["t", "n"])

    texts = docs.where("text is not null").select(F.col("text").cast("string"))
    grams = {r.t: r.n for r in texts.mapInArrow(tidied(trigrams), "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(grams)

    def rows(batches):
        model, known = CharModel(sent.value), {}
        for batch in batches:
            owners, marks, names, near = [], [], [], []
            for doc_id, toxic, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = contexts(text, model, known)
                owners += [doc_id] * len(found)
                marks += [toxic] * len(found)
                names += found
                near += found.values()
            yield pa.RecordBatch.from_arrays([pa.array(owners, pa.int64()), pa.array(marks, pa.int32()), pa.array(names, pa.string()), pa.array(near, pa.int64())], names=["doc_id", "toxic", "f", "near"])

    used = materialize(train.mapInArrow(tidied(rows), "doc_id long, toxic int, f string, near long"), "toxic-features")
    toxic, clean = (F.sum((F.col("toxic") == v).cast("long")) for v in (1, 0))
    both = used.groupBy("f").agg(toxic.alias("t"), clean.alias("c"), F.size(F.collect_set(F.when(F.col("toxic") == 1, F.col("near")))).alias("k"))
    good = both.where((F.col("k") >= min_support) & (F.col("t") >= min_precision * (F.col("t") + F.col("c"))))
    good = materialize(good.orderBy(F.desc("k"), "c", "f").limit(max_features), "toxic-good")
    counts = {r.f: (r.t, r.c, r.k) for r in good.collect()}
    holders = used.where("toxic = 1").join(F.broadcast(good.select("f")), "f").groupBy("f").agg(F.collect_set("doc_id").alias("docs"))
    cover = {r.f: set(r.docs) for r in holders.toLocalIterator()}
    totals = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    bad, fine = totals.get(1, 0), totals.get(0, 0)
    chance = math.log((bad + fine + 1) / (bad + 0.5))  # a toxic text for each context, by luck
    need = math.log(10 * max(1, used.select("f").distinct().count())) / chance
    sure = {f for f, (_, _, k) in counts.items() if k >= need}
    weights = {f: (counts[f][0] + 0.5) / (counts[f][0] + counts[f][1] + 1.0) for f in sure} | pick({f: d for f, d in cover.items() if counts[f][2] >= need / 2}, counts, min_support, sure)
    explained = set().union(*(cover[f] for f in weights)) if weights else set()
    missed = bad - len(explained)
    leak = (missed + 0.5) / (missed + fine + 1.0)
    return {"trigrams": grams, "weights": weights, "leak": min(0.5, leak)}


def pick(cover: dict, counts: dict, min_gain: int, sure: set) -> dict:
    """Greedy cover, lazily re-evaluated: {feature: p}. Ties go to the cleaner, then the longer feature."""
    import heapq

    heap = [(-len(docs), counts[f][1], -len(f), f) for f, docs in cover.items()]
    heapq.heapify(heap)
    open_docs = set().union(*cover.values()) if cover else set()
    for f in sure:
        open_docs -= cover.get(f, set())
    out: dict = {}
    while heap:
        gain, clean, length, f = heapq.heappop(heap)
        now = len(cover[f] & open_docs)
        if now < min_gain:
            continue
        if heap and (-now, clean, length, f) > heap[0]:
            heapq.heappush(heap, (-now, clean, length, f))
            continue
        t, c, _ = counts[f]
        out[f] = (t + 0.5) / (t + c + 1.0)
        open_docs -= cover[f]
    return out


# ------------------------------------------------------------ scoring
def score(docs: DataFrame, model: dict, keep: list) -> DataFrame:
    """The columns ``keep`` of docs (which has text), with score."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    picked = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), "score double"])

    def run(batches):
        weights, leak = sent.value["weights"], sent.value["leak"]
        chars = CharModel(sent.value["trigrams"])
        known: dict = {}

        def best(words: list) -> float:
            return max((weights.get(f, 0.0) for w in words for f in features(w)), default=0.0)

        for batch in batches:
            out = []
            if len(known) > CACHE_TOKENS:
                known.clear()
            for text in batch.column(len(keep)).to_pylist():
                low = text.lower()
                clean = 1.0 - leak
                for token in set(low.split()):
                    p = known.get(token)
                    if p is None:
                        p = known[token] = best(readings(token, chars))
                    if p:
                        clean *= 1.0 - p
                for word in spaced_words(low, chars):
                    clean *= 1.0 - best([word])
                out.append(1.0 - clean)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.float64())], names=[*keep, "score"])

    return picked.mapInArrow(tidied(run), schema)

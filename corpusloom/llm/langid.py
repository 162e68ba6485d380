"""Language identification by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary.  For each language, piece
probabilities are learned by expectation-maximisation on words: the expected
count of a piece is its posterior over all segmentations (forward-backward),
gathered by tasks and summed in Spark, so the driver holds no more than
languages x pieces numbers.  A word's probability in a language is the forward
sum over all segmentations; a text's is the product over its words.

Words are maximal runs of letters, lower-cased, with a word-start mark.  A
letter outside the vocabulary counts as a piece of probability ``FLOOR`` in
every language.

The fit uses a bounded sample of labelled rows: at most about
``docs_per_language`` texts of each language, chosen by a hash of id and text.

Cases: null texts and texts without a letter (digits, fractions and circled numbers are none) are ``und`` with score 0; null
languages are not learned; with no training rows every text is ``und``; a text
of any length is scored whole; a null doc_id is carried through.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, small_batches, tidied

FLOOR = 1e-7
PRIOR = 0.01
CACHE_WORDS = 200_000
TEXTS_AT_ONCE = 128
HASH_BASE = 0x9E3779B97F4A7C15
GROUP_LETTERS = 100_000
MARK = "▁"
LONG_WORD = 48
NEARLY = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no digits (such as 1/2 in one sign)
LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str) -> list:
    """The runs of letters (Unicode category L) of a lower-cased text."""
    found = NEARLY.findall(text)
    return found if not found or "".join(found).isalpha() else LETTERS.findall(text)


def vocabulary(path: str) -> list:
    """Lower-case letter pieces of a SentencePiece file, in id order; single letters of words are added by need."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
    return [p for p in found if p == p.lower() and all(c == MARK or c.isalpha() for c in p) and MARK not in p[1:] and p != MARK]


class Lattice:
    """Pieces with one probability for each language; forward and backward sums over words."""

    def __init__(self, pieces: list, probs: np.ndarray):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.columns = probs.T.tolist()
        self.longest = max(map(len, pieces), default=1)
        self.langs = probs.shape[1]
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        order = np.argsort(hashes)
        self.hashes = np.r_[hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF)]
        rows = probs[order] if len(pieces) else np.zeros((0, self.langs))
        self.multi = np.vstack([rows, np.zeros(self.langs)])  # last row: no such piece
        self.single = np.vstack([rows, np.full(self.langs, FLOOR)])

    @staticmethod
    def _hash(text: str) -> int:
        h = 0
        for c in text:
            h = (h * HASH_BASE + ord(c)) & 0xFFFFFFFFFFFFFFFF
        return h

    def log_words(self, words: list) -> np.ndarray:
        """log p of each word in each language; words of one length advance together."""
        out = np.zeros((len(words), self.langs))
        by: dict = {}
        for k, w in enumerate(words):
            by.setdefault(len(w), []).append(k)
        for length, at in by.items():
            step = max(1, GROUP_LETTERS // (length + 1))
            for k in range(0, len(at), step):
                part = at[k : k + step]
                flat = "".join([MARK + words[i] for i in part]).encode("utf-32-le")
                out[part] = self._forward(np.frombuffer(flat, dtype="<u4").reshape(len(part), length + 1).astype(np.uint64))
        return out

    def _forward(self, chars: np.ndarray) -> np.ndarray:
        """chars: one row of code points for each word."""
        m, n = chars.shape
        base, none = np.uint64(HASH_BASE), len(self.hashes) - 1
        scale = np.zeros((m, self.langs))
        window = [np.ones((m, self.langs))]  # sums at i, i + 1, ...
        for i in range(n):
            here = window.pop(0)
            if not i % 8 and i:
                factor = np.where(here < 1e-100, 1e100, 1.0)
                here = here * factor
                window = [x * factor for x in window]
                scale += np.log(factor)
            h = np.zeros(m, dtype=np.uint64)
            for j in range(min(self.longest, n - i)):
                h = h * base + chars[:, i + j]
                spot = np.searchsorted(self.hashes, h)
                spot[self.hashes[spot] != h] = none
                if j == len(window):
                    window.append(np.zeros((m, self.langs)))
                if j:
                    some = np.flatnonzero(spot != none)
                    if len(some):
                        window[j][some] += here[some] * self.multi[spot[some]]
                else:
                    window[0] = window[0] + here * self.single[spot]
        return np.log(window[0]) - scale

    def expected(self, word: str, lang: int, times: int, into: dict) -> None:
        """Add the posterior piece counts of a word in one language."""
        text = MARK + word
        n, longest, index, probs = len(text), self.longest, self.index, self.columns[lang]
        edges = []
        for i in range(n):
            some = False
            for j in range(i + 1, min(n, i + longest) + 1):
                k = index.get(text[i:j])
                if k is not None:
                    edges.append((i, j, k, probs[k]))
                    some = some or j == i + 1
            if not some:
                edges.append((i, i + 1, -1, FLOOR))
        if n > LONG_WORD:
            self._expected_logs(edges, n, lang, times, into)
            return
        forward = [1.0] + [0.0] * n
        for i, j, _, p in edges:
            forward[j] += forward[i] * p
        backward = [0.0] * n + [1.0]
        for i, j, _, p in reversed(edges):
            backward[i] += p * backward[j]
        if forward[n] <= 0:
            return
        for i, j, k, p in edges:
            if k >= 0:
                into[lang, k] = into.get((lang, k), 0.0) + times * forward[i] * p * backward[j] / forward[n]

    @staticmethod
    def _expected_logs(edges: list, n: int, lang: int, times: int, into: dict) -> None:
        """The same for a long word, whose probabilities are too small for plain numbers."""
        none = -math.inf

        def plus(a: float, b: float) -> float:
            if a < b:
                a, b = b, a
            return a if b == none else a + math.log1p(math.exp(b - a))

        logs = [(i, j, k, math.log(p)) for i, j, k, p in edges if p > 0]
        forward = [0.0] + [none] * n
        for i, j, _, p in logs:
            forward[j] = plus(forward[j], forward[i] + p)
        backward = [none] * n + [0.0]
        for i, j, _, p in reversed(logs):
            backward[i] = plus(backward[i], p + backward[j])
        if forward[n] == none:
            return
        for i, j, k, p in logs:
            if k >= 0:
                into[lang, k] = into.get((lang, k), 0.0) + times * math.exp(forward[i] + p + backward[j] - forward[n])


# ------------------------------------------------------------ fitting
def sample(labelled: DataFrame, docs_per_language: int) -> DataFrame:
    """About docs_per_language rows of each language, by a hash of id and text; all rows of rarer languages."""
    total = labelled.groupBy("lang").count()
    share = labelled.join(F.broadcast(total.withColumn("share", F.least(F.lit(1.0), docs_per_language / F.col("count"))).select("lang", "share")), "lang")
    return share.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 50)) < F.col("share") * (1 << 50)).select("lang", "text")


def fit(labelled: DataFrame, pieces: list, docs_per_language: int = 400, rounds: int = 3) -> tuple:
    """(languages, probs): probs[piece, language], from rows (doc_id, text, lang)."""
    spark = labelled.sparkSession
    small_batches(spark)
    picked = sample(labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang"), docs_per_language)

    def count(batches):
        seen: dict = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in words_of(text.lower()):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([seen[k] for k in keys], pa.int64())], names=["lang", "word", "n"])

    words = materialize(picked.mapInArrow(tidied(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lang-words")
    langs = [r.lang for r in words.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return [], np.zeros((len(pieces), 0))
    number = {x: i for i, x in enumerate(langs)}
    probs = np.full((len(pieces), len(langs)), 1.0 / max(1, len(pieces)))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, probs))

        def expect(batches, sent=sent):
            lattice, found = Lattice(*sent.value), {}
            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    lattice.expected(word, number[lang], n, found)
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k] for k in keys], pa.float64())], names=["lang", "piece", "n"])

        sums = words.mapInArrow(tidied(expect), "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        counts = np.full((len(pieces), len(langs)), PRIOR)
        got = sums.toPandas()
        counts[got["piece"].to_numpy(), got["lang"].to_numpy()] += got["n"].to_numpy()
        probs = counts / counts.sum(axis=0)
    return langs, probs


# ------------------------------------------------------------ prediction
def predict(docs: DataFrame, pieces: list, langs: list, probs: np.ndarray, keep: list, names: tuple = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of docs (which has text), with the language and its posterior under equal priors, as ``names``."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((pieces, probs))
    picked = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), f"{names[0]} string", f"{names[1]} double"])

    def run(batches):
        lattice = Lattice(*sent.value)
        n = len(langs)
        known: dict = {}
        table = np.zeros((1024, n))
        for whole, k in ((b, k) for b in batches for k in range(0, b.num_rows, TEXTS_AT_ONCE)):
            batch = whole.slice(k, TEXTS_AT_ONCE)
            best_langs, scores = [], []
            texts = batch.column(len(keep)).to_pylist()
            found = [words_of(t.lower()) if t else () for t in texts]
            if len(known) > CACHE_WORDS:
                known.clear()
            new = list({w for words in found for w in words if w not in known}) if n else []
            if new:
                while len(known) + len(new) > len(table):
                    table = np.concatenate([table, np.zeros_like(table)])
                table[len(known) : len(known) + len(new)] = lattice.log_words(new)
                known.update(zip(new, range(len(known), len(known) + len(new))))
            for words in found:
                if not words or not n:
                    best_langs.append("und")
                    scores.append(0.0)
                    continue
                total = table[np.fromiter(map(known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
                best = int(total.argmax())
                best_langs.append(langs[best])
                scores.append(float(1.0 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(best_langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, *names])

    return picked.mapInArrow(tidied(run), schema)

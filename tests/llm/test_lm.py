from collections import Counter
import math
import zlib

import numpy as np
import pytest

from corpusloom.llm import lm
from corpusloom.llm.common import remainder, text_bytes
from corpusloom.llm.queries import QUERIES


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


@pytest.fixture(scope="module")
def scored(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in QUERIES["op3_lm_score"](spark, sf).collect()}


def test_base_equals_brute_force(scored):
    texts, rows = scored
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in texts.items():
        r, ws = rows[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(ws), n)
        assert r.n_known == sum(w in counts for w in ws)
        assert math.isclose(r.base_score, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)


def test_scores_equal_brute_force(spark, sf):
    """Whole texts against exact counts, quantised as the filter does; wide filters have next to no false positives."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    split = remainder("doc_id", 7)
    model = lm.train(docs.where(split != 2), bits_per_level=200)
    rows = {r.doc_id: r.score for r in lm.score(docs.select("doc_id", (split == 2).alias("held_out"), text_bytes().alias("body")), model).collect()}
    texts = {r.doc_id: lm.tokens((r.text or "").encode()) for r in docs.collect()}
    one, two = Counter(), Counter()
    for i, ws in texts.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            one.update(ws)
            two.update(zip([lm.END, *ws], ws))
    n, v = sum(one.values()), len(one)
    read = lambda c: float(lm.expected(lm.levels(np.array([c])))[0]) if c else 0.0
    far = 0
    for i, ws in texts.items():
        total = 0.0
        for a, b in zip([lm.END, *ws], ws):
            left, right = read(one[a]), read(one[b])
            joint = min(read(two[a, b]), left, right)
            total += math.log10((joint + lm.MU * (right + 1) / (n + v + 1)) / (left + lm.MU))
        far += not math.isclose(rows[i], total, rel_tol=1e-9)
    assert far <= 0.02 * len(texts)


def test_model_beats_the_base_on_held_out_texts(scored):
    held = [r for r in scored[1].values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 for r in held)


def test_filter_reads_back_quantised_counts(spark):
    docs = spark.createDataFrame([("a " * 40 + "b b c",)], "text string")
    model = lm.train(docs, slices=4)
    words = lm.Words()
    got = model.filter.counts(words.hashes([b"a", b"b", b"c", b"never", b"nor"]))
    want = lm.expected(lm.levels(np.array([40, 2, 1])))
    assert list(got[:3]) == list(want) and abs(want[0] - 40) < 12
    assert (got[3:] <= 1.0).all()
    tiny = lm.train(docs, slices=4, max_filter_bytes=64)
    assert (tiny.filter.counts(words.hashes([b"a", b"b", b"c"])) >= want).all()  # too small a filter only overcounts
    assert len(tiny.filter.data) <= 64


def test_probabilities_sum_to_about_one(spark):
    docs = spark.createDataFrame([("a b a c a b d",)], "text string")
    model = lm.train(docs, slices=2)
    words = [b"a", b"b", b"c", b"d", lm.END]
    hashes = lm.Words().hashes(words)
    total = 0.0
    for h in hashes:
        flat = np.array([hashes[0], h, hashes[4]], dtype=np.uint64)
        total += 10 ** lm.conditional(model.filter, flat, *np.unique(flat, return_inverse=True), 5.0)[1]
    assert 0.7 < total < 1.1


def test_runs_of_slices_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = lm.train(docs)
    picked = docs.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), text_bytes().alias("body"))
    rows = lambda n: sorted((r.doc_id, round(r.base_score, 6), r.n_known, round(r.score, 6)) for r in lm.score(picked, model, max_slice=n).collect())
    assert rows(3000) == rows(10**9)


def test_bits_grow_with_the_corpus_and_runs_of_the_filter_give_the_same(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    picked = docs.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), text_bytes().alias("body"))
    one, many = lm.train(docs), lm.train(docs, max_filter_bytes=20_000)
    assert many.filter.bits_per_level >= 7.9 and len(many.filter.data) == len(one.filter.data) > 20_000
    assert len(list(lm.runs(many.slice_bytes, 20_000))) > 1
    rows = lambda m: sorted((r.doc_id, round(r.base_score, 6), r.n_known, round(r.score, 6)) for r in lm.score(picked, m).collect())
    assert rows(one) == rows(many)


def test_probing_stops_at_the_highest_level(spark):
    model = lm.train(spark.createDataFrame([("a " * 40 + "b",)], "text string"), slices=1)
    full = model.filter
    full.data[:] = 255
    assert full.levels(np.arange(5, dtype=np.uint64)).max() == lm.levels(np.array([40]))[0]


def test_edges(edge, none):
    picked = lambda d: d.select("doc_id", (remainder("doc_id", 7) == 2).alias("held_out"), text_bytes().alias("body"))
    model = lm.train(edge)
    rows = lm.score(picked(edge), model).collect()
    assert len(rows) == edge.count()
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm.score(picked(none), model).count() == 0
    empty = lm.score(picked(edge), lm.train(none)).collect()
    assert len(empty) == edge.count() and {r.train_tokens for r in empty} == {0} and {r.n_known for r in empty} == {0}

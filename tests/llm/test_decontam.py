import random

import pytest
from helpers import rows_of

from corpusloom.llm import decontam as D
from corpusloom.llm.queries import ORACLES, QUERIES


def brute(words, items, window):
    hit, ids = set(), set()
    for item, text in items:
        n = min(window, len(text))
        for k in range(max(1, len(text) - window + 1) if text else 0):
            part = text[k : k + n]
            for at in range(len(words) - n + 1):
                if words[at : at + n] == part:
                    hit |= set(range(at, at + n))
                    ids.add(item)
    return hit, ids


def test_automaton_equals_brute_force():
    rng = random.Random(4)
    for _ in range(400):
        window = rng.randint(2, 5)
        words = [f"w{i}" for i in range(rng.randint(2, 5))]
        items = [(i, [rng.choice(words) for _ in range(rng.randint(1, 9))]) for i in range(rng.randint(1, 6))]
        text = [rng.choice([*words, "other"]) for _ in range(rng.randint(0, 30))]
        spans, ids = D.SuffixAutomaton(items, window).spans(text)
        hit, truth = brute(text, items, window)
        assert {i for a, b in spans for i in range(a, b + 1)} == hit
        assert ids == truth
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("max_words", [2_000_000, 60, 1])
def test_query_equals_sql(spark, sf, duck, max_words):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    if max_words == 1:
        items = items.limit(4)
        items.createOrReplaceTempView("some")
        one = D.digest(D.hits(docs, items)).toPandas()
        assert rows_of(D.digest(D.hits(docs, items, max_words=1)).toPandas()) == rows_of(one)
        return
    assert rows_of(D.digest(D.hits(docs, items, max_words=max_words)).toPandas()) == rows_of(duck.execute(ORACLES["op5_decontaminate"]).df())


def test_registered_query(spark, sf, duck):
    assert rows_of(QUERIES["op5_decontaminate"](spark, sf).toPandas()) == rows_of(duck.execute(ORACLES["op5_decontaminate"]).df())


def test_cut():
    assert D.cut("One, two three four! Five", [(1, 2)]) == "One, four! Five".replace("One, four", "One,  four").replace("  ", " ")
    assert D.cut("a b c", [(0, 2)]) == ""
    assert D.cut("é b ü", [(1, 1)]) == "é ü"
    assert D.cut("\n  a b c d  \n", [(1, 2)]) == "\n  a d  \n"


def test_edges(spark, edge, none):
    items = spark.createDataFrame([(1, " ".join(f"w{i}x" for i in range(12)), "x"), (2, "ONE two", "x"), (3, None, "x"), (4, "?!", "x"), (None, "alpha", "x"), (2, "one TWO", "x")], "item_id long, text string, body string")
    found = {r.doc_id: r for r in D.digest(D.hits(edge, items)).collect()}
    assert (found[9].n_hit, found[9].n_items, found[10].n_hit, found[4].n_hit, found[4].n_items) == (12, 1, 12, 2, 1)
    assert found[1].n_words == 0 and not found[1].contaminated and found[7].n_words == 80_000
    assert (found[7].n_hit, found[7].n_items, found[7].items_sha256) == (20_000, 1, D.item_digest([]))  # an item without an id
    assert found[9].items_sha256 == D.item_digest([1]) and found[2].items_sha256 == D.item_digest([])
    assert D.digest(D.hits(none, items)).count() == 0
    assert not any(r.contaminated for r in D.digest(D.hits(edge, items.limit(0))).collect())
    out = {r.doc_id: r.text for r in D.remove(edge, items, max_coverage=0.5).collect()}
    assert 4 not in out  # the whole text was an item
    assert out[9].split()[0] == "w12x" and out[12] == "the THE The"
    assert D.remove(edge, items).columns == edge.columns

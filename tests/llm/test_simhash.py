import random

import numpy as np
import pytest
import xxhash

from corpusloom.llm import simhash as S


def plain(text, width=4):
    words = text.encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(words, radius):
    f = S.Forest()
    for i, a in enumerate(words):
        for b in words[:i]:
            if (a ^ b).bit_count() <= radius:
                f.union(a, b)
    return {w: f.find(w) for w in words}


def test_fingerprints():
    rng = random.Random(2)
    for n in (0, 1, 3, 4, 5, 40, 300):
        text = "  \n".join(rng.choice(["the", "THE", "cat", "ñandú", "x1", "日本"]) for _ in range(n))
        assert S.fingerprint(text.encode()) == plain(text)
    assert S.fingerprint(b"A b\xc3\x89") != S.fingerprint(b"a b\xc3\xa9")  # only A to Z are folded


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_trees_and_midpoints_equal_brute_force(radius):
    rng = random.Random(radius)
    words = []
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(12):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(0, radius + 1)))
            words.append(base)
    words = sorted(set(words))
    truth = closure(words, radius)
    tree, mid = S.Forest(), S.Forest()
    S.tree_links(words, radius, tree)
    S.midpoint_links(np.array(words, dtype=np.uint64), radius, list(range(64)), mid)
    assert {w: tree.find(w) for w in words} == truth
    assert {w: mid.find(w) for w in words} == truth


def test_bk_tree_search():
    tree = S.BKTree()
    words = [random.Random(i).getrandbits(16) for i in range(400)]
    for w in words:
        tree.insert(w)
    for q in words[:40]:
        assert sorted(tree.within(q, 3)) == sorted(w for w in set(words) if (w ^ q).bit_count() <= 3)


@pytest.mark.parametrize("more", [{}, {"tree_limit": 1}, {"blocks": 7}, {"blocks": 5}])
def test_components_equal_brute_force(spark, sf, more):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = S.near_duplicates(docs, **more).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert prints == {i: plain(t) for i, t in texts.items()}
    roots = closure(sorted(set(prints.values())), 4)
    least: dict = {}
    for i, p in prints.items():
        least[roots[p]] = min(i, least.get(roots[p], i))
    assert {r.doc_id: r.component_id for r in rows} == {i: least[roots[p]] for i, p in prints.items()}


def test_long_chains_settle(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(1000, 999)], "a long, b long")
    assert {r.node: r.root for r in S.components(edges).collect()} == {**{i: 0 for i in range(1, 61)}, 1000: 999}


def test_edges(edge, none):
    rows = S.near_duplicates(edge).collect()
    assert len(rows) == edge.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16
    assert by[3].component_id == 1
    assert S.near_duplicates(none).count() == 0
    kept = S.deduplicate(edge)
    assert kept.columns == edge.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(5) == 1 and 6 not in ids and 2 not in ids and 1 in ids
    assert S.deduplicate(none).count() == 0


def jaccard(a, b, width=5):
    grams = lambda t: {tuple(t.lower().split()[i : i + width]) for i in range(max(1, len(t.split()) - width + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_similar_texts_are_found(spark):
    """Copies with changed words: above 0.85 nearly all go, below 0.6 and unrelated ones none."""
    rng = random.Random(9)
    rows, near, far = [], 0, 0
    for g in range(60):
        words = [f"g{g}w{rng.randrange(10**6)}" for _ in range(200)]
        edits = 2 if g < 30 else 24
        copy = list(words)
        for i in rng.sample(range(200), edits):
            copy[i] = f"e{rng.randrange(10**6)}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(copy))]
        j = jaccard(rows[-1][1], rows[-2][1])
        near, far = near + (j > 0.85), far + (j < 0.6)
    assert near == 30 and far == 30
    kept = {r.doc_id for r in S.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(2 * g in kept for g in range(60))
    assert sum(2 * g + 1 not in kept for g in range(30)) >= 28
    assert all(2 * g + 1 in kept for g in range(30, 60))


def linked(texts, similarity=0.8):
    """Smallest id of each text's group, from all pairs and their exact similarity."""
    forest, names = S.Forest(), sorted(texts)
    sets = {i: set(S.shingle_set(texts[i].encode(), 5).tolist()) for i in names}
    for n, i in enumerate(names):
        for j in names[:n]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                forest.union(i, j)
    return {i: forest.find(i) for i in names}


@pytest.mark.parametrize("length", [60, 150, 400])
def test_recall_just_above_the_similarity(spark, length):
    """Pairs of similarity 0.80 to 0.85: at least nine in ten are found, and none below 0.8."""
    rng, texts = random.Random(length), {}
    while len(texts) < 120:
        words = [f"v{rng.randrange(5000)}" for _ in range(length)]
        copy = list(words)
        while True:
            copy[rng.randrange(length)] = f"e{rng.randrange(10**6)}"
            j = jaccard(" ".join(words), " ".join(copy))
            if j < 0.85:
                break
        if j >= 0.8 or len(texts) % 3 == 0:
            texts |= {len(texts): " ".join(words), len(texts) + 1: " ".join(copy)}
    want = {i for i, low in linked(texts).items() if i == low}
    kept = {r.doc_id for r in S.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert kept >= want and len(texts) - len(kept) >= 0.9 * (len(texts) - len(want))


def test_large_group_of_near_copies(spark):
    """Copies of one text around the similarity: shards of several blocks, groups by exact similarity."""
    rng = random.Random(5)
    words = [f"v{i}" for i in range(120)]
    texts = {}
    for i in range(500):
        copy = list(words)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    want = {i for i, low in linked(texts).items() if i == low}
    kept = {r.doc_id for r in S.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)).collect()}
    assert 0 in kept and kept >= want and len(kept) <= len(want) + 5


def test_proposals_equal_brute_force():
    rng = random.Random(11)
    words = [rng.getrandbits(256) for _ in range(3)]
    words += [words[i % 3] ^ sum(1 << b for b in rng.sample(range(256), rng.randint(1, 30))) for i in range(90)]
    near = lambda i, j: (words[i] ^ words[j]).bit_count()
    ids = list(range(len(words)))
    got = {x: (d, y) for x, y, d in S.proposals(words, ids, 38)}
    for i in ids:
        assert got.get(i) == min(((near(i, j), j) for j in range(i) if near(i, j) <= 38), default=None)


def test_all_candidates_equal_brute_force(spark, monkeypatch):
    """Every pair of two groups that shares a shard, in cells of any size; one crowded shard among small ones."""
    rng = np.random.default_rng(4)
    words = rng.integers(0, 2**64, (150, 4), dtype=np.uint64)
    words[:110] = words[0]
    words[:110, 3] ^= np.uint64(1) << rng.integers(0, 64, 110, dtype=np.uint64)
    words[1:110:2, 2] ^= np.uint64(1) << rng.integers(0, 64, 55, dtype=np.uint64)
    comps = [i if i > 100 or i % 5 == 0 else 0 for i in range(150)]
    sets = [{*range(100)} | {*range(100 * i % 700, 100 * i % 700 + 30)} for i in range(150)]
    sketches = [bytes(np.packbits(np.isin(np.arange(S.SKETCH), list(x)), bitorder="little")) for x in sets]
    samples = np.stack([rng.choice(256, 10, replace=False) for _ in range(6)])
    bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")
    want = set()
    for i in range(150):
        for j in range(i):
            if comps[i] != comps[j] and len(sets[i] ^ sets[j]) * 9 <= len(sets[i]) + len(sets[j]) and np.bitwise_count(words[i] ^ words[j]).sum() <= 3 and any((bits[i, s] == bits[j, s]).all() for s in samples):
                want.add((i, j))
    assert len(want) > 200
    rows = spark.createDataFrame([(i, comps[i], *map(int, w.view(np.int64)), len(sets[i]), sketches[i]) for i, w in enumerate(words)], "id long, comp long, w0 long, w1 long, w2 long, w3 long, size long, sketch binary")
    for cell in (7, 256):
        monkeypatch.setattr(S, "CELL", cell)
        got = [(r.a, r.b) for r in S.all_candidates(rows, samples, 3, 0.8).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("pairs,seed", [(60, 1), (600, 5), (600, 6)])
def test_pairs_on_one_template(spark, pairs, seed):
    """A crowd of texts that resemble one another, but link only two by two: at least 95 % of the links are found, and none is made up."""
    dice = random.Random(seed)
    template = [f"t{seed}w{dice.randrange(10**6)}" for _ in range(200)]

    def changed(base, n, tag):
        out = list(base)
        for i in dice.sample(range(200), n):
            out[i] = f"{tag}{i}"
        return out

    texts = {}
    for p in range(pairs):
        base = changed(template, 2, f"p{p}b")
        texts |= {2 * p: " ".join(changed(base, 2, f"p{p}l")), 2 * p + 1: " ".join(changed(base, 2, f"p{p}r"))}
    sets = {i: set(S.shingle_set(t.encode(), 5).tolist()) for i, t in texts.items()}
    close = [p for p in range(pairs) if len(sets[2 * p] & sets[2 * p + 1]) >= 0.8 * len(sets[2 * p] | sets[2 * p + 1])]
    kept = {r.doc_id for r in S.deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    apart = [p for p in close if {2 * p, 2 * p + 1} <= kept]
    assert len(close) > 0.9 * pairs and len(apart) <= 0.05 * len(close)
    if pairs == 60:
        assert kept >= {i for i, low in linked(texts).items() if i == low}

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from helpers import rows_of

from corpusloom.llm import trie as T
from corpusloom.llm.queries import ORACLES, QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, k1 long, depth long, low string"


def brute(rows, rebuild=True):
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    paths = dict(own)
    for c, v in own.items() if rebuild else ():
        h = zlib.crc32(str(c).encode()) % 6
        paths[c] = own.get(100 * int(c / 100), [])[:h] + v[h:]
    nodes, kids, sums = defaultdict(list), defaultdict(list), {}
    for c, v in paths.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    for k in nodes:
        if k:
            kids[k[:-1]].append(k)
    for k in sorted(nodes, key=len, reverse=True):
        sums[k] = (sum(sums[x][0] for x in kids[k]) or 1, sum(sums[x][1] for x in kids[k]) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0))
    out = []
    for k, m in nodes.items():
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(k))))
        out.append((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), len(kids[k]), *sums[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_equals_sql_and_brute_force(spark, sf, duck):
    ours = QUERIES["op12_prefix_trie"](spark, sf)
    assert rows_of(ours.toPandas()) == rows_of(duck.execute(ORACLES["op12_prefix_trie"]).df())
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert found(ours) == brute(rows)


@pytest.mark.parametrize("block,unroll,pack", [(4096, 8192, 1 << 16), (2, 2, 3), (3, 8192, 1)])
def test_random_tables(spark, monkeypatch, block, unroll, pack):
    """Nulls in all columns, ties, repeated rows, negative ids, and blocks so small that conversations cross them."""
    for name, value in (("BLOCK", block), ("UNROLL", unroll), ("PACK_BYTES", pack)):
        monkeypatch.setattr(T, name, value)
    dice = random.Random(block)
    rows = [(dice.choice([None, 0, 1, 2, 100, 101, -5, -100, 205, 200]), dice.choice([None, 0, 1, 2, 3, 5000, 9000, -4]), dice.choice([None, "u", "a"]), dice.choice([None, "", "x", "yÿ"]), 1, 2, "z") for _ in range(150)]
    table = spark.createDataFrame(rows, SCHEMA)
    assert found(T.trie(*T.rebuilt(T.turns(table)))) == brute(rows)
    assert found(T.prefix_trie(table)) == brute(rows, rebuild=False)


def test_shapes(spark):
    """A group of copies, a long unary path, a conversation without turns after rebuilding, one text per branch."""
    copies = [(c, t, "u", f"turn {t}") for c in range(1, 40) for t in range(6)]
    comb = [(1000 + c, t, "a", f"{t}" if t < c else f"{c} leaves") for c in range(12) for t in range(c + 1)]
    long = [(5000, t, "u", "x" * (t % 7)) for t in range(500)]
    for rows in (copies, comb, long, copies + comb + long, [(7, 0, "u", "alone")], [(c, 0, "u", "short") for c in (0, 3, 700, 701, 702)]):
        table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
        assert found(T.trie(*T.rebuilt(T.turns(table)))) == brute(rows)


def test_empty_tables(spark):
    table = spark.createDataFrame([(None, 1, "u", "no conversation")], "conv_id long, turn long, role string, text string")
    assert not found(T.prefix_trie(table)) and not found(T.trie(*T.rebuilt(T.turns(table.limit(0)))))

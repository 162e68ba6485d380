import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from corpusloom.llm import bytebpe as B
from corpusloom.llm.queries import QUERIES

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query_equals_library(spark, sf, library):
    got = {r.doc_id: r for r in QUERIES["op11_byte_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text = r.text or ""
        ids = library.encode_ordinary(text)
        one = got.pop(r.doc_id)
        assert one.n_tokens == len(ids)
        assert one.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert one.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert not got


@pytest.mark.parametrize("signs", ["aab   bc\n\t'sé日🙂1-_", "abcdeinorst", "eth ", " \n  \x1c\x85a", "'’sdtrvlm ", "<|endoftx>", "퟿�\U0010ffff\x00"])
def test_random_texts(library, signs):
    own, dice = B.Encoder(B.load(PATH), P.PATTERN), random.Random(len(signs))
    for n in (*range(40), *(dice.randint(0, 300) for _ in range(400))):
        text = "".join(dice.choice(signs) for _ in range(n))
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_caches_and_other_patterns(library, monkeypatch):
    """Forgetting changes nothing; without the rule about spaces neither; nor when long texts are taken in small parts."""
    dice = random.Random(5)
    text = " ".join("".join(dice.choice("etaoin.,\n ") for _ in range(dice.randint(0, 9))) for _ in range(3000))
    for name, value in (("CACHE_BYTES", 3), ("MATCHES", 7), ("LONG", 50)):
        monkeypatch.setattr(B, name, value)
    texts = [text[a : a + dice.randint(0, 200)] for a in range(0, len(text), 97)]
    for pattern in (P.PATTERN, f"(?:{P.PATTERN})"):
        own = B.Encoder(B.load(PATH), pattern)
        for a in range(0, len(texts), 5):
            assert [x.tolist() for x in own.encode_all(texts[a : a + 5])] == [library.encode_ordinary(t) for t in texts[a : a + 5]]


@pytest.mark.parametrize("text", ["a" * 200_000, " " * 50_001, "ab" * 70_000, "日" * 30_000])
def test_very_long_matches(library, text):
    assert B.Encoder(B.load(PATH), P.PATTERN).encode(text).tolist() == library.encode_ordinary(text)


def test_edges(spark, edge, none, library):
    tokens = B.load(PATH)
    rows = B.encode(edge, tokens, P.PATTERN, ["doc_id", "n_chars", "text"]).collect()
    assert len(rows) == edge.count()
    assert all(r.ids == library.encode_ordinary(r.text or "") for r in rows)
    back = B.decode(B.encode(edge, tokens, P.PATTERN, ["doc_id", "text"]), tokens, ["doc_id", "text"]).collect()
    assert all(r.decoded == (r.text or "").encode() for r in back) and len(back) == len(rows)
    assert B.encode(none, tokens, P.PATTERN, ["doc_id"]).collect() == [] == B.decode(B.encode(none, tokens, P.PATTERN, ["doc_id"]), tokens, ["doc_id"]).collect()
    assert B.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>"), tokens, ["doc_id"]).collect() == [(1, b""), (2, b"")]
    broken = spark.sql("SELECT 1L AS doc_id, cast(x'61ff62' AS string) AS text")
    assert B.encode(broken, tokens, P.PATTERN, ["doc_id"]).first().ids == library.encode_ordinary("a�b")


def test_batches(library):
    """Texts of one call share their words."""
    own, dice = B.Encoder(B.load(PATH), P.PATTERN), random.Random(9)
    for _ in range(200):
        texts = [" ".join("".join(dice.choice("ab's’.é1\n") for _ in range(dice.randint(1, 6))) for _ in range(dice.randint(0, 30))) for _ in range(dice.randint(1, 9))]
        assert [x.tolist() for x in own.encode_all(texts)] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("bad", [50_256, -1])
def test_unknown_ids(spark, bad):
    with pytest.raises(Exception, match="not in the vocabulary"):
        B.decode(spark.createDataFrame([(1, [bad])], "doc_id long, ids array<int>"), B.load(PATH), ["doc_id"]).collect()

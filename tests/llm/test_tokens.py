"""Round trips and library equality: SentencePiece and token files."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpusloom.llm import sentpiece as S
from corpusloom.llm import tokenbin as T
from corpusloom.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BPE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    odd = ["", None, " ", "   ", "a  b", " lead", "trail ", "日本語 と 漢字", "tab\tand\nline\n\n x", "\x00\x01\x02 a\x01b.c", "🙂 x🙂", "the" * 60, "thering" * 30 + " " + "a" * 300, "word,word. (x)"]
    return odd + ["".join(rng.choice("abtheinr.,!  \n日é\x01") for _ in range(rng.randint(0, 60))) for _ in range(120)]


@pytest.mark.parametrize("more", [{}, {"max_units": 0}, {"fold_limit": 3}])
def test_ids_equal_the_library(spark, texts, more):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = S.load(PIECES)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = S.encode(docs, vocab, ["doc_id"], **more)
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows.collect()}
    assert got == {i: library.encode(t or "") for i, t in enumerate(texts)}
    assert all(r.round_trip for r in rows.collect())
    if not more:
        back = {r.doc_id: r.text for r in S.decode(rows, vocab, ["doc_id"]).collect()}
        assert back == {i: t or "" for i, t in enumerate(texts)}


def test_viterbi_fold(spark):
    """A unigram vocabulary: the fold's path has the best score of all."""
    pieces = {"▁": (3, -2.0), "▁a": (4, -1.5), "a": (5, -2.5), "b": (6, -2.0), "ab": (7, -2.9), "▁ab": (8, -3.6), "ba": (9, -3.1), "aba": (10, -4.4)}
    vocab = S.Vocabulary(pieces, 100, 0, 3, False, True, True)
    words = ["▁" + "".join(random.Random(i).choice("abx") for _ in range(i % 9)) for i in range(60)]
    units = spark.createDataFrame([(w,) for w in sorted(set(words))], "unit string")

    def best(unit):
        scores = [0.0] + [-1e9] * len(unit)
        for j in range(1, len(unit) + 1):
            for i in range(j):
                p = unit[i:j]
                s = pieces[p][1] if p in pieces else -4.4 - 10.0 if len(p) == 1 else None
                if s is not None:
                    scores[j] = max(scores[j], scores[i] + s)
        return scores[-1]

    for r in S.encode_units(units, vocab).collect():
        names = {i: (p, s) for p, (i, s) in pieces.items()}
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert abs(sum(names[i][1] if i in names else -14.4 for i in ids) - best(r.unit)) < 1e-9
        assert abs(sum(vocab.pieces.get(r.unit[a:b], (0, -14.4))[1] for a, b in zip([0, *S.viterbi_cuts(r.unit, vocab)], S.viterbi_cuts(r.unit, vocab))) - best(r.unit)) < 1e-9


@pytest.mark.parametrize("most", [0, 40])
def test_texts_stay_where_they_are(spark, texts, most):
    """With more distinct units than the table takes: no exchange of texts or of their units, and the same ids."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = S.load(PIECES)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = S.encode(docs, vocab, ["doc_id"], max_units=most)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: (np.frombuffer(r.ids, "<u4").tolist(), r.round_trip) for r in rows.collect()}
    assert got == {i + more: (library.encode(t or ""), True) for i, t in enumerate(texts) for more in (0, 1000)}


def test_table_takes_the_most_frequent(spark):
    coded = spark.createDataFrame([(f"u{i}", i, b"") for i in range(2, 300)], "unit string, n long, ids binary")
    for most in (0, 1, 10, 100, 297):
        kept = sorted(r.n for r in S.most_frequent(coded, most).collect())
        assert len(kept) <= most and kept == list(range(300 - len(kept), 300)) and len(kept) >= 0.8 * most - 50
    assert S.most_frequent(coded, 298).count() == 298


def test_other_unit_of_the_same_hash(spark):
    """A table whose entry for a unit holds the ids of another: found by decoding, and the unit is folded on its own."""
    import pyarrow as pa

    vocab = S.load(PIECES)
    packed = S.Packed(S.hashes_of(pa.array(["▁the"])), np.array([0, 1], np.uint32), np.array([vocab.pieces["▁of"][0]], "<u2"))
    named = spark.createDataFrame([(1, "of the of the")], "doc_id long, _sp_text string")
    row = S.encode_with(packed, named, vocab, ["doc_id"], 48).first()
    assert np.frombuffer(row.ids, "<u4").tolist() == [vocab.pieces[p][0] for p in ("▁of", "▁the", "▁of", "▁the")] and row.round_trip


def test_both_lattices_agree(spark, texts):
    """The edges that a block of texts makes for its own units are those of Spark's lattice, for both kinds of vocabulary."""
    import pyarrow as pa

    bpe = S.load(PIECES)
    unigram = S.Vocabulary({"▁": (3, -2.0), "▁a": (4, -1.5), "a": (5, -2.5), "ab": (7, -2.9), "éa": (8, -3.6), "aba": (10, -4.4)}, 100, 0, 3, False, True, True)
    for vocab in (bpe, unigram):
        units = sorted(set(S.units_of(pa.array(texts + ["aba éab a" * 3]), vocab)[0].to_pylist()))
        frame = spark.createDataFrame([(u,) for u in units], "unit string")
        edges = S.bpe_lattice(frame, vocab, 20) if vocab.bpe else S.lattice(frame, S.piece_table(spark, vocab), vocab.longest, 1, 20)
        want = {r.unit: sorted(tuple(e) for e in r.edges) for r in edges.collect()}
        got = S.block_lattice(pa.array(units), vocab, S.piece_columns(vocab), 20).to_pylist()
        assert any(got) and {u: sorted(tuple(e.values()) for e in x) for u, x in zip(units, got)} == want
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts) if t], "doc_id long, text string")
        ids = [{r.doc_id: bytes(r.ids) for r in S.encode(docs, vocab, ["doc_id"], max_units=n).collect()} for n in (0, 1000)]
        assert ids[0] == ids[1]


def test_sentencepiece_edges(edge, none):
    vocab = S.load(PIECES)
    rows = S.encode(edge, vocab, ["doc_id", "body"]).collect()
    assert len(rows) == edge.count() and all(r.round_trip for r in rows)
    assert {len(r.ids) for r in rows if r.doc_id in (1, 2)} == {0}
    assert S.encode(none, vocab, ["doc_id"]).count() == 0


def test_sentencepiece_query(spark, sf):
    rows = QUERIES["op8_sentencepiece"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count() and all(r.round_trip for r in rows)


# ------------------------------------------------------------ token files
def test_encoder_equals_the_library():
    encoder, library = T.Encoder(BPE), Tokenizer.from_file(BPE)
    rng = random.Random(3)
    special = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>b  c", "x <|endoftext|", "<|endoftext|><|endoftext|>", "", " ", "x"]
    assert [x.tolist() for x in encoder.encode_all(special)] == [library.encode(x, add_special_tokens=False).ids for x in special]
    assert encoder.encode("hello <|endoftext|> world").tolist() == [31373, 220, 50256, 995]
    for letters in ("abc  \t\n\r\x0b\x1c\x85\xa0 　'sdtlrevm019²½Ⅷé日_-!?", "ab   \n\n'sdt.,!0²é日_-", "ab .,\n"):
        some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
        for text, ids in zip(some, encoder.encode_all(some)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_elias_fano():
    rng = random.Random(5)
    for n in (1, 2, 63, 64, 65, 700):
        ends = np.cumsum([rng.choice([0, 1, 3, 1000]) for _ in range(n)])
        low_bits, low, high = T.elias_fano(ends, int(ends[-1]))
        bounds = T.Boundaries(n, low_bits, low, high)
        assert [bounds.select(i) for i in range(n)] == ends.tolist() == bounds.span(0, n).tolist()
        for first in range(0, n, 37):
            last = min(n, first + rng.randint(0, 200))
            assert bounds.span(first, last).tolist() == ends[first:last].tolist()
        assert 8 * (len(low) + len(high)) <= n * (2 + max(0, np.log2(max(1, ends[-1] / n)) + 1)) + 256
    with pytest.raises(IndexError):
        bounds.select(700)


def test_files_give_back_all_ids(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(3)
    files = T.write(docs, str(tmp_path / "f"), BPE, 2).collect()
    library = Tokenizer.from_file(BPE)
    texts = {r.doc_id: r.text for r in docs.collect()}
    start, want = 0, {}
    for i in sorted(texts):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.read(spark, str(tmp_path / "f"), files).collect()} == want
    first = T.TokenFile.of((tmp_path / "f" / files[0]["name"]).read_bytes())
    assert first.document(1).tolist()[-1] == 2
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in QUERIES["op10_token_files"](spark, sf).collect()} == want
    assert not [p for p in (tmp_path / "f").iterdir() if p.name.startswith(".part")]


def test_rows_of_one_id_are_dealt_out(spark, tmp_path):
    """A doc_id that holds most rows does not end up in one file."""
    docs = spark.createDataFrame([(7, f"text {i}") for i in range(400)] + [(i, "x") for i in range(5)], "doc_id long, text string").repartition(4)
    files = T.write(docs, str(tmp_path / "o"), BPE, 2).collect()
    assert len(files) > 4 and max(f["n_docs"] for f in files) < 200
    rows = sorted(T.read(spark, str(tmp_path / "o"), files).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [0, 1, 2, 3, 4] + [7] * 400


def test_file_edges(edge, none, tmp_path):
    rows = sorted(T.export(edge, BPE, 2, folder=str(tmp_path / "e")).collect(), key=lambda r: r.start)
    assert len(rows) == edge.count()
    assert [r.doc_id for r in rows[:3]] == [None, None, 1]
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:]))
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert T.export(none, BPE, 2, folder=str(tmp_path / "n")).count() == 0
    assert T.export(edge, BPE, 2, width=4, folder=str(tmp_path / "w")).count() == edge.count()

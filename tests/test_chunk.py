import random

import pytest

from corpusloom.functions.tokens import Tiktoken
from corpusloom.operators.chunk import ChunkConfig, chunks, pack_units, pack_words


def slow(tokens, size, overlap):
    """A literal buffer."""
    out, buffer = [], []
    for i, n in enumerate(tokens):
        if buffer and sum(tokens[j] for j in buffer) + n > size:
            out.append((buffer[0], buffer[-1]))
            if overlap <= 0:
                buffer = []
            else:
                tail, held = [], 0
                for j in reversed(buffer):
                    tail.insert(0, j)
                    held += tokens[j]
                    if held >= overlap:
                        break
                buffer = tail
        buffer.append(i)
    if buffer:
        out.append((buffer[0], buffer[-1]))
    return out


def test_packing_equals_a_literal_buffer():
    rng = random.Random(5)
    for _ in range(4000):
        tokens = [rng.choice([0, 1, 2, 5, 9, 30]) for _ in range(rng.randint(0, 25))]
        size, overlap = rng.randint(1, 40), rng.randint(0, 12)
        assert pack_units(tokens, size, overlap) == slow(tokens, size, overlap), (tokens, size, overlap)


def test_words():
    assert pack_words([1, 1, 1, 1], 4) == [(0, 1), (2, 3)]
    assert pack_words([1, 9, 1], 4) == [(0, 0), (1, 1), (2, 2)]
    assert pack_words([4, 1], 4) == [(0, 0), (1, 1)]
    assert pack_words([], 4) == []


def test_config():
    assert ChunkConfig(400, 0.15).overlap_tokens == 60
    assert ChunkConfig(100, 0.5).overlap_tokens == 20
    assert ChunkConfig(100, 0.0).overlap_tokens == 10
    assert ChunkConfig(6, 0.15).overlap_tokens == 0
    with pytest.raises(ValueError):
        ChunkConfig(0)


def run(spark, text, size=8, **more):
    rows = chunks(spark.createDataFrame([("d", text)], "doc_id string, text string"), ChunkConfig(size, 0.15), **more).orderBy("chunk_index").collect()
    return [(r.text, r.page, r.section) for r in rows]


def test_context_of_the_closing_unit(spark):
    """A flushed chunk carries the page and section of the unit that closed it."""
    got = run(spark, "[PAGE:1]\none two three\n\n# A\nfour five\n\n[PAGE:2]\nsix seven eight nine\n\n# B\nten", 9)
    assert [x[1:] for x in got] == [(1, "A"), (2, "A"), (2, "B"), (2, "B")]
    assert got[0][0] == "one two three"


def test_empty_and_missing_texts_give_one_empty_chunk(spark):
    assert run(spark, "") == [("", None, None)]
    assert run(spark, None) == [("", None, None)]


def test_header_across_units_counts_once_nothing_is_known(spark):
    """A bare ## takes the next text as its section only through the joined chunk."""
    got = run(spark, "##\n\nplain words\n\nmore words here and there again now", 8)
    assert got[0][2] == "plain words"
    assert all(x[2] == "plain words" for x in got)


def test_marker_in_packed_words_is_lost(spark):
    got = run(spark, "[PAGE:3]\n" + " ".join(["w"] * 40), 8)
    assert got[0][1] is None and "[PAGE:3]" in got[0][0]


def test_sentences_are_joined_by_blank_lines(spark):
    assert run(spark, "One two three. Four five six. Seven eight nine ten.", 9)[0][0] == "One two three.\n\nFour five six."


def test_ids_and_carried_columns(spark):
    docs = spark.createDataFrame([(7, "a", 3, "t")], "doc_id long, text string, source_page_count int, source_title string")
    row = chunks(docs, carry=["source_page_count", "source_title"]).first()
    assert (row.chunk_id, row.source_page_count, row.source_title, row.token_estimate, row.chunk_char_count) == ("7::chunk-0000", 3, "t", 1, 1)


def test_other_tokenizer(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    counter = Tiktoken(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    docs = spark.createDataFrame([("d", "hello world. " * 30)], "doc_id string, text string")
    assert chunks(docs, ChunkConfig(20), tokens=counter).count() > 3


def test_text_without_breaks(spark):
    got = run(spark, "word " * 3000, 50)
    assert sum(len(x[0].split()) for x in got) >= 3000


def test_token_counts_and_strip_scan_once(spark):
    """No list of matches for a count, no pattern for the ends of a text; results as in Python."""
    import re
    import unicodedata

    from pyspark.sql import functions as F

    from corpusloom.functions import text as T

    spaces = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
    rows = ["", " ", "a  b,c", spaces + "x" + spaces + "y_1" + spaces, "\U0001f600\U0001f600 é2 – [PAGE:3]", "a.b\n\n#c", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    made = df.select("t", T.estimate_tokens(F.col("t")).alias("n"), T.strip(F.col("t")).alias("s"))
    assert "regexp_extract_all" not in (plan := made._jdf.queryExecution().optimizedPlan().toString()) and "regexp_count" not in plan and "\\z" not in plan
    kind = lambda c: "w" if c == "_" or unicodedata.category(c)[0] in "LN" else " " if c.isspace() else "."
    for r in made.collect():
        assert r.s == (None if r.t is None else r.t.strip())
        assert r.n == max(1, len(re.findall(r"w+|\.", "".join(map(kind, r.t or "")))))

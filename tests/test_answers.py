import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import answer as A
from corpusloom.operators import retrieve as R
from corpusloom.operators.embed import EmbeddingError, dimensions, embed_hashed, embed_with, model_path, with_retry
from corpusloom.sources import clients as C


def test_prompts_and_answers(spark):
    hits = spark.createDataFrame([(1, 2, "b", None, None, None), (1, 1, "a", "p.md", 3, "S")], "query_id int, rank int, text string, relative_path string, page int, section string")
    asked = spark.createDataFrame([(1, "q?"), (2, "r?")], "query_id int, question string")
    rows = {r.query_id: r for r in A.answer(A.contexts(hits, asked), C.EchoClient).collect()}
    assert rows[1].context == "[1] (p.md | page 3 | section: S)\na\n\n---\n\n[2] (unknown source)\nb"
    assert rows[1].system_prompt == A.SYSTEM_PROMPT.replace("{context}", rows[1].context)
    assert (rows[1].answer, rows[2].answer) == ("q?", A.NO_CONTEXT)


def test_top_k(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 0.0])], "id int, embedding array<float>")
    asked = spark.createDataFrame([(9, [2.0, 0.0]), (8, [0.0, 1.0])], "query_id int, embedding array<float>")
    got = [(r.query_id, r.rank, r.id, round(r.distance, 6)) for r in R.top_k(rows, asked, 2).orderBy("query_id", "rank").collect()]
    assert got == [(8, 1, 2, 0.0), (8, 2, 1, 1.0), (9, 1, 1, 0.0), (9, 2, 3, 0.0)]
    assert sorted((r.query_id, r.rank, r.id) for r in R.top_k(rows, asked, 2, max_queries=1).collect()) == sorted(x[:3] for x in got)
    assert R.top_k(rows, asked, 2, F.col("id") == 2).count() == 2
    assert (R.effective_k(0), R.effective_k(None), R.effective_k(3)) == (5, 5, 3)


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, "x", 0.1), (1, 2, "a", 0.4), (2, 1, "b", 1.5)], "query_id int, rank int, id string, distance double")
    expected = spark.createDataFrame([(1, "keyword", "a"), (2, "keyword", "b"), (3, "factual", "c")], "query_id int, query_type string, expected_id string")
    result = R.evaluate(hits, expected)
    assert {r.query_id: (r.found_at_rank, r.passed) for r in result.collect()} == {1: (2, True), 2: (1, False), 3: (None, False)}
    assert {r.query_type: r.hit_rate for r in R.pass_rates(result).collect()} == {"keyword": 0.5, "factual": 0.0}


def test_snippets(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(lambda t: R.snippet(t, 10), " ab\ncd ") == "ab cd"
    assert one(lambda t: R.snippet(t, 10), "abcdef hijkl") == "abcdef..."
    assert json.loads(one(lambda t: R.sources_json(t, F.struct(F.lit(1).alias("a")), F.lit(0.5)), "x" * 201))["text"] == "x" * 200 + "..."


def test_retry_and_models(tmp_path, monkeypatch):
    calls, pauses = [], []

    def flaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError("busy")
        return [[1.0]] * len(texts)

    assert with_retry(flaky, ["a"], sleep=pauses.append) == [[1.0]] and pauses == [1.0, 2.0]
    assert with_retry(flaky, []) == []
    with pytest.raises(EmbeddingError):
        with_retry(lambda _: 1 / 0, ["a"], sleep=lambda _: None)
    assert (dimensions("all-MiniLM-L6-v2"), dimensions("other")) == (384, 384)
    assert model_path("some/model", str(tmp_path)) == "some/model"
    (tmp_path / "some_model").mkdir()
    assert model_path("some/model", str(tmp_path)) == str(tmp_path / "some_model")


def test_embedders(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "text string")

    def load():
        def model(texts):
            if "" in texts:
                raise ValueError("empty")
            return [[float(len(t))] for t in texts]

        return model

    rows = embed_with(df, load, batch=1, delay=0.0).collect()
    assert [(r.embedding, r.embedding_error is None) for r in rows] == [([3.0], True), (None, False), (None, False)]
    assert [sum(r.embedding) for r in embed_hashed(df, size=16).collect()][1:] == [0.0, 0.0]


def test_clients(monkeypatch):
    signed = C.SignedClient("k", "s", "http://h/")
    body = signed.body([C.Message("user", "x")], 0, 0.0)
    assert (body["max_tokens"], body["temperature"], body["n"], body["stream"]) == (1000, 0.0, 1, False)
    wanted = base64.b64encode(hmac.new(b"s", f"kid12.5{json.dumps(body)}".encode(), hashlib.sha256).digest()).decode()
    assert signed.signature(body, 12.5, "id") == wanted
    monkeypatch.setattr(signed, "post", lambda url, headers, body: {"choices": [{"message": {"content": "hi"}}], "model": "m"})
    assert signed.generate("q", "sys") == "hi"
    monkeypatch.setattr(signed, "post", lambda url, headers, body: {"choices": []})
    with pytest.raises(C.ClientError):
        signed.generate("q")
    ollama = C.OllamaClient("http://h")
    assert ollama.body([C.Message("user", "x")], 7)["options"] == {"num_predict": 7, "temperature": 0.7}
    monkeypatch.setattr(ollama, "post", lambda *a: {"message": {"content": "yo"}, "eval_count": 2, "prompt_eval_count": 3})
    assert ollama.chat([C.Message("user", "x")]).usage["total_tokens"] == 5

    class Fake:
        def __init__(self):
            self.messages = self

        def create(self, **kwargs):
            self.kwargs = kwargs
            part = type("P", (), {"text": "ok"})
            return type("R", (), {"content": [part], "model": "m", "usage": None})

    fake = Fake()
    assert C.AnthropicClient("k", "m", fake).generate("q", "sys") == "ok"
    assert fake.kwargs["system"] == "sys" and fake.kwargs["messages"] == [{"role": "user", "content": "q"}]
    assert isinstance(C.create("echo"), C.Client)
    for name in ("LLM_API_KEY", "OPENAI_API_KEY", "ANTHROPIC_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    for name in ("nope", "openai", "custom", "anthropic"):
        with pytest.raises(C.ProviderError):
            C.create(name)
    monkeypatch.setenv("LLM_PROVIDER", " ECHO ")
    assert C.create().generate("a") == "a"


def test_stream(spark, tmp_path):
    from corpusloom.plans.ingest import read_chunks
    from corpusloom.streaming.ingest import stream_chunks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hello there.")

    def go():
        stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        return sorted(r.text for r in read_chunks(spark, str(tmp_path / "out")).collect())

    assert go() == ["Hello there."]
    (tmp_path / "in" / "b.md").write_text("More.")
    assert go() == ["Hello there.", "More."]


def test_distances_round_as_in_python(spark):
    """Values halfway between two numbers of four places, whose binary value lies above or below."""
    values = [i / 1e6 + 0.00005 for i in range(0, 2_000_000, 1900)] + [0.00035, 0.12345, 0.99995, 0.0, 0.00005, 0.00004, 0.00007, -0.00007, -0.12345, 2.0, 1234.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    line = R.source_line(F.lit(1), F.lit("t"), F.lit("p"), F.lit(None).cast("int"), F.col("x"))
    hit = R.hit_text(F.lit(1), F.lit("t"), {}, F.col("x"))
    for r in df.select("x", line.alias("line"), hit.alias("hit")).collect():
        assert f"(dist: {r.x:.4f})" in r.line and f" | distance={r.x:.4f}\n" in r.hit

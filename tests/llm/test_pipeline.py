import numpy as np

from corpusloom.llm import simhash


def test_stages_against_brute_force(spark, sf):
    import corpus_pipeline as P
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, [docs]
    for _, stage in P.STAGES[:-1]:
        held.append(spark.createDataFrame(stage(spark, held[-1], sf).collect(), docs.schema))
        assert held[-1].columns == columns
    texts = [{r.doc_id: r.text for r in d.collect()} for d in held]
    assert set(texts[1]) == set(texts[0])  # every document here has a language
    last: dict = {}
    for i, t in texts[1].items():
        last[t] = max(i, last.get(t, i))
    assert set(texts[2]) == set(last.values())
    forest, names = simhash.Forest(), sorted(texts[2])
    sets = {i: set(simhash.shingle_set(texts[2][i].encode(), 5).tolist()) for i in names}
    for n, i in enumerate(names):
        for j in names[:n]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                forest.union(i, j)
    want = {forest.find(i) for i in names}
    assert set(texts[3]) >= want  # sampled shards may miss a link, and never add one
    assert len(texts[3]) <= len(want) + 2
    changed = {i for i in texts[4] if texts[4][i] != texts[3][i]}
    assert changed and all(len(texts[4][i]) < len(texts[3][i]) for i in changed)
    rows = P.STAGES[-1][1](spark, held[-1], sf).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(P.PIECES))
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == {i: library.encode(t) for i, t in texts[4].items()}
    assert all(r.round_trip for r in rows)


def test_edges(spark, edge, none, sf):
    """What is left of the edge frame after each stage; empty tables stay empty."""
    import corpus_pipeline as P

    for frame in (edge, none):
        docs, left = frame, []
        for _, stage in P.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == frame.columns
            docs = spark.createDataFrame(docs.collect(), frame.schema)
            left.append(sorted((r.doc_id if r.doc_id is not None else -1) for r in docs.collect()))
        out = P.STAGES[-1][1](spark, docs, sf).collect()
        if frame is none:
            assert left == [[]] * 4 and not out
            continue
        assert not {1, 2, 3} & set(left[0])  # null, empty and blank texts have no language
        assert len(left[1]) == len(set(left[1])) and 5 not in left[1] and (6 in left[1]) == (6 in left[0])
        assert left[1] == left[2] == left[3] == sorted((r.doc_id if r.doc_id is not None else -1) for r in out)
        assert all(r.round_trip and r.n_tokens > 0 for r in out)


def test_encode_keeps_texts_in_place(spark, sf, monkeypatch):
    """The last stage with more distinct units than its table takes: no exchange of texts, the same rows."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, P.encode(spark, docs, sf).collect()))
    monkeypatch.setattr(P.sentpiece.encode, "__defaults__", (100, P.sentpiece.FOLD_LIMIT))
    rows = P.encode(spark, docs, sf)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, rows.collect())) == want


def test_languages_of_edges(spark, edge, sf):
    """With languages to learn from, all texts with letters stay."""
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").where("doc_id < 100")
    more = edge.select((1000 + edge.doc_id).alias("doc_id"), "text", "lang", "source", "n_chars")
    kept = [r.doc_id for r in P.STAGES[0][1](spark, docs.union(more), sf).collect()]
    assert {1004, 1005, 1006, 1007, 1009, 1010, 1012} <= set(kept) and not {1001, 1002, 1003} & set(kept) and kept.count(None) == 1

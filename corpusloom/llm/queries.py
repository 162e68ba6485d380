"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from corpusloom.llm import bytebpe, decontam, exact, html, langid, lm, sentpiece, simhash, substring, tokenbin, toxicity, trie
from corpusloom.llm.common import materialize, remainder, table, text_bytes


def op1_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    split = remainder("doc_id", 3)
    model = toxicity.fit(docs.where(split != 1), labels.where(split != 1))
    scored = toxicity.score(docs.withColumn("held_out", split == 1), model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    split = remainder("doc_id", 4)
    pieces = langid.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    langs, probs = langid.fit(docs.where(split != 2), pieces)
    return langid.predict(docs.withColumn("held_out", split == 2), pieces, langs, probs, ["doc_id", "held_out"])


def op3_lm_score(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    split = remainder("doc_id", 7)
    model = lm.train(docs.where(split != 2))
    return lm.score(docs.select("doc_id", (split == 2).alias("held_out"), text_bytes().alias("body")), model)


def op4_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, radius=4)
    return found.select("doc_id", "fingerprint", "component_id")


def op5_decontaminate(spark, sf_dir):
    return decontam.digest(decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op6_substrings(spark, sf_dir):
    return substring.passages(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark, sf_dir):
    vocab = sentpiece.load(public_tokenizers.path("piece_bpe_32k.model"))
    encoded = sentpiece.encode(table(spark, sf_dir, "documents"), vocab, ["doc_id"])
    return encoded.select("doc_id", F.expr("cast(length(ids) div 4 AS bigint)").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "round_trip")


def op9_html_text(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


def op10_token_files(spark, sf_dir):
    return tokenbin.export(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op11_byte_bpe(spark, sf_dir):
    tokens = bytebpe.load(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), tokens, public_tokenizers.PATTERN, ["doc_id"])
    said = encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(bytebpe.decimals(F.col("ids")), 256).alias("ids_sha256"), "ids")
    decoded = bytebpe.decode(said, tokens, ["doc_id", "n_tokens", "ids_sha256"])
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_prefix_trie(spark, sf_dir):
    rows = materialize(trie.turns(table(spark, sf_dir, "conversations")), "trie-turns")
    return trie.trie(*trie.rebuilt(rows, group=100, most=6))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_language_id": op2_language_id,
    "op3_lm_score": op3_lm_score,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_substrings": op6_substrings,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_text": op9_html_text,
    "op10_token_files": op10_token_files,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_prefix_trie": op12_prefix_trie,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '%s', '%s'), '[0-9a-z\x{80}-\x{10FFFF}]+')" % (UPPER, LOWER)

#: crc32 of a text of plain signs, bit by bit: DuckDB has no such function.
CRC32 = "xor(4294967295::BIGINT, list_reduce(list_transform(string_split({}, ''), lambda s: ascii(s)::BIGINT), lambda a, b: list_reduce(range(8), lambda v, _: xor(v >> 1, (v & 1) * 3988292384), xor(a, b)), 4294967295::BIGINT))"

ORACLES = {
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op5_decontaminate": f"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
        win AS (
            SELECT item_id, array_to_string(w[i : i + 9], ' ') AS s, least(len(w), 10) AS n
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM win),
        pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
        hit AS (
            SELECT p.doc_id, p.i, z.n, win.item_id
            FROM pos p JOIN sizes z ON p.i + z.n - 1 <= len(p.w)
            JOIN win ON win.n = z.n AND win.s = array_to_string(p.w[p.i : p.i + z.n - 1], ' ')),
        words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS i FROM hit) GROUP BY doc_id),
        items AS (
            SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256
            FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS l
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
        h AS (SELECT c, l, {CRC32.format("c::VARCHAR")} % 6 AS h, c - c % 100 AS b FROM t),
        m AS (SELECT h.c, list_concat(coalesce(o.l[1 : h.h], []), h.l[h.h + 1 :]) AS s FROM h LEFT JOIN t o ON o.c = h.b),
        p AS (SELECT c, d, s[1 : d] AS k, len(s) = d AS last FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM m)),
        n AS (SELECT k, d, min(c) AS low, count(*) AS n, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '') AS ends FROM p GROUP BY k, d),
        kids AS (SELECT k[1 : d - 1] AS k, count(*) AS kids FROM n WHERE d > 0 GROUP BY 1),
        f AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN d > 0 THEN (n - 1) * len(n.k[d].x) ELSE 0 END AS own FROM n LEFT JOIN kids ON kids.k = n.k),
        up AS (SELECT k[1 : g] AS k, count(*) FILTER (kids = 0) AS leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS g FROM f) GROUP BY 1)
        SELECT f.low AS conv_id, f.d AS depth, o.low AS parent_conv_id, f.n AS n_convs, f.kids AS n_children, up.leaves AS n_leaves, up.saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
        FROM f JOIN up ON up.k = f.k LEFT JOIN f o ON f.d > 0 AND o.k = f.k[1 : f.d - 1]""",
}

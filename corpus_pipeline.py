"""Corpus pipeline: five stages, each the production operator over all documents its predecessor kept.

1. language: documents whose language cannot be told (no letters, or no
   evidence for one language over the others) go.
2. exact: of equal texts one document stays.
3. near: of each group of texts with a SimHash similarity of 0.8 or more (five-word
   shingles) the smallest doc_id stays.
4. benchmark: passages of benchmark items are cut out of texts; documents that
   consist mostly of such passages go.
5. encode: SentencePiece ids of every text, with a decoding round trip.

All but the last return the columns of documents.

Cases: a null, empty or letterless text has no language and goes in the first stage;
documents that repeat a text are one group there, whatever their ids, and of rows
that repeat id and text one stays; a null doc_id is smaller than any other in the
exact stage, so it stays only where no other id has the text, and comes last in the near
stage; a text whose evidence is the same for all languages goes with the first stage; extra
columns are carried through and their names never matter; an empty table gives
empty results in every stage; texts of any length are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontam, exact, langid, sentpiece, simhash
from corpusloom.llm.common import materialize, table

PIECES = "piece_bpe_32k.model"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of its input; keeps texts with evidence for one language."""
    columns = docs.columns
    pieces = langid.vocabulary(public_tokenizers.path(PIECES))
    langs, probs = langid.fit(docs, pieces)
    found = langid.predict(docs, pieces, langs, probs, columns, ("_lang_pred", "_lang_score"))
    evidence = F.col("_lang_score") > 1.0 / max(2, len(langs)) + 1e-6
    return found.where((F.col("_lang_pred") != "und") & evidence).select(*columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicate(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs, width=5, similarity=0.8)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove(docs, table(spark, sf_dir, "benchmark"), window=10, max_coverage=0.5)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    vocab = sentpiece.load(public_tokenizers.path(PIECES))
    encoded = sentpiece.encode(docs, vocab, ["doc_id"])
    return encoded.select("doc_id", F.expr("cast(length(ids) div 4 AS bigint)").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language", language),
    ("exact", exact_duplicates),
    ("near", near_duplicates),
    ("benchmark", benchmark),
    ("encode", encode),
]

ORACLE_SQL = None  # language evidence, fingerprints and subword ids have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs

"""Prepare grounded prompts for a whole set of questions: retrieve, cite, and write one prompt a question for a batch model run.

    python -m jobs.prompt_batch EMBEDDINGS DOCUMENTS OUT [--config jobs/prompt_batch.json]

The questions are the vectors whose id is divisible by ``every``; each is searched
against all vectors (exact top-k), the texts found become a numbered, cited
context, and the prompt that answers from it alone is written with its source
list.

OUT/prompts     partitioned by the label of the question: query_id, question,
                n_chunks, context, system_prompt, sources

Each run replaces the whole table, so a second run over the same input gives the
same result.  Cases: a vector without length or null matches nothing; a hit whose
document is missing is left out; a question without hits keeps its row, with null
context, prompt and sources; a null label is Spark's default partition.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import answer, retrieve
from corpusloom.operators.state import read_or_empty
from jobs import common

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "prompt_batch.json")
DEFAULTS = {"k": 5, "every": 50, "question": "%d"}
PROMPTS = "query_id bigint, question string, n_chunks bigint, context string, system_prompt string, sources string, label int"


def prompts(vectors: DataFrame, documents: DataFrame, k: int, every: int, question: str) -> DataFrame:
    """vectors: vec_id, embedding, label; documents: doc_id, text, source, lang."""
    held = vectors.select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").cast("int").alias("label"))
    texts = documents.select(F.col("doc_id").alias("id"), "text", F.concat(F.lit("/"), "source").alias("relative_path"), F.lit(None).cast("int").alias("page"), F.col("lang").alias("section"))
    hits = retrieve.top_k(held, asked, k).join(texts, "id")
    questions = asked.select("query_id", F.format_string(question, "query_id").alias("question"))
    line = retrieve.source_line(F.col("rank"), F.col("text"), F.col("relative_path"), F.col("page"), F.round(F.abs("distance"), 6))
    cited = hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("sources"))  # k rows a question
    made = answer.contexts(hits, questions).join(cited, "query_id", "left").join(asked.select("query_id", "label"), "query_id")
    return made.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in PROMPTS.split(", ")))


def run(spark: SparkSession, embeddings: str, documents: str, out: str, config: str = CONFIG) -> dict:
    given = common.settings(spark, config, DEFAULTS)
    vectors, texts = spark.read.parquet(embeddings), spark.read.parquet(documents)
    prompts(vectors, texts, given["k"], given["every"], given["question"]).write.mode("overwrite").partitionBy("label").parquet(f"{out}/prompts")
    total = {"vectors_read": vectors.count(), "documents_read": texts.count(), "prompts_written": read(spark, out).count()}
    common.LOG.info("read %d vectors of %s and %d documents of %s; wrote %d prompts to %s", total["vectors_read"], embeddings, total["documents_read"], documents, total["prompts_written"], out)
    return total


def read(spark: SparkSession, out: str) -> DataFrame:
    return read_or_empty(spark, f"{out}/prompts", PROMPTS)


if __name__ == "__main__":
    common.main(__doc__, ["embeddings", "documents"], CONFIG, run)

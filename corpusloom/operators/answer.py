"""Grounded prompts and answers over retrieved chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The prompt, the answer without context, and what joins contexts.
SYSTEM_PROMPT = """You are a helpful assistant that answers questions based on the provided context.

Instructions:
- Answer the question using ONLY the information from the context below
- If the context doesn't contain enough information to answer, say so clearly
- Be concise and direct in your responses
- Cite specific details from the context when relevant

Context:
{context}"""
NO_CONTEXT = "I couldn't find any relevant information in the knowledge base."
SEPARATOR = "\n\n---\n\n"


def source_info(relative_path: Column, page: Column, section: Column) -> Column:
    """Path, page and section, or unknown source."""
    info = F.concat_ws(" | ", relative_path, F.concat(F.lit("page "), page.cast("string")), F.concat(F.lit("section: "), section))
    return F.when(info == "", F.lit("unknown source")).otherwise(info)


def contexts(hits: DataFrame, questions: DataFrame, prompt: str = SYSTEM_PROMPT) -> DataFrame:
    """One row per question: query_id, question, n_chunks, context, system_prompt (null without chunks).

    hits: query_id, rank, text, relative_path, page, section; at most k rows for each question.
    """
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] ("), source_info(F.col("relative_path"), F.col("page"), F.col("section")), F.lit(")\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    joined = hits.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), SEPARATOR).alias("context"), F.count(F.lit(1)).alias("n_chunks"))
    out = questions.join(joined, "query_id", "left")
    return out.select("query_id", "question", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "context", F.replace(F.lit(prompt), F.lit("{context}"), F.col("context")).alias("system_prompt"))


def answer(prompts: DataFrame, make_client, max_tokens: int | None = None, temperature: float | None = None) -> DataFrame:
    """Adds ``answer``; questions without context get a fixed sentence and call no model.

    make_client builds a client once in each Python worker.
    """
    @F.pandas_udf("string")
    def ask(questions: pd.Series, systems: pd.Series) -> pd.Series:
        client = make_client()
        return pd.Series([client.generate(q, s, max_tokens or 1000, 0.7 if temperature is None else temperature) for q, s in zip(questions, systems)])

    with_context = prompts.where("n_chunks > 0").withColumn("answer", ask("question", "system_prompt"))
    without = prompts.where("n_chunks = 0").withColumn("answer", F.lit(NO_CONTEXT))
    return with_context.unionByName(without)

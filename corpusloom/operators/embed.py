"""Embedding: a protocol, batches with retry, and a deterministic hashing embedder."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed values of the default model.
DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"
DIMENSIONS = {DEFAULT_MODEL: 384, "all-MiniLM-L6-v2": 384, "models/sentence-transformers_all-MiniLM-L6-v2": 384}
DEFAULT_DIMENSIONS = 384
BATCH, ATTEMPTS, DELAY, FACTOR = 32, 3, 1.0, 2.0


class EmbeddingError(Exception):
    """All attempts to embed a batch failed."""


def dimensions(model: str) -> int:
    return DIMENSIONS.get(model, DEFAULT_DIMENSIONS)


def model_path(name: str, root: str = "models") -> str:
    """An existing path, else a local copy below ``root``, else EMBEDDING_MODEL_PATH, else the name itself."""
    if Path(name).exists():
        return name
    local = Path(root) / name.replace("/", "_")
    if local.exists():
        return str(local)
    given = os.environ.get("EMBEDDING_MODEL_PATH")
    return given if given and Path(given).exists() else name


def with_retry(call: Callable[[list], list], texts: list, attempts: int = ATTEMPTS, delay: float = DELAY, factor: float = FACTOR, sleep=time.sleep) -> list:
    """I8: no texts give no vectors; between attempts the pause grows by ``factor``."""
    if not texts:
        return []
    for n in range(attempts):
        try:
            return call(texts)
        except Exception as error:
            if n + 1 == attempts:
                raise EmbeddingError(f"{attempts} attempts failed: {error}") from error
            sleep(delay * factor**n)
    raise EmbeddingError("no attempt was made")


def embed_with(df: DataFrame, load: Callable[[], Callable[[list], list]], column: str = "text", batch: int = BATCH, **retry) -> DataFrame:
    """Adds embedding array<float> and embedding_error string; ``load`` makes the model once in each Python worker.

    A batch that keeps failing leaves its rows without a vector and with the error.
    """

    @F.pandas_udf("struct<embedding:array<float>,embedding_error:string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for part in parts:
            vectors, errors = [], []
            texts = part.fillna("").tolist()
            for k in range(0, len(texts), batch):
                some = texts[k : k + batch]
                try:
                    model = model or load()
                    vectors += [list(map(float, v)) for v in with_retry(model, some, **retry)]
                    errors += [None] * len(some)
                except EmbeddingError as error:
                    vectors += [None] * len(some)
                    errors += [str(error)] * len(some)
            yield pd.DataFrame({"embedding": vectors, "embedding_error": errors})

    return df.withColumn("_e", run(F.col(column))).select("*", "_e.embedding", "_e.embedding_error").drop("_e")


def embed_hashed(df: DataFrame, column: str = "text", size: int = DEFAULT_DIMENSIONS) -> DataFrame:
    """Adds embedding array<float>: hashed word counts of unit length, JVM only; texts without words give zeros."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(column), F.lit(""))), rf"[^\p{{L}}\p{{N}}]+"), lambda w: w != "")
    out = HashingTF(numFeatures=size, inputCol="_e_words", outputCol="_e_tf").transform(df.withColumn("_e_words", words))
    out = Normalizer(inputCol="_e_tf", outputCol="_e_unit").transform(out)
    return out.withColumn("embedding", vector_to_array("_e_unit", "float32")).drop("_e_words", "_e_tf", "_e_unit")



"""Token counters: each counts one text column, or every text of an array column."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions import text as T


class Estimate:
    """C2 without a vocabulary: native expressions; the empty text has no tokens."""

    def one(self, text: Column) -> Column:
        return F.when(text == "", 0).otherwise(T.estimate_tokens(text)).cast("int")

    def many(self, texts: Column) -> Column:
        return F.transform(texts, self.one)


class Tiktoken:
    """C1 with a ranks file (base64 token and rank per line) and its pre-token pattern.

    The reference vocabulary cannot be loaded offline; any ranks file will do,
    and results depend on it.
    """

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def _run(self, kind: str):
        path, pattern = self.path, self.pattern

        def one(batch: pd.Series) -> pd.Series:
            encoding = _encoding(path, pattern)
            return batch.map(lambda t: 0 if not t else len(encoding.encode_ordinary(t)))

        def many(batch: pd.Series) -> pd.Series:
            encoding = _encoding(path, pattern)
            return batch.map(lambda ts: [] if ts is None else [len(encoding.encode_ordinary(t)) if t else 0 for t in ts])

        return F.pandas_udf(one, "int") if kind == "one" else F.pandas_udf(many, "array<int>")

    def one(self, text: Column) -> Column:
        return self._run("one")(text)

    def many(self, texts: Column) -> Column:
        return self._run("many")(texts)


_CACHE: dict = {}


def _encoding(path: str, pattern: str):
    """Loaded once in each Python worker."""
    if path not in _CACHE:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _CACHE[path] = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CACHE[path]

"""Extension surface: embedders and pair scorers as plain callables in Arrow batches, with native defaults."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from zlib import crc32

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.text import tokens

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[tuple[str, str]]], list[float]]


def hashed_embedder(texts: list[str], dims: int = 64) -> list[list[float]]:
    """The default embedder: token counts hashed into ``dims`` signed buckets, at unit length."""
    found = []
    for text in texts:
        counts = [0.0] * dims
        for word in re.findall(r"\w+", text.lower()):
            h = crc32(word.encode())
            counts[h % dims] += 1.0 if h & 4096 else -1.0
        length = math.sqrt(sum(x * x for x in counts))
        found.append([x / length for x in counts] if length >= 1e-8 else counts)
    return found


def lexical_overlap(query: Column, doc: Column) -> Column:
    """The default pair scorer: share of the query's distinct words that the document holds. Native."""
    words = F.array_distinct(tokens(query))
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, tokens(doc))) / F.size(words)).otherwise(0.0)


def embedder_udf(embed: Embedder):
    """An embedder over batches of texts."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(embed(texts.fillna("").tolist()))

    return run


def scorer_udf(score: Scorer, failed: float | None = 0.0):
    """A pair scorer over batches; the pairs of a batch that fails score ``failed``, with None the job fails instead."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for queries, docs in batches:
            try:
                yield pd.Series(score(list(zip(queries.fillna(""), docs.fillna("")))), dtype="float64")
            except Exception:  # a scorer is foreign code: what its failure means is the caller's choice
                if failed is None:
                    raise
                yield pd.Series([failed] * len(queries))

    return run


def embed_with_cache(df: DataFrame, text: str, cache: DataFrame, embed: Embedder = hashed_embedder) -> DataFrame:
    """``df`` with text_sha256 and embedding; only distinct texts that ``cache`` (text_sha256, embedding) lacks are embedded."""
    from .functions.text import strip

    keyed = df.withColumn("text_sha256", F.sha2(strip(F.col(text)), 256))
    new = keyed.select("text_sha256", F.col(text).alias("__text")).dropDuplicates(["text_sha256"]).join(cache.select("text_sha256"), "text_sha256", "left_anti")
    made = new.select("text_sha256", embedder_udf(embed)(F.col("__text")).alias("embedding"))
    return keyed.join(cache.select("text_sha256", "embedding").unionByName(made), "text_sha256", "left")

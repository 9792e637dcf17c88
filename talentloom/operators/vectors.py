"""Embeddings: encoder plug-in, normalisation and cosine similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions import scalars as fx
from talentloom.operators.features import career_text, skill_names

Encoder = Callable[[Sequence[str]], np.ndarray]
#: The passages of a candidate, in order.
PASSAGES = ("summary", "career", "skills", "headline")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 when either has length 0."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def unit(a: Column) -> Column:
    """Vector scaled to length 1 (a zero vector stays zero), so that dot() is the cosine.

    The length is bound once: written inside the lambda it would be computed anew for every number of the vector.
    """
    return fx.let(norm(a), lambda length: F.transform(
        a, lambda x: F.when(length == 0, F.lit(0.0)).otherwise(x.cast("double") / length)))


def mean_positive(similarities: Sequence[Column]) -> Column:
    """Mean of the similarities above 0; missing ones count as 0. Plain arithmetic, so codegen holds."""
    total, found = F.lit(0.0), F.lit(0)
    for s in similarities:
        total = total + F.when(s > 0, s).otherwise(0.0)
        found = found + F.when(s > 0, 1).otherwise(0)
    return F.when(found > 0, total / found).otherwise(0.0)


def encode(texts: DataFrame, keys: Sequence[str], texts_col: str, make_encoder: Callable[[], Encoder],
           output: str = "vectors", batch_texts: int = 256) -> DataFrame:
    """Encode an array<string> column row by row, without a shuffle.

    ``make_encoder`` runs once per task and returns texts -> matrix. Empty texts
    give a NULL vector at their place.
    """
    source = texts.select(*keys, texts_col)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make_encoder()
        for batch in batches:
            flat = [t for row in batch[texts_col] for t in row if t]
            vectors: list = []
            for start in range(0, len(flat), batch_texts):
                vectors.extend(np.asarray(encoder(flat[start:start + batch_texts]), dtype=float))
            ready = iter(vectors)
            out = batch[list(keys)].copy()
            out[output] = [[next(ready) if t else None for t in row] for row in batch[texts_col]]
            yield out

    return source.mapInPandas(run, f"{fields}, `{output}` array<array<double>>")


def encoded(texts: Column, make_encoder: Callable[[], Encoder], batch_texts: int = 256) -> Column:
    """Vectors of an array<string> column, in the row: copies of an id keep their own texts, nothing is joined.

    ``make_encoder`` runs once per task; empty texts give a NULL vector at their place.
    """
    @F.pandas_udf("array<array<double>>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            flat = [t for row in batch for t in row if t]
            found: list = []
            for start in range(0, len(flat), batch_texts):
                found.extend(np.asarray(encoder(flat[start:start + batch_texts]), dtype=float))
            ready = iter(found)
            yield pd.Series([[next(ready) if t else None for t in row] for row in batch])

    return vectors(texts)


def unit_rows(vectors: Column) -> Column:
    """Every vector of an array scaled to length 1; NULL stays NULL."""
    return F.transform(vectors, unit)


def job_sentences(jobs: DataFrame) -> DataFrame:
    """Sentences of each job text, in order, for encoding."""
    return jobs.select("jd_id", fx.sentences(F.col("raw_text")).alias("texts"))


def job_passages() -> Column:
    return F.array(F.substring("raw_text", 1, 1000))


def candidate_passages() -> Column:
    """Texts to compare with a job, in fixed order: summary, career, skills, headline."""
    return F.array(
        F.substring(F.col("profile.summary"), 1, 500),
        F.substring(career_text(F.col("career_history")), 1, 500),
        F.array_join(F.slice(skill_names(F.col("skills")), 1, 30), ", "),
        F.col("profile.headline"))


def semantic_scores(vectors: Column, job_vector: Column) -> Column:
    """Cosines of up to four unit passages with a unit job vector; absent ones are 0."""
    def cosine_at(i: int) -> Column:
        return F.coalesce(dot(F.get(vectors, F.lit(i)), job_vector), F.lit(0.0))
    return F.struct(*[cosine_at(i).alias(f"{name}_similarity") for i, name in enumerate(PASSAGES)])

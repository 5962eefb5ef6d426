"""Stages that turn files into graph and vector tables, and the parts a user may bring.

A stage is a function of a DataFrame; a pipeline is stages in order, so the
optimiser sees one plan.  Embedders and extractors are objects with the methods
below; a fallback takes over for texts that the first embedder refuses.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.functions import paths, text as tx
from codeloom.sources import extract

Stage = Callable[[DataFrame], DataFrame]


class Embedder(Protocol):
    def embed(self, text: Column) -> Column:
        """A vector column for a text column; null where a text is refused."""


class StaticEmbedder:
    """A hashed bag of words."""

    def __init__(self, dim: int = 128):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        return tx.static_embedding(tx.body_tokens(text), self.dim)


class CharacterEmbedder:
    """Character codes by their place modulo the length of the vector; the last character at a place counts, empty texts are refused."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, text: Column) -> Column:
        at = F.sequence(F.lit(1), F.lit(self.dim))
        # The last position that falls on slot i, from 1, is i + dim * floor((n - i) / dim).
        place = lambda i: i + self.dim * F.floor((F.length(text) - i) / self.dim)
        one = lambda i: F.when(F.length(text) >= i, F.ascii(F.substr(text, place(i).cast("int"), F.lit(1))) / 255).otherwise(0.0)
        return F.when(F.length(text) > 0, F.transform(at, one))


class FallbackEmbedder:
    """The first embedder, and the second where that gives nothing."""

    def __init__(self, first: Embedder, second: Embedder):
        self.first, self.second = first, second

    def embed(self, text: Column) -> Column:
        return F.coalesce(self.first.embed(text), self.second.embed(text))


def run(rows: DataFrame, stages: Sequence[Stage]) -> DataFrame:
    for stage in stages:
        rows = rows.transform(stage)
    return rows


def extracted(files: DataFrame) -> DataFrame:
    """Symbols of files (``path, source``)."""
    known = files.select("path", paths.language("path").alias("language"), "source")
    return extract.extract(known).where(F.col("record") == "node")


def weighed(symbols: DataFrame) -> DataFrame:
    """Symbols with the number of others of their file and an importance by it."""
    size = symbols.groupBy("path").agg(F.count("*").alias("symbols"))
    return symbols.join(size, "path").withColumn("importance", F.round(F.least(F.col("symbols") / 100, F.lit(1.0)), 6))


def embedded(embedder: Embedder, column: str = "name") -> Stage:
    return lambda rows: rows.withColumn("embedding", embedder.embed(F.col(column)))


def loaded(rows: DataFrame) -> DataFrame:
    """What a load would write: how many rows of each kind."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"))


def register_functions(spark: SparkSession) -> list[str]:
    """Make the engine's text functions callable in SQL as temporary functions; their names."""
    made = {
        "token_estimate": "CREATE OR REPLACE TEMPORARY FUNCTION token_estimate(t STRING) RETURNS INT RETURN CASE WHEN length(t) = 0 THEN 0 WHEN length(t) > 0 THEN CAST(greatest(ceil(length(t) / 4), 1) AS INT) END",
        "module_of": "CREATE OR REPLACE TEMPORARY FUNCTION module_of(p STRING) RETURNS STRING RETURN CASE WHEN regexp_extract(p, '^(.*)/[^/]*$', 1) = '' THEN 'root' ELSE regexp_extract(p, '^(.*)/[^/]*$', 1) END",
        "rrf": "CREATE OR REPLACE TEMPORARY FUNCTION rrf(r INT) RETURNS DOUBLE RETURN 1.0D / (60 + r + 1)",
    }
    for sql in made.values():
        spark.sql(sql)
    return list(made)

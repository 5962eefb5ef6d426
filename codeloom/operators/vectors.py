"""Vectors with metadata: upsert, filter, exact top-k, fusion of rankings.

A vector table is one row for each id: of several deliveries the greatest vector
counts.  Exact search compares a stated set of queries with all vectors in
blocks of bounded size, one matrix product a block; a block keeps the best of
each of its queries, and these are merged.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows, and queries, that a task compares at once.
BASE_BLOCK, QUERY_BLOCK = 8_192, 1_024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for different lengths, empty, missing or all-zero vectors, and for values that are not finite."""
    return cosine_by(a, norm(a), b, norm(b))


def cosine_by(a: Column, a_norm: Column, b: Column, b_norm: Column) -> Column:
    """:func:`cosine` where the lengths of the vectors are known, as for many pairs of few vectors."""
    raw = F.try_divide(dot(a, b), a_norm * b_norm)
    good = (F.size(a) == F.size(b)) & raw.isNotNull() & ~F.isnan(raw)
    return F.when(good, raw).otherwise(0.0)


class VectorTable:
    """Vectors under an id, with metadata columns.  Rows with a null id do not count."""

    def __init__(self, rows: DataFrame, key: str = "vec_id", vector: str = "embedding"):
        self.rows, self.key, self.vector = rows, key, vector

    @cached_property
    def frame(self) -> DataFrame:
        meta = [c for c, t in self.rows.dtypes if c not in (self.key, self.vector) and not t.startswith(("map", "variant"))]
        return self.rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(*[F.max(c).alias(c) for c in (*meta, self.vector)])

    def where(self, **equal) -> DataFrame:
        """Rows whose metadata equals all given values; a list means any of them; a missing value matches nothing."""
        kept = self.frame
        for name, value in equal.items():
            kept = kept.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
        return kept

    def get(self, ids: DataFrame) -> DataFrame:
        return self.frame.join(ids.select(self.key).distinct(), self.key, "left_semi")

    def without(self, ids: DataFrame) -> DataFrame:
        return self.frame.join(ids.select(self.key).distinct(), self.key, "left_anti")

    def count(self, **equal) -> DataFrame:
        return self.where(**equal).agg(F.count("*").alias("n"))

    def upserted(self, rows: DataFrame) -> DataFrame:
        """The table with other rows put in place of those of the same id."""
        new = VectorTable(rows, self.key, self.vector).frame
        return self.frame.join(new.select(self.key), self.key, "left_anti").unionByName(new, allowMissingColumns=True)

    def top(self, queries: DataFrame, k: int, least: float | None = None, **equal) -> DataFrame:
        """``query, id, score, rank``: the k best rows by cosine for each query (``query, embedding``), ties by id.

        Scores are rounded to six digits before they are compared.  A query of
        another length than a row scores 0 with it.
        """
        base = self.where(**equal).select(F.col(self.key).alias("id"), F.col(self.vector).alias("v"))
        asked = queries.select("query", F.col(self.vector).alias("v"))
        scored = compared(asked, base, k)
        if least is not None:
            scored = scored.where(F.col("score") >= least)
        return top_k(scored, "query", "score", "id", k)


def cosines(a: list, b: list) -> np.ndarray:
    """Cosines of vectors with vectors, of any lengths, to six digits; 0 where they are not comparable."""
    out = np.zeros((len(a), len(b)))
    of = lambda vs, n: [i for i, v in enumerate(vs) if v is not None and len(v) == n]
    for n in {len(v) for v in a if v is not None and len(v)}:
        i, j = of(a, n), of(b, n)
        if not j:
            continue
        x, y = (np.array([vs[k] for k in at], dtype=float) for vs, at in ((a, i), (b, j)))
        with np.errstate(all="ignore"):
            s = (x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(y, axis=1)[None, :])
        out[np.ix_(i, j)] = np.where(np.isfinite(s), s, 0.0)
    return np.round(out, 6)


def compared(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """``query, id, score``: the best of each block of rows for each query; ``queries`` is ``query, v``, ``base`` is ``id, v``.

    Where both also have a ``label``, rows with a query's own label do not count;
    a missing label is none's own.
    """
    label = ["label"] if "label" in queries.columns else []
    kinds = dict(queries.dtypes) | dict(base.dtypes)
    split = lambda df, size: max(1, -(-df.count() // size))
    rows, asks = split(base, BASE_BLOCK), split(queries, QUERY_BLOCK)
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    fresh = [F.col(c).alias(c) for c in ("v", *label)]  # queries may be rows of the same table
    left = queries.select("query", *fresh, own("query", asks).alias("qb"), every(rows).alias("bb"))
    right = base.select("id", *fresh, every(asks).alias("qb"), own("id", rows).alias("bb"))

    def best(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query": q["query"].iloc[:0], "id": b["id"].iloc[:0], "score": pd.Series(dtype=float)})
        b = b.sort_values("id", kind="stable")
        s = cosines(list(q["v"]), list(b["v"]))
        if label:
            x, y = q["label"].to_numpy(dtype=object), b["label"].to_numpy(dtype=object)
            s[(x[:, None] == y[None, :]) & (x != None)[:, None]] = -np.inf  # noqa: E711
        kept = np.argsort(-s, axis=1, kind="stable")[:, :k]  # of equal ones the least id
        out = pd.DataFrame({"query": np.repeat(q["query"].to_numpy(), kept.shape[1]), "id": b["id"].to_numpy()[kept.ravel()], "score": np.take_along_axis(s, kept, axis=1).ravel()})
        return out[np.isfinite(out["score"])]

    return left.groupBy("qb", "bb").cogroup(right.groupBy("qb", "bb")).applyInPandas(best, f"query {kinds['query']}, id {kinds['id']}, score double")


def top_k(scored: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best rows of each group, with their rank; Spark keeps only k rows of a group in each task before it shuffles."""
    order = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(rankings: list[DataFrame], k: float = 60.0) -> DataFrame:
    """``query, id, score, rank``: reciprocal-rank fusion of rankings ``query, id, rank`` (ranks from 1), ties by id."""
    parts = [r.select("query", "id", (F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("part")) for r in rankings]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    summed = both.groupBy("query", "id").agg(F.round(F.sum("part"), 8).alias("score"))
    return summed.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id")))

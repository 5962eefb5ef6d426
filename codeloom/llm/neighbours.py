"""The most similar vectors of every vector.

The collection is divided by learned partitions.  On a bounded sample the exact
neighbour graph is built and cut into balanced parts that keep neighbours
together; a small classifier, a network with one hidden layer, then learns the
part of a vector from the vector alone.  Every vector is stored in its most
probable part; a query goes to its several most probable parts and is ranked
exactly against what they hold.  How many parts that takes is calibrated on
held-out vectors of the sample.  Parts that hold much more than their share
(crowded areas) are worked on in blocks of bounded size, so no task depends on
how crowded they are.  The number of parts grows with the root of the
collection, and the same steps run at every size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codeloom.session import cut

#: The sample that teaches the partitions: this many vectors for each part, within these bounds.
SAMPLE_PER_PART, LEAST_SAMPLE, MOST_SAMPLE = 60, 4_000, 60_000
#: Neighbours in the sample's graph, and units of the classifier's hidden layer.
GRAPH_NEIGHBOURS, HIDDEN = 8, 96
#: Calibration target: share of held-out neighbour pairs that the parts keep together.
TARGET_RECALL = 0.96
#: Vectors of a part, and queries, that one task compares at once.
BASE_BLOCK, QUERY_BLOCK = 4_096, 16_384


@dataclass
class Router:
    """Weights of the classifier and the number of parts a query is sent to."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.bias)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.hidden + self.hidden_bias, 0) @ self.weights + self.bias

    def best(self, x: np.ndarray, m: int) -> np.ndarray:
        """The ``m`` most probable parts of each row, the most probable first."""
        s = self.scores(x)
        m = min(m, s.shape[1])
        top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < s.shape[1] else np.tile(np.arange(m), (len(x), 1))
        order = np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable")
        return np.take_along_axis(top, order, axis=1)


def usable(vectors: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``key, v``: unit vectors, as 4-byte floats in a row, of the rows with a key and ``dim`` finite values, not all zero; one row for each key.

    A key delivered with different vectors keeps the one whose bytes are greatest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy()) if lists.offset == 0 else np.array([len(x) if x is not None else -1 for x in lists.to_pylist()])
            good = np.flatnonzero((size[: batch.num_rows] == dim) & lists.is_valid().to_numpy(zero_copy_only=False))
            kept = lists.take(pa.array(good))
            flat = kept.flatten()
            x = np.asarray(flat.cast(pa.float64()).fill_null(math.nan)).reshape(len(good), dim)
            with np.errstate(over="ignore", invalid="ignore"):
                norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            fine = np.isfinite(norm) & (norm > 0)
            unit = (x[fine] / norm[fine, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good[fine])), pa.array([r.tobytes() for r in unit], type=pa.binary())], names=[key, "v"])

    kind = dict(vectors.dtypes)[key]
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(key, vector)
    return rows.mapInArrow(run, f"{key} {kind}, v binary").groupBy(key).agg(F.max("v").alias("v"))


def matrix(column) -> np.ndarray:
    """Vectors given as bytes, as rows."""
    rows = list(column)
    return np.frombuffer(b"".join(rows), dtype="<f4").reshape(len(rows), -1) if rows else np.zeros((0, 1), dtype=np.float32)


def nearest(queries: np.ndarray, base: np.ndarray, k: int, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Indices and similarities, to six digits, of the ``k`` best rows of ``base`` for each query; of equal ones the first."""
    k = min(k, len(base))
    index = np.empty((len(queries), k), dtype=np.int64)
    score = np.empty((len(queries), k), dtype=np.float32)
    for start in range(0, len(queries), block):
        s = queries[start : start + block] @ base.T
        if k < s.shape[1]:
            top = np.argpartition(-s, k, axis=1)[:, : k + 1]
            value = np.take_along_axis(s, top, axis=1)
            last = value[:, :k].min(axis=1)
            tied = np.flatnonzero(value[:, k] > last - 2e-6)  # the one beyond the edge is as good as the last
            top = top[:, :k]
            for i in tied:
                r = np.round(s[i], 6)
                edge = np.round(last[i], 6)
                above = np.flatnonzero(r > edge)
                top[i] = np.concatenate([above, np.flatnonzero(r == edge)])[:k]
        else:
            top = np.tile(np.arange(k), (len(s), 1))
        index[start : start + block] = top
        score[start : start + block] = np.round(np.take_along_axis(s, top, axis=1), 6)
    return index, score


def balanced_parts(graph: np.ndarray, parts: int, slack: float = 1.1, sweeps: int = 5, seed: int = 3) -> np.ndarray:
    """The part of each node of a neighbour graph: neighbours together, no part above ``slack`` times its share.

    Nodes are placed in breadth-first order where most of their neighbours are,
    weighted by the room left, and moved again in a few sweeps.
    """
    n = len(graph)
    linked: list[list[int]] = [list(row) for row in graph]
    for i, row in enumerate(graph):
        for j in row:
            linked[j].append(i)
    rng = np.random.default_rng(seed)
    order, seen = [], np.zeros(n, dtype=bool)
    for root in rng.permutation(n):
        if seen[root]:
            continue
        seen[root] = True
        queue = [int(root)]
        for node in queue:
            for j in linked[node]:
                if not seen[j]:
                    seen[j] = True
                    queue.append(j)
        order += queue
    limit = max(1.0, slack * n / parts)
    label = [-1] * n
    size = [0] * parts
    for _ in range(sweeps + 1):
        for node in order:
            if label[node] >= 0:
                size[label[node]] -= 1
            votes: dict[int, int] = {}
            for j in linked[node]:
                p = label[j]
                if p >= 0:
                    votes[p] = votes.get(p, 0) + 1
            best, most = -1, 0.0
            for p, v in votes.items():
                gain = v * (1 - size[p] / limit)
                if gain > most:
                    best, most = p, gain
            if best < 0:
                best = min(range(parts), key=size.__getitem__)
            label[node] = best
            size[best] += 1
    return np.array(label)


def train(x: np.ndarray, label: np.ndarray, parts: int, steps: int = 900, batch: int = 512, rate: float = 0.004, seed: int = 5) -> Router:
    """The classifier, by minibatches with Adam."""
    rng = np.random.default_rng(seed)
    n, dim = x.shape
    w = [
        rng.normal(0, math.sqrt(2), (dim, HIDDEN)).astype(np.float32), np.zeros(HIDDEN, dtype=np.float32),
        rng.normal(0, math.sqrt(1 / HIDDEN), (HIDDEN, parts)).astype(np.float32), np.zeros(parts, dtype=np.float32),
    ]
    m, s = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    for t in range(1, steps + 1):
        at = rng.integers(0, n, min(batch, n))
        z = x[at] @ w[0] + w[1]
        h = np.maximum(z, 0)
        p = h @ w[2] + w[3]
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(at)), label[at]] -= 1
        p /= len(at)
        back = (p @ w[2].T) * (z > 0)
        grads = [x[at].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ p + 1e-4 * w[2], p.sum(axis=0)]
        step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            w[i] -= step * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*w, 1)


def parts_for(rows: int) -> int:
    """A quarter of the root of the rows, so parts and their number grow alike; bounded by what the largest sample can teach."""
    return int(min(MOST_SAMPLE // SAMPLE_PER_PART, max(2, round(math.sqrt(rows) / 4))))


def fit(sample: np.ndarray, rows: int, target: float = TARGET_RECALL, parts: int | None = None) -> Router:
    """Learn the partitions for a collection of ``rows`` vectors from a sample of it, which must not be empty."""
    parts = min(parts or parts_for(rows), max(1, len(sample) // 4))
    index, score = nearest(sample, sample, min(GRAPH_NEIGHBOURS + 1, len(sample)))
    own = index == np.arange(len(sample))[:, None]
    score[own] = -2
    order = np.argsort(-score, axis=1, kind="stable")[:, : max(1, index.shape[1] - 1)]
    graph = np.take_along_axis(index, order, axis=1)
    label = balanced_parts(graph, parts)
    held = np.zeros(len(sample), dtype=bool)
    held[::5] = len(sample) >= 20
    router = train(sample[~held], label[~held], parts)
    test = held if held.any() else ~held
    ranks = np.argsort(np.argsort(-router.scores(sample[test]), axis=1), axis=1)
    home = router.best(sample, 1)[:, 0]
    rank = np.take_along_axis(ranks, home[graph[test][:, :5]], axis=1)  # of the parts that hold the neighbours
    for probes in range(1, parts + 1):
        router.probes = probes
        if (rank < probes).mean() >= target:
            break
    return router


def _routed(df: DataFrame, key: str, router: Router) -> DataFrame:
    """``key, v, parts``: each row with its most probable parts, its own first."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                best = router.best(matrix(batch.column(1).to_pylist()), router.probes).astype(np.int32)
                at = pa.array(np.arange(len(best) + 1, dtype=np.int32) * best.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(best.ravel()))], names=[key, "v", "parts"])

    return df.select(key, "v").mapInArrow(run, f"{key} {kind}, v binary, parts array<int>")


def sample_of(vectors: DataFrame, key: str, rows: int, size: int) -> np.ndarray:
    """About ``size`` vectors, at most twice as many, chosen by a hash of their key."""
    share = min(1.0, size / max(1, rows))
    kept = vectors.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(17)), F.lit(1 << 30)) < max(1, math.ceil(share * (1 << 30))))
    return matrix(kept.select("v").limit(2 * size).toPandas()["v"])


def search(queries: DataFrame | None, base: DataFrame, key: str, k: int, router: Router | None = None) -> DataFrame:
    """``query, neighbour, cosine, rank``: the ``k`` most similar other rows of ``base`` for each query; without queries for every row of it.

    Both come from :func:`usable`.  Similarities are compared to six digits;
    equal ones rank by key.  A row is never its own neighbour; equal vectors
    under other keys are.  Fewer than ``k`` rows give as many as there are;
    empty tables give no rows.
    """
    kind = dict(base.dtypes)[key]
    if router is None:
        rows = base.count()
        sample = sample_of(base, key, rows, min(MOST_SAMPLE, max(LEAST_SAMPLE, SAMPLE_PER_PART * parts_for(rows)))) if rows else np.zeros((0, 1))
        if not len(sample):  # no rows, or none with a key that counts
            return base.where(F.lit(False)).select(F.col(key).alias("query"), F.col(key).alias("neighbour"), F.lit(0.0).alias("cosine"), F.lit(1).alias("rank"))
        router = fit(sample, rows)
    stored = cut(_routed(base, key, router))
    asked = stored if queries is None else cut(_routed(queries, key, router))
    # One row a part comes to the driver; their number is bounded by the sample.
    held = {r["part"]: r["count"] for r in stored.groupBy(F.col("parts")[0].alias("part")).count().collect()}
    wanted = {r["part"]: r["count"] for r in asked.select(F.explode("parts").alias("part")).groupBy("part").count().collect()}
    blocks = F.create_map(*[F.lit(x) for p in range(router.parts) for x in (p, max(1, -(-held.get(p, 0) // BASE_BLOCK)))])
    asks = F.create_map(*[F.lit(x) for p in range(router.parts) for x in (p, max(1, -(-wanted.get(p, 0) // QUERY_BLOCK)))])
    h = F.xxhash64(F.col(key).cast("string"))
    one = asked.select(key, "v", F.explode("parts").alias("part"))
    left = one.select("part", F.pmod(h, asks[F.col("part")]).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), blocks[F.col("part")] - 1)).alias("bb"), key, "v")
    own = stored.select(key, "v", F.col("parts")[0].alias("part"))
    right = own.select("part", F.explode(F.sequence(F.lit(0), asks[F.col("part")] - 1)).alias("qb"), F.pmod(h, blocks[F.col("part")]).cast("int").alias("bb"), key, "v")

    def compare(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(b):
            return pd.DataFrame({"query": q[key].iloc[:0], "neighbour": q[key].iloc[:0], "cosine": pd.Series(dtype=float)})
        b = b.sort_values(key, kind="stable")
        names, mine = b[key].to_numpy(), q[key].to_numpy()
        index, score = nearest(matrix(q["v"]), matrix(b["v"]), k + 1)
        at = np.repeat(np.arange(len(q)), index.shape[1])
        other = names[index.ravel()]
        keep = other != mine[at]
        return pd.DataFrame({"query": mine[at][keep], "neighbour": other[keep], "cosine": np.round(score.ravel()[keep].astype(float), 6)})

    met = left.groupBy("part", "qb", "bb").cogroup(right.groupBy("part", "qb", "bb")).applyInPandas(
        compare, f"query {kind}, neighbour {kind}, cosine double"
    )
    # Each task keeps k rows of a query before they are shuffled.
    order = Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exhaustive(queries: DataFrame, base: DataFrame, key: str, k: int) -> DataFrame:
    """What :func:`search` approximates, by comparing a stated query set with all rows, block by block; to measure recall."""

    class Everything(Router):
        def best(self, x, m):
            return np.zeros((len(x), 1), dtype=np.int64)

    none = np.zeros((1, 1), dtype=np.float32)
    return search(queries, base, key, k, Everything(none, none[0], none, none[0], 1))


def recall(found: DataFrame, truth: DataFrame, margin: float = 1e-6) -> DataFrame:
    """``queries, expected, hit, recall``: how many true neighbours were found; one of equal similarity counts too."""
    worst = truth.groupBy("query").agg(F.min("cosine").alias("least"), F.count("*").alias("n"))
    got = (
        found.join(worst, "query", "right")
        .groupBy("query", "n")
        .agg(F.sum(F.when(F.col("cosine") >= F.col("least") - margin, 1).otherwise(0)).alias("hit"))
    )
    return got.agg(
        F.count("*").alias("queries"), F.sum("n").alias("expected"), F.sum(F.least("hit", "n")).alias("hit")
    ).withColumn("recall", F.round(F.col("hit") / F.col("expected"), 4))

"""Vector search: recall with real partitions, ties by key, blocks, unusable vectors."""

from __future__ import annotations

import math

import numpy as np

from codeloom.llm import neighbours as nb

SCHEMA = "vec_id long, embedding array<float>, other string"


def clouds(n: int, dim: int, centres: int, seed: int = 1) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return c[rng.integers(0, centres, n) ** 2 % centres] + 0.35 * rng.normal(size=(n, dim))


def frame(spark, x):
    return nb.usable(spark.createDataFrame([(i, [float(v) for v in r], "o") for i, r in enumerate(x)], SCHEMA), "vec_id", "embedding", x.shape[1])


def test_recall_with_sixteen_parts(spark):
    x = clouds(4000, 24, 40)
    vectors = frame(spark, x)
    sample = nb.matrix([r["v"] for r in vectors.collect()])
    router = nb.fit(sample, 4000, parts=16)
    assert router.parts == 16 and router.probes <= 8
    queries = vectors.where("vec_id % 20 = 0")
    got = nb.recall(nb.search(queries, vectors, "vec_id", 5, router), nb.exhaustive(queries, vectors, "vec_id", 5)).first()
    assert got["queries"] == 200 and got["expected"] == 1000 and got["recall"] >= 0.9


def test_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(nb, "BASE_BLOCK", 7)
    monkeypatch.setattr(nb, "QUERY_BLOCK", 5)
    x = np.concatenate([np.tile([1.0, 2.0, 3.0, 4.0], (30, 1)), clouds(20, 4, 3)])
    rows = nb.search(None, frame(spark, x), "vec_id", 5, nb.fit(x.astype("f4") / np.linalg.norm(x, axis=1, keepdims=True).astype("f4"), 50, parts=1)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["query"], []).append((r["rank"], r["neighbour"], r["cosine"]))
    assert len(by) == 50 and all(len(v) == 5 for v in by.values())
    assert [n for _, n, _ in sorted(by[0])] == [1, 2, 3, 4, 5] and [n for _, n, _ in sorted(by[29])] == [0, 1, 2, 3, 4]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q, found in by.items():
        best = sorted((-round(float(u[q] @ u[n]), 6), n) for n in range(50) if n != q)[:5]
        assert [n for _, n, _ in sorted(found)] == [n for _, n in best]


def test_unusable_vectors(spark):
    rows = [(1, [1.0, 0.0], ""), (1, [1.0, 0.0], ""), (2, [0.0, 0.0], ""), (3, [math.nan, 1.0], ""), (4, [math.inf, 1.0], ""), (5, None, ""), (6, [1.0], ""), (7, [1.0, None], ""), (None, [1.0, 0.0], ""), (8, [5.0, 0.1], "")]
    df = nb.usable(spark.createDataFrame(rows, SCHEMA), "vec_id", "embedding", 2)
    assert {r["vec_id"] for r in df.collect()} == {1, 8}
    found = [(r["query"], r["neighbour"], r["rank"]) for r in nb.search(None, df, "vec_id", 5).orderBy("query").collect()]
    assert found == [(1, 8, 1), (8, 1, 1)]
    assert nb.search(None, df.limit(0), "vec_id", 5).count() == 0 and nb.search(df.limit(0), df, "vec_id", 5).count() == 0

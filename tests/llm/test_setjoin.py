"""Similar sets against brute force, with copies, crowded neighbourhoods, nulls and two tables."""

from __future__ import annotations

import random

from codeloom.llm import setjoin

SCHEMA = "id string, tokens array<string>, extra string"


def random_sets(seed: int, families: int, members: int):
    rng, out = random.Random(seed), {}
    for f in range(families):
        base = [f"t{rng.randint(0, 400)}" for _ in range(60)]
        for m in range(members):
            out[f"r{f:02}_{m:02}"] = [t if rng.random() > rng.choice((0, 0.02, 0.06, 0.15)) else f"x{rng.randint(0, 999)}" for t in base]
    return out


def brute(sets, other=None, threshold=0.85):
    pairs = ((a, b) for a in sets for b in (other or sets) if other or a < b)
    both = lambda a, b: (set(sets[a]), set((other or sets)[b]))
    return {(a, b) for a, b in pairs for x, y in [both(a, b)] if len(x & y) >= threshold * len(x | y)}


def frame(spark, sets):
    return spark.createDataFrame([(k, v, "e") for k, v in sets.items()], SCHEMA)


def test_pairs_are_brute_force(spark, monkeypatch):
    monkeypatch.setattr(setjoin, "CROWDED", 3)
    monkeypatch.setattr(setjoin, "BLOCK", 4)  # blocks, also within a class of copies
    sets = random_sets(1, 12, 14) | {f"copy{i}": ["a", "b", "c", "d"] for i in range(11)}
    df = frame(spark, sets)
    found = {(r["id_a"], r["id_b"]) for r in setjoin.similar_pairs(df.union(df), "id", "tokens", 0.85).collect()}
    assert found == brute(sets)
    links = {r["id"]: r for r in setjoin.links(df, "id", "tokens", 0.85).collect()}
    assert links["copy3"]["copies"] == 11 and links["copy3"]["class"] == "copy0" and len(links) == len(sets)


def test_between_two_tables(spark):
    one, two = random_sets(2, 8, 5), {k + "x": v for k, v in random_sets(2, 8, 9).items()}
    found = {(r["left_id"], r["right_id"]) for r in setjoin.similar_between(frame(spark, one), frame(spark, two), "id", "tokens", 0.85).collect()}
    assert found == brute(one, two)


def test_recall_is_measured(spark):
    r = setjoin.recall(frame(spark, random_sets(3, 12, 14)), "id", "tokens", 0.85, every=2).first()
    assert r["expected"] > 50 and r["recall"] >= 0.99


def test_defined_results(spark):
    rows = [("a", None, ""), (None, ["x"], ""), ("b", [], ""), ("c", [None, None], ""), ("d", ["x", "x", None], ""), ("e", ["x"], ""), ("f", ["y"] * 2, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in setjoin.similar_pairs(df, "id", "tokens", 0.85).collect()] == [("d", "e", 1.0)]
    assert setjoin.similar_pairs(df, "id", "tokens", 0.85, 2).count() == 0
    assert setjoin.similar_pairs(df.limit(0), "id", "tokens", 0.85).count() == 0 and setjoin.links(df.limit(0), "id", "tokens", 0.85).count() == 0

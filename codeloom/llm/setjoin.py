"""All pairs of records whose sets of values are similar, within a table or between two.

Equal sets are one class from the start, so copies are never compared.  Every
class gets minhash values in many independent trees; a tree orders the classes
by their values, lexicographically, and classes with a common prefix are
neighbours there.  A prefix starts two values short.  Where too many classes
share it, the neighbourhood is deepened, for this place of this tree only, down
to the depth at which the trees together still find the target share of the
pairs at the threshold.  Neighbourhoods that are crowded even there are compared
in blocks by many tasks, whole.  Candidates are verified on the sets themselves.

Prefixes are grouped by their hashes, which gives the same neighbourhoods as
sorting each tree, without an order over all classes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from codeloom.session import cut

#: Share of the pairs at the threshold that the deepest neighbourhoods still find; more similar pairs are found more surely.
TARGET_RECALL = 0.9999
#: Independent trees.
TREES = 24
#: A neighbourhood of more classes than this is deepened.
CROWDED = 24
#: Classes that one task compares with as many others.
BLOCK = 512

_PERMUTATIONS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def depths(threshold: float, trees: int = TREES, recall: float = TARGET_RECALL) -> tuple[int, int]:
    """The first prefix length, and the deepest that reaches the target recall."""
    needed = 1 - (1 - recall) ** (1 / trees)  # of one tree
    deepest = max(1, math.floor(math.log(needed) / math.log(threshold)) if threshold < 1 else 8)
    return max(1, deepest - 2), deepest


def _permutations(m: int) -> tuple[np.ndarray, np.ndarray]:
    if m not in _PERMUTATIONS:
        rng = np.random.default_rng(7)
        odd = rng.integers(0, 1 << 31, m, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        _PERMUTATIONS[m] = odd, rng.integers(0, 1 << 32, m, dtype=np.uint32)
    return _PERMUTATIONS[m]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def prefix_keys(hashes: np.ndarray, trees: int, first: int, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """For each tree the keys of a set's short and long prefix; ``hashes`` are those of its values, of 32 bits."""
    a, b = _permutations(trees * deepest)
    with np.errstate(over="ignore"):
        h = hashes[:, None] * a[None, :]
        h += b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        least = _mix(h.min(axis=0).astype(np.uint64)).reshape(trees, deepest)
        key = np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)
        short = key
        for d in range(deepest):
            key = _mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + least[:, d])
            if d + 1 == first:
                short = key
    return short.view(np.int64), key.view(np.int64)


def classes(records: DataFrame, key: str, values: str, min_values: int = 1) -> DataFrame:
    """``class, key, items, n`` of every record: its class of equal sets, named by 128 bits, and the set.

    Records with a null key, a null list, fewer than ``min_values`` values
    (repeats and no nulls counted) or no value at all belong to none.  Repeated
    rows are still in it.
    """
    clean = records.select(F.col(key).alias("key"), F.filter(values, lambda x: x.isNotNull()).alias("_v")).where(
        F.col("key").isNotNull() & (F.size("_v") >= max(1, min_values))
    )
    sets = clean.select("key", F.array_sort(F.array_distinct("_v")).alias("items"))
    half = lambda *x: F.lpad(F.hex(F.xxhash64(*x)), 16, "0")
    return sets.select(F.unhex(F.concat(half("items"), half(F.lit(1), F.size("items"), "items"))).alias("class"), "key", "items", F.size("items").alias("n"))


def _forest(trees: int, first: int, deepest: int):
    """A function over batches of ``class, n, items``: one row for each class and tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            short, long_ = np.empty((rows, trees), dtype=np.int64), np.empty((rows, trees), dtype=np.int64)
            for i, items in enumerate(batch.column(2).to_pylist()):
                if len(known) > 500_000:
                    known.clear()
                h = np.empty(len(items), dtype=np.uint32)
                for j, x in enumerate(items):
                    v = known.get(x)
                    if v is None:
                        v = known[x] = xxhash.xxh32_intdigest(x)
                    h[j] = v
                short[i], long_[i] = prefix_keys(h, trees, first, deepest)
            at = pa.array(np.repeat(np.arange(rows), trees))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(short.ravel()), pa.array(long_.ravel())], names=["class", "n", "short", "long"]
            )

    return run


def _meet(rows: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """``class_a, class_b`` of rows with a common ``key``, in blocks where a key is crowded; sets too different in size are left out."""
    own = F.pmod(F.hash("class"), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("key", own.alias("x"), every.alias("y"), F.col("class").alias("class_a"), F.col("n").alias("n_a"))
    right = other.select("key", every.alias("x"), own.alias("y"), F.col("class").alias("class_b"), F.col("n").alias("n_b"))
    return left.join(right, ["key", "x", "y"]).where(
        (F.col("class_a") < F.col("class_b")) & (F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
    ).select("class_a", "class_b")


def similar_classes(distinct: DataFrame, threshold: float, trees: int = TREES) -> DataFrame:
    """``class_a, class_b, jaccard`` of different sets at or above the threshold, ``class_a < class_b``; ``distinct`` is ``class, items, n``."""
    first, deepest = depths(threshold, trees)
    forest = cut(distinct.select("class", "n", "items").mapInArrow(_forest(trees, first, deepest), "class binary, n int, short bigint, long bigint"))
    size = forest.groupBy("short").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    near = forest.join(size.hint("shuffle_hash"), "short").select("class", "n", F.when(F.col("size") <= CROWDED, F.col("short")).otherwise(F.col("long")).alias("key"), (F.col("size") > CROWDED).alias("deep"))
    held = near.where("deep").groupBy("key").agg(F.count("*").alias("held")).where(F.col("held") > BLOCK)
    placed = near.join(held, "key", "left").select("class", "n", "key", F.coalesce(F.ceil(F.col("held") / BLOCK), F.lit(1)).cast("int").alias("blocks"))
    candidates = _meet(placed, placed, threshold).distinct()
    items = distinct.select("class", "items", "n")
    both = (
        candidates.join(items.select(F.col("class").alias("class_a"), F.col("items").alias("a"), F.col("n").alias("na")), "class_a")
        .join(items.select(F.col("class").alias("class_b"), F.col("items").alias("b"), F.col("n").alias("nb")), "class_b")
        .withColumn("common", F.size(F.array_intersect("a", "b")))
    )
    return (
        both.withColumn("jaccard", F.col("common") / (F.col("na") + F.col("nb") - F.col("common")))
        .where(F.col("jaccard") >= threshold)
        .select("class_a", "class_b", "jaccard")
    )


def _distinct(keyed: DataFrame) -> DataFrame:
    return keyed.select("class", "items", "n").dropDuplicates(["class"])


def _copies(members: DataFrame, other: DataFrame) -> DataFrame:
    """``x, y``: members of a class with those of the same class in ``other``; big classes in blocks, and every pair once."""
    size = members.groupBy("class").agg(F.count("*").alias("held")).where(F.col("held") > 1)
    big = size.select("class", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.hash("key"), F.col("blocks"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = members.join(big, "class").select("class", own.alias("p"), every.alias("q"), F.col("key").alias("x"))
    right = other.join(big, "class").select("class", every.alias("p"), own.alias("q"), F.col("key").alias("y"))
    return left.join(right, ["class", "p", "q"]).select("x", "y")


def similar_pairs(records: DataFrame, key: str, values: str, threshold: float, min_values: int = 1) -> DataFrame:
    """``{key}_a, {key}_b, jaccard`` of all pairs of records at or above the threshold, ``{key}_a < {key}_b``.

    Repeated rows and repeated values count once (``min_values`` counts repeats);
    records without values are similar to none; an id delivered with different
    lists is paired by each.  Extra columns are ignored; an empty table gives no
    rows.
    """
    keyed = cut(classes(records, key, values, min_values))
    members = keyed.select("class", "key").distinct()
    a, b = f"{key}_a", f"{key}_b"
    across = (
        similar_classes(_distinct(keyed), threshold)
        .join(members.select(F.col("class").alias("class_a"), F.col("key").alias("x")), "class_a")
        .join(members.select(F.col("class").alias("class_b"), F.col("key").alias("y")), "class_b")
        .where(F.col("x") != F.col("y"))
        .select(F.least("x", "y").alias(a), F.greatest("x", "y").alias(b), "jaccard")
    )
    within = _copies(members, members).where(F.col("x") < F.col("y")).select(F.col("x").alias(a), F.col("y").alias(b), F.lit(1.0).alias("jaccard"))
    return across.union(within).groupBy(a, b).agg(F.max("jaccard").alias("jaccard"))


def similar_between(left: DataFrame, right: DataFrame, key: str, values: str, threshold: float, min_values: int = 1) -> DataFrame:
    """``left_{key}, right_{key}, jaccard``: pairs of a record of one table and one of another, at or above the threshold."""
    one = classes(left, key, values, min_values).withColumn("side", F.lit(0))
    keyed = cut(one.unionByName(classes(right, key, values, min_values).withColumn("side", F.lit(1))))
    pairs = cut(similar_classes(_distinct(keyed), threshold))
    both = pairs.unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b"), "jaccard"))
    lefts = keyed.where("side = 0").select("class", "key").distinct()
    rights = keyed.where("side = 1").select("class", "key").distinct()
    same = lefts.withColumnRenamed("key", "x").join(rights.withColumnRenamed("key", "y"), "class").select("x", "y", F.lit(1.0).alias("jaccard"))
    across = (
        both.join(lefts.select(F.col("class").alias("class_a"), F.col("key").alias("x")), "class_a")
        .join(rights.select(F.col("class").alias("class_b"), F.col("key").alias("y")), "class_b")
        .select("x", "y", "jaccard")
    )
    return across.union(same).groupBy(F.col("x").alias(f"left_{key}"), F.col("y").alias(f"right_{key}")).agg(F.max("jaccard").alias("jaccard"))


def links(records: DataFrame, key: str, values: str, threshold: float, min_values: int = 1) -> DataFrame:
    """``key, class, copies, links``: one row for each record, without expanding copies into pairs.

    ``class`` is the least key among the records with the same set, ``copies``
    their number, ``links`` the number of different sets similar to it.
    """
    keyed = cut(classes(records, key, values, min_values))
    members = keyed.select("class", "key").distinct()
    pairs = similar_classes(_distinct(keyed), threshold)
    degree = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    named = members.groupBy("class").agg(F.min("key").alias("least"), F.count("*").alias("copies"))
    per_class = named.join(degree, "class", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    return members.join(per_class, "class").select(F.col("key").alias(key), F.col("least").alias("class"), "copies", "links")


def recall(records: DataFrame, key: str, values: str, threshold: float, min_values: int = 1, every: int = 20) -> DataFrame:
    """``queries, expected, hit, recall``: a stated set of classes, each ``every``-th by a hash of its name, against all classes, exactly."""
    keyed = cut(classes(records, key, values, min_values))
    distinct = _distinct(keyed)
    asked = distinct.where(F.pmod(F.hash("class"), F.lit(every)) == 0).select(F.col("class").alias("q"), F.col("items").alias("a"), F.col("n").alias("na"))
    fits = (F.least("na", "n") >= F.lit(threshold) * F.greatest("na", "n")) & (F.col("q") != F.col("class"))
    common = F.size(F.array_intersect("a", "items"))
    true = asked.join(distinct, fits).where(common / (F.col("na") + F.col("n") - common) >= threshold).select(F.least("q", "class").alias("class_a"), F.greatest("q", "class").alias("class_b")).distinct()
    found = similar_classes(distinct, threshold).select("class_a", "class_b", F.lit(1).alias("found"))
    got = true.join(found, ["class_a", "class_b"], "left").agg(F.count("*").alias("expected"), F.count("found").alias("hit"))
    counted = asked.agg(F.count("*").alias("queries"))
    share = F.round(F.when(F.col("expected") > 0, F.col("hit") / F.col("expected")).otherwise(1.0), 6)
    return counted.join(got).select("queries", "expected", "hit", share.alias("recall"))  # one row each

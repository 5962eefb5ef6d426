"""Similar bodies and repeated lines.

Clone candidates meet in bands of minhash signatures.  A band that many bodies
share is no cross product in one task: bodies with the same tokens are one class
first, so copies never meet each other, and every class is joined by (band,
block) with the blocks of a crowded band spread over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeloom.functions import text as tx
from codeloom.session import cut

#: Classes of one band that a task compares with each other.
BLOCK = 512


def classes(bodies: DataFrame, key: str, tokens: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Distinct token sets ``class, items, sig`` and the members ``class, key`` of each; bodies of fewer tokens are left out."""
    clean = bodies.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.filter(tokens, lambda t: t.isNotNull()).alias("t")).where(F.size("t") >= least)
    sets = clean.select("key", F.array_sort(F.array_distinct("t")).alias("items"))
    named = sets.withColumn("class", F.sha1(F.array_join("items", "\x1f"))).distinct()
    distinct = named.groupBy("class").agg(F.first("items").alias("items"))
    return signed(distinct), named.select("class", "key").distinct()


def signed(distinct: DataFrame) -> DataFrame:
    """``class, items, sig``: the signatures of :func:`codeloom.functions.text.minhash`, made in batches.

    64 permutations of every token are one product of vectors here; as
    expressions they would be evaluated one by one.
    """
    a, b = (np.array(c, dtype=np.int64) for c in zip(*map(tx.coefficients, range(tx.SLOTS))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            sigs = []
            for items in batch.column(1).to_pylist():
                if len(known) > 500_000:
                    known.clear()
                for t in items:
                    if t not in known:
                        known[t] = int(hashlib.md5(t.encode()).hexdigest()[:15], 16) % tx.PRIME
                h = np.fromiter((known[t] for t in items), dtype=np.int64, count=len(items))
                sigs.append(((h[:, None] * a + b) % tx.PRIME).min(axis=0) if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sigs, type=pa.list_(pa.int64()))], names=["class", "items", "sig"])

    return distinct.select("class", "items").mapInArrow(run, "class string, items array<string>, sig array<bigint>")


def candidates(signed: DataFrame) -> DataFrame:
    """``a, b``: pairs of different classes that share a band, each once."""
    banded = signed.select("class", F.explode(tx.bands(F.col("sig"))).alias("band"))
    size = banded.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    rows = banded.join(size, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int")
    left = rows.select("band", F.col("class").alias("a"), own.alias("x"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    right = rows.select("band", F.col("class").alias("b"), own.alias("y"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x"))
    return left.join(right, ["band", "x", "y"]).where(F.col("a") < F.col("b")).select("a", "b").distinct()


def similar_classes(bodies: DataFrame, key: str, tokens: str, threshold: float, least: int = 50) -> tuple[DataFrame, DataFrame]:
    """``a, b, estimate, jaccard`` of the similar classes, and their members; the estimate must reach the threshold."""
    sketches, members = classes(bodies, key, tokens, least)
    sketches = cut(sketches)  # read by the bands and from both sides
    left = sketches.select(F.col("class").alias("a"), F.col("items").alias("ia"), F.col("sig").alias("sa"))
    right = sketches.select(F.col("class").alias("b"), F.col("items").alias("ib"), F.col("sig").alias("sb"))
    met = candidates(sketches).join(left, "a").join(right, "b").withColumn("estimate", tx.equal_slots(F.col("sa"), F.col("sb")))
    kept = met.where(F.col("estimate") >= threshold)
    return kept.select("a", "b", F.round("estimate", 6).alias("estimate"), F.round(tx.jaccard(F.col("ia"), F.col("ib")), 6).alias("jaccard")), members


def clone_groups(bodies: DataFrame, key: str, tokens: str, least: int = 50) -> DataFrame:
    """``class, copies, first``: bodies with the very same set of tokens, without listing their pairs."""
    _, members = classes(bodies, key, tokens, least)
    return members.groupBy("class").agg(F.count("*").alias("copies"), F.min("key").alias("first"))


def repeated_lines(sources: DataFrame, key: str, text: str, least_chars: int = 12) -> DataFrame:
    """``line, files, times``: trimmed lines that occur more than once, by digest; short ones are left out."""
    lines = sources.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, F.explode(F.split(text, "\n")).alias("line"))
    kept = lines.select(key, F.trim(F.regexp_replace("line", r"[ \t\r]+", " ")).alias("line")).where(F.length("line") >= least_chars)
    per = kept.groupBy(F.md5("line").alias("line"), key).agg(F.count("*").alias("n"))
    return per.groupBy("line").agg(F.count("*").alias("files"), F.sum("n").alias("times")).where(F.col("times") > 1)


def windows(sources: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``key, start, block``: a digest of every run of so many lines, from 1."""
    lines = F.split(text, "\n")
    runs = F.transform(F.sequence(F.lit(1), F.size("l") - width + 1), lambda i: F.md5(F.array_join(F.slice("l", i, width), "\n")))
    rows = sources.where(F.col(text).isNotNull()).select(key, F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r"))).alias("l")).where(F.size("l") >= width)
    return rows.select(key, F.posexplode(runs).alias("i", "block")).select(key, (F.col("i") + 1).alias("start"), "block")


def duplicate_blocks(sources: DataFrame, key: str, text: str, width: int = 6) -> DataFrame:
    """``block, places, files``: runs of lines that occur at several places, once for each run."""
    per = windows(sources, key, text, width).groupBy("block", key).agg(F.count("*").alias("n"))
    return per.groupBy("block").agg(F.sum("n").alias("places"), F.count("*").alias("files")).where(F.col("places") > 1)


def duplicates_in_file(sources: DataFrame, key: str, text: str, width: int = 6) -> DataFrame:
    """``key, block, places``: runs of lines that occur more than once within a file."""
    return windows(sources, key, text, width).groupBy(key, "block").agg(F.count("*").alias("places")).where(F.col("places") > 1)


def duplication_share(sources: DataFrame, key: str, text: str, width: int = 6) -> DataFrame:
    """``key, lines, duplicated, share``: how many lines of each file lie in a run that occurs elsewhere too."""
    w = windows(sources, key, text, width)
    shared = w.groupBy("block").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    covered = w.join(shared, "block", "left_semi").select(key, F.explode(F.sequence(F.col("start"), F.col("start") + width - 1)).alias("line")).distinct()
    per = covered.groupBy(key).agg(F.count("*").alias("duplicated"))
    size = sources.where(F.col(text).isNotNull()).select(key, F.size(F.split(text, "\n")).alias("lines"))
    return size.join(per, key, "left").fillna(0, ["duplicated"]).withColumn("share", F.round(F.col("duplicated") / F.col("lines"), 6))

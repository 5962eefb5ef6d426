"""Texts packed whole into containers of a fixed capacity in tokens.

Texts are measured with a public tokenizer; only a text above the capacity is
cut, into full containers and a rest.  Items then go by a hash of their key to
shards of bounded size, and every shard is packed by itself with linear
grouping: the large items, sorted, form groups of equal cardinality whose sizes
are rounded up to the largest of the group; configurations of these few sizes
are optimised (the fullest one by dynamic programming over the sizes still
there, used as often as they allow, until none is left); actual items of the
groups take the places, largest first; the small items are added best-fit.  A
shard wastes at most the room of a few containers more than a single packing
would, whatever the number of shards.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from codeloom.llm.common import map_columns

#: The rank file texts are measured with, and the pattern that splits text before its merges.
RANKS = os.environ.get("CODELOOM_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the pre-tokenisation pattern that belongs to the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Items in a shard, about.
SHARD_ITEMS = 20_000
#: Groups of large items in a shard; items up to this share of the capacity are small.
GROUPS = 128
SMALL = 1 / 4

_ENCODINGS: dict = {}


def encoding(path: str):
    """The tokenizer of a rank file, one for each worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODINGS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def count_tokens(texts: Iterable[str | None], path: str = RANKS) -> list[int]:
    encode = encoding(path).encode_ordinary
    return [len(encode(t)) if t else 0 for t in texts]


def measure(items: DataFrame, key: str, text: str, path: str = RANKS) -> DataFrame:
    """``key, tokens``: the size of each text; 0 for null and empty ones."""
    kind = items.select(key).dtypes[0][1]

    def run(cols: dict[str, list]) -> dict[str, list]:
        return {key: cols[key], "tokens": count_tokens(cols[text], path)}

    return map_columns(items.select(key, text), run, f"{key} {kind}, tokens bigint")


def fullest(sizes: list[int], counts: list[int], capacity: int) -> list[int]:
    """How often to take each size so that the sum is as large as the capacity allows.

    Bounded subset sum: bit s of a mask says whether sum s can be reached with
    the sizes so far; the choice is read back from the last mask to the first.
    """
    masks = [1]
    room = (1 << (capacity + 1)) - 1
    for size, count in zip(sizes, counts):
        mask, left, step = masks[-1], min(count, capacity // size), 1
        while left > 0:  # copies in powers of two
            take = min(step, left)
            mask |= (mask << (size * take)) & room
            left -= take
            step *= 2
        masks.append(mask)
    total = masks[-1].bit_length() - 1
    chosen = [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not (masks[i] >> total) & 1:
            total -= sizes[i]
            chosen[i] += 1
    return chosen


def pack_shard(sizes: np.ndarray, capacity: int, groups: int = GROUPS, small: float = SMALL) -> np.ndarray:
    """The container (from 0) of each item; no item is above the capacity."""
    n = len(sizes)
    bins = np.zeros(n, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    large = order[: int(np.count_nonzero(sizes > capacity * small))]
    room: list[int] = []
    if len(large):
        bounds = np.linspace(0, len(large), min(groups, len(large)) + 1).astype(int)
        members: dict[int, list[int]] = {}
        for a, b in zip(bounds, bounds[1:]):
            members.setdefault(int(sizes[large[a]]), []).extend(large[a:b][::-1].tolist())  # the largest is popped first
        kinds = sorted(members, reverse=True)
        while kinds:
            chosen = fullest(kinds, [len(members[k]) for k in kinds], capacity)
            often = min(len(members[k]) // c for k, c in zip(kinds, chosen) if c)
            for _ in range(often):
                left = capacity
                for k, c in zip(kinds, chosen):
                    for _ in range(c):
                        item = members[k].pop()
                        bins[item] = len(room)
                        left -= int(sizes[item])
                room.append(left)
            kinds = [k for k in kinds if members[k]]
    # Best fit for the small ones: the fullest container that still has room; bit r of the mask says some container has room r.
    by_room: dict[int, list[int]] = {}
    mask = 0
    for b, left in enumerate(room):
        by_room.setdefault(left, []).append(b)
        mask |= 1 << left
    for item in order[len(large) :]:
        size = int(sizes[item])
        fits = mask >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = by_room[left].pop()
            if not by_room[left]:
                mask &= ~(1 << left)
        else:
            b, left = len(room), capacity
            room.append(capacity)
        bins[item] = b
        room[b] = left - size
        by_room.setdefault(left - size, []).append(b)
        mask |= 1 << (left - size)
    return bins


def pack(items: DataFrame, key: str, text: str, capacity: int, path: str = RANKS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``container, key, part, first_token, tokens``: where every text is, whole or in parts.

    ``part`` counts from 1; a text of up to ``capacity`` tokens has one part, a
    longer one full parts of ``capacity`` tokens (each alone in its container)
    and a rest.  Null and empty texts have size 0 and share a container.  Keys
    are unique (repeated ones are packed as often as they come); null keys are
    packed too; other columns are ignored; an empty table gives no rows.
    """
    kind = items.select(key).dtypes[0][1]
    sized = measure(items, key, text, path)
    # A shard is a hash range of rows, by key and place in the scan, so neither null nor repeated keys can be hot.
    n = items.count()
    shards = max(1, -(-n // shard_items))
    rest = F.when(F.col("tokens") > capacity, F.col("tokens") % capacity).otherwise(F.col("tokens"))
    placed = sized.withColumn("shard", F.pmod(F.xxhash64(F.col(key).cast("string"), F.monotonically_increasing_id()), F.lit(shards)).cast("bigint"))
    placed = placed.withColumn("rest", rest.cast("bigint"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        shard = int(frame["shard"].iloc[0])
        tokens, rests = frame["tokens"].to_numpy(), frame["rest"].to_numpy()
        full = np.where(tokens > capacity, tokens // capacity, 0)
        whole = (rests > 0) | (tokens == 0)
        bins = np.full(len(frame), -1, dtype=np.int64)
        bins[whole] = pack_shard(rests[whole], capacity)
        used = int(bins.max()) + 1 if len(bins) else 0
        at = np.repeat(np.arange(len(frame)), full)
        part = np.arange(len(at)) - np.repeat(np.cumsum(full) - full, full) + 1
        keys = frame[key].to_numpy()
        out = pd.DataFrame(
            {
                "container": np.concatenate([bins[whole], used + np.arange(len(at))]) + (shard << 32),
                key: np.concatenate([keys[whole], keys[at]]),
                "part": np.concatenate([full[whole] + 1, part]).astype(np.int32),
                "first_token": np.concatenate([full[whole] * capacity, (part - 1) * capacity]),
                "tokens": np.concatenate([rests[whole], np.full(len(at), capacity)]),
            }
        )
        return out

    schema = f"container bigint, {key} {kind}, part int, first_token bigint, tokens bigint"
    return placed.groupBy("shard").applyInPandas(run, schema)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """``containers, tokens, capacity, unused_share`` of a packing, one row."""
    used = packed.groupBy("container").agg(F.sum("tokens").alias("used"))
    return used.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens")).select(
        "containers",
        "tokens",
        F.lit(capacity).cast("bigint").alias("capacity"),
        F.round(1 - F.col("tokens") / F.nullif(F.col("containers") * capacity, F.lit(0)), 6).alias("unused_share"),
    )


def capacity_of(limits: DataFrame, purpose: str = "document_container", default: int = 2048) -> int:
    """The capacity that the limits table sets for a purpose (its row without a language)."""
    row = limits.where((F.col("purpose") == purpose) & F.col("lang").isNull()).select("max_size").first()
    return int(row["max_size"]) if row and row["max_size"] else default

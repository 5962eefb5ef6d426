"""File events as streams: filters, debouncing, deduplication, limits, windows.

Every function takes a DataFrame, streaming or not, with ``path, kind, ts`` (and
what it names besides), and uses event time only, so a replay of a stream gives
what the batch gives.  Where a function keeps state, ``late`` is how late an
event may be; state older than that is dropped, and so are events later than it.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from codeloom.functions import paths

LATE = "10 minutes"


def watched(events: DataFrame, late: str = LATE) -> DataFrame:
    """A stream with its watermark; a batch as it is."""
    return events.withWatermark("ts", late) if events.isStreaming else events


def event_filter(
    events: DataFrame, ignore: Sequence[str] = (), excluded_dirs: Sequence[str] = (), include_ext: Sequence[str] = (), exclude_ext: Sequence[str] = (), size: tuple[int, int] | None = None
) -> DataFrame:
    """Events that pass, in the order of the rules: ignored places, folders, sizes, endings; a list of endings to include excludes all others."""
    p = F.col("path")
    kept = paths.path_filter(p, (), ignore)
    for d in excluded_dirs:
        kept = kept & ~F.coalesce(paths.under(p, d), F.lit(False))
    if size is not None:
        kept = kept & F.coalesce(F.col("size").between(*size), F.lit(True))
    ext = paths.extension(p)
    if exclude_ext:
        kept = kept & ~ext.isin(*exclude_ext)
    if include_ext:
        kept = kept & ext.isin(*include_ext)
    return events.where(F.coalesce(kept, F.lit(False)))


def rule_match(kind: Column, path: Column, rules: Sequence[tuple[str | None, str, str]], default: str = "accept") -> Column:
    """The action of the first rule (event kind or None, glob, action) that matches."""
    out = F
    for want, pattern, action in rules:
        hit = F.coalesce(paths.matches(path, pattern), F.lit(False))
        out = out.when(hit if want is None else hit & (kind == want), action)
    return out.otherwise(default) if rules else F.lit(default)


def debounce(events: DataFrame, gap: str, late: str = LATE) -> DataFrame:
    """``path, first_ts, kind, events``: events of a path with less than a gap between them as one, with the kind of the first.

    Emitted from a stream when the gap has passed for certain.
    """
    sessions = watched(events, late).groupBy("path", F.session_window("ts", gap).alias("w"))
    return sessions.agg(F.min("ts").alias("first_ts"), F.min_by("kind", "ts").alias("kind"), F.count("*").alias("events")).select("path", "first_ts", "kind", "events")


def tumbling(events: DataFrame, width: str, late: str = LATE) -> DataFrame:
    """``start, kind, n``: events by kind in windows that follow each other."""
    counted = watched(events, late).groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n")


def sliding(events: DataFrame, width: str, step: str, late: str = LATE) -> DataFrame:
    counted = watched(events, late).groupBy(F.window("ts", width, step).alias("w"), "kind").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "kind", "n")


def deduplicated(events: DataFrame, key: Sequence[str], late: str = "24 hours") -> DataFrame:
    """The first event of each key; in a stream, of each key within so long."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(list(key)) if events.isStreaming else events.dropDuplicates(list(key))


def first_of_each(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """The earliest event of each key, by time and id."""
    rest = [c for c in events.columns if c not in key]
    return events.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("ts", "event_id")).alias("x")).select(*key, "x.*")


def limited(events: DataFrame, width: str, most: int) -> DataFrame:
    """The first events of each window, at most so many, by time and id; for batches."""
    from pyspark.sql import Window

    rows = events.withColumn("_w", F.window("ts", width)["start"])
    w = Window.partitionBy("_w").orderBy("ts", "event_id")
    return rows.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= most).drop("_w", "_i")


def adaptive_delay(fill: Column, least: int = 100, most: int = 2000) -> Column:
    """Milliseconds to wait by how full a queue is, from 0 to 1."""
    return F.least(least + fill * (most - least), F.lit(float(most)))


def backpressure(loads: DataFrame, group: str, high: float = 0.8, low: float = 0.5) -> DataFrame:
    """``on``: whether pressure holds after each load: from the high mark until the low mark, the last mark passed decides."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("load") >= high, True).when(F.col("load") <= low, False)
    return loads.withColumn("on", F.coalesce(F.last(mark, ignorenulls=True).over(w), F.lit(False)))


_OUT = "path string, first_ts timestamp, kind string, events bigint"
_STATE = "first_ts timestamp, last_ts timestamp, kind string, events bigint"


def stateful_debounce(events: DataFrame, delay_ms: int, late: str = LATE) -> DataFrame:
    """As :func:`debounce`, with own state for each path: ready when the oldest waiting event is ``delay_ms`` old, by event time.

    Unlike sessions a steady flow of events is cut, since the oldest decides.
    """

    def step(key, batches, state: GroupState):
        out = []
        held = state.get if state.exists else None
        if state.hasTimedOut:
            if held is not None:
                out.append((key[0], *(held[0], held[2], held[3])))
            state.remove()
        else:
            frames = [b for b in batches if len(b)]
            rows = pd.concat(frames).sort_values("ts", kind="stable") if frames else pd.DataFrame()
            for ts, kind in zip(rows.get("ts", ()), rows.get("kind", ())):
                if held is not None and (ts - held[0]).total_seconds() * 1000 >= delay_ms:
                    out.append((key[0], held[0], held[2], held[3]))
                    held = None
                held = (ts, ts, kind, 1) if held is None else (held[0], ts, held[2], held[3] + 1)
            if held is not None:
                state.update(held)
                state.setTimeoutTimestamp(max(int(pd.Timestamp(held[0]).timestamp() * 1000) + delay_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["path", "first_ts", "kind", "events"])

    keyed = watched(events, late).select("path", "ts", "kind").groupBy("path")
    return keyed.applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def replay(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, to the end, into parquet; the rows it wrote."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def upsert_batches(stream: DataFrame, target: str, key: Sequence[str], checkpoint: str) -> None:
    """Apply a stream of changes (``deleted`` says which are removals) to a parquet table, a batch at a time; a batch that runs again gives the same table."""

    def apply(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        last = batch.groupBy(*key).agg(F.max_by(F.struct(*[c for c in batch.columns if c not in key]), "ts").alias("x")).select(*key, "x.*")
        path = f"{target}/v{number + 1}"
        before = f"{target}/v{number}"
        try:
            old = spark.read.parquet(before)
            rows = old.join(last.select(*key), list(key), "left_anti").unionByName(last.where(~F.col("deleted")).drop("deleted"))
        except Exception:  # the first batch has no table before it
            rows = last.where(~F.col("deleted")).drop("deleted")
        rows.write.mode("overwrite").parquet(path)

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()

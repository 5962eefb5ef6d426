"""The tables around the graph: jobs, telemetry, memory, insights, branches, projects.

Each operator takes the columns it names; rows with a null key do not count
unless stated.  Times are columns and "now" is a parameter, so a result does not
depend on when it is computed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def lsp_verdict(caller, callee, file, confidence, line) -> Column:
    """``accepted`` or the first reason to reject an observed call edge."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    return (
        F.when(empty(caller), "empty_caller_fqn").when(empty(callee), "empty_callee_fqn").when(empty(file), "empty_file")
        .when(confidence.isNull() | (confidence < 0) | (confidence > 1), "invalid_confidence_range").when(line == 0, "invalid_line_number").otherwise("accepted")
    )


def latest(rows: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of each key by an order; a column with a missing value is before all others."""
    names = [c for c in rows.columns if c not in key]
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return rows.groupBy(*key).agg(F.max_by(F.struct(*names), by).alias("x")).select(*key, "x.*")


def append_insights(existing: DataFrame, incoming: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Insights with new ones merged in; of several with an id the last by the order counts."""
    return latest(existing.unionByName(incoming).where(F.col(key).isNotNull()), [key], order)


def prune(rows: DataFrame, time: str, now: str, days: float) -> DataFrame:
    """Rows no older than so many days; rows without a time stay."""
    return rows.where(F.col(time).isNull() | (F.col(time) >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {int(days * 86400)} SECOND")))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def recent(rows: DataFrame, group: str, time: str, tie: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    w = Window.partitionBy(group).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("age_rank", F.row_number().over(w)).where(F.col("age_rank") <= n)


def claim(jobs: DataFrame, now: str, n: int) -> DataFrame:
    """The next jobs to run: pending and due, the first by when they may run and when they were made."""
    due = F.coalesce("next_attempt_at", "created_at")
    return jobs.where((F.col("status") == "pending") & (due <= F.lit(now).cast("timestamp"))).orderBy(due, "created_at", "job_id").limit(n)


def retried(jobs: DataFrame, most: int = 3) -> DataFrame:
    """Failed jobs as they are queued again: pending with a delay of 10 s doubled by each attempt, at most 300 s, or dead after too many."""
    delay = F.least(10 * F.pow(F.lit(2), F.col("attempts") - 1), F.lit(300))
    again = F.col("attempts") < most
    return jobs.withColumn("status", F.when(again, "pending").otherwise("dead")).withColumn("delay_s", F.when(again, delay.cast("int")))


def enqueue(jobs: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """One open job for each key, the first of them."""
    w = Window.partitionBy(*key).orderBy(order, "job_id")
    return jobs.withColumn("_i", F.row_number().over(w)).where(F.col("_i") == 1).drop("_i")


def changes(rows: DataFrame, group: str, order: Sequence[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before in its group; the first of a group is no change."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("before", F.lag(value).over(w)).where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def keep_newest(rows: DataFrame, group: str, order: Sequence[Column], k: int) -> DataFrame:
    """The rows beyond the newest k of each group: what a cleanup removes."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") > k)


def branch_health(indexed: DataFrame, current: DataFrame, key: Sequence[str], commit: str) -> DataFrame:
    """``key..., state``: fresh, stale or missing, by the commit that was indexed and the one there is."""
    a = indexed.select(*key, F.col(commit).alias("indexed_commit"))
    b = current.select(*key, F.col(commit).alias("current_commit"))
    state = F.when(F.col("indexed_commit").isNull(), "missing").when(F.col("indexed_commit") == F.col("current_commit"), "fresh").otherwise("stale")
    return b.join(a, list(key), "left").select(*key, state.alias("state"))


def tool_stats(calls: DataFrame, tool: str, value: str, failed: Column) -> DataFrame:
    """``tool, calls, failures, least, most, mean, error_rate``."""
    return calls.groupBy(tool).agg(
        F.count("*").alias("calls"), F.count_if(failed).alias("failures"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.avg(value), 6).alias("mean"),
        F.round(F.count_if(failed) / F.count("*"), 6).alias("error_rate"),
    )


def percentiles(rows: DataFrame, group: str, value: str, points: Sequence[float], rule: str = "nearest") -> DataFrame:
    """``group, point, value`` by an index rule: ``nearest`` is round(p (n - 1)), ``floor`` is min(floor(n p), n - 1); nulls do not count.

    Ranks come from one sort of each group; nothing is gathered.
    """
    kept = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(group)
    ranked = kept.select(group, value, (F.row_number().over(w.orderBy(value)) - 1).alias("i"), F.count("*").over(w).alias("n"))
    out = None
    for p in points:
        at = F.floor(F.lit(p) * (F.col("n") - 1) + 0.5) if rule == "nearest" else F.least(F.floor(F.col("n") * p), F.col("n") - 1)
        part = ranked.where(F.col("i") == at).select(group, F.lit(p).alias("point"), F.col(value).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def quality(rows: DataFrame, tool: str, time: str, tie: str, value: str, failed: Column, last: int = 100) -> DataFrame:
    """``tool, calls, error_rate, p95, score`` over the last calls of each tool: 0.6 for success, 0.4 for speed under a second."""
    kept = recent(rows.withColumn("_failed", failed.cast("int")), tool, time, tie, last)
    w = Window.partitionBy(tool)
    ranked = kept.withColumn("_i", F.row_number().over(w.orderBy(value, tie)) - 1).withColumn("_n", F.count("*").over(w))
    at = F.least(F.floor(F.col("_n") * 0.95), F.col("_n") - 1)
    out = ranked.groupBy(tool).agg(F.count("*").alias("calls"), F.round(F.avg("_failed"), 6).alias("error_rate"), F.max(F.when(F.col("_i") == at, F.col(value))).alias("p95"))
    return out.withColumn("score", F.round(0.6 * (1 - F.col("error_rate")) + 0.4 * F.greatest(F.lit(0.0), 1 - F.col("p95") / 1000), 6))


def system_quality(tools: DataFrame) -> DataFrame:
    """``score, band``: the mean of the tools' scores, weighted by their calls, in five bands."""
    s = tools.agg(F.round(F.sum(F.col("score") * F.col("calls")) / F.sum("calls"), 6).alias("score"))
    band = F.when(F.col("score") >= 0.9, "excellent").when(F.col("score") >= 0.75, "good").when(F.col("score") >= 0.5, "fair").when(F.col("score") >= 0.25, "poor").otherwise("critical")
    return s.withColumn("band", band)


def savings(rows: DataFrame, time: str, value: str, now: str) -> DataFrame:
    """``today, last_7_days, total``: sums by when, up to now; days are UTC days."""
    t = F.col(time)
    day = F.date_trunc("day", F.lit(now).cast("timestamp"))
    past = rows.where(t <= F.lit(now).cast("timestamp"))
    return past.agg(
        F.round(F.sum(F.when(t >= day, F.col(value)).otherwise(0)), 4).alias("today"),
        F.round(F.sum(F.when(t >= day - F.expr("INTERVAL 6 DAY"), F.col(value)).otherwise(0)), 4).alias("last_7_days"), F.round(F.sum(value), 4).alias("total"),
    )


def rate_limited(rows: DataFrame, group: str, time: str, tie: str, seconds: int, most: int) -> DataFrame:
    """Rows that come when their group has had fewer than ``most`` in the seconds before: the rule of a sliding window over all rows."""
    w = Window.partitionBy(group).orderBy(F.col("_s")).rangeBetween(-seconds, 0)
    order = Window.partitionBy(group, "_s").orderBy(tie)
    counted = rows.withColumn("_s", F.unix_timestamp(time)).withColumn("_n", F.count("*").over(w) - F.count("*").over(Window.partitionBy(group, "_s")) + F.row_number().over(order))
    return counted.where(F.col("_n") <= most).drop("_s", "_n")


def moving_average(rows: DataFrame, group: str, order: Sequence[str], value: str, n: int) -> DataFrame:
    """``average`` of the last n values up to each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-(n - 1), 0)
    return rows.withColumn("average", F.round(F.avg(value).over(w), 6))


def poll_interval(rate) -> Column:
    """How long to wait, in five steps, by how much happens."""
    return F.when(rate >= 50, 100).when(rate >= 20, 250).when(rate >= 10, 500).when(rate >= 1, 1000).otherwise(2000)


def prometheus(stats: DataFrame, name: str, label: str, value: str) -> DataFrame:
    """``line``: a counter for each row in the text format of metrics."""
    return stats.select(F.concat(F.lit(name + "{" + label + '="'), F.col(label), F.lit('"} '), F.col(value).cast("string")).alias("line"))


def cache_stats(cached: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """``hits, changed, added, gone``: a cache against the current state, by key and digest."""
    a = cached.select(key, F.col(digest).alias("a")).distinct()
    b = current.select(key, F.col(digest).alias("b")).distinct()
    j = a.join(b, key, "full")
    return j.agg(
        F.count_if(F.col("a") == F.col("b")).alias("hits"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.count_if(F.col("a").isNull()).alias("added"), F.count_if(F.col("b").isNull()).alias("gone")
    )


def stale(rows: DataFrame, key: str, refs: str, digests: DataFrame) -> DataFrame:
    """``key, stale``: whether any symbol that a row refers to (``name``, ``digest`` in an array) changed or vanished."""
    e = rows.select(key, F.explode(refs).alias("r")).select(key, F.col("r.name").alias("name"), F.col("r.digest").alias("was"))
    j = e.join(digests.select("name", "digest").groupBy("name").agg(F.max("digest").alias("now")), "name", "left")
    return j.groupBy(key).agg(F.max(F.col("now").isNull() | (F.col("now") != F.col("was"))).alias("stale"))


def phases(reports: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``phase, seconds, share``: columns of a report as rows, with their part of the whole."""
    long = reports.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("phase", "seconds"))
    per = long.groupBy("phase").agg(F.sum("seconds").alias("seconds"))
    total = per.agg(F.sum("seconds").alias("total"))
    return per.join(F.broadcast(total)).select("phase", F.round("seconds", 4).alias("seconds"), F.round(F.col("seconds") / F.col("total"), 6).alias("share"))  # one row

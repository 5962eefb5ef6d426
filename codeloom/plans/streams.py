"""Queries over event streams: the batch form with SQL, and the replayed stream.

``events`` are file events here: the user is the path, the event type the kind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from codeloom.plans.registry import Workspace, query
from codeloom.session import checkpoint_dir
from codeloom.streaming import events as op


def shaped(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.concat(F.lit("/srv/f"), F.col("user_id"), F.when(F.col("user_id") % 2 == 0, ".py").otherwise(".rs")).alias("path"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")


def batch(w: Workspace) -> DataFrame:
    return shaped(w.table("events"))


def stream(w: Workspace) -> DataFrame:
    schema = w.table("events").schema
    return shaped(w.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(w.folder))


def replayed(w: Workspace, df: DataFrame) -> DataFrame:
    """The stream run to its end; what it leaves open at the end of the events stays with it."""
    base = f"{checkpoint_dir(w.spark)}/replay-{uuid.uuid4().hex}"
    return op.replay(df, base + "/out", base + "/state")


E = "WITH e AS (SELECT event_id, '/srv/f' || user_id || CASE WHEN user_id % 2 = 0 THEN '.py' ELSE '.rs' END AS path, event_type AS kind, ts, value FROM events) "
SESSIONS = (
    E + ", g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY path ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM e), "
    "h AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), d AS (SELECT path, min(ts) AS first_ts, arg_min(kind, ts) AS kind, count(*) AS events, max(ts) AS last_ts FROM h GROUP BY path, s) "
)


@query(SESSIONS + "SELECT path, first_ts, kind, events FROM d", graph=False)
def debounce(w: Workspace):
    return op.debounce(batch(w), "30 minutes")


@query(SESSIONS + "SELECT path, first_ts, kind, events FROM d WHERE last_ts + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e)", graph=False)
def debounce_stream(w: Workspace):
    """The same from the stream: what is certain when the events end."""
    return replayed(w, op.debounce(stream(w), "30 minutes"))


@query(E + "SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS start, kind, count(*) AS n FROM e GROUP BY ALL", graph=False)
def tumbling_windows(w: Workspace):
    return op.tumbling(batch(w), "6 hours")


@query(
    E + "SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP AS start, kind, count(*) AS n FROM e WHERE time_bucket(INTERVAL 6 HOUR, ts) + INTERVAL 6 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM e) GROUP BY ALL", graph=False
)
def tumbling_stream(w: Workspace):
    return replayed(w, op.tumbling(stream(w), "6 hours"))


@query(
    E + "SELECT s::TIMESTAMP AS start, kind, count(*) AS n FROM (SELECT kind, unnest([time_bucket(INTERVAL 6 HOUR, ts), time_bucket(INTERVAL 6 HOUR, ts) - INTERVAL 6 HOUR]) AS s FROM e) GROUP BY ALL", graph=False
)
def sliding_windows(w: Workspace):
    return op.sliding(batch(w), "12 hours", "6 hours")


@query(E + "SELECT event_id FROM e WHERE ends_with(path, '.py') AND NOT contains(path, '/f10.')", graph=False)
def event_filter(w: Workspace):
    return op.event_filter(batch(w), ignore=("**/f10.*",), include_ext=("py",)).select("event_id")


@query(E + "SELECT event_id, CASE WHEN kind = 'error' AND ends_with(path, '.rs') THEN 'drop' WHEN ends_with(path, '.py') THEN 'accept' ELSE 'defer' END AS action FROM e", graph=False)
def rule_match(w: Workspace):
    rules = (("error", "**/*.rs", "drop"), (None, "**/*.py", "accept"))
    return batch(w).select("event_id", op.rule_match(F.col("kind"), F.col("path"), rules, "defer").alias("action"))


@query(E + ", r AS (SELECT event_id, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY ts, event_id) AS i FROM e) SELECT event_id FROM r WHERE i <= 5", graph=False)
def rate_limit(w: Workspace):
    return op.limited(batch(w), "1 hour", 5).select("event_id")


@query(E + ", h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS n FROM e GROUP BY 1) SELECT hour, round(least(100 + least(n / 30.0, 1.0) * 1900, 2000.0), 4)::DOUBLE AS delay FROM h", graph=False)
def adaptive_delay(w: Workspace):
    hours = batch(w).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    return hours.select("hour", F.round(op.adaptive_delay(F.least(F.col("n") / 30, F.lit(1.0))), 4).alias("delay"))


@query(
    E + ", l AS (SELECT event_id, path, ts, (event_id * 7 % 100) / 100.0 AS load FROM e), m AS (SELECT *, CASE WHEN load >= 0.8 THEN true WHEN load <= 0.5 THEN false END AS mark FROM l) "
    "SELECT event_id, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY path ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), false) AS pressed FROM m",
    graph=False,
)
def backpressure(w: Workspace):
    loads = batch(w).withColumn("load", (F.col("event_id") * 7 % 100) / 100)
    return op.backpressure(loads, "path").select("event_id", F.col("on").alias("pressed"))


@query(E + "SELECT path, kind, arg_min(event_id, (ts, event_id)) AS event_id FROM e GROUP BY ALL", graph=False)
def first_events(w: Workspace):
    return op.first_of_each(batch(w), ["path", "kind"]).select("path", "kind", "event_id")


@query(E + "SELECT DISTINCT path, kind FROM e", graph=False)
def deduplicate_events(w: Workspace):
    return op.deduplicated(batch(w), ["path", "kind"]).select("path", "kind")


@query(
    E + ", k AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY event_id ORDER BY ts) AS before FROM e) SELECT event_id FROM k WHERE before IS NULL", graph=False
)
def deduplicate_stream(w: Workspace):
    """Each event is delivered twice; the stream keeps it once."""
    s = stream(w)
    return replayed(w, op.deduplicated(s.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))), ["event_id"]).select("event_id"))


@query()
def stateful_debounce(w: Workspace):
    return replayed(w, op.stateful_debounce(stream(w), 1_800_000))


@query(E + "SELECT kind, count(*) AS n FROM e WHERE value >= 10 GROUP BY 1", graph=False)
def stream_aggregate(w: Workspace):
    """A filter and a count over the whole stream, in complete mode into memory."""
    counted = stream(w).where(F.col("value") >= 10).groupBy("kind").agg(F.count("*").alias("n"))
    name = f"agg_{uuid.uuid4().hex}"
    q = counted.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return w.spark.table(name)

"""Queries over the tables around the graph, sets of files, and sources.

``events`` stands for calls of tools: ``event_type`` is the tool, ``value`` the
latency, ``user_id`` the session.  ``deferred_files`` are rebuild records.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from codeloom.operators import control as op
from codeloom.plans.registry import Workspace, query
from codeloom.sources import tables as src

NOW = "2024-01-20 12:00:00"


def events(w: Workspace):
    return w.table("events")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1", graph=False)
def job_counts(w: Workspace):
    return op.status_counts(events(w), "event_type")


@query(
    "SELECT event_type, count(*) AS calls, count(*) FILTER (value < 5) AS failures, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, "
    "round(count(*) FILTER (value < 5) / count(*), 6) AS error_rate FROM events GROUP BY 1",
    graph=False,
)
def tool_stats(w: Workspace):
    return op.tool_stats(events(w), "event_type", "value", F.col("value") < 5)


def percentile_sql(rule: str) -> str:
    parts = [
        f"SELECT event_type, {p}::DOUBLE AS point, value FROM r WHERE i = " + (f"floor({p}::DOUBLE * (n - 1) + 0.5)" if rule == "nearest" else f"least(floor(n * {p}::DOUBLE), n - 1)")
        for p in (0.5, 0.95, 0.99)
    ]
    return "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) " + " UNION ALL ".join(parts)


@query(percentile_sql("nearest"), graph=False)
def latency_percentiles(w: Workspace):
    return op.percentiles(events(w), "event_type", "value", (0.5, 0.95, 0.99))


@query(percentile_sql("floor"), graph=False)
def quality_percentiles(w: Workspace):
    return op.percentiles(events(w), "event_type", "value", (0.5, 0.95, 0.99), "floor")


@query("SELECT event_type, round(avg(value), 6) AS p50, round(greatest(0.8 * max(value), 1.5 * avg(value)), 6) AS p95 FROM events GROUP BY 1", graph=False)
def estimated_percentiles(w: Workspace):
    """The rough estimates that tool statistics report: mean and a share of the maximum."""
    return events(w).groupBy("event_type").agg(
        F.round(F.avg("value"), 6).alias("p50"), F.round(F.greatest(0.8 * F.max("value"), 1.5 * F.avg("value")), 6).alias("p95")
    )


QUALITY = (
    "WITH l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, "
    "count(*) OVER (PARTITION BY event_type) AS n FROM l WHERE k <= 100), q AS (SELECT event_type, count(*) AS calls, round(avg(CASE WHEN value < 5 THEN 1 ELSE 0 END), 6) AS error_rate, "
    "max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN value END) AS p95 FROM r GROUP BY 1), s AS (SELECT *, round(0.6 * (1 - error_rate) + 0.4 * greatest(0.0, 1 - p95 / 1000), 6) AS score FROM q) "
)


def quality(w: Workspace):
    return op.quality(events(w), "event_type", "ts", "event_id", "value", F.col("value") < 5)


@query(QUALITY + "SELECT * FROM s", graph=False)
def quality_metrics(w: Workspace):
    return quality(w)


@query(
    QUALITY + ", t AS (SELECT round(sum(score * calls) / sum(calls), 6) AS score FROM s) SELECT score, CASE WHEN score >= 0.9 THEN 'excellent' WHEN score >= 0.75 THEN 'good' WHEN score >= 0.5 THEN 'fair' "
    "WHEN score >= 0.25 THEN 'poor' ELSE 'critical' END AS band FROM t",
    graph=False,
)
def system_quality(w: Workspace):
    return op.system_quality(quality(w))


@query("SELECT event_id, event_type, age_rank FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS age_rank FROM events) WHERE age_rank <= 100", graph=False)
def latest_samples(w: Workspace):
    return op.recent(events(w), "event_type", "ts", "event_id", 100).select("event_id", "event_type", "age_rank")


@query(
    f"SELECT round(sum(CASE WHEN ts >= date_trunc('day', TIMESTAMP '{NOW}') THEN value ELSE 0 END), 4) AS today, round(sum(CASE WHEN ts >= date_trunc('day', TIMESTAMP '{NOW}') - INTERVAL 6 DAY THEN value ELSE 0 END), 4) AS last_7_days, "
    f"round(sum(value), 4) AS total FROM events WHERE ts <= TIMESTAMP '{NOW}'",
    graph=False,
)
def savings_report(w: Workspace):
    return op.savings(events(w), "ts", "value", NOW)


@query(
    "WITH e AS (SELECT *, floor(epoch(ts))::BIGINT AS s FROM events), c AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) "
    "- count(*) OVER (PARTITION BY user_id, s) + row_number() OVER (PARTITION BY user_id, s ORDER BY event_id) AS n FROM e) SELECT event_id, user_id FROM c WHERE n <= 3",
    graph=False,
)
def memory_rate_limit(w: Workspace):
    return op.rate_limited(events(w), "user_id", "ts", "event_id", 86400, 3).select("event_id", "user_id")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS average FROM events", graph=False)
def adaptive_batch(w: Workspace):
    return op.moving_average(events(w), "event_type", ["ts", "event_id"], "value", 10).select("event_id", "average")


@query(
    "WITH h AS (SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1), a AS (SELECT hour, avg(n) OVER (ORDER BY hour ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS rate FROM h) "
    "SELECT hour::TIMESTAMP AS hour, CASE WHEN round(rate, 6) >= 50 THEN 100 WHEN round(rate, 6) >= 20 THEN 250 WHEN round(rate, 6) >= 10 THEN 500 WHEN round(rate, 6) >= 1 THEN 1000 ELSE 2000 END AS wait_ms FROM a",
    graph=False,
)
def adaptive_poll(w: Workspace):
    hours = events(w).groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    return op.moving_average(hours, "one", ["hour"], "n", 10).select("hour", op.poll_interval(F.col("average")).alias("wait_ms"))


@query("SELECT 'calls_total{event_type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type", graph=False)
def prometheus_export(w: Workspace):
    return op.prometheus(op.status_counts(events(w), "event_type"), "calls_total", "event_type", "n")


@query(
    "WITH l AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, user_id, before, event_type FROM l WHERE before IS NOT NULL AND before <> event_type",
    graph=False,
)
def branch_change_check(w: Workspace):
    return op.changes(events(w), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "before", "event_type")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k > 5", graph=False)
def old_branch_cleanup(w: Workspace):
    return op.keep_newest(events(w), "user_id", [F.desc("ts"), F.desc("event_id")], 5).select("event_id", "user_id")


@query(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY", graph=False)
def memory_prune(w: Workspace):
    return op.prune(events(w), "ts", NOW, 7).select("event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL", graph=False)
def insight_upsert(w: Workspace):
    return op.latest(events(w).select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("SELECT event_id, event_type, value FROM events WHERE user_id = 7", graph=False)
def list_insights(w: Workspace):
    return events(w).where(F.col("user_id") == 7).select("event_id", "event_type", "value")


@query("SELECT count(*) AS n FROM events WHERE user_id = 7", graph=False)
def count_insights(w: Workspace):
    return events(w).where(F.col("user_id") == 7).agg(F.count("*").alias("n"))


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' ORDER BY ts DESC, event_id LIMIT 50", graph=False)
def audit_log(w: Workspace):
    return events(w).where(F.col("ts") >= F.lit("2024-01-10 00:00:00").cast("timestamp")).orderBy(F.desc("ts"), "event_id").limit(50).select("event_id", "ts")


JOBS = (
    "j AS (SELECT event_id AS job_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'pending' END AS status, ts AS created_at, "
    "CASE WHEN user_id % 3 = 0 THEN ts + INTERVAL 1 HOUR END AS next_attempt_at, (user_id % 5 + 1)::INTEGER AS attempts, user_id AS project FROM events)"
)


def jobs(w: Workspace):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "done").otherwise("pending")
    return events(w).select(
        F.col("event_id").alias("job_id"), status.alias("status"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 3 == 0, F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("next_attempt_at"),
        (F.col("user_id") % 5 + 1).cast("int").alias("attempts"), F.col("user_id").alias("project"),
    )


@query(f"WITH {JOBS} SELECT job_id, created_at FROM j WHERE status = 'pending' AND coalesce(next_attempt_at, created_at) <= TIMESTAMP '{NOW}' ORDER BY coalesce(next_attempt_at, created_at), created_at, job_id LIMIT 20", graph=False)
def claim_next_job(w: Workspace):
    return op.claim(jobs(w), NOW, 20).select("job_id", "created_at")


@query(f"WITH {JOBS} SELECT job_id, CASE WHEN attempts < 3 THEN 'pending' ELSE 'dead' END AS status, CASE WHEN attempts < 3 THEN least(10 * pow(2, attempts - 1), 300)::INTEGER END AS delay_s FROM j WHERE status = 'failed'", graph=False)
def retry_jobs(w: Workspace):
    return op.retried(jobs(w).where(F.col("status") == "failed")).select("job_id", "status", "delay_s")


@query(f"WITH {JOBS} SELECT job_id, project FROM (SELECT *, row_number() OVER (PARTITION BY project, status ORDER BY created_at, job_id) AS i FROM j) WHERE i = 1", graph=False)
def enqueue_jobs(w: Workspace):
    return op.enqueue(jobs(w), ["project", "status"], "created_at").select("job_id", "project")


@query(f"WITH {JOBS} SELECT job_id, status FROM j ORDER BY created_at DESC, job_id LIMIT 100", graph=False)
def list_jobs(w: Workspace):
    return jobs(w).orderBy(F.desc("created_at"), "job_id").limit(100).select("job_id", "status")


RECORDS = "r AS (SELECT path, max(repository_path) AS repository_path, max(branch) AS branch, max(content_hash) AS content_hash, min(content_hash) AS first_hash FROM deferred_files WHERE path IS NOT NULL GROUP BY 1)"


def records(w: Workspace):
    return w.table("deferred_files").where(F.col("path").isNotNull()).groupBy("path").agg(
        F.max("repository_path").alias("repository_path"), F.max("branch").alias("branch"), F.max("content_hash").alias("content_hash"), F.min("content_hash").alias("first_hash")
    )


FILES = "fl AS (SELECT path, max(md5(source)) AS content_hash FROM nodes WHERE kind = 'FILE' AND path IS NOT NULL AND source IS NOT NULL GROUP BY 1)"


def files(w: Workspace):
    return w.graph.raw_nodes.where((F.col("kind") == "FILE") & F.col("path").isNotNull() & F.col("source").isNotNull()).groupBy("path").agg(F.max(F.md5("source")).alias("content_hash"))


@query(
    f"WITH {RECORDS}, {FILES}, j AS (SELECT coalesce(r.path, fl.path) AS path, r.content_hash AS a, fl.content_hash AS b FROM r FULL JOIN fl ON r.path = fl.path), k AS (SELECT * FROM j WHERE a IS NULL OR b IS NULL OR a <> b), "
    "g AS (SELECT DISTINCT a FROM k WHERE b IS NULL) SELECT path, CASE WHEN a IS NULL AND b IN (SELECT a FROM g WHERE a IS NOT NULL) THEN 'renamed' WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'deleted' ELSE 'changed' END AS state FROM k",
    graph=False,
)
def incremental_diff_plan(w: Workspace):
    return src.changed_files(records(w).select("path", "content_hash"), files(w))


@query(f"WITH {RECORDS}, {FILES} SELECT fl.path FROM fl WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.path = fl.path AND r.content_hash = fl.content_hash)", graph=False)
def filter_changed_files(w: Workspace):
    return files(w).join(records(w).select("path", "content_hash"), ["path", "content_hash"], "left_anti").select("path")


@query(f"WITH {RECORDS}, {FILES} SELECT path FROM r WHERE path NOT IN (SELECT path FROM fl)", graph=False)
def prune_missing_files(w: Workspace):
    return records(w).join(files(w), "path", "left_anti").select("path")


@query(
    f"WITH {RECORDS}, {FILES}, j AS (SELECT r.content_hash AS a, fl.content_hash AS b, r.path AS x, fl.path AS y FROM r FULL JOIN fl ON r.path = fl.path) SELECT count(*) FILTER (a = b) AS hits, count(*) FILTER (a <> b) AS changed, "
    "count(*) FILTER (a IS NULL) AS added, count(*) FILTER (b IS NULL) AS gone FROM j",
    graph=False,
)
def incremental_cache_stats(w: Workspace):
    return op.cache_stats(records(w), files(w), "path", "content_hash")


@query(
    f"WITH {RECORDS}, c AS (SELECT DISTINCT path, first_hash AS h FROM r) SELECT r.path, CASE WHEN c.h IS NULL THEN 'missing' WHEN c.h = r.content_hash THEN 'fresh' ELSE 'stale' END AS state FROM r LEFT JOIN c ON c.path = r.path",
    graph=False,
)
def branch_health(w: Workspace):
    r = records(w)
    return op.branch_health(r.select("path", F.col("first_hash").alias("content_hash")), r.select("path", "content_hash"), ["path"], "content_hash")


@query("SELECT path, max(content_hash) AS content_hash, max(written_at) AS written_at FROM deferred_files WHERE path IS NOT NULL AND written_at IS NOT NULL GROUP BY 1 HAVING count(*) > 1", graph=False)
def repeated_records(w: Workspace):
    rows = w.table("deferred_files").where(F.col("path").isNotNull() & F.col("written_at").isNotNull())
    return rows.groupBy("path").agg(F.max("content_hash").alias("content_hash"), F.max("written_at").alias("written_at"), F.count("*").alias("n")).where(F.col("n") > 1).drop("n")


@query(
    "WITH d AS (SELECT f.path, f.content_hash AS was, max(md5(n.source)) AS now FROM deferred_files f LEFT JOIN nodes n ON n.path = f.path AND n.kind = 'FILE' AND n.source IS NOT NULL WHERE f.path IS NOT NULL AND f.content_hash IS NOT NULL GROUP BY ALL) "
    "SELECT path, bool_or(now IS NULL OR now <> was) AS stale FROM d GROUP BY 1",
    graph=False,
)
def memory_staleness(w: Workspace):
    d = w.table("deferred_files").where(F.col("path").isNotNull() & F.col("content_hash").isNotNull())
    refs = d.groupBy("path").agg(F.collect_set(F.struct(F.col("path").alias("name"), F.col("content_hash").alias("digest"))).alias("refs"))
    return op.stale(refs, "path", "refs", files(w).select(F.col("path").alias("name"), F.col("content_hash").alias("digest")))


@query(
    "WITH p AS (SELECT sum(l_quantity) AS parse, sum(l_discount) AS flush, sum(l_tax) AS resolve FROM lineitem), l AS (SELECT unnest(['parse', 'flush', 'resolve']) AS phase, unnest([parse, flush, resolve]) AS seconds FROM p) "
    "SELECT phase, round(seconds, 4) AS seconds, round(seconds / (SELECT sum(seconds) FROM l), 6) AS share FROM l",
    graph=False,
)
def phase_rows(w: Workspace):
    report = w.table("lineitem").agg(F.sum("l_quantity").alias("parse"), F.sum("l_discount").alias("flush"), F.sum("l_tax").alias("resolve"))
    return op.phases(report, ["parse", "flush", "resolve"])


# -- sources and sinks

HOT = "/srv/checkouts/weighted-digest-service"


@query("x AS (SELECT DISTINCT id FROM n WHERE kind = 'CLASS');; SELECT n.id, CASE WHEN n.id IN (SELECT id FROM x) THEN 'CHANGED' ELSE n.name END AS name FROM n")
def upsert_nodes(w: Workspace):
    cols = ["id", "kind", "name", "path"]
    new = w.graph.of_kind("CLASS").select(*cols).withColumn("name", F.lit("CHANGED"))
    base = w.graph.nodes.select(*cols)
    return src.upsert_nodes(base, new.union(new)).select("id", "name")


@query("SELECT DISTINCT src, dst, kind FROM e WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def upsert_edges(w: Workspace):
    e = w.graph.raw_edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return src.upsert_edges(e.where(F.col("kind") != "CALLS"), e.where(F.col("kind") == "CALLS"), w.graph.raw_nodes)


@query(f"SELECT DISTINCT src, dst, kind FROM e WHERE src NOT IN (SELECT id FROM n WHERE repository_path = '{HOT}') AND dst NOT IN (SELECT id FROM n WHERE repository_path = '{HOT}')")
def delete_repository(w: Workspace):
    return src.delete_repository(w.graph, HOT)[1]


@query(f"SELECT id FROM n WHERE repository_path IS DISTINCT FROM '{HOT}'")
def repository_nodes_left(w: Workspace):
    return src.delete_repository(w.graph, HOT)[0].select("id").distinct()


@query("SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM deferred_files t WHERE t.path = n.path AND t.branch = n.branch AND t.repository_path = n.repository_path AND t.node_count % 7 = 0)")
def file_tombstones(w: Workspace):
    t = w.table("deferred_files").where(F.col("node_count") % 7 == 0)
    return src.without_tombstones(w.graph.nodes, t).select("id")


@query("SELECT path FROM n WHERE kind = 'FILE' AND NOT regexp_matches(path, '/(node_modules|target|dist|build|\\.git|vendor|__pycache__)/|\\.min\\.js$|\\.lock$')")
def collect_index_files(w: Workspace):
    return src.index_files(w.graph.of_kind("FILE")).select("path")


@query("SELECT path, regexp_matches(path, '/(lib|vendor)/') AND NOT ends_with(path, '.rs') AS ignored FROM n WHERE kind = 'FILE'")
def ignore_test(w: Workspace):
    return w.graph.of_kind("FILE").select("path", src.ignored("path", ("**/lib/**", "**/vendor/**", "!**/*.rs")).alias("ignored"))


@query("SELECT path FROM n WHERE kind = 'FILE' AND NOT regexp_matches(path, '/tests/')")
def policy_exclude(w: Workspace):
    files_ = w.graph.of_kind("FILE")
    return files_.where(~src.ignored("path", ("**/tests/**",))).select("path")


@query(
    "l AS (SELECT id, unnest(string_split(source, chr(10))) AS line, generate_subscripts(string_split(source, chr(10)), 1) AS i FROM n WHERE kind = 'FILE' AND source IS NOT NULL);; "
    "SELECT id, i AS line_number, regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 1)::INTEGER AS old_start, CASE WHEN regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 2) = '' THEN 1 ELSE regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 2)::INTEGER END AS old_count, "
    "regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 3)::INTEGER AS new_start, CASE WHEN regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 4) = '' THEN 1 ELSE regexp_extract(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@', 4)::INTEGER END AS new_count "
    "FROM l WHERE regexp_matches(line, '^@@ -(\\d+)(?:,(\\d+))? \\+(\\d+)(?:,(\\d+))? @@')"
)
def diff_hunks(w: Workspace):
    return src.diff_hunks(w.graph.of_kind("FILE"), "id", "source")


@query("SELECT repository_path, 'python' AS build_system, count(*) AS files FROM n WHERE kind = 'FILE' AND regexp_extract(path, '[^/]+$', 0) IN ('setup.py', 'requirements.txt', 'pyproject.toml') GROUP BY 1")
def build_systems(w: Workspace):
    return src.build_systems(w.graph.of_kind("FILE"))


@query(f"SELECT kind, count(*) AS n FROM n WHERE repository_path = '{HOT}' GROUP BY 1")
def raw_user_query(w: Workspace):
    return src.query_tables(w.graph, "SELECT kind, count(*) AS n FROM {nodes} WHERE repository_path = :repo GROUP BY kind", repo=HOT)


@query(f"SELECT id FROM n WHERE repository_path = '{HOT}' AND name = 'it''s; DROP'")
def parameter_escaping(w: Workspace):
    return src.query_tables(w.graph, "SELECT id FROM {nodes} WHERE repository_path = :repo AND name = :name", repo=HOT, name="it's; DROP")


@query("SELECT id, json_object('id', id, 'name', name)::VARCHAR AS row_json FROM n WHERE kind = 'REPOSITORY'")
def output_json(w: Workspace):
    return w.graph.of_kind("REPOSITORY").select("id", F.to_json(F.struct("id", "name")).alias("row_json"))


# -- sets


@query("SELECT DISTINCT name FROM f WHERE repository_path = '/srv/checkouts/weighted-digest-service' INTERSECT SELECT DISTINCT name FROM f WHERE repository_path = '/srv/checkouts/atlas-monorepo'")
def shared_functions(w: Workspace):
    f = w.graph.callables
    one = f.where(F.col("repository_path") == HOT).select("name")
    return one.intersect(f.where(F.col("repository_path") == "/srv/checkouts/atlas-monorepo").select("name"))


@query("SELECT DISTINCT name FROM f WHERE repository_path = '/srv/checkouts/weighted-digest-service' EXCEPT SELECT DISTINCT name FROM f WHERE repository_path = '/srv/checkouts/atlas-monorepo'")
def unique_functions(w: Workspace):
    f = w.graph.callables
    one = f.where(F.col("repository_path") == HOT).select("name").distinct()
    return one.join(f.where(F.col("repository_path") == "/srv/checkouts/atlas-monorepo").select("name"), "name", "left_anti")


@query("SELECT kind, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e WHERE kind IN ('CALLS', 'IMPORTS') GROUP BY 1")
def multi_kind_edges(w: Workspace):
    e = w.graph.edges.where(F.col("kind").isin("CALLS", "IMPORTS"))
    return e.groupBy("kind").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


GRAMS = "list_distinct(list_concat(list_transform(range(1, greatest(length({0}), 1)), lambda i: substr({0}, i, 2)), list_transform(range(1, greatest(length({0}) - 1, 1)), lambda i: substr({0}, i, 3))))"


@query(f"SELECT id, len(list_intersect({GRAMS.format('name')}, {GRAMS.format(chr(39) + 'snapshot' + chr(39))})) AS overlap FROM f WHERE length(name) >= 3")
def ngram_overlap(w: Workspace):
    from codeloom.functions import scores

    f = w.graph.callables.where(F.length("name") >= 3)
    return f.select("id", F.size(F.array_intersect(scores.ngrams("name"), scores.ngrams(F.lit("snapshot")))).alias("overlap"))


@query(
    "WITH b AS (SELECT id, max(list_sort(list_distinct(list_filter(tokens, lambda t: t IS NOT NULL)))) AS t FROM function_bodies WHERE id IS NOT NULL AND tokens IS NOT NULL GROUP BY 1), o AS (SELECT id, t, lag(t) OVER (ORDER BY id) AS u FROM b) "
    "SELECT id, round(CASE WHEN len(list_distinct(list_concat(t, u))) > 0 THEN len(list_intersect(t, u)) / len(list_distinct(list_concat(t, u))) ELSE 0.0 END, 6) AS jaccard FROM o WHERE u IS NOT NULL",
    graph=False,
)
def jaccard_of_neighbours(w: Workspace):
    from codeloom.functions import text as tx

    items = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())))
    b = w.table("function_bodies").where(F.col("id").isNotNull() & F.col("tokens").isNotNull()).groupBy("id").agg(F.max(items).alias("t"))
    o = b.withColumn("u", F.lag("t").over(Window.orderBy("id"))).where(F.col("u").isNotNull())
    return o.select("id", F.round(tx.jaccard(F.col("t"), F.col("u")), 6).alias("jaccard"))

"""Reports, queues, hashes and stages that stand beside the main queries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from codeloom import pipeline
from codeloom.functions import scores, text as tx
from codeloom.operators import relations, smells, vectors
from codeloom.plans.control import FILES, NOW, RECORDS, events, files, records
from codeloom.plans.registry import Workspace, query
from codeloom.plans.text import AGE, DOCS, RULE, SOURCES, age, docs, sources
from codeloom.sources import tables as src

SYM = "SELECT DISTINCT repository_path, name, kind FROM n WHERE kind IN ('FUNCTION', 'METHOD', 'CLASS') AND repository_path IS NOT NULL AND branch = '{}'"


@query(f"u AS (({SYM.format('develop')} EXCEPT {SYM.format('main')}) UNION ALL ({SYM.format('main')} EXCEPT {SYM.format('develop')}));; SELECT kind, count(*) AS changes, count(DISTINCT repository_path) AS repositories FROM u GROUP BY 1")
def diff_summary(w: Workspace):
    both = relations.branch_only(w.graph, "develop", "main").unionByName(relations.branch_only(w.graph, "main", "develop"))
    return both.groupBy("kind").agg(F.count("*").alias("changes"), F.countDistinct("repository_path").alias("repositories"))


@query("SELECT kind, count(*) AS edges, round(count(*) / (SELECT count(*) FROM n), 6) AS per_node, round(count(*) / (SELECT count(*) FROM n WHERE kind = 'FILE'), 6) AS per_file FROM e GROUP BY 1")
def index_report(w: Workspace):
    sizes = w.graph.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "FILE").alias("files"))
    per = w.graph.edges.groupBy("kind").agg(F.count("*").alias("edges"))
    return per.join(F.broadcast(sizes)).select("kind", "edges", F.round(F.col("edges") / F.col("nodes"), 6).alias("per_node"), F.round(F.col("edges") / F.col("files"), 6).alias("per_file"))  # one row


@query()
def pattern_summary(w: Workspace):
    return smells.patterns(w.graph.of_kind("FUNCTION", "METHOD", "CLASS")).groupBy("pattern").agg(F.count("*").alias("n"), F.max("confidence").alias("best"))


@query(
    "WITH s AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'treatment' END AS mode, sum(value) AS tokens, count(*) AS calls FROM events GROUP BY ALL) SELECT mode, count(*) AS sessions, round(avg(tokens), 4) AS tokens, round(avg(calls), 4) AS calls FROM s GROUP BY 1",
    graph=False,
)
def measurement_report(w: Workspace):
    """Each child is summed by session before sessions are compared, so that joins do not multiply them."""
    mode = F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("treatment")
    per = events(w).groupBy("user_id", mode.alias("mode")).agg(F.sum("value").alias("tokens"), F.count("*").alias("calls"))
    return per.groupBy("mode").agg(F.count("*").alias("sessions"), F.round(F.avg("tokens"), 4).alias("tokens"), F.round(F.avg("calls"), 4).alias("calls"))


@query(
    DOCS + f", i AS (SELECT doc_id, round(0.9 * pow(0.95, {AGE.replace('epoch(collected_at)', 'floor(epoch(collected_at))')}), 6) AS importance FROM d WHERE collected_at IS NOT NULL) SELECT doc_id, importance FROM i WHERE importance < 0.01", graph=False
)
def find_low_importance(w: Workspace):
    d = docs(w).where(F.col("collected_at").isNotNull())
    return d.select("doc_id", F.round(scores.decayed_importance(F.lit(0.9), age(), F.lit("note"), F.lit(0)), 6).alias("importance")).where(F.col("importance") < 0.01)


HASH = "(('0x' || substr(md5({0}), 1, 15))::BIGINT % 2147483647)"
COEFF = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in map(tx.coefficients, range(tx.SLOTS))) + "]"


@query(
    f"WITH b AS (SELECT id, max(list_sort(list_distinct(list_filter(tokens, lambda t: t IS NOT NULL)))) AS t FROM function_bodies WHERE id IS NOT NULL GROUP BY 1), h AS (SELECT id, list_transform(t, lambda x: {HASH.format('x')}) AS h FROM b WHERE len(t) > 0), "
    f"g AS (SELECT id, list_transform({COEFF}, lambda p: list_min(list_transform(h, lambda x: (p.a * x + p.b) % 2147483647))) AS sig FROM h) SELECT id, i AS band, md5(i || ':' || array_to_string(sig[i * 4 + 1:i * 4 + 4], ',')) AS key FROM g, range(16) r(i)",
    graph=False,
)
def lsh_bands(w: Workspace):
    from codeloom.operators.clones import signed

    items = F.array_sort(F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())))
    b = w.table("function_bodies").where(F.col("id").isNotNull()).groupBy("id").agg(F.max(items).alias("items")).where(F.size("items") > 0)
    keys = signed(b.withColumnRenamed("id", "class")).select(F.col("class").alias("id"), F.posexplode(tx.bands(F.col("sig"))).alias("band", "key"))
    return keys.select("id", "band", F.md5("key").alias("key"))


@query(
    "WITH v AS (SELECT vec_id, max(embedding) AS e FROM code_vectors WHERE vec_id IS NOT NULL AND len(embedding) > 2 GROUP BY 1) SELECT a.vec_id, round(coalesce(CASE WHEN isnan(list_sum(list_transform(a.e, lambda x: x::DOUBLE))) THEN 0.0 "
    "WHEN list_sum(list_transform(a.e, lambda x: x::DOUBLE * x)) = 0 THEN 0.0 ELSE list_sum(list_transform(list_zip(a.e, list_reverse(a.e)), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / list_sum(list_transform(a.e, lambda x: x::DOUBLE * x)) END, 0.0), 6) AS score FROM v a",
    graph=False,
)
def cosine_similarity(w: Workspace):
    """Each vector with its own reverse."""
    v = w.table("code_vectors").where(F.col("vec_id").isNotNull() & (F.size("embedding") > 2)).groupBy("vec_id").agg(F.max("embedding").alias("e"))
    return v.select("vec_id", F.round(vectors.cosine(F.col("e"), F.reverse("e")), 6).alias("score"))


@query(
    "x AS (SELECT id, name, unnest(range(1, 9)) AS i FROM f WHERE length(name) > 0 AND NOT regexp_matches(name, '[^\\x00-\\x7f]'));; SELECT id, i::INTEGER AS slot, round(CASE WHEN length(name) >= i THEN ascii(substr(name, (i + 8 * ((length(name) - i) // 8))::BIGINT, 1)) / 255.0 ELSE 0.0 END, 6)::DOUBLE AS value FROM x"
)
def character_embedding(w: Workspace):
    f = w.graph.callables.where((F.length("name") > 0) & ~F.col("name").rlike(r"[^\x00-\x7f]"))
    e = f.select("id", F.posexplode(pipeline.CharacterEmbedder(8).embed(F.col("name"))).alias("i", "v"))
    return e.select("id", (F.col("i") + 1).alias("slot"), F.round("v", 6).alias("value"))


@query("SELECT event_id, sha256(user_id || ':' || event_type) AS insight_id FROM events", graph=False)
def insight_ids(w: Workspace):
    return events(w).select("event_id", F.sha2(F.concat_ws(":", "user_id", "event_type"), 256).alias("insight_id"))


WIDE = (RULE + "|^(?:import|from|use|require|require_relative|package|#include|using)\\b|^(?:///|/\\*\\*|\\*|#:|\"\"\")")


@query(
    f"{SOURCES};; SELECT id, md5(array_to_string(list_transform(list_filter(string_split(replace(source, chr(13), ''), chr(10)), lambda x: regexp_matches(ltrim(x, ' '), '{WIDE}')), lambda x: substr(rtrim(x, ' '), 1, 120)), chr(10))) AS digest FROM s"
)
def skeleton_standard(w: Workspace):
    return sources(w).select("id", F.md5(tx.skeleton(F.col("source"), minimal=False)).alias("digest"))


@query(f"SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE ts <= TIMESTAMP '{NOW}') WHERE k <= 10", graph=False)
def bounded_queue(w: Workspace):
    """What a queue of ten for each path still holds: the oldest are dropped."""
    rows = events(w).where(F.col("ts") <= F.lit(NOW).cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("k", F.row_number().over(order)).where(F.col("k") <= 10).select("event_id")


@query(f"SELECT user_id, max(event_id) AS event_id FROM events WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '{NOW}' GROUP BY 1", graph=False)
def cache_ttl(w: Workspace):
    """The entries of a cache that have not expired, the newest of each key."""
    now = F.lit(NOW).cast("timestamp")
    return events(w).where((F.col("ts") > now - F.expr("INTERVAL 6 HOUR")) & (F.col("ts") <= now)).groupBy("user_id").agg(F.max("event_id").alias("event_id"))


@query("SELECT id, row_number() OVER (PARTITION BY path ORDER BY line_number, id) - 1 AS rank FROM f")
def rank_map(w: Workspace):
    order = Window.partitionBy("path").orderBy("line_number", "id")
    return w.graph.callables.select("id", (F.row_number().over(order) - 1).alias("rank"))


@query(
    f"{RECORDS}, {FILES}, ch AS (SELECT fl.path FROM fl LEFT JOIN r ON r.path = fl.path WHERE r.path IS NULL OR r.content_hash <> fl.content_hash);; "
    "SELECT id, CASE WHEN path IN (SELECT path FROM ch) THEN 'reinserted' ELSE 'kept' END AS state FROM n WHERE path IS NOT NULL"
)
def apply_incremental_change(w: Workspace):
    """Nodes of files that changed since their record go out and come in anew; the others stay."""
    changed = src.changed_files(records(w).select("path", "content_hash"), files(w)).where(F.col("state").isin("added", "changed", "renamed")).select("path")
    n = w.graph.nodes.where(F.col("path").isNotNull()).select("id", "path")
    kept = n.join(changed, "path", "left_anti").select("id", F.lit("kept").alias("state"))
    return kept.unionByName(n.join(changed, "path", "left_semi").select("id", F.lit("reinserted").alias("state")))


@query()
def pipeline_load(w: Workspace):
    """extract, weigh, embed and load as one plan."""
    stages = [pipeline.extracted, pipeline.weighed, pipeline.embedded(pipeline.FallbackEmbedder(pipeline.CharacterEmbedder(), pipeline.StaticEmbedder())), pipeline.loaded]
    return pipeline.run(sources(w).select("path", "source"), stages)


@query("SELECT kind, sum(CASE WHEN length(source) > 0 THEN greatest(ceil(length(source) / 4.0), 1) ELSE 0 END)::BIGINT AS tokens FROM n GROUP BY 1")
def functions_in_sql(w: Workspace):
    """The engine's functions called from SQL."""
    pipeline.register_functions(w.spark)
    return src.query_tables(w.graph, "SELECT kind, sum(coalesce(token_estimate(source), 0)) AS tokens FROM {nodes} GROUP BY kind")

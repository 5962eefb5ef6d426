"""Queries that compute scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import scores, text as tx
from codeloom.plans.registry import Workspace, query

SOURCES = "s AS (SELECT id, name, path, lang, source FROM n WHERE kind = 'FILE' AND source IS NOT NULL)"
AS_OF = "TIMESTAMP '2025-06-01 00:00:00'"


def sources(w: Workspace):
    return w.graph.of_kind("FILE").where(F.col("source").isNotNull())


def docs(w: Workspace):
    return w.table("documents").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())


DOCS = "WITH d AS (SELECT * FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) "


def count_sql(col: str, token: str) -> str:
    return f"((length({col}) - length(replace({col}, '{token}', ''))) // {len(token)})"


CYCLO = "1 + " + " + ".join(count_sql("source", t) for t in tx.BRANCHES)


@query(f"{SOURCES};; SELECT id, ({CYCLO})::INTEGER AS complexity FROM s")
def cyclomatic_complexity(w: Workspace):
    return sources(w).select("id", tx.cyclomatic(F.col("source")).alias("complexity"))


@query(f"{SOURCES};; SELECT rating, count(*) AS n FROM (SELECT CASE WHEN k <= 5 THEN 'simple' WHEN k <= 10 THEN 'moderate' WHEN k <= 20 THEN 'complex' ELSE 'very_complex' END AS rating FROM (SELECT {CYCLO} AS k FROM s)) GROUP BY 1")
def complexity_rating(w: Workspace):
    return sources(w).select(tx.rating(tx.cyclomatic(F.col("source"))).alias("rating")).groupBy("rating").agg(F.count("*").alias("n"))


@query()
def cognitive_complexity(w: Workspace):
    return sources(w).select("id", tx.cognitive(F.col("source")).alias("complexity"))


TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: strlen(x) > 1)"
BODY = "list_transform(list_filter(regexp_split_to_array({0}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: strlen(x) > 2), lambda x: lower(x))"


@query(DOCS + f"SELECT doc_id, len({TOKENS.format('text')}) AS n, array_to_string({TOKENS.format('text')}[1:20], ' ') AS head FROM d", graph=False)
def tokenize(w: Workspace):
    t = tx.tokens(F.col("text"))
    return docs(w).select("doc_id", F.size(t).alias("n"), F.array_join(F.slice(t, 1, 20), " ").alias("head"))


@query(f"{SOURCES};; SELECT id, len({BODY.format('source')}) AS n, len(list_distinct({BODY.format('source')})) AS distinct_n FROM s")
def tokenize_body(w: Workspace):
    t = tx.body_tokens(F.col("source"))
    return sources(w).select("id", F.size(t).alias("n"), F.size(F.array_distinct(t)).alias("distinct_n"))


LINE = "regexp_extract_all({0}, '(\\w+|[^\\w\\s])', 1)"


@query(f"{SOURCES};; SELECT id, len({LINE.format('source')}) AS n FROM s WHERE NOT regexp_matches(source, '[^\\x00-\\x7f]')")
def tokenize_line(w: Workspace):
    """Files of plain characters: what a word character is beyond them differs between engines."""
    plain = sources(w).where(~F.col("source").rlike(r"[^\x00-\x7f]"))
    return plain.select("id", F.size(tx.line_tokens(F.col("source"))).alias("n"))


WORDS = ", ".join(f"'{k}'" for k in tx.KEYWORDS)


@query(
    f"{SOURCES};; SELECT id, array_to_string(list_transform({LINE.format('split_part(source, chr(10), 4)')}, lambda x: CASE WHEN lower(x) IN ({WORDS}) THEN x "
    "WHEN regexp_matches(x, '^[0-9]') THEN '_NUM_' WHEN regexp_matches(x, '^\\w') THEN '_ID_' ELSE x END), ' ') AS line FROM s WHERE NOT regexp_matches(source, '[^\\x00-\\x7f]')"
)
def normalize_tokens(w: Workspace):
    plain = sources(w).where(~F.col("source").rlike(r"[^\x00-\x7f]"))
    line = F.split_part("source", F.lit("\n"), F.lit(4))
    return plain.select("id", F.array_join(tx.normal_tokens(line), " ").alias("line"))


HASH = "(('0x' || substr(md5({0}), 1, 15))::BIGINT % 2147483647)"


@query(
    "WITH b AS (SELECT id, list_distinct(list_transform(list_filter(tokens, lambda t: t IS NOT NULL), lambda t: " + HASH.format("t") + ")) AS h FROM function_bodies WHERE id IS NOT NULL AND tokens IS NOT NULL) "
    "SELECT DISTINCT id, " + ", ".join(f"list_min(list_transform(h, lambda x: ({a} * x + {b}) % 2147483647)) AS s{i}" for i, (a, b) in enumerate(map(tx.coefficients, range(4)))) + " FROM b WHERE len(h) > 0",
    graph=False,
)
def minhash_signature(w: Workspace):
    """The first four of the 64 slots."""
    rows = w.table("function_bodies").where(F.col("id").isNotNull() & F.col("tokens").isNotNull())
    sig = tx.minhash(F.transform(F.filter("tokens", lambda t: t.isNotNull()), tx.token_hash))
    signed = rows.select("id", sig.alias("sig")).where(F.col("sig").isNotNull())
    return signed.select("id", *[F.col("sig")[i].alias(f"s{i}") for i in range(4)]).distinct()


@query(DOCS + "SELECT doc_id, (CASE WHEN length(text) = 0 THEN 0 ELSE greatest(ceil(length(text) / 4.0), 1) END)::INTEGER AS tokens FROM d", graph=False)
def count_tokens(w: Workspace):
    return docs(w).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(DOCS + "SELECT source, greatest(ceil(sum(length(text))::DOUBLE / greatest(count(*), 1) * 5000), sum(length(text)))::BIGINT AS baseline FROM d GROUP BY 1", graph=False)
def baseline_extrapolation(w: Workspace):
    per = docs(w).groupBy("source").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    return per.select("source", scores.extrapolated(F.col("chars"), F.col("n"), F.lit(5000)).cast("bigint").alias("baseline"))


@query(DOCS + "SELECT doc_id, greatest(coalesce(n_chars, 0) - 500, 0)::BIGINT AS saved FROM d", graph=False)
def token_savings(w: Workspace):
    return docs(w).select("doc_id", scores.saved(F.coalesce("n_chars", F.lit(0)), F.lit(500)).alias("saved"))


ENTROPY = "list_sum(list_transform(list_distinct(string_split({0}, '')), lambda ch: -((length({0}) - length(replace({0}, ch, ''))) / length({0})) * log2((length({0}) - length(replace({0}, ch, ''))) / length({0}))))"


@query("SELECT id, round(" + ENTROPY.format("name") + ", 6) AS entropy FROM f WHERE length(name) > 0")
def shannon_entropy(w: Workspace):
    return w.graph.callables.where(F.length("name") > 0).select("id", F.round(tx.entropy(F.col("name")), 6).alias("entropy"))


CUES = " OR ".join(f"contains(lower(text), '{c}')" for c in tx.SENSITIVE)


@query(
    DOCS + ", x AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda z: strlen(z) >= 32)) AS word FROM d), "
    f"h AS (SELECT DISTINCT doc_id FROM x WHERE len(list_distinct(string_split(word, ''))) >= 8 AND {ENTROPY.format('word')} > 4) SELECT doc_id, ({CUES}) OR doc_id IN (SELECT doc_id FROM h) AS sensitive FROM d",
    graph=False,
)
def looks_sensitive(w: Workspace):
    return docs(w).select("doc_id", tx.looks_sensitive(F.col("text")).alias("sensitive"))


@query(
    f"{SOURCES};; SELECT id, md5(regexp_replace(source, '(?im)^[^\\n]*(?:{'|'.join(tx.REDACTED)})[^\\n]*$', '[REDACTED_SECRET_LINE]', 'g')) AS digest FROM s WHERE NOT contains(source, chr(13))"
)
def redact_secrets(w: Workspace):
    """Files with plain line ends: what ends a line differs between engines."""
    return sources(w).where(~F.col("source").contains("\r")).select("id", F.md5(tx.redact(F.col("source"))).alias("digest"))


@query(
    "SELECT id, trim(regexp_replace(regexp_extract(source, '(?s)^(.*?)(?:\\{|:[ \\t]*(?:\\n|$)|\\z)', 1), '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')) AS signature FROM f WHERE source IS NOT NULL"
)
def get_signature(w: Workspace):
    return w.graph.callables.where(F.col("source").isNotNull()).select("id", tx.signature_preview(F.col("source")).alias("signature"))


RULE = tx._SIGNATURE.replace("'", "''")


@query(
    f"{SOURCES};; SELECT id, md5(array_to_string(list_transform(list_filter(string_split(replace(source, chr(13), ''), chr(10)), lambda x: regexp_matches(ltrim(x), '{RULE}')), lambda x: substr(rtrim(x), 1, 100)), chr(10))) AS digest FROM s"
)
def get_skeleton(w: Workspace):
    return sources(w).select("id", F.md5(tx.skeleton(F.col("source"))).alias("digest"))


@query(
    f"{SOURCES};; SELECT id, round(CASE WHEN length(source) > 0 THEN 1 - length(array_to_string(list_transform(list_filter(string_split(replace(source, chr(13), ''), chr(10)), "
    f"lambda x: regexp_matches(ltrim(x), '{RULE}')), lambda x: substr(rtrim(x), 1, 100)), chr(10))) / length(source) ELSE 0.0 END, 6) AS ratio FROM s"
)
def compression_ratio(w: Workspace):
    return sources(w).select("id", tx.compression_ratio(F.col("source"), tx.skeleton(F.col("source"))).alias("ratio"))


@query()
def nesting_depth(w: Workspace):
    return sources(w).select("id", tx.nesting_depth(F.col("source")).alias("depth"))


LINES = "(CASE WHEN length(source) = 0 THEN 0 ELSE length(source) - length(replace(source, chr(10), '')) + CASE WHEN ends_with(source, chr(10)) THEN 0 ELSE 1 END END)"


@query(f"{SOURCES};; SELECT id, {LINES} AS lines FROM s")
def line_counts(w: Workspace):
    return sources(w).select("id", tx.line_count(F.col("source")).alias("lines"))


@query(f"{SOURCES};; SELECT id, round(0.4 * least(({CYCLO}) / 20.0, 1.0) + 0.3 * least(4 / 10.0, 1.0) + 0.3 * least({LINES} / 100.0, 1.0), 6)::DOUBLE AS importance FROM s")
def symbol_importance(w: Workspace):
    """With a fixed depth, as the fold over braces has no counterpart in SQL."""
    s = F.col("source")
    return sources(w).select("id", tx.importance(tx.cyclomatic(s), F.lit(4), tx.line_count(s)).alias("importance"))


@query(f"{SOURCES};; SELECT id, md5(source) AS content_hash, substr(md5(source), 1, 16) AS etag, sha256(source) AS sha FROM s")
def content_hash(w: Workspace):
    s = F.col("source")
    return sources(w).select("id", F.md5(s).alias("content_hash"), tx.etag(s).alias("etag"), F.sha2(s, 256).alias("sha"))


@query(f"s AS (SELECT repository_path, path, md5(source) AS h FROM n WHERE kind = 'FILE' AND source IS NOT NULL AND repository_path IS NOT NULL);; SELECT repository_path, sha256(string_agg(path || h, '' ORDER BY path, h)) AS watermark FROM s GROUP BY 1")
def aggregate_watermark(w: Workspace):
    """One digest for each repository: over one digest for each path, so what is gathered is a hash a file."""
    hashed = sources(w).where(F.col("repository_path").isNotNull()).select("repository_path", "path", F.md5("source").alias("h"))
    rows = hashed.groupBy("repository_path").agg(F.array_sort(F.collect_list(F.struct("path", "h"))).alias("x"))
    return rows.select("repository_path", F.sha2(F.array_join(F.transform("x", lambda r: F.concat(r["path"], r["h"])), ""), 256).alias("watermark"))


@query("SELECT DISTINCT src, dst, md5(concat_ws(':', src, dst, kind)) AS edge_id FROM e")
def lsp_edge_id(w: Workspace):
    return w.graph.edges.select("src", "dst", tx.edge_id("src", "dst", "kind").alias("edge_id")).distinct()


@query(
    "WITH x AS (SELECT CASE WHEN coalesce(src, '') = '' THEN 'empty_caller_fqn' WHEN coalesce(dst, '') = '' THEN 'empty_callee_fqn' WHEN confidence IS NULL OR confidence < 0 OR confidence > 1 "
    "THEN 'invalid_confidence_range' WHEN line_number = 0 THEN 'invalid_line_number' ELSE 'accepted' END AS verdict FROM edges WHERE kind = 'CALLS') SELECT verdict, count(*) AS n FROM x GROUP BY 1",
    graph=False,
)
def lsp_edge_validation(w: Workspace):
    from codeloom.operators.control import lsp_verdict

    rows = w.graph.raw_edges.where(F.col("kind") == "CALLS")
    return rows.select(lsp_verdict(F.col("src"), F.col("dst"), F.lit("x"), F.col("confidence"), F.col("line_number")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events", graph=False)
def properties_decode(w: Workspace):
    return w.table("events").select("event_id", F.try_element_at(F.from_json("props", "map<string,string>"), F.lit("k")).alias("k"))


@query("SELECT event_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events", graph=False)
def start_of_utc_day(w: Workspace):
    return w.table("events").select("event_id", F.date_trunc("day", "ts").alias("day"))


# -- scores


@query(f"{SOURCES};; SELECT id, least(" + " + ".join(f"CASE WHEN contains(lower(path), '{p}') THEN 0.35 ELSE 0 END" for p in scores.PENALISED) + ", 1.0)::DOUBLE AS penalty FROM s")
def path_penalty(w: Workspace):
    return sources(w).select("id", scores.path_penalty(F.col("path")).alias("penalty"))


@query("SELECT id, CASE WHEN lower(name) = 'unwrap' THEN 1.0 WHEN contains(lower(name), 'unwrap') THEN 0.5 ELSE 0.0 END::DOUBLE AS bias FROM n WHERE name IS NOT NULL")
def definition_bias(w: Workspace):
    return w.graph.nodes.where(F.col("name").isNotNull()).select("id", scores.definition_bias("unwrap", F.col("name")).alias("bias"))


HYBRID_INTENT = (
    "CASE WHEN contains(lower(text), 'bug') OR contains(lower(text), 'error') OR contains(lower(text), 'panic') OR contains(lower(text), 'fix') THEN 'bugfix' "
    "WHEN contains(lower(text), 'refactor') OR contains(lower(text), 'cleanup') OR contains(lower(text), 'rename') THEN 'refactor' "
    "WHEN contains(lower(text), 'test') OR contains(lower(text), 'assert') OR contains(lower(text), 'spec') THEN 'tests' "
    "WHEN contains(lower(text), 'how to') OR contains(lower(text), 'usage') OR contains(lower(text), 'example') THEN 'api' ELSE 'explore' END"
)


@query(DOCS + f"SELECT doc_id, {HYBRID_INTENT} AS intent FROM d", graph=False)
def hybrid_intent(w: Workspace):
    return docs(w).select("doc_id", scores.hybrid_intent(F.col("text")).alias("intent"))


@query(
    DOCS + "SELECT doc_id, CASE WHEN contains(lower(text), 'debug') OR contains(lower(text), 'error') OR contains(lower(text), 'fix') OR contains(lower(text), 'bug') THEN 'debug' "
    "WHEN contains(lower(text), 'refactor') OR contains(lower(text), 'clean') OR contains(lower(text), 'improve') THEN 'refactor' "
    "WHEN contains(lower(text), 'test') OR contains(lower(text), 'spec') OR contains(lower(text), 'verify') THEN 'test' ELSE 'explore' END AS intent FROM d",
    graph=False,
)
def capsule_intent(w: Workspace):
    return docs(w).select("doc_id", scores.capsule_intent(F.col("text")).alias("intent"))


@query(
    DOCS + f", i AS (SELECT DISTINCT {HYBRID_INTENT} AS intent FROM d) SELECT intent, "
    + ", ".join("(CASE intent " + " ".join(f"WHEN '{k}' THEN {v[j]}" for k, v in scores.HYBRID.items()) + f" END)::DOUBLE AS {n}" for j, n in enumerate(("vector", "graph", "lexical"))) + " FROM i",
    graph=False,
)
def intent_weights(w: Workspace):
    intents = docs(w).select(scores.hybrid_intent(F.col("text")).alias("intent")).distinct()
    table = F.create_map(*[x for k, v in scores.HYBRID.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return intents.select("intent", *[table[F.col("intent")][i].alias(n) for i, n in enumerate(("vector", "graph", "lexical"))])


@query(f"SELECT id, least(CASE WHEN contains('test the function api', lower(kind)) THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(path), 'test') THEN 0.3 ELSE 0 END + CASE WHEN contains(lower(path), 'api') THEN 0.2 ELSE 0 END, 1.0)::DOUBLE AS hint FROM n WHERE path IS NOT NULL")
def metadata_hint(w: Workspace):
    return w.graph.nodes.where(F.col("path").isNotNull()).select("id", scores.metadata_hint("test the function api", F.col("kind"), F.col("path")).alias("hint"))


@query("SELECT id, CASE WHEN contains(lower(kind), 'function') OR contains(lower(kind), 'method') THEN 0.08 ELSE 0.0 END::DOUBLE AS boost FROM n")
def intent_kind_boost(w: Workspace):
    return w.graph.nodes.select("id", scores.intent_kind_boost(F.lit("bugfix"), F.col("kind")).alias("boost"))


@query("SELECT id, CASE WHEN contains(lower(path), 'test') OR contains(lower(name), 'test') THEN 0.18 ELSE 0.04 END::DOUBLE AS boost FROM n WHERE path IS NOT NULL")
def generation_boost(w: Workspace):
    g = w.graph.nodes.where(F.col("path").isNotNull())
    return g.select("id", scores.generation_boost(F.lit("tests"), F.col("path"), F.col("kind"), F.col("name")).alias("boost"))


FRESH = "CASE WHEN content_hash IS NULL THEN 'unknown' WHEN written_at > spilled_at + INTERVAL 5 SECOND THEN 'stale' ELSE 'fresh' END"


@query(f"SELECT DISTINCT path, CASE {FRESH} WHEN 'fresh' THEN 0.0 WHEN 'stale' THEN 0.2 ELSE 0.05 END::DOUBLE AS penalty FROM deferred_files WHERE path IS NOT NULL AND spilled_at IS NOT NULL", graph=False)
def freshness_penalty(w: Workspace):
    late = F.col("written_at") > F.col("spilled_at") + F.expr("INTERVAL 5 SECOND")
    state = F.when(F.col("content_hash").isNull(), "unknown").when(late, "stale").otherwise("fresh")
    rows = w.table("deferred_files").where(F.col("path").isNotNull() & F.col("spilled_at").isNotNull())
    return rows.select("path", scores.freshness_penalty(state).alias("penalty")).distinct()


@query(f"{SOURCES};; SELECT id, round(least(strlen(source) / 4.0 / 8000, 0.18)::DOUBLE, 8) AS penalty FROM s")
def token_cost_penalty(w: Workspace):
    return sources(w).select("id", F.round(scores.token_cost_penalty(F.col("source")), 8).alias("penalty"))


@query("SELECT id, CASE WHEN contains(lower(path), 'generated') OR contains(lower(path), 'vendor/') OR contains(lower(path), 'node_modules') OR contains(lower(path), 'target/') THEN 0.35 ELSE 0.0 END::DOUBLE AS penalty FROM n WHERE path IS NOT NULL")
def vendor_penalty(w: Workspace):
    return w.graph.nodes.where(F.col("path").isNotNull()).select("id", scores.vendor_penalty(F.col("path")).alias("penalty"))


AGE = f"(epoch({AS_OF}) - epoch(collected_at)) / 86400.0"


def age():
    return (F.unix_timestamp(F.lit("2025-06-01 00:00:00")) - F.unix_timestamp("collected_at")) / 86400.0


@query(DOCS + f"SELECT doc_id, round(1.0 + 0.5 * pow(0.5, {AGE.replace('epoch(collected_at)', 'floor(epoch(collected_at))')} / 30.0), 6) AS boost FROM d WHERE collected_at IS NOT NULL", graph=False)
def recency_half_life(w: Workspace):
    return docs(w).where(F.col("collected_at").isNotNull()).select("doc_id", F.round(scores.recency_half_life(age()), 6).alias("boost"))


@query(DOCS + f"SELECT doc_id, round(CASE WHEN collected_at IS NULL THEN 0.0 ELSE greatest(0.0, least(1.0, 1 - {AGE.replace('epoch(collected_at)', 'floor(epoch(collected_at))')} / 365)) END, 6) AS boost FROM d", graph=False)
def recency_linear(w: Workspace):
    return docs(w).select("doc_id", F.round(scores.recency_linear(age()), 6).alias("boost"))


@query(
    DOCS + f"SELECT doc_id, round(greatest(0.0, least(1.0, 0.9 * pow(0.95, {AGE.replace('epoch(collected_at)', 'floor(epoch(collected_at))')}) * CASE WHEN doc_type IN ('rule', 'context') THEN 0.5 WHEN doc_type IN ('decision', 'pattern') THEN 0.7 ELSE 1.0 END "
    "* (1 + least(0.05 * (doc_id % 20), 0.5)))), 6)::DOUBLE AS importance FROM d WHERE collected_at IS NOT NULL",
    graph=False,
)
def decayed_importance(w: Workspace):
    d = docs(w).where(F.col("collected_at").isNotNull())
    return d.select("doc_id", F.round(scores.decayed_importance(F.lit(0.9), age(), F.col("doc_type"), F.col("doc_id") % 20), 6).alias("importance"))


@query()
def lexical_score(w: Workspace):
    return w.graph.callables.select("id", F.round(scores.lexical("graph", F.col("name"), F.col("source"), F.col("path")), 6).alias("score"))


@query()
def proximity_score(w: Workspace):
    best = ("/srv/checkouts/weighted-digest-service/lib", "/srv/checkouts/fresh-cache/src/graph/index.py")
    return w.graph.callables.select("id", scores.proximity(F.col("path"), best).alias("score"))


@query("SELECT id, round(1.0 / (60 + coalesce(line_number, 0) + 1.0), 8)::DOUBLE AS part FROM f")
def rrf_kernel(w: Workspace):
    return w.graph.callables.select("id", F.round(scores.rrf(F.coalesce("line_number", F.lit(0))), 8).alias("part"))


@query(
    "r AS (SELECT id, name, path, coalesce(cyclomatic_complexity, 1) AS k, row_number() OVER (ORDER BY id) - 1 AS rk FROM f);; "
    "SELECT id, round((1.0 / (60 + rk + 1.0)) * 1.0 + 0.5 * 0.1 + 0.25 * 0.8 + (k / 100.0) * 0.6 + CASE WHEN lower(name) = 'graph' THEN 1.0 WHEN contains(lower(name), 'graph') THEN 0.5 ELSE 0.0 END * 0.6 "
    "+ 0.0 - least(" + " + ".join(f"CASE WHEN contains(lower(path), '{p}') THEN 0.35 ELSE 0 END" for p in scores.PENALISED) + ", 1.0) * 0.4 - least(k * 100 / 4000.0, 1.0) * 0.25, 6)::DOUBLE AS score FROM r"
)
def rerank_score(w: Workspace):
    """Ranks by id over one row a function; every signal of the formula with a value."""
    from pyspark.sql import Window

    k = F.coalesce("cyclomatic_complexity", F.lit(1))
    ranked = w.graph.callables.select("id", "name", "path", k.alias("k"), (F.row_number().over(Window.orderBy("id")) - 1).alias("rk"))
    score = scores.rerank(
        "graph", name=F.col("name"), path=F.col("path"), lexical_rank=F.col("rk"), lexical_score=F.lit(0.5), vector_rank=F.lit(None).cast("int"), vector_score=F.lit(0.25),
        centrality=F.col("k") / 100, tokens=F.col("k") * 100, age_days=F.lit(None).cast("double"),
    )
    return ranked.select("id", F.round(score, 6).alias("score"))


@query("SELECT lang, CASE WHEN m >= 0.2 THEN 0.2 WHEN m >= 0.15 THEN 0.15 WHEN m >= 0.1 THEN 0.1 ELSE 0.05 END::DOUBLE AS threshold FROM (SELECT lang, max(cyclomatic_complexity) / 100.0 AS m FROM f GROUP BY 1)")
def threshold_relaxation(w: Workspace):
    best = w.graph.callables.groupBy("lang").agg((F.max("cyclomatic_complexity") / 100).alias("m"))
    return best.select("lang", scores.threshold(F.col("m")).alias("threshold"))


@query(
    "t AS (SELECT id, unnest(" + BODY.format("name") + ") AS tok FROM f WHERE name IS NOT NULL), h AS (SELECT id, " + HASH.format("tok") + " AS h FROM t), "
    "a AS (SELECT id, (h % 16)::INTEGER AS idx, sum(CASE WHEN (h // 16) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS v FROM h GROUP BY ALL), z AS (SELECT id, sqrt(sum(v * v)) AS len FROM a GROUP BY 1);; "
    "SELECT a.id, idx, round(v / len, 6) AS value FROM a JOIN z ON z.id = a.id WHERE v <> 0"
)
def static_embedding(w: Workspace):
    """The values of 16 dimensions that are not 0."""
    e = w.graph.callables.where(F.col("name").isNotNull()).select("id", F.posexplode(tx.static_embedding(tx.body_tokens(F.col("name")), 16)).alias("idx", "v"))
    return e.where(F.col("v") != 0).select("id", "idx", F.round("v", 6).alias("value"))


@query("SELECT DISTINCT dst, substr(dst, 8) AS module FROM e WHERE kind = 'IMPORTS'")
def import_normalisation(w: Workspace):
    return w.graph.links("IMPORTS").select("dst", tx.import_name(F.regexp_replace("dst", "^module:", "import ")).alias("module")).distinct()

"""The queries of this package, by name, and SQL for those that SQL can check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from codeloom.llm import credentials, docpairs, leakage, neighbours, packing, provenance, readability, setjoin, splitting
from codeloom.llm.common import SPELLINGS, table
from codeloom.llm.syntax import validity
from codeloom.session import cut

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.flag_files(table(spark, sf, "nodes")).select("node_id").distinct()


def p1_profile(spark: SparkSession, sf: str) -> DataFrame:
    return provenance.profile(table(spark, sf, "nodes"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.documented_functions(table(spark, sf, "nodes"))


def p2_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return docpairs.pairs(table(spark, sf, "nodes"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.find_credentials(table(spark, sf, "nodes")).select("node_id", "line_number").distinct()


def p3_masked(spark: SparkSession, sf: str) -> DataFrame:
    return credentials.redact(table(spark, sf, "nodes"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return validity.invalid_files(table(spark, sf, "deferred_files"), table(spark, sf, "nodes"))


def p4_errors(spark: SparkSession, sf: str) -> DataFrame:
    return validity.file_errors(table(spark, sf, "deferred_files"), table(spark, sf, "nodes"))


def p4_rates(spark: SparkSession, sf: str) -> DataFrame:
    return validity.rates(table(spark, sf, "deferred_files"), table(spark, sf, "nodes"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return p5_pieces(spark, sf).select("node_id").distinct()


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.source_pieces(table(spark, sf, "nodes"), table(spark, sf, "size_limits"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = setjoin.similar_pairs(table(spark, sf, "function_bodies"), "id", "tokens", 0.85, 50)
    return pairs.select("id_a", "id_b")


def p6_links(spark: SparkSession, sf: str) -> DataFrame:
    return setjoin.links(table(spark, sf, "function_bodies"), "id", "tokens", 0.85, 50)


def p6_recall(spark: SparkSession, sf: str) -> DataFrame:
    return setjoin.recall(table(spark, sf, "function_bodies"), "id", "tokens", 0.85, 50)


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return cut(neighbours.usable(table(spark, sf, "code_vectors"), "vec_id", "embedding", 128))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    near = neighbours.search(None, vectors, "vec_id", 5).where(F.col("cosine") >= 0.84)
    return near.select(
        F.least("query", "neighbour").alias("vec_a"), F.greatest("query", "neighbour").alias("vec_b")
    ).distinct()


def p7_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    return neighbours.search(vectors.where(F.col("vec_id") % 20 == 0), vectors, "vec_id", 5)


def p7_recall(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf)
    queries = vectors.where(F.col("vec_id") % 20 == 0)
    return neighbours.recall(
        neighbours.search(queries, vectors, "vec_id", 5), neighbours.exhaustive(queries, vectors, "vec_id", 5)
    )


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    capacity = packing.capacity_of(table(spark, sf, "size_limits"))
    return packing.pack(table(spark, sf, "documents"), "doc_id", "text", capacity)


def p8_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill(p8_packed(spark, sf), packing.capacity_of(table(spark, sf, "size_limits")))


def p8_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return packing.measure(table(spark, sf, "documents"), "doc_id", "text")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    graded = readability.bands(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))
    return graded.select("doc_id", "band")


def p10_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return readability.agreement(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    return readability.profile(table(spark, sf, "documents"), table(spark, sf, "reading_labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_found, p1_profile, p2_found, p2_pairs, p3_found, p3_masked, p4_found, p4_errors, p4_rates, p5_found, p5_pieces, p6_found, p6_links, p6_recall, p7_found, p7_neighbours, p7_recall, p8_fill, p8_packed, p8_sizes, p9_found, p9_items, p10_agreement, p10_found, p10_profile)
}

_LANG = "CASE lower(trim({0})) " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in SPELLINGS.items()) + " ELSE lower(trim({0})) END"
_UNIT = (
    "WITH u AS (SELECT vec_id, max(embedding) AS e FROM code_vectors WHERE vec_id IS NOT NULL AND len(embedding) = 128 "
    "AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0 GROUP BY 1), "
    "v AS MATERIALIZED (SELECT vec_id, list_transform(e, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(e, lambda y: y::DOUBLE * y)))) AS e FROM u), "
    "s AS (SELECT a.vec_id AS q, b.vec_id AS n, round(list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2])), 6) AS c FROM v a JOIN v b ON a.vec_id <> b.vec_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY c DESC, n) AS k FROM s) "
)

#: SQL for what SQL can say on small tables: sizes against limits, exact set similarity, exact neighbours.
ORACLE: dict[str, str] = {
    "p5_found": (
        f"WITH l AS (SELECT {_LANG.format('lang')} AS lang, max_size FROM size_limits WHERE purpose = 'source_piece') SELECT DISTINCT id AS node_id FROM nodes n "
        "WHERE kind IN ('FILE', 'FUNCTION', 'METHOD') AND id IS NOT NULL AND strlen(source) > "
        f"coalesce((SELECT min(max_size) FROM l WHERE l.lang = {_LANG.format('n.lang')}), (SELECT min(max_size) FROM l WHERE l.lang IS NULL))"
    ),
    "p6_found": (
        "WITH s AS (SELECT DISTINCT id, list_sort(list_distinct(list_filter(tokens, lambda t: t IS NOT NULL))) AS t FROM function_bodies WHERE id IS NOT NULL AND len(list_filter(tokens, lambda t: t IS NOT NULL)) >= 50) "
        "SELECT DISTINCT a.id AS id_a, b.id AS id_b FROM s a JOIN s b ON a.id < b.id AND len(list_intersect(a.t, b.t)) >= 0.85 * (len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)))"
    ),
    "p7_found": _UNIT + "SELECT DISTINCT least(q, n) AS vec_a, greatest(q, n) AS vec_b FROM r WHERE k <= 5 AND c >= 0.84",
}

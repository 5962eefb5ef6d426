"""Column functions that rank: lexical, rerank, hybrid and memory scores.

Fixed values are the weights of the documented formulas.  ``query`` is a text
known when the plan is built; all else are columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from codeloom.functions import paths

RRF_K = 60.0
RERANK = {"lexical": 1.0, "vector": 0.8, "centrality": 0.6, "path_penalty": 0.4, "definition": 0.6, "recency": 0.3, "token_cost": 0.25}
# Weights of (text, tf-idf, centrality, proximity) by intent.
CAPSULE = {"default": (0.4, 0.3, 0.1, 0.2), "debug": (0.5, 0.25, 0.1, 0.15), "refactor": (0.25, 0.35, 0.25, 0.15), "explore": (0.35, 0.35, 0.15, 0.15), "test": (0.45, 0.25, 0.15, 0.15)}
# Weights of (vector, graph, lexical) by intent.
HYBRID = {"bugfix": (0.60, 0.25, 0.15), "refactor": (0.50, 0.35, 0.15), "tests": (0.45, 0.20, 0.35), "api": (0.55, 0.20, 0.25), "explore": (0.65, 0.15, 0.20)}
# Path parts that cost a candidate.
PENALISED = ("/test/", "/tests/", "_test.", "/fixtures/", "/generated/", "/vendor/", "/target/", "/node_modules/")

_HYBRID_CUES = (("bugfix", "bug error panic fix"), ("refactor", "refactor cleanup rename"), ("tests", "test assert spec"))
_CAPSULE_CUES = (("debug", "debug error fix bug"), ("refactor", "refactor clean improve"), ("test", "test spec verify"))


def _cues(text, table: Sequence[tuple[str, str]]) -> Column | None:
    out = None
    for name, words in table:
        hit = F.lit(False)
        for word in words.split():
            hit = hit | text.contains(word)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def hybrid_intent(text) -> Column:
    """bugfix, refactor, tests, api or explore, by the first cue."""
    low = F.lower(text)
    return _cues(low, _HYBRID_CUES).when(low.contains("how to") | low.contains("usage") | low.contains("example"), "api").otherwise("explore")


def capsule_intent(text) -> Column:
    """debug, refactor, test or explore, by the first cue."""
    return _cues(F.lower(text), _CAPSULE_CUES).otherwise("explore")


def rrf(rank, k: float = RRF_K) -> Column:
    """The reciprocal-rank kernel for a rank from 0."""
    return F.lit(1.0) / (F.lit(k) + rank + 1.0)


def ngrams(text) -> Column:
    """The distinct runs of two and three characters."""

    def runs(n: int):
        at = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(at, lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(2), runs(3)))


def _query_grams(query: str) -> list[str]:
    return sorted({query[i : i + n] for n in (2, 3) for i in range(len(query) - n + 1)})


def fuzzy(query: str, name) -> Column:
    """Shared character runs of a query and a name, and 0.15 for each word of the query in the name; 1 if equal."""
    grams, words = _query_grams(query), [w for w in re.split(r"[^\w]+", query) if len(w) > 1]
    overlap = F.size(F.array_intersect(ngrams(name), F.array(*map(F.lit, grams)).cast("array<string>"))) / max(1, len(grams))
    boost = F.lit(0.0)
    for w in words:
        boost = boost + F.when(name.contains(w), 0.15).otherwise(0.0)
    return F.when(name == query, 1.0).otherwise(F.least(overlap + boost, F.lit(1.0)))


def lexical(query: str, name, source, path) -> Column:
    """How well a query fits a name, a body and a path: at most 1; missing texts fit nothing."""
    q = query.lower()
    n, s, p = (F.lower(F.coalesce(x, F.lit(""))) for x in (name, source, path))
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    base = flag(n.contains(q), 0.35) + flag(s.contains(q), 0.6 * 0.2) + flag(p.contains(q), 0.7 * 0.2) + flag(n == q, 0.3)
    prefix = F.when(n.startswith(q), 0.4).when(F.lit(q).startswith(n), 0.3).otherwise(0.0)
    return F.least(base + fuzzy(q, n) * 0.15 + prefix * 0.1, F.lit(1.0))


def _within(parts, text: str) -> Column:
    return F.exists(parts, lambda x: F.lit(text).contains(x))


def proximity(path, best: Sequence[str], boost: float = 1.0) -> Column:
    """How near a path is to the best ones: the first of them that relates decides."""
    low = F.lower(path)
    parts = F.filter(F.split(low, "/"), lambda x: F.length(x) > 3)
    out = None
    for b in best:
        bl = b.lower()
        same = (low == bl) | low.startswith(bl) | F.lit(bl).startswith(low)
        near = paths.module(path) == (b.rpartition("/")[0] or "root")
        touches = _within(parts, bl)
        out = F.when(same, boost) if out is None else out.when(same, boost)
        out = out.when(near, boost * 0.8).when(touches, boost * 0.6)
    return F.lit(0.0) if out is None else out.otherwise(0.0)


def combined(intent: str, text, tfidf, centrality, near) -> Column:
    a, b, c, d = CAPSULE[intent]
    return text * a + F.least(tfidf / 2.5, F.lit(1.0)) * b + centrality * c + near * d


def path_penalty(path) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(0.0)
    for part in PENALISED:
        out = out + F.when(low.contains(part), 0.35).otherwise(0.0)
    return F.least(out, F.lit(1.0))


def definition_bias(query: str, name) -> Column:
    """1 for the very name, 0.5 for a name that holds the query."""
    q = query.strip().lower()
    if not q:
        return F.lit(0.0)
    words = [w for w in re.split(r"[^\w]+", q) if len(w) > 1]
    exact = F.lower(name) == words[0] if len(words) == 1 else F.lit(False)
    return F.when(exact, 1.0).when(F.lower(name).contains(q), 0.5).otherwise(0.0)


def recency_half_life(age_days, least: float = 1.0, most: float = 1.5, half_life: float = 30.0) -> Column:
    return least + (most - least) * F.pow(F.lit(0.5), age_days / half_life)


def recency_linear(age_days) -> Column:
    """1 today, 0 after a year; 0 for an unknown age."""
    return F.when(age_days.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age_days / 365)))


def rerank(query: str, *, name, path, lexical_rank, lexical_score, vector_rank, vector_score, centrality, tokens, age_days, weights=None) -> Column:
    """Seven signals in one linear score; a missing vector rank is replaced by the vector score."""
    w = {**RERANK, **(weights or {})}
    text = rrf(lexical_rank) * w["lexical"] + lexical_score * 0.1
    vector = F.coalesce(rrf(vector_rank), vector_score) * w["vector"]
    cost = F.least(tokens / 4000, F.lit(1.0)) * w["token_cost"]
    return (
        text + vector + centrality * w["centrality"] + definition_bias(query, name) * w["definition"] + recency_linear(age_days) * w["recency"]
        - path_penalty(path) * w["path_penalty"] - cost
    )


def metadata_hint(query: str, kind, path) -> Column:
    q, p = query.lower(), F.lower(path)
    out = F.when(F.lit(q).contains(F.lower(kind)), 0.3).otherwise(0.0)
    if "test" in q:
        out = out + F.when(p.contains("test"), 0.3).otherwise(0.0)
    if "api" in q or "endpoint" in q:
        out = out + F.when(p.contains("api"), 0.2).otherwise(0.0)
    return F.least(out, F.lit(1.0))


def intent_kind_boost(intent, kind) -> Column:
    k = F.lower(kind)
    return (
        F.when((intent == "tests") & k.contains("test"), 0.15).when((intent == "refactor") & (k.contains("struct") | k.contains("class")), 0.10)
        .when((intent == "bugfix") & (k.contains("function") | k.contains("method")), 0.08).when((intent == "api") & k.contains("function"), 0.06).otherwise(0.0)
    )


def generation_boost(intent, path, kind, name) -> Column:
    p, k, n = F.lower(path), F.lower(kind), F.lower(name)
    return (
        F.when((intent == "tests") & (p.contains("test") | n.contains("test")), 0.18).when((intent == "bugfix") & p.contains("test"), 0.08)
        .when((intent == "refactor") & (k.contains("trait") | k.contains("interface")), 0.12).when((intent == "api") & (p.contains("api") | k.contains("interface")), 0.14)
        .when(intent == "explore", 0.0).otherwise(0.04)
    )


def freshness_penalty(freshness) -> Column:
    table = {"fresh": 0.0, "warming": 0.04, "partial": 0.08, "stale": 0.20}
    out = F
    for name, value in table.items():
        out = out.when(freshness == name, value)
    return out.otherwise(0.05)


def token_cost_penalty(content) -> Column:
    return F.least(F.coalesce(F.octet_length(content), F.lit(0)) / 4 / 8000, F.lit(0.18))


def vendor_penalty(path) -> Column:
    p = F.lower(path)
    return F.when(p.contains("generated") | p.contains("vendor/") | p.contains("node_modules") | p.contains("target/"), 0.35).otherwise(0.0)


def decayed_importance(confidence, age_days, classification, accesses) -> Column:
    """Confidence, less 5 % a day, by class, raised by how often it was read; within 0 and 1."""
    factor = F.when(classification.isin("rule", "context"), 0.5).when(classification.isin("decision", "pattern"), 0.7).otherwise(1.0)
    raw = confidence * F.pow(F.lit(0.95), age_days) * factor * (1 + F.least(0.05 * accesses, F.lit(0.5)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def extrapolated(sample_tokens, sample_items, total_items) -> Column:
    """What all items cost if they are like the sample; never less than the sample."""
    return F.greatest(F.ceil(sample_tokens / F.greatest(sample_items, F.lit(1)) * total_items), sample_tokens)


def saved(baseline, returned) -> Column:
    return F.greatest(baseline - returned, F.lit(0))


def threshold(best, first: float = 0.2, least: float = 0.05, step: float = 0.05) -> Column:
    """The first threshold, going down in steps, that the best score reaches; the least if none."""
    levels = [round(first - i * step, 10) for i in range(int(round((first - least) / step)) + 1)]
    out = F
    for level in levels:
        out = out.when(best >= level, level)
    return out.otherwise(least)

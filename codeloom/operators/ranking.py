"""Ranking texts: TF-IDF, BM25, token budgets, context capsules, evaluation.

Term counts are made once for each text and shuffled as (text, term) rows;
document frequencies come from the same rows.  Only the terms of a query are
kept before anything is shuffled, so a query costs what its terms occur.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window, functions as F

from codeloom.functions import scores, text as tx


def query_terms(query: str) -> list[str]:
    return [t for t in re.split(r"[^\w]+", query.lower()) if len(t.encode()) > 1]


def term_counts(texts: DataFrame, key: str, text: str, only: list[str] | None = None) -> DataFrame:
    """``key, size, term, n``: how often each text holds each term; ``size`` is its number of terms."""
    words = texts.where(F.col(key).isNotNull()).select(key, tx.tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    kept = F.col("w") if only is None else F.filter("w", lambda x: x.isin(*only))
    return words.select(key, F.size("w").alias("size"), F.explode(kept).alias("term")).groupBy(key, "size", "term").agg(F.count("*").alias("n"))


def term_frequency(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``: relative frequencies."""
    return term_counts(texts, key, text).select(key, "term", F.round(F.col("n") / F.col("size"), 8).alias("tf"))


def document_frequency(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``term, df, idf``: in how many texts a term occurs, and ln((N + 1) / (df + 1)) + 1."""
    total = texts.where(F.col(key).isNotNull()).agg(F.count("*").alias("total"))
    df = term_counts(texts, key, text).groupBy("term").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(total)).select("term", "df", F.round(F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1, 8).alias("idf"))  # one row


def tfidf(texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``key, score``: the sum of tf x idf over the query's terms, by the root of the text's length; positive ones."""
    asked = query_terms(query)
    total = texts.where(F.col(key).isNotNull()).agg(F.count("*").alias("total"))
    counts = term_counts(texts, key, text, sorted(set(asked)))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    times = F.create_map(*[F.lit(x) for t in sorted(set(asked)) for x in (t, asked.count(t))])
    part = F.col("n") / F.col("size") * (F.log((F.col("total") + 1) / (F.col("df") + 1)) + 1) * times[F.col("term")]
    scored = counts.join(F.broadcast(df), "term").join(F.broadcast(total))  # a row a term of the query; one row
    return scored.groupBy(key, "size").agg(F.sum(part).alias("s")).select(key, F.round(F.col("s") / F.sqrt("size"), 6).alias("score")).where(F.col("score") > 0)


def bm25(texts: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``key, score``: BM25 with relative term frequencies; positive scores only."""
    asked = query_terms(query)
    sizes = texts.where(F.col(key).isNotNull()).select(F.size(tx.tokens(F.col(text))).alias("s"))
    total = sizes.agg(F.count("*").alias("total"), F.avg(F.greatest("s", F.lit(0))).alias("mean"))
    counts = term_counts(texts, key, text, sorted(set(asked)))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    times = F.create_map(*[F.lit(x) for t in sorted(set(asked)) for x in (t, asked.count(t))])
    tf = F.col("n") / F.col("size")
    idf = F.log((F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("size") / F.col("mean"))) * times[F.col("term")]
    scored = counts.join(F.broadcast(df), "term").join(F.broadcast(total))  # a row a term of the query; one row
    return scored.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).where(F.col("score") > 0)


def simple_tfidf(texts: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """``key, score``: twice the relative frequencies of the query's terms by ln(2 + length), without a corpus."""
    asked = query_terms(query)
    counts = term_counts(texts, key, text, sorted(set(asked)))
    times = F.create_map(*[F.lit(x) for t in sorted(set(asked)) for x in (t, asked.count(t))])
    return counts.groupBy(key, "size").agg(F.sum(F.col("n") / F.col("size") * 2 * times[F.col("term")]).alias("s")).select(
        key, F.round(F.col("s") / F.log1p(1 + F.col("size")), 6).alias("score")
    )


def budget(items: DataFrame, group: str | None, order: list, cost: str, limit: int, least: int = 1) -> DataFrame:
    """The items of each group, in order, up to the first that would go over the limit; later ones that would fit are not taken.

    ``spent`` is the sum so far.  Without a group the order is one sequence over
    all items, as a budget for one answer is; every item costs at least
    ``least``, so no more than ``limit / least`` of the first can be in it, and
    only those are gathered.
    """
    if group is None:
        items = items.orderBy(*order).limit(limit // max(1, least) + 1)
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(*order)
    summed = items.withColumn("spent", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.max((F.col("spent") > limit).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return summed.withColumn("_over", over).where(F.col("_over") == 0).drop("_over")


def first_hit(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``query, first``: the rank of the first right answer; null where there is none."""
    hits = ranked.join(gold, ["query", "id"], "left_semi").groupBy("query").agg(F.min("rank").alias("first"))
    return gold.select("query").distinct().join(hits, "query", "left")


def retrieval_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """``queries, r_at_1, r_at_5, r_at_20, mrr``."""
    first = F.col("first")
    share = lambda n: F.round(F.avg(F.when(first <= n, 1.0).otherwise(0.0)), 6)
    return first_hit(ranked, gold).agg(
        F.count("*").alias("queries"), share(1).alias("r_at_1"), share(5).alias("r_at_5"), share(20).alias("r_at_20"),
        F.round(F.avg(F.coalesce(1.0 / first, F.lit(0.0))), 6).alias("mrr"),
    )


def budget_recall(ranked: DataFrame, gold: DataFrame, cost: str, limit: int) -> DataFrame:
    """``queries, recall``: for how many queries a right answer comes before the budget is spent."""
    w = Window.partitionBy("query").orderBy("rank")
    before = ranked.withColumn("before", F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    hit = before.where(F.col("before") < limit).join(gold, ["query", "id"], "left_semi").select("query").distinct().withColumn("hit", F.lit(1.0))
    return gold.select("query").distinct().join(hit, "query", "left").agg(F.count("*").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("recall"))


def capsule(symbols: DataFrame, centrality: DataFrame, query: str, intent: str = "explore", best: tuple[str, ...] = (), tokens: int = 4000) -> DataFrame:
    """``id, score, cost, spent, rank``: the symbols worth reading for a query, best first, within a token budget.

    ``symbols`` is ``id, name, path, source``; ``centrality`` is ``id,
    centrality``.  Text, BM25, centrality and nearness are weighted by the
    intent; what is below the relaxed threshold is left out; ties go by id.
    """
    doc = symbols.select("id", F.concat_ws(" ", "name", "path", "source").alias("doc"))
    raw = bm25(doc, "id", "doc", query).withColumnRenamed("score", "bm25")
    joined = symbols.join(raw, "id", "left").join(centrality, "id", "left").fillna(0.0, ["bm25", "centrality"])
    score = scores.combined(intent, scores.lexical(query, F.col("name"), F.col("source"), F.col("path")), F.col("bm25"), F.col("centrality"), scores.proximity(F.col("path"), best))
    cost = F.floor(F.octet_length(F.coalesce(F.substring("source", 1, 320), F.lit(""))) / 4) + 32
    scored = joined.select("id", F.round(score, 6).alias("score"), cost.cast("int").alias("cost"))
    top = scored.agg(F.max("score").alias("top"))
    kept = scored.join(F.broadcast(top)).where(F.col("score") >= scores.threshold(F.col("top"))).drop("top")  # one row
    taken = budget(kept, None, [F.desc("score"), "id"], "cost", tokens, least=32)
    return taken.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")))

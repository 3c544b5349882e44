"""Hybrid search, context assembly and web research: operators composed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemolake.functions import text as T
from mnemolake.functions import urls
from mnemolake.operators import graph, models, packing, ranking


def hybrid_search(docs: DataFrame, queries: DataFrame, semantic: DataFrame | None = None, usage: DataFrame | None = None, degrees: DataFrame | None = None, weights: tuple[float, float] = (1.0, 1.0), k: int = 10, pool: int = 50) -> DataFrame:
    """query_id, doc_id, score, rank, why: lexical (all terms, else any) and semantic rankings fused, then boosted by use
    and importance. semantic: query_id, doc_id, rank; usage: doc_id, usage; degrees: doc_id, in_degree."""
    lex = ranking.bm25_or_fallback(docs, queries, pool).select("query_id", "doc_id", "rank")
    lists, w = [lex], [weights[0]]
    if semantic is not None:
        lists, w = [lex, semantic.filter(F.col("rank") <= pool)], list(weights)
    fused = ranking.rrf(lists, w, k=pool).select("query_id", "doc_id", "score")
    out = fused.join(lex.withColumnRenamed("rank", "lex"), ["query_id", "doc_id"], "left")
    out = out.join(semantic.select("query_id", "doc_id", F.col("rank").alias("sem")), ["query_id", "doc_id"], "left") if semantic is not None else out.withColumn("sem", F.lit(None).cast("int"))
    score = F.col("score")
    if usage is not None:
        out = out.join(usage.select("doc_id", "usage"), "doc_id", "left").join(F.broadcast(usage.agg(F.max("usage").alias("most_used"))))
        score = score * ranking.usage_boost(F.coalesce("usage", F.lit(0.0)), F.col("most_used"))
    if degrees is not None:
        out = out.join(degrees.select("doc_id", "in_degree"), "doc_id", "left").join(F.broadcast(degrees.agg(F.max("in_degree").alias("most_linked"))))
        score = score * ranking.importance_boost(F.coalesce("in_degree", F.lit(0)), F.col("most_linked"))
    final = out.withColumn("score", F.round(score, 9))
    w_ = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    final = final.withColumn("rank", F.row_number().over(w_)).filter(F.col("rank") <= k)
    return final.select("query_id", "doc_id", "score", "rank", ranking.why(F.col("lex"), F.col("sem"), F.lit(None)).alias("why"))


def assemble_context(hits: DataFrame, docs: DataFrame, queries: DataFrame, budget: int = 1500) -> DataFrame:
    """query_id, doc_id, rank, passage, tokens: passages of hits that share an anchor term with the query (the best three
    need none), as long as the budget lasts."""
    own = hits.select("query_id", "doc_id", "rank").join(queries, "query_id")
    passages = packing.best_passage(docs, own.select("query_id", "doc_id", "query"))
    out = own.join(passages, ["query_id", "doc_id"])
    shared = F.size(F.array_intersect(T.anchor_terms("query"), T.anchor_terms("passage")))
    gated = out.filter((shared > 0) | (F.col("rank") <= 3)).withColumn("tokens", T.token_estimate("passage"))
    return packing.within_budget(gated, budget, ["query_id"], ["rank", "doc_id"]).select("query_id", "doc_id", "rank", "passage", "tokens")


def reranked_search(docs: DataFrame, queries: DataFrame, load: Callable[[], models.Scorer], name: str, k: int = 10, pool: int = models.POOL, margin: float | None = None, **search) -> DataFrame:
    """query_id, doc_id, score, logit, rank: the pool of hybrid_search (its arguments: search) in the order of a model that
    reads each query beside the best passage of each document."""
    hits = hybrid_search(docs, queries, k=max(pool, k), pool=max(pool, k, search.pop("pool", 50)), **search).join(queries.select("query_id", "query"), "query_id")
    read = hits.join(docs.select("doc_id", "text"), "doc_id").withColumn("passage", packing.extract_passage(F.col("text"), F.col("query")))
    return models.rerank(read, load, name, k, pool, margin)


def graph_expand(hits: DataFrame, edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Neighbours of all hits with their scores."""
    return graph.typed_neighbors(edges, hits.select(F.col("doc_id").alias("node")).distinct(), weights)


def research(results: DataFrame, covered: DataFrame | None = None, per_host: int = 3, k: int = 40) -> DataFrame:
    """results: query_id (the question), list_id (sub-query), rank, url. One ranking a question: lists fused on canonical
    addresses, covered pages left out, hosts capped."""
    keyed = results.withColumn("key", urls.canonical("url")).filter("key <> ''")
    once = keyed.groupBy("query_id", "list_id", "key").agg(F.min("rank").alias("rank"))
    parts = once.withColumn("part", 1 / (ranking.RRF_K + F.col("rank")))
    fused = parts.groupBy("query_id", "key").agg(F.round(F.sum("part"), 9).alias("score"), F.count("*").alias("found_by"))
    if covered is not None:
        fused = fused.join(covered.select("key"), "key", "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    ranked = fused.withColumn("rank", F.row_number().over(w)).withColumn("host", urls.host_of("key"))
    return ranking.host_cap(ranked, per_host, ["query_id"]).filter(F.col("position") <= k).select("query_id", "key", "host", "score", "found_by", "position")


def judged_research(judged: DataFrame, drop_below: float = 3.0, near: float | None = 0.92, diversify: float | None = None, k: int = 40) -> DataFrame:
    """query_id, key, relevance, rank, dropped: pages in the order of their verdicts.

    judged: query_id, key, position, relevance (null: no verdict), relevant (of pages without a score: false is a rejection,
    null unknown), vec. Scores come first, then pages that were called relevant or not without a score (as 5), then those
    without a verdict (as -1), in the order they had. Scores under `drop_below` go; `dropped` tells how many of the query
    did. Then a page goes whose cosine with a better one reaches `near`, pages without a vector stay; with `diversify`,
    maximal marginal relevance of that weight orders what is left."""
    verdict = F.coalesce(F.col("relevance").cast("double"), F.when(F.col("relevant").isNull(), F.lit(-1.0)).otherwise(5.0))
    own = Window.partitionBy("query_id")
    rejected = F.coalesce(F.col("relevance") < drop_below, F.lit(False))
    rows = judged.withColumn("verdict", verdict).withColumn("dropped", F.count_if(rejected).over(own)).filter(~rejected)
    rows = rows.withColumn("rank", F.row_number().over(own.orderBy(F.desc("verdict"), "position", "key")))
    if near is not None:
        stays = ranking.greedy_near_dup(rows.select(F.col("query_id").alias("group"), F.col("key").alias("id"), "rank", "vec"), near)
        bare = rows.filter(F.col("vec").isNull()).select(F.col("query_id").alias("group"), F.col("key").alias("id"))
        left = stays.select("group", "id").unionByName(bare)
        rows = rows.join(left.select(F.col("group").alias("query_id"), F.col("id").alias("key")), ["query_id", "key"], "left_semi")
    order = F.col("rank")
    if diversify is not None:
        turns = ranking.mmr(rows.select("query_id", F.col("key").alias("id"), F.coalesce(F.col("relevance").cast("double"), F.lit(0.0)).alias("score"), "vec"), k, diversify, pool=k)
        rows = rows.join(turns.select("query_id", F.col("id").alias("key"), F.col("rank").alias("turn")), ["query_id", "key"])
        order = F.col("turn")
    return rows.withColumn("rank", F.row_number().over(own.orderBy(order))).filter(F.col("rank") <= k).select("query_id", "key", "relevance", "rank", "dropped")

"""Candidates of batches of queries: collapse, thresholds, fusion, rerank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Constant of reciprocal-rank fusion.
RRF_K = 60


def below_threshold(similarity: Column, threshold: float) -> Column:
    """The reason to drop a candidate; null where it stays. A similarity equal to the threshold stays."""
    return F.when(similarity < threshold, F.format_string("similarity %.2f < threshold %.2f", similarity, F.lit(threshold)))


def collapse(hits: DataFrame, canonical: DataFrame) -> DataFrame:
    """(query_id, chunk_id, similarity, rank, collapsed_from), one row a canonical chunk.

    ``hits``: query_id, rank, chunk_id, similarity. ``canonical``: chunk_id, head (null
    for a canonical), over chunks that pass the filters; a duplicate whose head is not
    among them stands alone. A group keeps its best similarity and first rank.
    """
    heads = canonical.select(F.col("chunk_id").alias("head"), F.lit(True).alias("known"))
    keyed = hits.join(canonical, "chunk_id", "left").join(heads, "head", "left").withColumn("key", F.when(F.col("known"), F.col("head")).otherwise(F.col("chunk_id")))
    other = F.when(F.col("chunk_id") != F.col("key"), F.struct("rank", "chunk_id"))
    g = keyed.groupBy("query_id", F.col("key").alias("chunk_id")).agg(F.max("similarity").alias("similarity"), F.min("rank").alias("first"), F.array_distinct(F.transform(F.array_sort(F.collect_list(other)), lambda x: x["chunk_id"])).alias("collapsed_from"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("first", "chunk_id"))).drop("first")


def ranked_unique(ids: DataFrame, order: list[Column]) -> DataFrame:
    """(query_id, chunk_id, rank): each id once, at its first place. ``ids``: query_id, chunk_id and what orders them."""
    w = W.partitionBy("query_id").orderBy(*order, "chunk_id")
    first = ids.withColumn("_p", F.row_number().over(w)).groupBy("query_id", "chunk_id").agg(F.min("_p").alias("_p"))
    return first.select("query_id", "chunk_id", F.row_number().over(W.partitionBy("query_id").orderBy("_p")).alias("rank"))


def weighted_rrf(vector: DataFrame, graph: DataFrame, weight: float) -> DataFrame:
    """(query_id, chunk_id, score, source, rank) of two ranked lists (query_id, chunk_id, rank).

    A side of weight 0 adds nothing, and rows with score 0 are dropped. Ties: vector
    rank, then graph rank, then id.
    """
    v, g = vector.select("query_id", "chunk_id", F.col("rank").alias("rv")), graph.select("query_id", "chunk_id", F.col("rank").alias("rg"))
    both = v.join(g, ["query_id", "chunk_id"], "full_outer")
    part = lambda w, r: F.coalesce(w / (RRF_K + F.col(r)), F.lit(0.0))
    score = F.round(part(weight, "rv") + part(1.0 - weight, "rg"), 9)
    source = F.when(F.col("rv").isNotNull() & F.col("rg").isNotNull(), "both").when(F.col("rv").isNotNull(), "vector").otherwise("graph")
    kept = both.withColumn("score", score).where(F.col("score") > 0).withColumn("source", source)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.col("rv").asc_nulls_last(), F.col("rg").asc_nulls_last(), "chunk_id")
    return kept.withColumn("rank", F.row_number().over(order)).drop("rv", "rg")


def fuse(vector: DataFrame, graph: DataFrame, allowed: DataFrame, weight: float, top_k: int) -> DataFrame:
    """The fusion stage: graph evidence that exists and passes the filters, cut at ``top_k``, then fused and cut.

    Without evidence for a query its vector list passes through in order.
    """
    evidence = graph.join(allowed.select("chunk_id"), "chunk_id", "left_semi").where(F.col("rank") <= top_k)
    fused = weighted_rrf(vector, evidence, weight).where(F.col("rank") <= top_k)
    alone = vector.join(evidence.select("query_id").distinct(), "query_id", "left_anti").where(F.col("rank") <= top_k)
    rest = alone.select("query_id", "chunk_id", F.round(F.lit(weight) / (RRF_K + F.col("rank")), 9).alias("score"), F.lit("vector").alias("source"), "rank")
    return fused.join(evidence.select("query_id").distinct(), "query_id", "left_semi").unionByName(rest)


def words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1)))


def overlap_score(question: Column, text: Column) -> Column:
    """Share of the distinct words of the question that the text holds; 0 without words."""
    q = words(question)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(q, words(text))), F.size(q)), F.lit(0.0))


def rerank(candidates: DataFrame, score: Column, top_n: int) -> DataFrame:
    """Candidates (query_id, chunk_id, rank, ...) with score, before and after, the best ``top_n`` kept."""
    scored = candidates.withColumn("score", F.round(score, 6)).withColumnRenamed("rank", "before")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "before", "chunk_id")
    return scored.withColumn("after", F.row_number().over(w)).where(F.col("after") <= top_n)

"""Fusing and reranking of ranked lists: (query_id, id, rank, score) in, the same out."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import body_of
from .relational import top_per_group


class Retriever(Protocol):
    """(queries, k) -> ranked rows."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


def reciprocal_rank_fusion(legs: list[DataFrame], k: int, constant: int = 60, pool: int | None = None) -> DataFrame:
    """Sum of 1 / (constant + rank) over the legs, each cut to the pool, 4k or 30 if more; ties go to the earlier
    leg, then to its better rank, then to the smaller id."""
    pool = pool or max(4 * k, 30)
    rows = None
    for i, leg in enumerate(legs):
        part = leg.where(F.col("rank") <= pool).select("query_id", "id", F.lit(i).alias("leg"), F.col("rank"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 12).alias("score"), F.min(F.struct("leg", "rank")).alias("first"))
    best = top_per_group(fused, ["query_id"], [F.desc("score"), F.asc("first"), F.asc("id")], k)
    return best.select("query_id", "id", "rank", "score")


def rerank_document(text: Column, piece: Column, mode: str = "both", prefix: int = 1800, most: int = 3600) -> Column:
    """What a reranker reads: a prefix, the matched piece, or the prefix and the piece without its header; the prefix where there is no piece."""
    head = F.substring(text, 1, prefix)
    if mode == "prefix":
        return head
    if mode == "slice":
        return F.coalesce(F.substring(piece, 1, most), head)
    return F.coalesce(F.substring(F.concat(head, F.lit("\n…\n"), body_of(piece)), 1, most), head)


def rerank(candidates: DataFrame, relevance: Column | None, k: int) -> DataFrame:
    """The best k by relevance, ties in the order in which they came; without a relevance that order, cut to k, and
    the status says so."""
    if relevance is None:
        return top_per_group(candidates.withColumnRenamed("rank", "came"), ["query_id"], [F.asc("came")], k).withColumn("status", F.lit("not reranked"))
    scored = candidates.withColumnRenamed("rank", "came").withColumn("relevance", relevance)
    return top_per_group(scored, ["query_id"], [F.desc_nulls_last("relevance"), F.asc("came")], k).withColumn("status", F.lit("reranked"))


def term_overlap(query_terms: Column, document_terms: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the query's terms that the document holds."""
    return F.round(F.size(F.array_intersect(query_terms, document_terms)) / F.greatest(F.size(F.array_distinct(query_terms)), F.lit(1)), 9)


def expand_one_hop(candidates: DataFrame, edges: DataFrame, eligible: DataFrame, seeds: int = 8, most: int = 40) -> DataFrame:
    """What the first `seeds` candidates of a query cite, appended with score 0 after all candidates: eligible, not
    there already, at most `most` a query, in the order of the seeds' ranks, then ids.
    candidates (query_id, id, rank, score), edges (from_id, to_id), eligible (id)."""
    seed = candidates.where(F.col("rank") <= seeds).select("query_id", F.col("id").alias("from_id"), F.col("rank").alias("seed_rank"))
    cited = seed.join(edges, "from_id").groupBy("query_id", F.col("to_id").alias("id")).agg(F.min("seed_rank").alias("seed_rank"))
    fresh = cited.join(eligible.select("id").distinct(), "id", "left_semi").join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
    added = top_per_group(fresh, ["query_id"], [F.asc("seed_rank"), F.asc("id")], most, "place")
    n = candidates.groupBy("query_id").agg(F.max("rank").alias("n"))
    added = added.join(n, "query_id").select("query_id", "id", (F.col("n") + F.col("place")).cast("int").alias("rank"), F.lit(0.0).alias("score"))
    return candidates.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score")).unionByName(added)

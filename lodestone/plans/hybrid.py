"""Hybrid search: permissions, both legs, fusion; short queries go by vector alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.functions.vocabulary import RRF_K, TOP_K
from lodestone.operators import retrieval as R

SHORTEST = 3


def hybrid_search(queries: DataFrame, users: DataFrame, chunks: DataFrame, k: int = TOP_K, rrf_k: int = RRF_K) -> DataFrame:
    """query_id, chunk_id, rrf_score, vector_rank, keyword_rank, rank."""
    q = R.principals(queries, users).withColumn("short", F.length(strip(F.col("query_text"))) < SHORTEST)
    vector = R.vector_topk(q, chunks, k)
    short = q.where("short").select("query_id")
    keyword = R.keyword_topk(q.where("not short"), chunks, k)
    alone = R.vector_only(vector.join(short, "query_id", "left_semi"), rrf_k)
    return R.rrf_fusion(vector.join(short, "query_id", "left_anti"), keyword, k, rrf_k).unionByName(alone)

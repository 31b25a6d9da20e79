"""Dense, keyword and fused retrieval over a chunk table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions import vectors as V

CANDIDATES, RRF = 20, 60


def postings(chunks: DataFrame) -> DataFrame:
    """id, term, tf: the terms of each chunk, for keyword search."""
    return chunks.select("id", F.explode(T.search_tokens(F.col("text"))).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def dense(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest by cosine distance, ties by id: id, distance (six places), similarity."""
    vector = F.array(*[F.lit(float(x)) for x in query])
    distance = F.round(V.cosine_distance(F.col("embedding"), vector), 6)
    return chunks.where(F.size("embedding") == len(query)).select("id", distance.alias("distance"), F.round(1 - distance, 6).alias("similarity")).orderBy("distance", "id").limit(k)


def keyword(chunks: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k chunks in which the terms of an OR query occur most often, ties by id: id, hits."""
    found = chunks.select("id", F.explode(T.search_tokens(F.col("text"))).alias("term")).where(F.col("term").isin(terms) if terms else F.lit(False))
    return found.groupBy("id").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "id").limit(k)


def hybrid(chunks: DataFrame, query: list[float], terms: list[str], k: int = 10, candidates: int = CANDIDATES) -> DataFrame:
    """Reciprocal-rank fusion of both: id, dense_rank, keyword_rank, rrf_score. Ranks are given after each cut, to few rows."""
    everything = Window.partitionBy(F.lit(0))
    a = dense(chunks, query, candidates).select("id", F.rank().over(everything.orderBy("distance")).alias("dense_rank"))
    b = keyword(chunks, terms, candidates).select("id", F.rank().over(everything.orderBy(F.desc("hits"))).alias("keyword_rank"))
    part = lambda c: F.coalesce(F.lit(1.0) / (F.lit(float(RRF)) + F.col(c)), F.lit(0.0))
    return a.join(b, "id", "full_outer").select("id", "dense_rank", "keyword_rank", F.round(part("dense_rank") + part("keyword_rank"), 9).alias("rrf_score")).orderBy(F.desc("rrf_score"), "id").limit(k)


def keyword_all(chunks: DataFrame, questions: DataFrame, k: int) -> DataFrame:
    """Keyword search for every question at once: query_id, id, hits, rank. questions: query_id, text.

    Texts are dealt out by id before they are split, so that all counts of a chunk are made where
    it lies and each task sends its k best of a question only. Where the terms of all questions are
    too many for a broadcast, Spark deals out the counts by term instead.
    """
    terms = questions.select("query_id", F.explode(F.array_distinct(T.search_tokens(F.col("text")))).alias("term"))
    scored = postings(chunks.repartition("id")).join(terms, "term").groupBy("query_id", "id").agg(F.sum("tf").alias("hits"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hits"), "id"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k)

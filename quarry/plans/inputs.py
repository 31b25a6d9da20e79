"""The test tables as documents, pages, chunks and questions; one text of each expression serves Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import places


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts in which every rule finds something, made of the stored ones.
DERIVED = """CASE row_id % 13
 WHEN 0 THEN 'List of Figures' || chr(10) || text
 WHEN 1 THEN 'Contents' || chr(10) || 'Intro ..... 3' || chr(10) || 'Methods ..... 14' || chr(10) || 'Results .... xii' || chr(10) || 'a' || chr(10) || 'b' || chr(10) || 'c   7' || chr(10) || text
 WHEN 2 THEN 'Appendix A' || chr(10) || text
 WHEN 3 THEN '# Appendix B' || chr(10) || text
 WHEN 4 THEN text || chr(10) || '6 References:' || chr(10) || 'Doe 2019'
 WHEN 5 THEN text || chr(10) || '# **References**' || chr(10) || 'Doe 2019'
 WHEN 6 THEN '###SEC### Part ' || CAST(row_id AS STRING) || chr(10) || text
 WHEN 7 THEN '# Part ' || CAST(row_id AS STRING) || chr(10) || text || chr(10) || '| a | b |' || chr(10) || '| 1 | 2 |' || chr(10) || '17' || chr(10) || '12  34 56'
 WHEN 8 THEN text || ' (Doe et al., 2019) [1, 2-4] see doi 10.1234/abc.' || CAST(row_id AS STRING) || ').'
 WHEN 9 THEN text || chr(10) || '![fig](images/p' || CAST(row_id AS STRING) || '.png)' || chr(10) || '**==> picture [1 x 2] intentionally omitted <==**' || chr(10) || '![b](images/q.png)'
 WHEN 10 THEN '1. Note one of the page' || chr(10) || chr(10) || text || chr(10) || chr(10) || '2. Last'
 WHEN 11 THEN 'Running head' || chr(10) || '  spaced   line  ' || chr(10) || 'hyphen-' || chr(10) || 'ated' || chr(10) || chr(10) || text
 ELSE text END"""

PAGES_SQL = "pages_raw AS (SELECT source AS doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_num, doc_id AS row_id, text FROM documents)"
DERIVED_SQL = f"{PAGES_SQL}, p AS (SELECT doc_id, page_num, row_id, {DERIVED} AS text FROM pages_raw)"
PLAIN_SQL = f"{PAGES_SQL}, p AS (SELECT * FROM pages_raw)"


#: Rows of a range of ids, in which the pages of a source are counted by one task.
RANGE_ROWS = 2048


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: doc_id (the source), page_num, row_id, text. A source may be a large share of the table, so its pages are counted by ranges of ids."""
    rows = read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("row_id"), "text")
    least, most, n = rows.agg(F.min("row_id"), F.max("row_id"), F.count("row_id")).first()
    width = max(1, -(-(most - least + 1) * RANGE_ROWS // n)) if n else 1
    # null ids come first, as they do in a window
    part = F.coalesce(F.floor((F.col("row_id") - F.lit(least)) / width), F.lit(-1))
    out = places.running(rows, "doc_id", part, "row_id", F.lit(1), "page_num")
    return out.select("doc_id", F.col("page_num").cast("int").alias("page_num"), "row_id", "text")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(spark, sf_dir).select("doc_id", "page_num", "row_id", F.expr(DERIVED).alias("text"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the document of the same id: id, source_file, section, text, embedding."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_file"), "text")
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(docs, "id", "full_outer")


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The stored vector of id 7 as the question's."""
    found = read(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()
    return found[0] if found else []


def query_terms(spark: SparkSession, sf_dir: str) -> list[str]:
    """Terms of the first benchmark text as the question's."""
    from quarry.functions import text as T

    found = read(spark, sf_dir, "benchmark").where("item_id = 0").select(F.array_distinct(T.search_tokens(F.col("text")))).first()
    return found[0] if found else []

"""The chunk table: Parquet, partitioned by source file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.profiles import LAYOUT, Profile

COLUMNS = "chunk_id string, section string, text string, page_num int, embedding_dense array<float>, embedding_sparse map<string,double>, metadata string, source_file string"


def prepared(chunks: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Chunk rows as table rows: vectors of another length left out, defaults for what is missing, metadata as JSON."""
    note = F.col("type").startswith("footnote")
    section = F.when(F.lit(profile.name == "markdown") & note, "Nota de Rodapé").otherwise(profile.general_section)
    metadata = F.to_json(F.struct("metadata.*", "image_path", "caption", F.when(F.col("type") == "figure", "image").otherwise("text").alias("chunk_type")))
    return chunks.where(F.size("embedding_dense") == profile.dimension).select(
        F.col("chunk_id").cast("string").alias("chunk_id"), F.coalesce("section", section).alias("section"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("page_num", F.lit(0)).alias("page_num"),
        "embedding_dense", F.coalesce("embedding_sparse", F.expr("cast(map() as map<string,double>)")).alias("embedding_sparse"), metadata.alias("metadata"), "source_file",
    )


def create(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({COLUMNS}) USING parquet PARTITIONED BY (source_file)")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("source_file").parquet(path)


def replace_documents(rows: DataFrame, path: str) -> None:
    """Rows of the same source files go; others stay. Running it again changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_file").parquet(path)


def reload(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("source_file").parquet(path)


def replaced(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The table after a replacement by document, as a frame."""
    return existing.join(incoming.select("source_file").distinct(), "source_file", "left_anti").unionByName(incoming)


def metadata_of(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Files (doc_id, filename, filepath, title, author) with total_pages and the DOI of the first five pages."""
    from pyspark.sql import Window

    from quarry.functions import text as T

    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))
    # each task sends on five pages of a document at most
    head = pages.withColumn("r", place).where("r <= 5")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "text"))), lambda x: x["text"]), " ")
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_pages"))
    return files.join(sizes, "doc_id", "left").join(head.groupBy("doc_id").agg(T.extract_doi(text).alias("doi")), "doc_id", "left")

"""Readers and writers of document files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "struct<chunk_id:string,section:string,text:string,caption:string,image_path:string,image_size:string,start_word:int,end_word:int,word_count:int,type:string,page_num:int,embedding_dense:array<float>,embedding_sparse:map<string,double>>"
METADATA = "struct<filename:string,filepath:string,title:string,author:string,subject:string,keywords:string,creator:string,producer:string,creation_date:string,modification_date:string,total_pages:int,doi:string>"
DOCUMENT = f"metadata {METADATA}, document_type string, chunks array<{CHUNK}>, footnote_chunks array<{CHUNK}>, image_chunks array<{CHUNK}>"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, filename, content of the PDF files of a folder."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").load(folder)
    return found.select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Extracted documents, one JSON file each, with source_file."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return spark.read.option("multiLine", True).schema(DOCUMENT).json(path).withColumn("source_file", name)


def write_documents(docs: DataFrame, path: str) -> None:
    docs.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def chunk_rows(docs: DataFrame, kinds: tuple[str, ...] = ("chunks", "footnote_chunks", "image_chunks")) -> DataFrame:
    """One row for each chunk of the kinds, with source_file, metadata and defaults for what is missing."""
    every = F.flatten(F.array(*[F.coalesce(F.col(k), F.array().cast(f"array<{CHUNK}>")) for k in kinds]))
    return docs.select("source_file", "metadata", F.explode(every).alias("c")).select("source_file", "metadata", "c.*")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """CSV with cells of several lines."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_markdown(pages: DataFrame, path: str) -> None:
    """One text file for each document: its pages in order."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "text"))), lambda x: x["text"]), "\n\n")
    pages.groupBy("doc_id").agg(text.alias("value")).write.mode("overwrite").partitionBy("doc_id").text(path)

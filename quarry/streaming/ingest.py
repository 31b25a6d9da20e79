"""Incremental ingest of extracted documents: an extension, as the reference loads in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from quarry.profiles import LAYOUT, Profile
from quarry.sources import files, store


def ingest(spark: SparkSession, folder: str, table_path: str, checkpoint: str, profile: Profile = LAYOUT) -> StreamingQuery:
    """Every new JSON file of a folder replaces its document in the chunk table; a restart goes on from the checkpoint."""
    docs = spark.readStream.option("multiLine", True).schema(files.DOCUMENT).json(folder)
    from pyspark.sql import functions as F

    docs = docs.withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))

    def load(batch: DataFrame, number: int) -> None:
        store.replace_documents(store.prepared(files.chunk_rows(batch), profile), table_path)

    return docs.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

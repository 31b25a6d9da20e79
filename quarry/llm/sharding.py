"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are ranked in a seeded shuffle. Row r of n has the fractional rank
(r + 1/2) / n, so the rows of every source are spread evenly over [0, 1). All rows sorted
by that rank are cut into shards of equal counts: each cut takes its share of every source.

Neither ranking puts a source into one task. A rank is the number of rows in earlier
buckets plus the rank inside a bucket; buckets are slices of the hash, or of the
fractional rank, both of which spread evenly whatever the skew of the sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import group_key, table

#: Slices into which a ranking is dealt. Their counts are the only thing gathered by source.
BUCKETS = 4096


def interleave(docs: DataFrame, shards: int = 24, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Assign every row to one of `shards` shards, whose counts are at most one apart.

    Returns doc_id, source, size (UTF-8 bytes and 8), text_crc32, shard, slot (place in the
    shard, gapless from 0). A null text has no bytes and crc32 0; null sources are one
    source. Rows with equal ids are told apart by source, size and crc32; equal rows are
    interchangeable. An empty table gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), group_key(F.col(f"`{source_col}`")).alias("_s"),
        (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(F.col(f"`{id_col}`"), F.lit(seed)).alias("_h"),
    )
    rows = rows.withColumn("_b", F.shiftrightunsigned("_h", 52))

    per_bucket = rows.groupBy("_s", "_b").agg(F.count(F.lit(1)).alias("_c"))
    per_source = Window.partitionBy("_s")
    offsets = per_bucket.select(
        "_s", "_b", (F.sum("_c").over(per_source.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_before"),
        F.sum("_c").over(per_source).alias("_n"),
    )
    ranked = rows.join(offsets, ["_s", "_b"])
    inside = Window.partitionBy("_s", "_b").orderBy("_h", "doc_id", "size", "text_crc32")
    ranked = ranked.withColumn("_r", F.col("_before") + F.row_number().over(inside) - 1)
    # exact in whole numbers: the bucket of the fractional rank (2r + 1) / 2n
    ranked = ranked.withColumn("_f", (2 * F.col("_r") + 1) / (2 * F.col("_n")))
    ranked = ranked.withColumn("_g", F.least(F.lit(BUCKETS - 1).cast("long"), F.floor(F.col("_f") * BUCKETS)))

    # the slices of [0, 1): at most BUCKETS rows, whatever the input
    slices = ranked.groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    everything = Window.partitionBy(F.lit(0))
    slices = slices.select(
        "_g", (F.sum("_c").over(everything.orderBy("_g").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_first"),
        F.sum("_c").over(everything).alias("_total"),
    )
    placed = ranked.join(slices, "_g")
    order = Window.partitionBy("_g").orderBy("_f", "_s", "_h", "doc_id", "size", "text_crc32")
    place = F.col("_first") + F.row_number().over(order) - 1
    placed = placed.withColumn("_p", place).withColumn("shard", F.expr(f"(_p * {shards}) div _total").cast("int"))
    first = F.expr(f"(cast(shard as long) * _total + {shards - 1}) div {shards}")
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", (F.col("_p") - first).alias("slot"))


def op8_stratified_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 24 shards; law `rows`, as equal texts need not stay together."""
    done = interleave(table(spark, sf_dir, "documents"), shards=24)
    return done.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_stratified_interleave": op8_stratified_interleave}
ORACLES: dict[str, str] = {}

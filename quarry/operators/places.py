"""Running sums over rows of one key that may be a large share of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(rows: DataFrame, by: str, part: Column, order: str, value: Column, name: str) -> DataFrame:
    """rows with the sum of a value over the rows of the same key up to each, itself included, in order.

    part ascends with the order and cuts each key into parts that one task can hold. The sums of
    earlier parts, one row a part, are broadcast. Null is a key of its own.
    """
    cut = rows.withColumn("_part", part)
    sums = cut.select(by, "_part", value.alias("_v")).groupBy(by, "_part").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")
    earlier = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_of"), before.alias("_before"))
    own = F.sum(value).over(Window.partitionBy(by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    met = cut.withColumn(name, own).join(F.broadcast(earlier), F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_of")))
    return met.select(*rows.columns, (F.col(name) + F.col("_before")).alias(name))

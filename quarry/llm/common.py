"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words; a word is a run of any others.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset a folder of the warehouse."""
    return spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/quarry-shared"


#: Bytes of rows that go to a Python worker at once; a longer row goes alone.
ARROW_BYTES = 8 << 20


def bounded(spark: SparkSession) -> None:
    """Bound what goes to a Python worker at once by bytes, as texts differ in length; a smaller bound of the caller's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    value, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(name).strip().lower()).groups()
    if int(value) << 10 * " kmgtp".index(unit or " ") > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: its lineage ends here.

    The table outlives lost executors. It is not removed here, as the returned frame
    still reads it; the folder belongs to one application and goes with it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+|[{SPACE}]+$", ""), f"[{SPACE}]+")
    return F.when(F.coalesce(text, F.lit("")).rlike(f"[^{SPACE}]"), parts).otherwise(F.array().cast("array<string>"))


def group_key(column: Column) -> Column:
    """A string that tells null apart from every value, so that null is a group of its own."""
    return F.when(column.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), column.cast("string")))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named by place, so that none can clash, and the new name of each old one."""
    place = {c: f"own_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*place.values()), place


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone; extra columns, whatever their names, take no part."""
    return df.select(*[F.col(f"`{n}`") for n in names])

"""Tables of a database over JDBC."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Y


@dataclass(frozen=True)
class Database:
    """Where a database is. Drivers are on the session's class path."""

    url: str
    user: str | None = None
    password: str | None = field(default=None, repr=False)
    driver: str | None = None

    def options(self) -> dict[str, str]:
        given = {"url": self.url, "user": self.user, "password": self.password, "driver": self.driver}
        return {k: v for k, v in given.items() if v is not None}


def postgres(host: str, database: str, user: str, password: str, port: int = 5432) -> Database:
    return Database(f"jdbc:postgresql://{host}:{port}/{database}", user, password, "org.postgresql.Driver")


def read(spark: SparkSession, db: Database, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 64) -> DataFrame:
    """A table. With a whole-number key and its bounds it is read in so many ranges at once; rows outside the bounds are in the first and last."""
    reader = spark.read.format("jdbc").options(**db.options()).option("dbtable", table)
    if key and bounds:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def plain(rows: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, which any database holds."""
    nested = (Y.ArrayType, Y.MapType, Y.StructType)
    return rows.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in rows.schema.fields])


def append(rows: DataFrame, db: Database, table: str, batch: int = 1000, parts: int = 16) -> None:
    """Rows added to a table over so many connections at most. A task that is run again may add its rows twice: a unique key, or a table replaced whole, guards against it."""
    plain(rows).write.format("jdbc").options(**db.options()).option("dbtable", table).option("batchsize", batch).option("numPartitions", parts).mode("append").save()


def replace(rows: DataFrame, db: Database, table: str, batch: int = 1000, parts: int = 16) -> None:
    """The table emptied, its definition kept, and filled anew."""
    plain(rows).write.format("jdbc").options(**db.options()).option("dbtable", table).option("batchsize", batch).option("numPartitions", parts).option("truncate", "true").mode("overwrite").save()

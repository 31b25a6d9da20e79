"""An index for nearest neighbours by cosine: cells of k-means, each a partition of a Parquet table.

A search reads the cells whose centres are nearest to the question and ranks their vectors
exactly; other cells are never opened. With as many probes as cells it is the exact search.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import vectors as V
from quarry.operators import retrieval

#: Centres are learned from about this many vectors, whatever the table's size; every vector is indexed.
SAMPLE, MOST_CELLS = 200_000, 4096


def _usable(c: Column, dimension: int) -> Column:
    return (F.size(c) == dimension) & F.forall(V.doubles(c), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (V.norm(c) > 0)


def _directions(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors of unit length for all that can be compared; the others have no direction and are not indexed."""
    rows = vectors.where(_usable(F.col("embedding"), dimension))
    return rows.withColumn("_n", V.norm(F.col("embedding"))).withColumn("_unit", array_to_vector(F.transform(V.doubles(F.col("embedding")), lambda x: x / F.col("_n")))).drop("_n")


def learn(vectors: DataFrame, dimension: int, cells: int | None = None, seed: int = 5) -> KMeansModel:
    """Centres for vectors (id, embedding): about the root of their number, MOST_CELLS at most."""
    n = vectors.count()
    cells = cells or int(min(MOST_CELLS, max(1, round(n**0.5))))
    part = vectors.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, SAMPLE / max(n, 1)) * 1_000_000))
    return KMeans(k=cells, seed=seed, maxIter=10, initMode="random", featuresCol="_unit", predictionCol="cell").fit(_directions(part, dimension))


def assign(vectors: DataFrame, model: KMeansModel, dimension: int) -> DataFrame:
    """Vectors with the cell of each."""
    return model.transform(_directions(vectors, dimension)).drop("_unit")


def nearest_cells(model: KMeansModel, query: list[float], probes: int) -> list[int]:
    centres = np.array(model.clusterCenters())
    x = np.asarray(query, dtype=np.float64)
    far = ((centres - x / np.linalg.norm(x)) ** 2).sum(axis=1)
    return np.argsort(far, kind="stable")[:probes].tolist()


def search(indexed: DataFrame, model: KMeansModel, query: list[float], k: int, probes: int = 16) -> DataFrame:
    """The k nearest of the probed cells: id, distance, similarity."""
    return retrieval.dense(indexed.where(F.col("cell").isin(nearest_cells(model, query, probes))), query, k)


def write(vectors: DataFrame, path: str, dimension: int, cells: int | None = None, seed: int = 5) -> None:
    """The index at a path that all executors reach. Rows are dealt by cell and large cells are split, so files are few and no task holds a hot cell."""
    model = learn(vectors, dimension, cells, seed)
    model.write().overwrite().save(f"{path}/centres")
    assign(vectors, model, dimension).hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, KMeansModel]:
    return spark.read.parquet(f"{path}/cells"), KMeansModel.load(f"{path}/centres")

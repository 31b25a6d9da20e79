"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors of the largest inner product are found by distance: with one more component that
gives all vectors the largest norm, the nearest vectors have the largest inner product.
A table hashes a vector by `k` Gaussian projections, each cut into cells of a fixed width.
For a neighbour whose cosine with the query is `rho`, each projection is Gaussian around rho
times the query's, so the chance of every cell is known; a query visits the buckets of a
table in descending chance until the sum reaches `success`, perturbed cells included. Tables
are independent: with L tables a neighbour is missed with a chance of (1 - success) ** L.

Equal vectors are one class with the smallest of its ids, as many as a result can hold, so
a vector with a third of all rows is searched once. Chunks of buckets are dealt to tasks of a
bounded number of vectors and of queries; each returns its best by exact inner product and then
by smallest id, and those are merged by query. A query that found too little goes through all chunks.
`rho` comes from a bounded sample of cosines, as the nearest of few vectors are further off.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded, table, written

TABLES = 4
#: Width of a cell in standard deviations of a projection.
WIDTH = 1.2
#: Vectors, and queries among them, of the sample that tells the usual cosine of the last neighbour asked for.
SAMPLE, SAMPLE_QUERIES = 4096, 128
#: Chance of a neighbour in the buckets that a query visits in one table.
SUCCESS = 0.6
#: Classes of a bucket to aim at; projections are added as the input grows, up to MOST_K.
PER_BUCKET = 1024
MOST_K = 7
#: Cells of a table that a query weighs; where they don't reach `success`, the query goes through all chunks.
CELLS = 20_000
#: Vectors of a bucket that stay together, vectors of a task, and queries of a task.
CHUNK, PER_TASK, QUERIES_PER_TASK = 4096, 16_384, 8192
SEED = 7


def _numbers(column: pd.Series) -> np.ndarray:
    return np.stack([np.frombuffer(x, "<f8") for x in column]) if len(column) else np.empty((0, 0))


def projections(dim: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Directions (tables, k, dim) and offsets (tables, k)."""
    pick = np.random.default_rng(seed)
    return pick.standard_normal((TABLES, k, dim)), pick.uniform(0, WIDTH, (TABLES, k))


def _codes(cells: np.ndarray, t: int) -> np.ndarray:
    """One number for the cells of each row in table t: a byte each, so 7 at most."""
    out = np.full(len(cells), t, np.int64)
    for j in range(cells.shape[1]):
        out = out * 256 + (cells[:, j] + 128)
    return out


def bucket_codes(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows, tables): the bucket of each row in each table."""
    return np.stack([_codes(np.clip(np.floor((points @ a[t].T + b[t]) / WIDTH), -128, 127).astype(np.int64), t) for t in range(len(a))], axis=1)


_GRID = np.linspace(-8, 8, 16_001)
_NORMAL = np.array([0.5 * (1 + math.erf(x / math.sqrt(2))) for x in _GRID])


def _phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, to about seven digits."""
    return np.interp(x, _GRID, _NORMAL)


def usual_cosine(sample: np.ndarray, total: int, top: int) -> float:
    """The cosine that the last of the `top` nearest of `total` vectors usually has with a query.

    Cosines within the sample (rows of norm 1) have a mean and a spread; the last neighbour
    stands where a normal distribution leaves top of total above it. With clusters the real
    neighbours are nearer than that, and are found more often.
    """
    asks = sample[:SAMPLE_QUERIES]
    cosines = asks @ sample.T
    cosines = cosines[~np.eye(len(asks), len(sample), dtype=bool)]
    if not len(cosines):
        return 0.5
    beyond = float(np.interp(max(0.5, 1 - top / max(total, 1)), _NORMAL[8000:], _GRID[8000:]))
    return float(np.clip(cosines.mean() + beyond * cosines.std(), 0.05, 0.95))


def probes(point: np.ndarray, a: np.ndarray, b: np.ndarray, rho: float, success: float) -> list[int] | None:
    """Buckets of all tables to visit, in descending chance within a table; None where CELLS cells of a table don't reach `success`."""
    found = []
    spread = math.sqrt(1 - rho * rho)
    for t in range(len(a)):
        u = a[t] @ point
        chance, cells = np.ones(1), np.zeros((1, 0), np.int64)
        for j in range(len(u)):
            low = math.floor((min(rho * u[j], 0) - 3 + b[t, j]) / WIDTH)
            high = math.floor((max(rho * u[j], 0) + 3 + b[t, j]) / WIDTH)
            own = np.arange(low, high + 1)
            edge = _phi((np.append(own, high + 1) * WIDTH - b[t, j] - rho * u[j]) / spread)
            p = np.diff(edge)
            chance = (chance[:, None] * p[None, :]).reshape(-1)
            cells = np.concatenate((np.repeat(cells, len(own), axis=0), np.tile(own, len(cells))[:, None]), axis=1)
            keep = np.argsort(-chance, kind="stable")[:CELLS]
            chance, cells = chance[keep], cells[keep]
        reached = np.cumsum(chance)
        if reached[-1] < success:
            return None
        some = int(np.searchsorted(reached, success)) + 1
        found += _codes(np.clip(cells[:some], -128, 127), t).tolist()
    return found


def classes_of(vectors: DataFrame, id_col: str, vec_col: str, keep: int, every: int) -> DataFrame:
    """vec (doubles), ids (the smallest of the rows in a batch, at most keep), asked (ids divisible by every), norm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own: dict[bytes, list[int]] = {}
            for i, v in zip(batch["id"].tolist(), batch["vec"]):
                x = np.asarray(v, "<f8")
                if len(x) and np.isfinite(x).all() and x.any():
                    own.setdefault((x + 0.0).tobytes(), []).append(i)
            ids = [sorted(set(x)) for x in own.values()]
            yield pd.DataFrame({
                "vec": list(own), "ids": [x[:keep] for x in ids], "asked": [[i for i in x if i % every == 0] for x in ids],
                "norm": [float(np.linalg.norm(np.frombuffer(x, "<f8"))) for x in own],
            })

    whole = F.col(f"`{vec_col}`")
    rows = vectors.where(F.col(f"`{id_col}`").isNotNull() & whole.isNotNull() & ~F.exists(whole, lambda x: x.isNull()))
    rows = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole.cast("array<double>").alias("vec"))
    return rows.mapInPandas(run, "vec binary, ids array<long>, asked array<long>, norm double")


def _best(members: pd.DataFrame, top: int) -> pd.DataFrame:
    """The nearest `top` of the vectors (kind 0) in a query's buckets to each query (kind 1), by exact inner product.

    Equal products go to the class with the smaller least id: its ids come before those that
    are left out.
    """
    data, asks = members[members["kind"] == 0].sort_values("bucket", kind="stable"), members[members["kind"] == 1]
    out_q, out_c, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    if len(data) and len(asks):
        x, names, at, least = _numbers(data["vec"]), data["cls"].to_numpy(), data["bucket"].to_numpy(), data["least"].to_numpy()
        # twice what two ways of adding up an inner product may differ by, for a query of norm 1
        slack = 4 * x.shape[1] * np.finfo(float).eps * np.sqrt((x * x).sum(axis=1).max())
        for who, vec, buckets in zip(asks["cls"].tolist(), asks["vec"], asks["buckets"]):
            y = np.frombuffer(vec, "<f8")
            own = np.sort(np.asarray(buckets, np.int64))
            first, size = np.searchsorted(at, own, "left"), np.searchsorted(at, own, "right")
            size = size - first
            rows = np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)
            if not len(rows):
                continue
            # a class stands once in each table at most, so those at or above the cut are `top` classes at least; all that tie with it stay
            rough = x[rows] @ y
            most = min(len(rows), TABLES * top)
            cut = np.partition(rough, len(rows) - most)[len(rows) - most]
            some = rows[~(rough < cut - slack * np.linalg.norm(y))]
            cls, first = np.unique(names[some], return_index=True)
            exact = (x[some[first]] * y).sum(axis=1)
            by = np.lexsort((least[some[first]], -exact))[:top]
            out_q.append(np.full(len(by), who))
            out_c.append(cls[by])
            out_s.append(exact[by])
    return pd.DataFrame({"q": np.concatenate(out_q), "cls": np.concatenate(out_c), "score": np.concatenate(out_s)})


#: Stands for all buckets; no bucket has it as its code.
EVERYWHERE = -1
FOUND = "q long, cls long, score double"


def nearest(vectors: DataFrame, top: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", rho: float | None = None, success: float = SUCCESS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest by inner product of every row whose id is divisible by `every`.

    Rows without an id, and vectors that are null, empty, zero, or hold null or non-finite
    components take no part; neither do vectors of another length than most. Rows of one id
    and vector count once; a query never returns its own id. Ties go to the smaller id. Where
    fewer than `top` others exist, all are returned. An empty table gives no rows. rho: the
    cosine (after the added component) of neighbours to be found with a chance of `success`
    in each table; without it, that of a sample of about SAMPLE vectors. With a success of 1
    every query goes through all vectors, and the result is exact.
    """
    spark = vectors.sparkSession
    bounded(spark)
    parts = written(classes_of(vectors, id_col, vec_col, top + 1, every), "vectors")
    length = parts.groupBy(F.octet_length("vec").alias("n")).agg(F.sum(F.size("ids")).alias("c")).orderBy(F.desc("c"), F.desc("n")).limit(1).collect()
    if not length:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = parts.where(F.octet_length("vec") == length[0].n).withColumn("cls", F.xxhash64("vec"))
    # by batch at most top + 1 ids of a class: what is gathered for it is small beside its rows
    ids = F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, top + 1)
    classes = written(parts.groupBy("cls").agg(F.first("vec").alias("vec"), ids.alias("ids"), F.max("norm").alias("norm"), F.max(F.size("asked") > 0).alias("asked")), "classes")
    asked = parts.select("cls", F.explode("asked").alias("query_id")).distinct()
    n, most = classes.agg(F.count(F.lit(1)), F.max("norm")).first()
    dim = length[0].n // 8
    k = max(1, min(MOST_K, round(math.log(n / PER_BUCKET) / math.log(3))))
    a, b = projections(dim + 1, k)
    if rho is None:
        # one of so many classes that about SAMPLE come, whatever the input
        some = classes.where(F.pmod(F.xxhash64("cls"), F.lit(-(-n // SAMPLE))) == 0).select("cls", "vec").collect()
        sample = _numbers(pd.Series([bytes(r.vec) for r in sorted(some)] or [bytes(classes.select("vec").first().vec)]))
        # candidates are scaled to the largest norm and get one more component, queries are of norm 1
        rho = usual_cosine(sample / np.linalg.norm(sample, axis=1, keepdims=True), n, top) * float(np.linalg.norm(sample, axis=1).mean() / most)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _numbers(batch["vec"]) / most
            if not len(x):
                continue
            x = np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]), axis=1)
            codes = bucket_codes(x, a, b)
            yield pd.DataFrame({"bucket": codes.reshape(-1), "cls": np.repeat(batch["cls"].to_numpy(), codes.shape[1]), "least": np.repeat(batch["least"].to_numpy(), codes.shape[1]), "vec": np.repeat(batch["vec"].to_numpy(), codes.shape[1])})

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _numbers(batch["vec"])
            for cls, v in zip(batch["cls"], x):
                found = probes(np.append(v / np.linalg.norm(v), 0.0), a, b, rho, success)
                yield pd.DataFrame({"bucket": np.array([EVERYWHERE] if found is None else list(dict.fromkeys(found)), np.int64), "cls": cls})

    queries = classes.where("asked").select("cls", "vec")
    least = F.col("ids")[0].alias("least")
    index = classes.select("cls", least, "vec").mapInPandas(place, "bucket long, cls long, least long, vec binary")
    visits = written(queries.mapInPandas(visit, "bucket long, cls long"), "visits")
    result = written(_met(index, n * len(a), visits, queries, top + 1), "found")

    ready = result.join(classes.select("cls", "ids"), "cls").groupBy("q").agg(F.sum(F.size("ids")).alias("n"))
    # what can be found at all: ids of all classes, the query's own left out
    total = classes.agg(F.sum(F.size("ids"))).first()[0]
    short = queries.join(ready.withColumnRenamed("q", "cls"), "cls", "left").where(F.coalesce("n", F.lit(0)) < min(top + 1, total)).select("cls", "vec")
    short = written(short.union(visits.where(F.col("bucket") == EVERYWHERE).select("cls").join(queries, "cls")).dropDuplicates(["cls"]), "unfinished")
    if not short.isEmpty():
        chunks = -(-n // CHUNK)
        everywhere = short.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("bucket"), "cls")
        rest = classes.select(F.pmod(F.xxhash64("cls"), F.lit(chunks)).alias("bucket"), "cls", least, "vec")
        result = result.union(_met(rest, n, everywhere, short, top + 1))
    result = result.groupBy("q", "cls").agg(F.max("score").alias("score"))
    # classes with the score of the last one stay, as their ids decide
    result = result.withColumn("r", F.rank().over(Window.partitionBy("q").orderBy(F.desc("score")))).where(F.col("r") <= top + 1)
    by = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    each = result.join(classes.select("cls", "ids"), "cls").select("q", "score", F.explode("ids").alias("vec_id"))
    each = each.withColumn("r", F.row_number().over(by)).where(F.col("r") <= top + 1)
    lists = each.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("all"))
    out = asked.join(lists, asked.cls == lists.q).select("query_id", F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("query_id")), 1, top).alias("all"))
    return out.select("query_id", F.posexplode("all").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def _met(index: DataFrame, rows: int, visits: DataFrame, queries: DataFrame, top: int) -> DataFrame:
    """Vectors (bucket, cls, least, vec), visits (bucket, cls) and queries (cls, vec) -> q, cls, score: the best of each task for each query.

    Chunks of buckets are dealt to tasks; a query comes once to a task, with the buckets that it visits there.
    """
    tasks = max(1, -(-rows // PER_TASK))
    chunks = index.groupBy("bucket").agg(F.expr(f"cast(ceil(count(1) / {CHUNK}) as int)").alias("chunks"))
    turns = max(1, -(-queries.count() // QUERIES_PER_TASK))
    deal = F.pmod(F.xxhash64("bucket", "chunk"), F.lit(tasks)).cast("int").alias("task")
    data = index.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int"))
    data = data.select(deal, F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"), F.lit(0).alias("kind"), "cls", "least", "vec", "bucket", F.lit(None).cast("array<long>").alias("buckets"))
    met = visits.join(chunks, "bucket").select("cls", "bucket", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    met = met.select("cls", "bucket", deal).groupBy("task", "cls").agg(F.collect_set("bucket").alias("buckets"))
    asks = met.join(queries, "cls").select("task", F.pmod(F.xxhash64("cls"), F.lit(turns)).cast("int").alias("turn"), F.lit(1).alias("kind"), "cls", F.lit(0).cast("long").alias("least"), "vec", F.lit(0).cast("long").alias("bucket"), "buckets")
    return data.union(asks).groupBy("task", "turn").applyInPandas(lambda members: _best(members, top), FOUND)


def op3_multiprobe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_multiprobe": op3_multiprobe}
ORACLES: dict[str, str] = {}

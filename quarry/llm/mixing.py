"""Mixing sources to target weights as a time-varying curriculum, with DataFrame functions only.

Each source has a weight schedule over training time [0, 1]: straight lines between knots.
The integral of its schedule is the source's weight in the whole mix. Targets follow the
weights, held at `max_repeat` times what a source has; the excess is shared out again by
weight. A source's documents stand in a seeded shuffle. The copy of a document that covers
a place in the source's cumulative tokens is trained when the source's cumulative demand
reaches that place: the position is the inverse of the integrated schedule there.

A source may hold a third of all rows, so its running sum is not made in one task: it is
the sum of earlier slices of the shuffle plus the running sum inside a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, group_key, shielded, table

#: Schedules of sources in code point order, repeating: (time, weight) knots with integrals 5, 2 and 1.
SCHEDULES = (((0.0, 6.0), (1.0, 4.0)), ((0.0, 1.0), (0.5, 2.0), (1.0, 3.0)), ((0.0, 1.0), (1.0, 1.0)))
MAX_REPEAT = 3
#: Hexadecimal digits of the shuffle key that make a slice.
SLICE_DIGITS = 3


def integral(knots) -> float:
    """The area under straight lines between knots: the weight of a source."""
    if knots[0][0] != 0.0 or knots[-1][0] != 1.0 or any(b[0] <= a[0] for a, b in zip(knots, knots[1:])) or any(w < 0 for _, w in knots):
        raise ValueError("knots run from time 0 to 1 in ascending order with weights of 0 or more")
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))


def _weight(index: Column, schedules) -> Column:
    out = F.lit(float(integral(schedules[-1])))
    for k in reversed(range(len(schedules) - 1)):
        out = F.when(index % len(schedules) == k, F.lit(float(integral(schedules[k])))).otherwise(out)
    return out


def invert(share: Column, knots) -> Column:
    """The time at which the integrated schedule has reached `share` of its whole."""
    total, done, out = integral(knots), 0.0, None
    pieces = []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (w0 + w1) / 2
        pieces.append((t0, t1, w0, (w1 - w0) / (t1 - t0), done, done + area))
        done += area
    for t0, t1, w0, slope, low, high in reversed(pieces):
        need = share * total - low  # = w0 x + slope x^2 / 2
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + 2 * slope * need))
        time = F.least(F.lit(t1), F.lit(t0) + F.when(root + w0 > 0, 2 * need / (root + w0)).otherwise(F.lit(0.0)))
        out = time if out is None else F.when(share * total < high, time).otherwise(out)
    return out


def targets(sizes: DataFrame, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """_s, _size, source -> with _k (place by code point, null last), _weight and target.

    Water filling: sources in the order of room per weight fill up one by one; the level
    is the first at which the next source has room left.
    """
    whole = Window.partitionBy(F.lit(0))
    by_name = whole.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("_k", F.row_number().over(by_name) - 1).withColumn("_weight", _weight(F.row_number().over(by_name) - 1, schedules))
    out = out.withColumn("_cap", F.lit(float(max_repeat)) * F.col("_size"))
    out = out.withColumn("_room", F.when(F.col("_weight") > 0, F.col("_cap") / F.col("_weight")))
    by_room = whole.orderBy(F.col("_room").asc_nulls_last(), F.col("_k")).rowsBetween(Window.unboundedPreceding, 0)
    left = F.sum("_size").over(whole) - (F.sum("_cap").over(by_room) - F.col("_cap"))
    weight_left = F.sum("_weight").over(whole) - (F.sum("_weight").over(by_room) - F.col("_weight"))
    out = out.withColumn("_level", F.when(F.col("_weight") > 0, left / weight_left))
    out = out.withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_room"), F.struct("_room", "_k", "_level"))).over(whole)["_level"])
    level = F.col("_level") * F.col("_weight")
    return out.withColumn("target", F.when((F.col("_weight") <= 0) | F.col("_level").isNull(), F.lit(0.0)).otherwise(F.least(F.col("_cap"), level))).drop("_cap", "_room", "_level")


def mix(docs: DataFrame, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Each row of docs with what the mix takes of it.

    Adds _size, _source_size, _target, _copies, _taken and _positions (one for each copy,
    ascending); columns of docs by these names are left out. A null text has size 0; null
    sources are one source, the last. Rows of size 0 take nothing but keep a place. Equal
    ids, null ones too, keep a fixed order by size and text; equal rows are interchangeable.
    An empty table gives no rows.
    """
    own, place = shielded(docs)
    out = _mixed(own, schedules, max_repeat, seed, place[id_col], place[text_col], place[source_col])
    return out.select(*[F.col(p).alias(c) for c, p in place.items() if c.lower() not in ADDED], *ADDED)


#: What mix() adds to a row.
ADDED = ("_size", "_source_size", "_target", "_copies", "_taken", "_positions")


def _mixed(docs: DataFrame, schedules, max_repeat: int, seed: str, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select("*", group_key(F.col(source_col)).alias("_mix_s"), size.alias("_size"), key.alias("_mix_h"), F.xxhash64(text).alias("_mix_t"))
    rows = rows.withColumn("_mix_b", F.substring("_mix_h", 1, SLICE_DIGITS))

    per_slice = rows.groupBy("_mix_s", "_mix_b").agg(F.sum("_size").alias("_c"), F.min(source_col).alias("source"))
    sums = per_slice.groupBy("_mix_s").agg(F.sum("_c").alias("_size"), F.min("source").alias("source"))
    goal = targets(sums, schedules, max_repeat).select("_mix_s", "_k", F.col("_size").alias("_source_size"), F.col("target").alias("_target"))
    up_to = Window.partitionBy("_mix_s").orderBy("_mix_b").rowsBetween(Window.unboundedPreceding, 0)
    offsets = per_slice.select("_mix_s", "_mix_b", (F.sum("_c").over(up_to) - F.col("_c")).alias("_mix_before")).join(goal, "_mix_s")

    out = rows.join(offsets, ["_mix_s", "_mix_b"])
    inside = Window.partitionBy("_mix_s", "_mix_b").orderBy("_mix_h", F.col(id_col), "_size", "_mix_t").rowsBetween(Window.unboundedPreceding, 0)
    out = out.withColumn("_mix_start", F.col("_mix_before") + F.sum("_size").over(inside) - F.col("_size"))
    rounds = F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("_mix_rounds", F.least(rounds, F.lit(max_repeat).cast("long")))
    rest = F.col("_target") - F.col("_mix_rounds") * F.col("_source_size")
    extra = (F.col("_size") > 0) & (F.col("_mix_rounds") < max_repeat) & (2 * F.col("_mix_start") + F.col("_size") <= 2 * rest)
    copies = F.when(F.col("_size") > 0, F.col("_mix_rounds") + F.when(extra, 1).otherwise(0)).otherwise(F.lit(0))
    out = out.withColumn("_copies", copies.cast("int")).withColumn("_taken", F.col("_copies") * F.col("_size"))

    def position(e: Column) -> Column:
        share = F.least(F.lit(1.0), (e * F.col("_source_size") + F.col("_mix_start") + F.col("_size") / 2) / F.col("_target"))
        place = invert(share, schedules[-1])
        for k in reversed(range(len(schedules) - 1)):
            place = F.when(F.col("_k") % len(schedules) == k, invert(share, schedules[k])).otherwise(place)
        return place

    places = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    return out.withColumn("_positions", places).drop("_mix_s", "_mix_h", "_mix_b", "_mix_before", "_mix_start", "_mix_rounds", "_mix_t", "_k")


def curriculum(docs: DataFrame, schedules=SCHEDULES, max_repeat: int = MAX_REPEAT, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", position_col: str | None = "_position") -> DataFrame:
    """The mix itself: one row of docs for each copy, range-sorted by its training position.

    The position is a last column, unless position_col is None or a name that docs has.
    Awkward rows are as mix() has them.
    """
    own, place = shielded(docs)
    out = _mixed(own, schedules, max_repeat, seed, place[id_col], place[text_col], place[source_col])
    out = out.select(*place.values(), F.explode("_positions").alias("_position")).orderBy("_position", place[id_col])
    new = [F.col("_position").alias(position_col)] if position_col and position_col.lower() not in {c.lower() for c in docs.columns} else []
    return out.select(*[F.col(p).alias(c) for c, p in place.items()], *new)


def op2_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, the words taken and the training positions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"),
        F.round(F.get("_positions", F.lit(0)), 6).alias("first_position"),
    )
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


ORACLE = """
WITH d AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k
  FROM d GROUP BY source),
w AS (SELECT *, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             3.0::DOUBLE * source_size AS cap FROM s),
r AS (
  SELECT *, cap / weight AS room,
         CAST(sum(source_size) OVER () AS DOUBLE) - (sum(cap) OVER (ORDER BY cap / weight, k ROWS UNBOUNDED PRECEDING) - cap) AS words_left,
         sum(weight) OVER () - (sum(weight) OVER (ORDER BY cap / weight, k ROWS UNBOUNDED PRECEDING) - weight) AS weight_left
  FROM w),
v AS (SELECT first(words_left / weight_left ORDER BY room, k) AS level FROM r WHERE words_left / weight_left <= room),
t AS (SELECT source, source_size, k, least(cap, level * weight) AS target FROM r, v),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.k, t.target,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS begins,
         floor(t.target / t.source_size) AS rounds
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(rounds AS BIGINT) + CASE WHEN rounds < 3 AND 2 * begins + size <= 2 * (target - rounds * source_size) THEN 1 ELSE 0 END END AS copies,
         least(1.0::DOUBLE, (begins + size / 2.0::DOUBLE) / target) AS share
  FROM c)
SELECT doc_id, size, source_size, target, CAST(copies * size AS BIGINT) AS taken,
       round(CASE WHEN copies = 0 THEN NULL
            WHEN k % 3 = 0 THEN 2 * (share * 5) / (sqrt(greatest(0, 36.0::DOUBLE - 4 * (share * 5))) + 6)
            WHEN k % 3 = 1 THEN CASE WHEN share * 2 < 0.75
                 THEN 2 * (share * 2) / (sqrt(1.0::DOUBLE + 4 * (share * 2)) + 1)
                 ELSE 0.5 + 2 * (share * 2 - 0.75) / (sqrt(4.0::DOUBLE + 4 * (share * 2 - 0.75)) + 2) END
            ELSE share END, 6) AS first_position
FROM n
"""

QUERIES = {"op2_curriculum_mix": op2_curriculum_mix}
ORACLES = {"op2_curriculum_mix": ORACLE}

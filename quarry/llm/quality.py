"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Base rules reject short texts and texts of repeated passages. The rest are judged by a
vector of transformed statistics: the minimum covariance determinant of each language and
source gives a centre and a covariance that outliers don't pull, and a text far from the
centre by Mahalanobis distance is rejected.

Statistics are arrays inside the row of the text, and are written once. The estimate then
reads only those: it starts at medians and quartiles, at all rows and at two halves of them,
and each concentration step refits mean and covariance on the nearest share of the rows.
After a few steps the start of least determinant goes on until it settles. Thresholds come from counts by
distance bin, sums are of whole numbers in decimals, so any order of rows gives the same
result, and a group with a third of all rows is summed in part before it is shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import SPACE, group_key, table, words_of, written

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # hundredths of the words
#: The transformed statistics and the least standard deviation granted to each.
FEATURES = {"word_length": 0.6, "symbols": 0.05, "dup_lines": 0.15, "repeats": 0.15, "stutter": 0.1}
#: Largest value of each statistic: a mean word length beyond it counts as it.
MOST = 25.0
SCALE = 10_000
#: Share of rows on which the determinant is made least.
SHARE = 0.75
#: Steps that every start takes, most steps of the best of them, and the change of its log determinant that counts as none.
STEPS, MOST_STEPS, SETTLED = 2, 4, 0.01
#: Groups smaller than this are judged by all rows of their language, then by the whole table; a smaller table rejects nothing.
LEAST_GROUP = 100
#: Chance of a clean row beyond the cut, if rows were normal.
TAIL = 1e-5
BINS_PER_UNIT, MOST_BIN = 16, 4096
#: Pairs of language and source up to which models and pools (about 300 bytes each) are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 50_000


def chi2_cdf(x: float, d: int) -> float:
    """The regularised incomplete gamma function by its series."""
    a, y = d / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while abs(term) > 1e-16 * abs(total):
        k += 1
        term *= y / k
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter")


def _own(docs: DataFrame, text_col: str, kept: list[str], *more: Column) -> DataFrame:
    """row, a struct of the kept columns by place, t and more: no name of docs can clash with one of ours."""
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.lit(True).alias("end"))
    return docs.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"), *more)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row of docs, without its text, with the base statistics of the whole text and n_lines and n_stutter.

    A null text has no words. Words are runs of other than ASCII white space. A column of
    docs by the name of a statistic is left out.
    """
    kept = [c for c in docs.columns if c != text_col and c.lower() not in STATISTICS]
    return _statistics(_own(docs, text_col, kept), ["row"]).select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], *STATISTICS)


def _statistics(own: DataFrame, rest: list[str]) -> DataFrame:
    text = F.col("t")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))
    out = own.select(*rest, words_of(text).alias("_w"), lines.alias("_l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"))
    out = out.select(
        *rest, "n_symbols", F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    pair = lambda a, b: F.xxhash64(a, b)
    kept = [*rest, "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    after = lambda c, k: F.slice(c, k + 1, F.greatest(F.size(c), F.lit(1)))
    # hashes of 2, 4 and 8 words, each from two of the size before; those that reach past the end are cut off
    out = out.select(*kept, F.zip_with("_h1", after("_h1", 1), pair).alias("_h2"), F.size(F.filter(F.zip_with("_h1", after("_h1", 1), lambda a, b: a == b), lambda x: x)).cast("long").alias("n_stutter"))
    kept.append("n_stutter")
    out = out.select(*kept, F.zip_with("_h2", after("_h2", 2), pair).alias("_h4"))
    out = out.select(*kept, F.slice(F.zip_with("_h4", after("_h4", 4), pair), 1, F.greatest(F.size("_h4") - (WINDOW - 1), F.lit(0))).alias("_h8"))
    twice = F.size(F.array_distinct("_h8")) < F.size("_h8")
    empty = F.array().cast("array<struct<h:bigint,i:int>>")
    out = out.select(*kept, F.when(twice, F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(empty).alias("_p"))
    same = lambda s, j: F.get("_p", j - 1)["h"].eqNullSafe(s["h"]) | F.get("_p", j + 1)["h"].eqNullSafe(s["h"])
    out = out.select(*kept, F.sort_array(F.transform(F.filter("_p", same), lambda s: s["i"])).alias("_i"))
    covers = F.transform("_i", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_i", j + 1) - p, F.lit(WINDOW))))
    return out.select(*kept, F.aggregate(covers, F.lit(0).cast("long"), lambda a, b: a + b).alias("n_repeat_words"))


def _base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def _features() -> list[Column]:
    """Whole numbers, SCALE to the unit."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    raw = (
        F.least(F.col("word_chars") / words, F.lit(MOST)), F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))), F.sqrt(F.col("n_repeat_words") / words), F.sqrt(F.col("n_stutter") / words),
    )
    return [F.round(x * SCALE).cast("long").alias(f"_x{k}") for k, x in enumerate(raw)]


D = len(FEATURES)
FLOORS = list(FEATURES.values())


def _pools(rows: DataFrame) -> DataFrame:
    """_lang, _source -> _g, the pool that judges the pair, and _fit, the pools that its rows are fitted in.

    A pair is judged by its own rows, or by all of its language, or by the whole table: the
    first that is large enough. A pool holds all rows of its language or of the table, those
    of large pairs too; one that judges no pair, or is too small, is not fitted.
    """
    sizes = rows.groupBy("_lang", "_source").agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n"))
    by = Window.partitionBy("_lang")
    sizes = sizes.withColumn("in_lang", F.sum("n").over(by)).withColumn("least", F.min("n").over(by))
    lang_used = (F.col("in_lang") >= LEAST_GROUP) & (F.col("least") < LEAST_GROUP)
    all_used = sizes.agg(F.coalesce((F.min("in_lang") < LEAST_GROUP) & (F.sum("n") >= LEAST_GROUP), F.lit(False)).alias("all_used"))
    own, lang, whole = F.concat_ws("|", F.lit("pair"), "_lang", "_source"), F.concat_ws("|", F.lit("lang"), "_lang"), F.lit("all")
    judge_by = F.when(F.col("n") >= LEAST_GROUP, own).when(F.col("in_lang") >= LEAST_GROUP, lang).otherwise(whole)
    fits = F.array(F.when(F.col("n") >= LEAST_GROUP, own), F.when(lang_used, lang), F.when(F.col("all_used"), whole))
    return sizes.crossJoin(F.broadcast(all_used)).select("_lang", "_source", judge_by.alias("_g"), F.array_compact(fits).alias("_fit"))


def _medians(rows: DataFrame) -> DataFrame:
    """_g -> m0.., s0..: medians and scaled quartile ranges, from counts by bin of 1/200."""
    width = SCALE // 200
    bins = rows.select("_g", F.posexplode(F.array(*[F.expr(f"_x{k} div {width}") for k in range(D)])).alias("k", "bin"))
    # as a table, so that counts of one group are summed by bin and not all in the task of the group
    counts = written(bins.groupBy("_g", "k", "bin").agg(F.count(F.lit(1)).alias("c")), "quality-counts")
    by = Window.partitionBy("_g", "k")
    counts = counts.withColumn("up_to", F.sum("c").over(by.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(by))
    mark = lambda q: F.min(F.when(F.col("up_to") >= q * F.col("n"), F.col("bin")))
    marks = counts.groupBy("_g", "k").agg(mark(0.25).alias("q1"), mark(0.5).alias("q2"), mark(0.75).alias("q3"))
    out = marks.groupBy("_g").agg(*[F.max(F.when(F.col("k") == k, (F.col("q2") + 0.5) * width / SCALE)).alias(f"m{k}") for k in range(D)], *[F.max(F.when(F.col("k") == k, (F.col("q3") - F.col("q1")) * width / SCALE / 1.349)).alias(f"s{k}") for k in range(D)])
    # as a model: a diagonal covariance
    roots = [(F.sqrt(F.col(f"s{i}") * F.col(f"s{i}") + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i in range(D) for j in range(i + 1)]
    return out.select("_g", F.lit(0).alias("_s"), *[f"m{k}" for k in range(D)], *roots)


MODEL = [*[f"m{i}" for i in range(D)], *[f"l{i}{j}" for i in range(D) for j in range(i + 1)]]


def _sums() -> list[Column]:
    whole = lambda c: F.sum(c.cast("decimal(20,0)"))
    return [F.count(F.lit(1)).alias("c"), *[whole(F.col(f"_x{i}")).alias(f"a{i}") for i in range(D)], *[whole(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"b{i}{j}") for i in range(D) for j in range(i + 1)]]


def _fitted(total: DataFrame, grow: float) -> DataFrame:
    """_g, _s and sums -> the mean and the Cholesky root of the covariance, grown by a factor."""
    n = F.col("c").cast("double")
    out = total.select("_g", "_s", *[(F.col(f"a{i}").cast("double") / n / SCALE).alias(f"m{i}") for i in range(D)], *[(F.col(f"b{i}{j}").cast("double") / n / SCALE / SCALE).alias(f"b{i}{j}") for i in range(D) for j in range(i + 1)])
    for i in range(D):
        for j in range(i + 1):
            left = (F.col(f"b{i}{j}") - F.col(f"m{i}") * F.col(f"m{j}")) * grow + (FLOORS[i] ** 2 if i == j else 0.0)
            for k in range(j):
                left = left - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(left, F.lit(FLOORS[i] ** 2 / 4))) if i == j else left / F.col(f"l{j}{j}"))
    return out.select("_g", "_s", *MODEL)


def _starts(rows: DataFrame) -> DataFrame:
    """Models to start from, by _g and _s: 0 medians and quartiles, 1 all rows, 2 and 3 halves of the rows by a hash of their values."""
    half = F.pmod(F.xxhash64(*[f"_x{k}" for k in range(D)]), F.lit(2)).cast("int")
    sums = rows.select("*", F.explode(F.array(F.lit(1), half + 2)).alias("_s")).groupBy("_g", "_s").agg(*_sums())
    return _medians(rows).select("_g", "_s", *MODEL).union(_fitted(sums, 1.0))


def _distance(rows: DataFrame, model: DataFrame, how: str = "left") -> DataFrame:
    """rows with _d, the squared Mahalanobis distance: forward substitution with the Cholesky root. A row meets every start of its group."""
    out = rows.join(model, "_g", how)
    for i in range(D):
        left = F.col(f"_x{i}") / SCALE - F.col(f"m{i}")
        for j in range(i):
            left = left - F.col(f"l{i}{j}") * F.col(f"_y{j}")
        out = out.withColumn(f"_y{i}", left / F.col(f"l{i}{i}"))
    total = sum((F.col(f"_y{i}") * F.col(f"_y{i}") for i in range(1, D)), F.col("_y0") * F.col("_y0"))
    return out.withColumn("_d", total).drop(*MODEL, *[f"_y{i}" for i in range(D)])


def _log_det() -> Column:
    """The logarithm of the determinant of a model's covariance."""
    return sum((2 * F.log(F.col(f"l{i}{i}")) for i in range(D)), F.lit(0.0))


def _concentrate(rows: DataFrame, model: DataFrame) -> DataFrame:
    """One step: each model refitted on the nearest share of its group, whole bins of distance."""
    near = _distance(rows, model, "inner").withColumn("_bin", F.least(F.floor(F.sqrt("_d") * BINS_PER_UNIT), F.lit(MOST_BIN)))
    # as a table, so that a group's sums meet by bin and not all in the task of the group
    binned = written(near.groupBy("_g", "_s", "_bin").agg(*_sums()), "quality-bins")
    by = Window.partitionBy("_g", "_s")
    binned = binned.withColumn("before", F.sum("c").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).withColumn("n", F.sum("c").over(by))
    sums = [c for c in binned.columns if c[0] in "abc" and c != "before"]
    total = binned.where(F.col("before") < SHARE * F.col("n")).groupBy("_g", "_s").agg(*[F.sum(c).alias(c) for c in sums])
    return _fitted(total, SHARE / chi2_cdf(chi2_quantile(SHARE, D), D + 2))


def _estimate(fit: DataFrame, sent) -> DataFrame:
    """_g -> the model of least determinant that concentration steps reach from the starts; sent: how a model comes to the rows.

    Every start takes STEPS steps; the one of least determinant goes on until a step leaves
    its determinant as it is, or MOST_STEPS at most.
    """
    model = written(_starts(fit), "quality-model")
    for _ in range(STEPS):
        model = written(_concentrate(fit, sent(model)), "quality-model")
    best = model.groupBy("_g").agg(F.min_by(F.struct("_s", *MODEL), F.struct(F.round(_log_det(), 9), "_s")).alias("best"))
    model = written(best.select("_g", "best.*"), "quality-model")
    for _ in range(MOST_STEPS):
        was = model.select("_g", _log_det().alias("was"))
        model = written(_concentrate(fit, sent(model)).join(was, "_g"), "quality-model")
        if model.where(F.abs(F.col("was") - _log_det()) > SETTLED).isEmpty():
            break
        model = model.drop("was")
    return model.select("_g", *MODEL)


def _judged(docs: DataFrame, text_col: str, lang_col: str, source_col: str, kept: list[str]) -> DataFrame:
    """row (the kept columns), the statistics, base_failed, kept and _d of each row of docs."""
    own = _own(docs, text_col, kept, group_key(F.col(f"`{lang_col}`")).alias("_lang"), group_key(F.col(f"`{source_col}`")).alias("_source"))
    rows = _statistics(own, ["row", "_lang", "_source"]).withColumn("base_failed", _base_failed())
    rows = written(rows.select("*", *_features()), "quality-statistics")
    pools = written(_pools(rows), "quality-pools")
    # a table of few rows in many files looks large to the planner, so that their number decides
    sent = F.broadcast if pools.count() <= MOST_BROADCAST else lambda df: df
    values = [f"_x{k}" for k in range(D)]
    fit = rows.where(~F.col("base_failed")).select("_lang", "_source", *values).join(sent(pools), ["_lang", "_source"]).select(F.explode("_fit").alias("_g"), *values)
    fit = written(fit, "quality-values")
    out = _distance(rows.join(sent(pools.drop("_fit")), ["_lang", "_source"]), sent(_estimate(fit, sent)))
    far = F.coalesce(F.col("_d") > chi2_quantile(1 - TAIL, D), F.lit(False))
    return out.select("row", *STATISTICS, "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "_d")


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep_text: bool = False) -> DataFrame:
    """Each row of docs with its statistics, base_failed, kept and _distance (squared; null without a model).

    A null or empty text fails the base rules. Null languages and sources are groups of
    their own. Repeated rows count as often as they stand. Ties in distance are judged
    alike, as a step takes whole bins of distance. An empty table gives no rows. The text is
    dropped unless keep_text. Columns of docs named as one of the new ones are left out.
    """
    new = [*STATISTICS, "base_failed", "kept", "_distance"]
    kept = [c for c in docs.columns if (c != text_col or keep_text) and c.lower() not in new]
    out = _judged(docs, text_col, lang_col, source_col, kept)
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], *STATISTICS, "base_failed", "kept", F.col("_d").alias("_distance"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, unchanged, whatever their columns are named; as judge() has it for awkward rows."""
    out = _judged(docs, text_col, lang_col, source_col, docs.columns).where("kept")
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def op6_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base statistics and verdict."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("_distance", 3).alias("distance"))


QUERIES = {"op6_robust_outliers": op6_robust_outliers}
ORACLES: dict[str, str] = {}

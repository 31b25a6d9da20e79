"""URL rules by a sort-merge range join over reversed-host keys.

The key of a host is its labels from last to first, joined by NUL. A rule for a host and
all subdomains then is the interval of keys that start with the rule's key; NUL sorts
first, so intervals nest or are disjoint. One sweep over sorted urls keeps a stack of the
rules whose interval is open; at each url the stack holds every rule that fits the host,
and those whose path starts the url's path are compared.

Rules up to `MAX_RULES` travel with the tasks and every batch of urls is swept where it
lies: no shuffle, and a host with a third of all rows costs nothing extra. Beyond that
bound the rules stay a table: host suffixes of distinct hosts meet the rules' hosts in an
equi-join instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded, shielded, table

#: The rules of the query: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Rules that may travel with a task (about 100 bytes each).
MAX_RULES = 200_000
DEFAULT_VERDICT = "allow"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: str) -> str:
    return "\x00".join(reversed(host.split(".")))


def sweep(hosts: Sequence[str], paths: Sequence[str], rules: Sequence[tuple[str, str, str]]) -> list[int]:
    """For each url the number of the rule that wins, or -1: the longest, then the longer host, then the first given.

    rules: (key, path, text) sorted by key. One pass over urls and rules in key order.
    """
    keys = [host_key(h) for h in hosts]
    best = [-1] * len(keys)
    stack: list[tuple[str, list[int]]] = []  # open intervals: the key and its rules
    at = 0
    for i in sorted(range(len(keys)), key=keys.__getitem__):
        key = keys[i]
        while at < len(rules) and rules[at][0] <= key:
            opened = rules[at][0]
            while stack and not (opened == stack[-1][0] or opened.startswith(stack[-1][0] + "\x00")):
                stack.pop()
            if stack and stack[-1][0] == opened:
                stack[-1][1].append(at)
            else:
                stack.append((opened, [at]))
            at += 1
        while stack and not (key == stack[-1][0] or key.startswith(stack[-1][0] + "\x00")):
            stack.pop()
        if key:
            fits = [r for _, own in stack for r in own if paths[i].startswith(rules[r][1])]
            if fits:
                best[i] = max(fits, key=lambda r: (len(rules[r][2]), len(rules[r][0]), -r))
    return best


def judge_swept(urls: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = DEFAULT_VERDICT) -> DataFrame:
    """urls with string columns host and path -> with rule and verdict, batch by batch without a shuffle.

    Columns of urls named rule or verdict are left out. A null host or path is empty; an
    empty host fits no rule. Of rules of one length the longer host wins, then the first
    given. Repeated rows are judged each; an empty table gives no rows. More rules than
    MAX_RULES are joined instead.
    """
    urls = urls.select(*[F.col(f"`{c}`") for c in urls.columns if c.lower() not in ("rule", "verdict")])
    if len(rules) > MAX_RULES:
        given = urls.sparkSession.createDataFrame([(*r, k) for k, r in enumerate(rules)], "verdict string, host string, path string, place long")
        return judge_joined(urls, given, default)
    bounded(urls.sparkSession)
    known = sorted(((host_key(h), p, h + p, v) for v, h, p in rules), key=lambda r: r[0])
    schema = ", ".join(f"`{c}` {t}" for c, t in urls.dtypes) + ", rule string, verdict string"
    host, path = urls.columns.index("host"), urls.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = [r[:3] for r in known]
        texts, verdicts = [r[2] for r in known] + [None], [r[3] for r in known] + [default]
        for batch in batches:
            won = sweep([x or "" for x in batch.column(host).to_pylist()], [x or "" for x in batch.column(path).to_pylist()], plain)
            new = [pa.array([x[k] for k in won], pa.string()) for x in (texts, verdicts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "rule", "verdict"])

    return urls.mapInArrow(run, schema)


def judge_joined(urls: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """As judge_swept for any number of rules, given as a table of verdict, host and path.

    Distinct (host, path) pairs meet the rules through the suffixes of the host, so a hot
    url is looked up once; its verdict then joins every row of it. Of equal rules that of
    the smallest number in a column `place` wins, without one the verdict that sorts last.
    """
    urls = urls.select(*[F.col(f"`{c}`") for c in urls.columns if c.lower() not in ("rule", "verdict")])
    pairs = urls.select("host", "path").where(F.col("host") != "").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    first = -F.col("place") if "place" in rules.columns else F.lit(0).cast("long")
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"), first.alias("r_first"))
    met = pairs.withColumn("r_host", F.explode(suffixes)).join(rules, "r_host").where(F.expr("startswith(coalesce(path, ''), r_path)"))
    text = F.concat("r_host", "r_path")
    best = met.groupBy("host", "path").agg(F.max_by(F.struct(text.alias("rule"), F.col("r_verdict").alias("v")), F.struct(F.length(text), F.length("r_host"), "r_first", "r_verdict")).alias("best"))
    best = best.select(F.col("host").alias("b_host"), F.col("path").alias("b_path"), "best")
    own, place = shielded(urls)
    out = own.join(best, F.col(place["host"]).eqNullSafe(F.col("b_host")) & F.col(place["path"]).eqNullSafe(F.col("b_path")), "left")
    return out.select(*[F.col(p).alias(c) for c, p in place.items()], F.col("best.rule").alias("rule"), F.coalesce("best.v", F.lit(default)).alias("verdict"))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, winning rule and verdict. Without a rule a url is allowed."""
    pages = table(spark, sf_dir, "pages")
    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return judge_swept(urls, RULES)


ORACLE = """
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path,
  (SELECT first(h || p ORDER BY length(h || p) DESC) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)) AS rule,
  coalesce((SELECT first(r.verdict ORDER BY length(h || p) DESC) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)), 'allow') AS verdict
FROM u
"""

QUERIES = {"op5_url_rules": op5_url_rules}
ORACLES = {"op5_url_rules": ORACLE}

import random
from collections import Counter, defaultdict

import pytest

from quarry.llm import mixing, sharding, urls
from tests.llm.fixtures import SMALL, docs, plain


def test_water_filling_against_repeated_sharing(spark):
    pick = random.Random(1)
    for sizes in ([100, 1, 1, 50], [10], [0, 5, 0], [pick.randint(0, 1000) for _ in range(17)], [3, 3, 3, 3000]):
        df = spark.createDataFrame([(f"s{k:02}", f"s{k:02}", n) for k, n in enumerate(sizes)], "_mix_s string, source string, _size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        weights, caps = [(5, 2, 1)[k % 3] for k in range(len(sizes))], [3 * n for n in sizes]
        target, free = [0.0] * len(sizes), set(range(len(sizes)))
        while free:
            left = sum(sizes) - sum(target[k] for k in range(len(sizes)) if k not in free)
            share = {k: left * weights[k] / sum(weights[j] for j in free) for k in free}
            full = {k for k in free if share[k] > caps[k]}
            for k in full or free:
                target[k] = caps[k] if full else share[k]
            free = free - full if full else set()
        assert [got[f"s{k:02}"] for k in range(len(sizes))] == pytest.approx(target)


def test_schedules_invert():
    for knots in mixing.SCHEDULES:
        assert mixing.integral(knots) in (5, 2, 1)
    with pytest.raises(ValueError):
        mixing.integral(((0.0, 1.0), (0.9, 1.0)))


def test_mix_of_whole_table(spark):
    rows = mixing.op2_curriculum_mix(spark, SMALL).collect()
    assert sorted(rows) == sorted(mixing.op2_curriculum_mix(spark, SMALL).collect())
    by = defaultdict(list)
    for r in rows:
        assert r.taken <= 3 * r.size
        by[r.target, r.source_size].append(r)
    for (target, _), own in by.items():
        assert abs(sum(r.taken for r in own) - target) <= max(r.size for r in own)
    # the first source's weight falls with time: more than half of it is in the first half
    places = [r["_position"] for r in mixing.curriculum(spark.read.parquet(f"{SMALL}/documents.parquet").where("source = 'src0'")).collect()]
    assert places == sorted(places) and sum(p < 0.5 for p in places) > 0.5 * len(places)


def test_mix_awkward_rows(spark):
    df = docs(spark)
    rows = mixing.mix(df).collect()
    assert len(rows) == df.count() and all(r["_taken"] == r["_size"] * r["_copies"] == r["_size"] * len(r["_positions"]) for r in rows)
    assert all(r["_taken"] == 0 for r in rows if not (r.text or "").strip())
    out = mixing.curriculum(df)
    assert out.columns == [*df.columns, "_position"]
    assert mixing.mix(plain(spark, [])).count() == 0 and mixing.curriculum(plain(spark, [])).count() == 0


def brute_rule(host, path):
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else ("allow", None)


def test_sweep_against_brute_force(spark, monkeypatch):
    pick = random.Random(7)
    labels = ["com", "net", "example", "a", "b", "xcom", "a-b", "", "é"]
    hosts = [".".join(pick.choices(labels, k=pick.randint(1, 4))) for _ in range(400)]
    paths = [pick.choice(["", "/", "/en", "/en/", "/en/7", "/en/71/x", "/de/8"]) for _ in hosts]
    rules = [(pick.choice(["block", "allow"]), ".".join(pick.choices(labels[:6], k=pick.randint(1, 3))), pick.choice(["", "/", "/en/", "/en/7"])) for _ in range(60)]
    rules = list({(h, p): (v, h, p) for v, h, p in rules}.values())
    known = sorted(((urls.host_key(h), p, h + p, v) for v, h, p in rules), key=lambda r: r[0])
    won = urls.sweep(hosts, paths, [k[:3] for k in known])
    want = []
    for h, p, w in zip(hosts, paths, won):
        fits = [(len(b + c), len(b), b + c, v) for v, b, c in rules if h and (h == b or h.endswith("." + b)) and p.startswith(c)]
        want.append(max(fits)[2:] if fits else None)
        assert (max(fits)[:2] if fits else None) == ((len(known[w][2]), len(known[w][0])) if w >= 0 else None)
    df = spark.createDataFrame(list(zip(hosts, paths)), "host string, path string")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    assert sorted((r.host, r.path, r.rule or "", r.verdict) for r in urls.judge_joined(df, table).collect()) == sorted((h, p, w[0] if w else "", w[1] if w else "allow") for h, p, w in zip(hosts, paths, want))
    monkeypatch.setattr(urls, "MAX_RULES", 3)
    # more rules than may travel are joined; the first given wins a tie
    few = df.limit(40)
    assert sorted(map(str, urls.judge_swept(few, urls.RULES).collect())) == sorted(str(r) for r in urls.judge_joined(few, spark.createDataFrame(urls.RULES, "verdict string, host string, path string")).collect())
    tied = [("block", "tie.org", "/x"), ("allow", "tie.org", "/x"), *urls.RULES]
    assert urls.judge_swept(spark.createDataFrame([("tie.org", "/x")], "host string, path string"), tied).first().verdict == "block"


def test_urls_awkward_rows(spark):
    made = ["https://A.Example.COM/en/7?x", "x://com/en/", "http://user@com:80/en/", None, "", "no scheme", "http://", "http://net/de/8", "a://b.example.net/de/8#/en/", "http://com?/en/", "http://xcom/en/", "y://é.org/es/" + "x" * 100_000, "p\nq://org/es/"]
    df = spark.createDataFrame([(k, u, "h", "p") for k, u in enumerate(made)] * 2, "page_id long, url string, rule string, html string")
    got = urls.judge_swept(df.select("page_id", urls.host_of(df.url).alias("host"), urls.path_of(df.url).alias("path")), urls.RULES).collect()
    assert len(got) == 2 * len(made)
    for r in got:
        url = made[r.page_id] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:].split("?")[0].split("#")[0]
        assert (r.host, r.path) == (host, path)
        assert (r.verdict, r.rule) == (brute_rule(host, path) if host else ("allow", None))


def check_shards(rows, shards):
    counts = Counter(r.shard for r in rows)
    assert len(rows) < shards or (len(counts) == shards and max(counts.values()) - min(counts.values()) <= 1)
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))
    by = defaultdict(Counter)
    for r in rows:
        by[r.source][r.shard] += 1
    for source, own in by.items():
        fair = sum(own.values()) / shards
        assert all(abs(own[s] - fair) <= 2 for s in range(shards))


def test_shards_of_whole_table(spark):
    import zlib

    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    rows = sharding.interleave(df).collect()
    check_shards(rows, 24)
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    assert sorted(rows) == sorted(sharding.interleave(df.repartition(5)).collect())
    check_shards(sharding.interleave(df.where("source < 'src13'"), shards=7).collect(), 7)


def test_shards_against_plain_ranking(spark):
    from pyspark.sql import functions as F

    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = df.select("doc_id", "source", (F.octet_length("text") + 8).alias("size"), F.xxhash64("doc_id", F.lit(11)).alias("h")).collect()
    own = defaultdict(list)
    for r in rows:
        own[r.source].append((r.h % 2**64 >> 52, r.h, r.doc_id))
    order = []
    for source, all_of in own.items():
        for rank, (_, h, doc) in enumerate(sorted(all_of)):
            share = (2 * rank + 1) / (2 * len(all_of))
            order.append((min(sharding.BUCKETS - 1, int(share * sharding.BUCKETS)), share, "s" + source, h, doc))
    n, want = len(order), {}
    for place, (*_, doc) in enumerate(sorted(order)):
        shard = place * 24 // n
        want[doc] = (shard, place - -(-shard * n // 24))
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.op8_stratified_interleave(spark, SMALL).collect()} == want


def test_shards_awkward_rows(spark):
    rows = sharding.interleave(docs(spark), shards=3).collect()
    check_shards(rows, 3)
    assert len(rows) == docs(spark).count()
    by_id = {r.doc_id: r for r in rows}
    assert (by_id[3].size, by_id[3].text_crc32) == (8, 0)
    assert sharding.interleave(plain(spark, [])).count() == 0
    with pytest.raises(ValueError):
        sharding.interleave(docs(spark), shards=0)

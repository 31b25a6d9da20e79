import re
from collections import Counter

import corpus_pipeline
from quarry.llm import mixing, ngram_join, quality
from tests.llm.fixtures import SMALL, plain
from tests.llm.test_secrets import base


def test_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, texts = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SMALL)
        docs = spark.createDataFrame(done.collect(), done.schema)
        steps[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    kept = {r.doc_id for r in quality.op6_robust_outliers(spark, SMALL).collect() if r.kept}
    assert {r.doc_id for r in steps["quality rules"]} == kept
    of = {r.doc_id: r.component_id for r in ngram_join.ngram_join(spark.read.parquet(f"{SMALL}/documents.parquet").where(f"doc_id in ({','.join(map(str, kept))})")).collect()}
    assert sorted(r.doc_id for r in steps["near duplicates"]) == sorted(set(of.values()))
    before = {r.doc_id: r.text for r in steps["near duplicates"]}
    changed = 0
    for r in steps["secret scan"]:
        assert r.n_chars == len(r.text)
        if base(before[r.doc_id]):
            changed += 1
            assert not base(r.text) and "[SECRET]" in r.text
        elif r.text != before[r.doc_id]:
            assert "[SECRET]" in r.text
    assert changed
    taken = Counter(r.doc_id for r in steps["curriculum mix"])
    assert taken and set(taken.values()) <= {1, 2, 3}
    assert sum(taken.values()) == sum(r["_copies"] for r in mixing.mix(spark.createDataFrame(steps["secret scan"], plain(spark, []).schema)).collect())
    packed = steps["packing"]
    assert Counter(r.doc_id for r in packed if r.start == 0) == taken
    assert sum(r.length for r in packed) == sum(r.doc_tokens for r in packed if r.start == 0)
    assert all(re.search(r"\S", texts[i]) for i in taken)


def test_run_and_empty_table(spark, tmp_path):
    plain(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() > 100


def test_awkward_rows_at_every_stage(spark):
    awkward = plain(spark)
    done = {name: stage(spark, awkward, SMALL).collect() for name, stage in corpus_pipeline.STAGES}
    ids = {name: Counter(r.doc_id for r in rows) for name, rows in done.items()}
    assert ids["quality rules"] == {1: 1, 2: 2, 6: 1, 8: 1}
    assert ids["near duplicates"] == dict.fromkeys([1, 3, 4, 5, 6, 7, 9, 10, None], 1)
    assert sorted(map(repr, done["secret scan"])) == sorted(map(repr, awkward.collect()))
    mixed, stands = ids["curriculum mix"], Counter(r.doc_id for r in awkward.collect())
    assert mixed and all(n <= mixing.MAX_REPEAT * stands[i] for i, n in mixed.items())
    pieces = done["packing"]
    assert Counter(r.doc_id for r in pieces if r.start == 0) == stands
    assert sum(r.length for r in pieces) == sum(r.doc_tokens for r in pieces if r.start == 0)


def test_no_rows_at_every_stage(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain(spark, []), SMALL).collect() == []

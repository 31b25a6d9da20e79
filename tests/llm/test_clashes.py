"""Every operator and stage takes tables whose columns are named as its own are."""

import corpus_pipeline
from quarry.llm import html, mixing, ngram_join, packing, quality, secrets, sharding, tokenfiles, urls
from tests.llm.fixtures import CLASHES, clashing, plain


def untouched(df):
    return [r for r in df.select(*[c for c in CLASHES if c in df.columns]).distinct().collect() if any(v != f"own {c}" for c, v in r.asDict().items())]


def test_stages_return_the_columns_of_documents(spark):
    docs = clashing(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, None)
        assert out.columns == docs.columns and not untouched(out)
        assert stage(spark, clashing(spark, []), None).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() >= docs.count()


def test_operators(spark):
    docs, bare = clashing(spark), plain(spark)
    for f in (ngram_join.ngram_join, packing.pack, sharding.interleave):
        assert f(docs).columns == f(bare).columns and f(docs).count() == f(bare).count()
    for f in (quality.judge, secrets.scan, mixing.mix):
        got, want = f(docs), f(bare)
        new = [c for c in want.columns if c not in bare.columns]
        assert set(got.columns) == {*docs.columns, *new} - {"text"} | {"text"} & set(want.columns)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    assert mixing.curriculum(docs).columns == docs.columns and mixing.curriculum(bare).columns == [*bare.columns, "_position"]


def test_urls_pages_and_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "example.com", "/en/7", "x"), (2, None, None, "y"), (2**60 + 1, "a.example.net", "/de/8", "z"), (None, "", "/en/", "w")], "page_id long, host string, path string, rule string").selectExpr("*", "'v' as verdict", "1 as place", "2 as best")
    rules = spark.createDataFrame([(*r, k) for k, r in enumerate(urls.RULES)], "verdict string, host string, path string, place int")
    want = [(1, "example.com/en/7", "allow"), (2, None, "allow"), (2**60 + 1, "example.net/de/8", "block"), (None, None, "allow")]
    for out in (urls.judge_swept(pages, urls.RULES), urls.judge_joined(pages, rules)):
        assert sorted(((r.page_id, r.rule, r.verdict) for r in out.collect()), key=str) == sorted(want, key=str)
        assert out.columns.count("rule") == out.columns.count("verdict") == 1
    assert urls.judge_swept(pages.limit(0), urls.RULES).count() == urls.judge_joined(pages.limit(0), rules).count() == 0
    web = spark.createDataFrame([(1, "<p>a</p>"), (1, "<p>a</p>"), (None, None)], "page_id long, html string").selectExpr("*", "'t' as _text", "'x' as row")
    assert sorted(html.extract(web).columns) == ["_text", "page_id", "row"] and html.extract(web).count() == 3 and html.extract(web.limit(0)).count() == 0
    tokenfiles.write_files(clashing(spark), f"{tmp_path}/f")
    assert tokenfiles.read_files(spark, f"{tmp_path}/f").count() == clashing(spark).count()

"""What grows with the square of the input, or is gathered in one task, in earlier forms of the library's queries."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import evaluation, layout, models, pages, places, retrieval, sections
from quarry.plans import inputs as I
from quarry.plans import queries as Q
from quarry.profiles import LAYOUT, MARKDOWN


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_self_retrieval_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "BLOCK_CHARS", 700)
    monkeypatch.setattr(evaluation, "CELLS", 50)
    monkeypatch.setattr(evaluation, "ENTRIES", 40)
    r = random.Random(1)
    texts = {k: " ".join(r.choices([f"w{i}" for i in range(40)], k=r.randint(1, 60))) for k in range(0, 240, 3)}
    texts |= {500: texts[0], 501: texts[3] + " w1", 502: "", 503: "never seen", 504: None}
    grams = lambda t: (g := re.findall(r"\w\w+", t or "")) + [f"{a} {b}" for a, b in zip(g, g[1:])]
    counts = {k: Counter(grams(t)) for k, t in texts.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in df.items() if n > 1}
    vectors = {}
    for k, c in counts.items():
        v = {t: n * idf[t] for t, n in c.items() if t in idf}
        vectors[k] = {t: w / math.sqrt(sum(x * x for x in v.values())) for t, w in v.items()}
    want = {}
    for k, t in texts.items():
        q = Counter(grams(" ".join((t or "").split()[:15])))
        s = {d: round(sum(n * idf[x] * v[x] for x, n in q.items() if x in v), 9) for d, v in vectors.items()}
        want[k] = min(s, key=lambda d: (-s[d], d))
    rows = spark.createDataFrame(list(texts.items()), "id int, text string").repartition(3)
    out = evaluation.self_retrieval(rows)
    assert {r.id: r.found for r in out.collect()} == want and out.schema["found"].dataType == rows.schema["id"].dataType
    assert not re.search(r"Join.*term", plan(out))
    assert evaluation.self_retrieval(rows.limit(0)).count() == 0


def test_runs(spark):
    rows = spark.createDataFrame([([3, 1, 3, 3],), ([7],), ([],), (None,)], "x array<long>")
    got = [r[0] and [tuple(e) for e in r[0]] for r in rows.select(evaluation.runs(F.col("x"))).collect()]
    assert got == [[(1, 1), (3, 3)], [(7, 1)], None, None]


def test_coherence_in_the_row(spark):
    r = random.Random(2)
    sentence = lambda: " ".join(r.choices([f"word{i}" for i in range(30)], k=r.randint(5, 12)))
    texts = {k: ". ".join(sentence() for _ in range(r.randint(0, 9))) for k in range(60)} | {70: None, 71: "", 72: f"{'- ' * 20}. {'* ' * 20}. {sentence()}"}
    want = {}
    for k, t in texts.items():
        parts = [re.findall(r"\w\w+", s) for s in (t or "").split(".") if len(s.strip()) > 30]
        df, n, pairs = Counter(x for p in parts for x in set(p)), len(parts), 0.0
        vectors = [{x: c * (math.log((1 + n) / (1 + df[x])) + 1) for x, c in Counter(p).items()} for p in parts]
        norm = lambda v: math.sqrt(sum(w * w for w in v.values()))
        for i, a in enumerate(vectors):
            pairs += sum(sum(w * b.get(x, 0) for x, w in a.items()) / norm(a) / norm(b) for j, b in enumerate(vectors) if i != j and a and b)
        if n > 1:
            want[k] = round(pairs / n / (n - 1), 9)
    out = evaluation.intra_chunk_coherence(spark.createDataFrame(list(texts.items()), "id long, text string"))
    assert {r.id: round(r.coherence, 9) for r in out.collect()} == want and want[72] == 0
    assert "Exchange" not in plan(out)


def documents(spark, folder, rows):
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_embedded_documents_gather_no_source(spark, tmp_path):
    sf = documents(spark, tmp_path, [(k, "a" if k % 5 else "b", "en", None if k == 3 else f"text {k}") for k in range(50)])
    out = Q.embedded_documents(spark, sf)
    assert {tuple(r) for r in out.collect()} == {("a", 40, 40), ("b", 10, 10)}
    assert "collect_list" not in plan(out) and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_keyword_counts_are_made_where_the_text_lies(spark, tmp_path):
    chunks = spark.createDataFrame([(k, "common " * (k % 7) + f"own{k}") for k in range(60)] + [(60, None)], "id long, text string")
    questions = spark.createDataFrame([(q, f"Common own{q} common") for q in range(8)], "query_id long, text string")
    questions.write.parquet(f"{tmp_path}/q")
    questions = spark.read.parquet(f"{tmp_path}/q")
    out = retrieval.keyword_all(chunks, questions, 4)
    hits = {q: sorted(((-(k % 7) - (k == q), k) for k in range(60) if k % 7 or k == q))[:4] for q in range(8)}
    assert {(r.query_id, r["rank"], r.id, r.hits) for r in out.collect()} == {(q, i + 1, k, -n) for q, found in hits.items() for i, (n, k) in enumerate(found)}
    # counts of every question and chunk are not dealt out; the best of each task are
    assert not re.search(r"Exchange hashpartitioning\(query_id#\d+L?, id#", plan(out)) and "WindowGroupLimit" in plan(out)


def test_running_sums_by_parts(spark):
    rows = spark.createDataFrame([(k, None if k % 3 == 0 else f"d{k % 3}", k % 5) for k in range(100)], "k int, doc string, v int")
    got = places.running(rows, "doc", F.floor(F.col("k") / 7), "k", F.col("v"), "s")
    assert {r.k: r.s for r in got.collect()} == {k: sum(i % 5 for i in range(k % 3, k + 1, 3)) for k in range(100)} and got.columns == ["k", "doc", "v", "s"]


def test_pages_of_a_source_are_not_one_task(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(I, "RANGE_ROWS", 10)
    ids = [k * k for k in range(200)]
    sf = documents(spark, tmp_path, [(k, "only", "en", f"t{k}") for k in ids] + [(5, None, "en", "x"), (None, "only", "en", "first")])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = I.pages(spark, sf).withColumn("at", F.spark_partition_id()).collect()
        lines = layout.read_pages(Q.layout_lines(spark, sf))
        assert lines.count() > 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.row_id: r.page_num for r in rows if r.doc_id} == {None: 1} | {k: i + 2 for i, k in enumerate(ids)}
    assert [(r.row_id, r.page_num) for r in rows if not r.doc_id] == [(5, 1)] and len({r["at"] for r in rows if r.doc_id}) > 1


def test_table_chunks_bound_what_python_takes(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    Q.table_chunks(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20


def test_report_makes_no_row_of_a_pair(spark):
    chunks = spark.createDataFrame([("d", k, f"common words w{k}") for k in range(9)], "doc_id string, id long, text string")
    out = evaluation.report(chunks)
    assert out.first().retrieval == round(1 / 9, 6) and not re.search(r"Join.*term", plan(out))


def one_document(spark, n=60):
    """A document of many pages, in which each rule finds something, and a small one."""
    body = "\n".join(f"line {k} with some words to fill the page well enough " * 3 for k in range(6))
    text = lambda k: f"Head\n{'###SEC### Part' if k % 4 == 0 else '# Part' if k % 4 == 2 else 'Plain'} {k}\n{body.replace('line', f'row{k}')}"
    rows = [("d", k, text(k), f"note {k}" if k % 9 == 0 else "") for k in range(1, n)]
    rows += [("d", n, "# Appendix\nend", ""), ("d", n + 1, text(n), ""), ("e", 1, "abc\n# References\nx " * 60, ""), (None, 1, "text", "")]
    rows[n - 20] = ("d", n - 19, text(n - 19) + "\nReferences\n# References\nDoe", "")
    rows[2] = ("d", 3, "Contents\n" + "\n".join(f"Part ..... {k}" for k in range(9)), "")
    rows[4] = ("d", 5, "List of Figures\nx", "")
    return spark.createDataFrame(rows, "doc_id string, page_num int, text string, footnotes string").repartition(4, "page_num")


def spread(spark, make):
    """The rows of a frame, and in how many partitions the larger document's lie."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = make().withColumn("_at", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return sorted(repr(tuple(r)[:-1]) for r in rows), len({r["_at"] for r in rows if r["doc_id"] == "d"})


def test_no_task_holds_a_document(spark, monkeypatch):
    given = one_document(spark)
    for profile in (LAYOUT, MARKDOWN):
        makes = [lambda f=f: f(given, profile) for f in (pages.drop_front_matter, pages.cut_appendices, pages.cut_references, pages.strip_repeated_lines, sections.split_sections, models.process)]
        makes.append(lambda: sections.chunk_sections(given.selectExpr("doc_id", "page_num AS section_no", "'t' AS title", "text", "page_num"), profile))
        for make in makes:
            monkeypatch.setattr(pages, "PART", 10**6)
            whole = spread(spark, make)[0]
            monkeypatch.setattr(pages, "PART", 3)
            rows, at = spread(spark, make)
            assert rows == whole and rows and at > 1


def test_filters_at_once_are_the_filters_in_turn(spark):
    given = one_document(spark)
    for profile in (LAYOUT, MARKDOWN):
        for kind in ("report", "article"):
            kinds = spark.createDataFrame([("d", kind), ("e", "scanned")], "doc_id string, document_type string")
            d = given.where("doc_id = 'd'")
            turn = pages.drop_contents(d if kind == "article" else pages.drop_front_matter(d, profile), profile)
            turn = pages.cut_references(pages.cut_appendices(turn, profile), profile)
            want = sorted(map(repr, turn.collect())) + sorted(map(repr, given.where("doc_id = 'e'").collect()))
            got = pages.filtered(given.where("doc_id is not null"), kinds, profile).drop("document_type")
            assert sorted(map(repr, got.collect())) == want and 2 < len(want) < given.count() - 1


def test_large_documents_have_several_rows(spark, monkeypatch):
    given = one_document(spark)
    files = given.where("doc_id is not null").selectExpr("doc_id", "doc_id AS filename", "doc_id AS filepath", "'' AS title", "'' AS author").distinct()
    one = {r.doc_id: r for r in models.process_documents(given, files).collect()}
    monkeypatch.setattr(models, "ROW_CHUNKS", 4)
    rows = [r for r in models.process_documents(given, files).collect() if r.doc_id == "d"]
    rows.sort(key=lambda r: r.chunks[0].chunk_id)
    assert len(rows) > 2 and max(len(r.chunks) for r in rows) == 4 and [c for r in rows for c in r.chunks] == one["d"].chunks
    assert [n for r in rows for n in r.footnote_chunks] == one["d"].footnote_chunks == rows[0].footnote_chunks != []
    assert all(r.metadata == one["d"].metadata for r in rows)


def test_queries_are_not_written_for_every_block(spark, monkeypatch):
    kept, found, sizes = [], {}, {}
    save = evaluation.saved
    monkeypatch.setattr(evaluation, "saved", lambda *a: kept.append(save(*a)) or kept[-1])
    monkeypatch.setattr(evaluation, "PACKET", 30)
    chunks = spark.createDataFrame([(k, f"common words w{k // 2} " * 4) for k in range(90)], "id long, text string")
    for chars in (10**6, 600):
        monkeypatch.setattr(evaluation, "BLOCK_CHARS", chars)
        out = evaluation.self_retrieval(chunks)
        found[chars] = {r.id: r.found for r in out.collect()}
        assert not re.search(r"Exchange hashpartitioning\((block|query|part)", plan(out))
        rows = kept[-1].collect()
        sizes[chars] = sum(len(r.data) for r in rows if r.query), sum(r.query for r in rows), len(rows) > 4
    assert found[600] == found[10**6] == {k: k - k % 2 for k in range(90)}
    assert sizes[600][:2] == sizes[10**6][:2] and sizes[600][1] == 3 and (sizes[10**6][2], sizes[600][2]) == (False, True)

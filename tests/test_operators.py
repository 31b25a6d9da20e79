import json

from pyspark.sql import functions as F

from quarry.operators import answers, evaluation, layout, models, pages, sections
from quarry.profiles import LAYOUT, MARKDOWN, MULTIMODAL
from quarry.sources import files, store


def made(spark, *texts):
    return spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(texts)], "doc_id string, page_num int, text string")


def texts(df):
    return [r.text for r in df.orderBy("doc_id", "page_num").collect()]


def test_repeated_lines(spark):
    # a single page loses every line of eligible length, as the rule counts over pages
    assert texts(pages.strip_repeated_lines(made(spark, "first line\nabc"))) == ["abc"]
    assert texts(pages.strip_repeated_lines(made(spark, "head\nx1 page", "head\n\nx2 page"))) == ["x1 page", "x2 page"]
    assert texts(pages.strip_repeated_lines(made(spark, "same line\nsame line\nsame line\na", "b", "c", "d", "e"), LAYOUT)) == ["a", "b", "c", "d", "e"]
    assert texts(pages.strip_repeated_lines(made(spark, "| a |\n# head\n\nx", "| a |\n# head\n\ny"), MARKDOWN)) == ["| a |\n# head\n\nx", "| a |\n# head\n\ny"]


def test_front_matter(spark):
    rows = ["Title Page\na", "a\nb\nDedication", "a\nb\nc\nDedication", ""] + ["x"] * 11 + ["Dedication", ""]
    got = texts(pages.drop_front_matter(made(spark, *rows)))
    assert got == ["a\nb\nc\nDedication"] + ["x"] * 11 + ["Dedication", ""]


def test_contents(spark):
    lines = ["Intro ..... 3"] + ["text"] * 5
    assert texts(pages.drop_contents(made(spark, "Contents\n" + "\n".join(lines[:5]), "\n".join(lines)))) == ["\n".join(lines)]
    five, six = "\n".join(["A .... xii"] + ["t"] * 4), "\n".join(["A .... xii"] + ["t"] * 5)
    assert texts(pages.drop_contents(made(spark, five, six), MARKDOWN)) == [five]


def test_cuts(spark):
    assert texts(pages.cut_appendices(made(spark, "Appendix A\nx", "y"))) == []
    assert texts(pages.cut_appendices(made(spark, "a", "Appendix" + "x" * 60, "Annex\nanexo", "b"))) == ["a", "Appendix" + "x" * 60]
    assert texts(pages.cut_appendices(made(spark, "# Appendix", "a", "# Appendix", "b"), MARKDOWN)) == ["# Appendix", "a"]
    assert texts(pages.cut_references(made(spark, "References\nq", "a\n6.1 References:\nb\nReferences"))) == ["References\nq", "a"]
    assert texts(pages.cut_references(made(spark, "6. References\nq"))) == ["6. References\nq"]
    assert texts(pages.cut_references(made(spark, "## **References**\nx", "b"), MARKDOWN)) == ["## **References**\nx", "b"]
    assert texts(pages.cut_references(made(spark, "a", "b", "## **References**\nx"), MARKDOWN)) == ["a", "b"]


def test_sections(spark):
    got = sections.split_sections(made(spark, "before\n###SEC### A\n###SEC### B\none\n two", "three\n###SEC###\nfour")).collect()
    assert [(r.section_no, r.title, r.text, r.page_num) for r in sorted(got, key=lambda r: r.section_no)] == [(0, "UNLABELED_SECTION", "before", 1), (1, "B", "one two three", 1), (2, "UNLABELED_SECTION", "four", 2)]
    got = sections.split_sections(made(spark, "before\n# A\n## B\none", "#tag\nx"), MULTIMODAL).collect()
    assert [(r.title, r.text, r.page_num) for r in sorted(got, key=lambda r: r.section_no)] == [("Document Start", "before", 1), ("A", "# A", 1), ("B", "## B\none", 1), ("tag", "#tag\nx", 2)]


def test_footnotes(spark):
    long = " ".join(f"w{k}" for k in range(201))
    df = spark.createDataFrame([("d", f"{' '.join(['a'] * 200)}\n\n \n\n{long}")], "doc_id string, footnotes string")
    got = {r.chunk_id: (r.type, r.word_count) for r in sections.footnote_chunks(df).collect()}
    assert got == {"fn_0": ("footnote_whole", 200), "fn_1_0": ("footnote_part", 200), "fn_1_1": ("footnote_part", 1)}
    assert {r.chunk_id: r.type for r in sections.footnote_chunks(df, MARKDOWN).collect()} == {"fn_0": "footnote_whole", "fn_1_0": "footnote_part"}


LINE = "doc_id string, page_num int, page_w double, page_h double, block_no int, line_no int, x0 double, y0 double, x1 double, y1 double, ly double, spans array<struct<text:string,size:double,color:int>>, tables array<struct<x0:double,y0:double,x1:double,y1:double>>, drawings array<struct<y0:double,height:double,width:double>>"


def line(n, y, text, size=11.0, color=0, x0=100.0, x1=500.0):
    return ("d", 1, 600.0, 800.0, n, 0, x0, float(y), x1, y + 12.0, float(y), [(text, size, color)], [(90.0, 400.0, 510.0, 450.0)], [(600.0, 1.0, 200.0), (100.0, 1.0, 300.0)])


def test_layout(spark):
    rows = [
        line(0, 100, "A Large Heading", 14.0), line(1, 130, "body text of the page that goes on"), line(2, 160, "Coloured heading", 11.0, 255), line(3, 190, "however it is no title", 14.0), line(4, 220, "12"),
        line(5, 250, "Figure 3 shows"), line(6, 410, "inside a table"), line(7, 300, "side", x0=550.0, x1=590.0), line(8, 330, "1 2 3 4 5 6 a"), line(9, 20, "Top Heading", 14.0),
        line(10, 610, "lost before any note", 8.0), line(11, 640, "1. First note", 8.0), line(12, 660, "goes on", 8.0), line(13, 680, "(2) Second note", 8.0), line(14, 360, "more body text of the page"), line(15, 380, "and more body text"),
    ]
    got = layout.read_pages(spark.createDataFrame(rows, LINE)).first()
    assert got.text.split("\n") == ["###SEC### A Large Heading", "body text of the page that goes on", "###SEC### Coloured heading", "however it is no title", "Top Heading", "more body text of the page", "and more body text"]
    assert got.footnotes == "1. First note goes on\n\n(2) Second note"


def test_body_style_ties_and_slides(spark):
    rows = [line(0, 100, "aa", 10.25), line(1, 120, "bb", 12.0), line(2, 140, "cc", 12.0), line(3, 160, "dd", 10.25), line(4, 180, "  ", 9.0)]
    assert layout.body_style(spark.createDataFrame(rows, LINE)).first().body_size == 10.2
    wide = [(*r[:2], 900.0, 600.0, *r[4:]) for r in [line(0, 300, "plain body")]]
    assert layout.read_pages(spark.createDataFrame(wide, LINE)).first().text == "###SEC### Slide 1\nplain body"


def test_captions(spark):
    rows = [line(0, 100, "Figure 1 too high"), line(1, 400, "see Fig. 2: a plot"), line(2, 420, "of two  things"), line(3, 440, "New Paragraph starts"), line(4, 460, "Table 9")]
    assert layout.captions(spark.createDataFrame(rows, LINE)).first().caption == "see Fig. 2: a plot of two things"
    assert layout.captions(spark.createDataFrame([line(0, 500, "Table 1 " + "x" * 600)], LINE)).first().caption.endswith("...")


def test_citations_and_figures(spark):
    rows = [(1, 1, "a_b.pdf.json", "", "image", "p1"), (1, 2, "c.json", "A Long Title", "image", "p2"), (2, 1, "x.json", "", "text", None), (2, 2, "y.json", "", "image", "p3"), (2, 3, "z.json", "", "image", "p4")]
    hits = spark.createDataFrame(rows, "query_id int, rank int, source_file string, title string, chunk_type string, image_path string")
    told = spark.createDataFrame([(1, "see [long title, Page 3] and [A, B, Page 1]"), (2, "nothing")], "query_id int, answer string")
    assert sorted(r.image_path for r in answers.cited_figures(hits, told).collect()) == ["p2", "p3"]
    assert spark.range(1).select(answers.matches(F.lit("a.json"), F.lit(""), F.array(F.lit("zzz")))).first()[0] is False


def test_chunk_table_loads(spark, tmp_path):
    def document(name, n, dim=4):
        chunk = lambda k: {"chunk_id": k, "text": f"{name} {k}", "type": "body", "embedding_dense": [0.5] * dim}
        return {"metadata": {"filename": name, "title": "t"}, "document_type": "report", "chunks": [chunk(k) for k in range(n)], "footnote_chunks": [{"chunk_id": "fn_0", "text": "n", "type": "footnote_whole", "embedding_dense": [1.0] * 4}], "image_chunks": []}

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(document("a", 2), indent=2))
    (folder / "b.json").write_text(json.dumps(document("b", 3, dim=5), indent=2))
    from dataclasses import replace

    profile = replace(MARKDOWN, dimension=4)
    rows = store.prepared(files.chunk_rows(files.read_documents(spark, str(folder))), profile)
    assert {(r.source_file, r.chunk_id, r.section, r.page_num) for r in rows.collect()} == {("a.json", "0", "Geral", 0), ("a.json", "1", "Geral", 0), ("a.json", "fn_0", "Nota de Rodapé", 0), ("b.json", "fn_0", "Nota de Rodapé", 0)}
    path = str(tmp_path / "table")
    for load in (store.append, store.replace_documents, store.replace_documents):
        load(rows, path)
        assert spark.read.parquet(path).count() == 4
    store.append(rows, path)
    assert spark.read.parquet(path).count() == 8
    store.reload(rows.where("source_file = 'a.json'"), path)
    assert spark.read.parquet(path).count() == 3

    from quarry.streaming.ingest import ingest

    for _ in range(2):
        ingest(spark, str(folder), str(tmp_path / "stream"), str(tmp_path / "checkpoint"), profile).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "stream")).count() == 4


def test_files(spark, tmp_path):
    (tmp_path / "a.PDF").write_bytes(b"%PDF one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"x")

    def maker():
        def parse(content):
            if not content.startswith(b"%PDF"):
                raise ValueError("not a PDF")
            return content.decode().split("\f")

        return parse

    got = models.parse(files.pdf_files(spark, str(tmp_path)), maker).collect()
    assert sorted((r.doc_id, r.page_num or 0, r.text, r.error) for r in got) == [("a.PDF", 1, "%PDF one", None), ("a.PDF", 2, "two", None), ("b.pdf", 0, None, "not a PDF")]
    questions = spark.createDataFrame([("one\ntwo \"x\", y", "t")], "question string, truth string")
    files.write_results(questions, str(tmp_path / "q"))
    assert files.read_questions(spark, str(tmp_path / "q")).collect() == questions.collect()


def test_models(spark):
    ocr = spark.createDataFrame([("d", "\n# PAGE 1\na-\nb\n# PAGE 2\nc")], "doc_id string, text string")
    assert [(r.page_num, r.text) for r in models.ocr_pages(ocr).orderBy("page_num").collect()] == [(2, "1\nab"), (3, "2\nc")]
    out = models.embed(spark.createDataFrame([("a b",), (None,), ("a b",)], "text string"), F.col("text")).collect()
    assert out[0].embedding_dense == out[2].embedding_dense and abs(sum(x * x for x in out[0].embedding_dense) - 1) < 1e-6 and out[1].embedding_sparse == {}
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")
        return "ok"

    assert models.with_retry(flaky, sleep=lambda s: None)() == "ok" and len(calls) == 3
    images = spark.createDataFrame([("d", 1, 0, "p.png", "cap", 200, 300)], "doc_id string, page_num int, image_no int, path string, caption string, width int, height int")
    made_ = models.describe(images, spark.createDataFrame([("d", 1, "t")], "doc_id string, page_num int, text string"), lambda: lambda xs: [f"shows {x}" for x in xs]).first()
    assert (made_.chunk_id, made_.text, made_.image_size) == ("img_0", "shows cap", "200x300")
    row = models.judge_overlap([("a b", "a b", ["a b", "z"], "a b")])[0]
    assert row == {"faithfulness": 1.0, "answer_relevancy": 1.0, "context_precision": 1.0, "context_recall": 1.0}


def test_evaluation_measures(spark):
    import math

    text = "red apples grow on tall trees in autumn. red apples grow on tall trees in winter. short one"
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    first, second = ["red", "apples", "grow", "tall", "trees", "autumn"], ["red", "apples", "grow", "tall", "trees", "winter"]
    w = {t: 1.0 if t not in ("autumn", "winter") else math.log(3 / 2) + 1 for t in first + second}
    n = math.sqrt(sum(w[t] ** 2 for t in first))
    assert abs(evaluation.intra_chunk_coherence(rows).first().coherence - sum(w[t] ** 2 for t in first[:5]) / n / n) < 1e-9
    ends = spark.createDataFrame([("d", 0, "alpha beta"), ("d", 1, "beta gamma"), ("d", 2, "delta")], "doc_id string, id long, text string")
    got = {r.id: r.similarity for r in evaluation.boundary_integrity(ends).collect()}
    u = math.log(3 / 2) + 1
    assert abs(got[0] - 1 / (1 + u * u)) < 1e-9 and got[1] == 0
    chunks = spark.createDataFrame([(0, "zebra quagga lion"), (1, "apple pear zebra quagga"), (2, "apple pear plum")], "id long, text string")
    assert {r.id: r.found for r in evaluation.self_retrieval(chunks).collect()} == {0: 0, 1: 1, 2: 2}


def test_process_both_profiles(spark):
    body = "\n".join(f"line {k} with some words to fill the page well enough " * 3 for k in range(12))
    rows = made(spark, "Title Page", "# Intro\n" + body, body + " (Doe, 2019)", "# References\nx")
    got = models.process(rows, MULTIMODAL).orderBy("chunk_id").collect()
    assert got and got[0].section == "Intro" and not any("2019" in r.text for r in got) and not any("References" in r.text for r in got)
    assert models.process(rows, LAYOUT).count() > 0 and models.process(rows.limit(0), LAYOUT).count() == 0

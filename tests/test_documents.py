"""Whole documents, headers by size, encoding, the index, databases and single questions."""

import numpy as np
from pyspark.sql import functions as F

from quarry.__main__ import main
from quarry.operators import answers, evaluation, index, layout, models, retrieval
from quarry.plans import inputs as I
from quarry.profiles import LAYOUT, MARKDOWN
from quarry.sources import database, store

SF = "/root/testdata/sf0.01"


def test_sections_by_headers(spark):
    rows = [
        ("d", 1, 0, "before any", 11.0, False), ("d", 1, 1, "Big Title", 12.0, False), ("d", 1, 2, "body  one", 11.0, False), ("d", 1, 3, "Ends as a sentence.", 12.0, False),
        ("d", 2, 0, "1.2 Numbered.", 11.0, False), ("d", 2, 1, "BOLD CAPS", 11.0, True), ("d", 2, 2, "SOFT CAPS", 11.0, False), ("d", 2, 3, "Just at", 11.5, False),
        ("d", 2, 4, "L" * 150, 14.0, False), ("d", 2, 5, "Last Header", 14.0, False), ("e", 1, 0, "Only a header", 14.0, None), ("f", 1, 0, "no size", None, None),
    ]
    lines = spark.createDataFrame(rows, "doc_id string, page_num int, line_no int, text string, size double, is_bold boolean").withColumn("body_size", F.lit(11.0))
    got = [(r.doc_id, r.section_no, r.title, r.text, r.page_num) for r in layout.sections_by_headers(lines).orderBy("doc_id", "section_no").collect()]
    assert got == [
        ("d", 0, "Introduction/Preamble", "before any", 1), ("d", 1, "Big Title", "body one Ends as a sentence.", 1),
        ("d", 2, "BOLD CAPS", "SOFT CAPS Just at " + "L" * 150, 2), ("f", 0, "Introduction/Preamble", "no size", 1),
    ]
    assert layout.sections_by_headers(lines.limit(0)).count() == 0


def test_embed_documents(spark):
    schema = "doc_id string, chunks array<struct<chunk_id:int,text:string,section:string,type:string>>"
    docs = spark.createDataFrame([("a", [(0, "x y", "S", "body"), (1, "n", "S", "footnote_whole")]), ("b", []), ("c", None), ("d", [(0, None, None, None)])], schema)
    got = {r.doc_id: r.chunks for r in models.embed_documents(docs, LAYOUT).collect()}
    assert sorted(got) == ["a", "d"] and [c.chunk_id for c in got["a"]] == [0, 1]
    want = models.hashing_embedder()(["x y"])[0]
    assert np.allclose(got["a"][0].embedding_dense, want[0]) and got["a"][0].embedding_sparse == want[1] and got["d"][0].embedding_sparse == {}
    marked = {r.doc_id: r.chunks for r in models.embed_documents(docs, MARKDOWN).collect()}
    assert sorted(marked) == ["a", "b", "c", "d"] and marked["b"] == [] and marked["c"] == []
    want = models.hashing_embedder()(["Nota de Rodapé: n"])[0]
    assert np.allclose(marked["a"][1].embedding_dense, want[0])


def test_index(spark, tmp_path):
    rows = I.read(spark, SF, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    bad = spark.createDataFrame([(-1, None), (-2, [0.0] * 64), (-3, [1.0]), (-4, [float("nan")] * 64)], "id long, embedding array<float>")
    index.write(rows.union(bad), str(tmp_path), 64, cells=12)
    cells, model = index.read(spark, str(tmp_path))
    assert cells.count() == rows.count()
    hits = 0
    for row in rows.where("id % 50 = 0").collect():
        exact = [r.id for r in retrieval.dense(rows, row.embedding, 5).collect()]
        assert [r.id for r in index.search(cells, model, row.embedding, 5, 12).collect()] == exact
        hits += len(set(exact) & {r.id for r in index.search(cells, model, row.embedding, 5, 6).collect()})
    assert hits >= 0.75 * 5 * 10
    plan = index.search(cells, model, [1.0] * 64, 5, 3)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("]")[0]


def test_database(spark):
    db = database.Database("jdbc:derby:memory:quarry;create=true", driver="org.apache.derby.jdbc.EmbeddedDriver")
    rows = spark.createDataFrame([(k, f"t{k}", [1.0, 2.0]) for k in range(10)], "id int, text string, embedding array<double>")
    database.replace(rows, db, "chunks")
    database.append(rows.withColumn("id", F.col("id") + 10), db, "chunks")
    back = database.read(spark, db, "chunks", "id", (0, 20), 4)
    assert back.rdd.getNumPartitions() == 4 and sorted(r[0] for r in back.collect()) == list(range(20)) and back.first()[2] == "[1.0,2.0]"
    database.replace(rows.limit(3), db, "chunks")
    assert database.read(spark, db, "chunks").count() == 3
    assert "hidden" not in repr(database.postgres("h", "d", "u", "hidden"))


def test_services(spark):
    def service():
        def call(text):
            if "bad" in text:
                raise OSError("HTTP 429")
            return "  " if "blank" in text else f"said {len(text)}"

        return call

    asked = spark.createDataFrame([(1, "fine", "c"), (2, "bad", "c")], "query_id int, question string, context string")
    got = {r.query_id: r.answer for r in answers.answered(asked, service).collect()}
    assert got[1].startswith("said ") and got[2] == "quota exceeded"
    terms = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "blank")], "query_id int, question string")
    assert {r.query_id: r.search_query for r in answers.expanded(terms, service).collect()} == {1: "said 4", 2: "bad", 3: "blank"}


def test_one_question(spark, tmp_path, capsys):
    chunks = spark.createDataFrame([("a b c", 3), ("x y z", 4)], "text string, page int")
    rows = models.embed(chunks, F.col("text")).selectExpr("text", "page AS page_num", "embedding_dense", "concat('d', page, '.json') AS source_file", "cast(page AS string) AS chunk_id", "'{\"title\":\"T\",\"doi\":\"\"}' AS metadata")
    rows.write.parquet(str(tmp_path / "t"))
    assert main([str(tmp_path / "t"), "x y", "--top", "1"]) == 0 and "[Source 1] T, Page 4\nx y z" in capsys.readouterr().out
    assert main([str(tmp_path / "t"), "  "]) == 1
    empty = rows.limit(0).selectExpr("chunk_id AS id", "embedding_dense AS embedding", "source_file", "text", "page_num", "'' AS title", "'' AS doi")
    assert answers.answer_question(empty, "x", lambda: lambda p: p, models.hashing_embedder) is None


def test_process_documents(spark):
    body = "\n".join(f"line {k} with some words to fill the page well enough " * 3 for k in range(12))
    pages = spark.createDataFrame(
        [("d", 1, "Title Page", "1. gone"), ("d", 2, body, "1. kept"), ("d", 3, body.replace("line", "row") + " doi 10.1/ab", "  2. later "), ("e", 1, "short", None)], "doc_id string, page_num int, text string, footnotes string"
    )
    files = spark.createDataFrame([("d", "d.pdf", "data/d.pdf", "T", "A"), ("e", "e.pdf", "data/e.pdf", "", "")], "doc_id string, filename string, filepath string, title string, author string")
    figures = spark.createDataFrame([("d", "img_1", 2, "two"), ("d", "img_0", 2, "one")], "doc_id string, chunk_id string, page_num int, text string")
    got = {r.doc_id: r for r in models.process_documents(pages, files, LAYOUT, figures).collect()}
    d, e = got["d"], got["e"]
    assert d.metadata.total_pages == 3 and d.metadata.title == "T" and [c.chunk_id for c in d.chunks] == list(range(len(d.chunks))) and d.chunks
    assert [n.text for n in d.footnote_chunks] == ["1. kept", "2. later"] and [f.text for f in d.image_chunks] == ["one", "two"]
    assert e.document_type == "scanned" and e.footnote_chunks == [] and e.image_chunks == [] and [c.text for c in e.chunks] in ([], ["short"])
    want = sorted(tuple(r) for r in models.process(pages, LAYOUT).where("doc_id = 'd'").select("chunk_id", "text").collect())
    assert [(c.chunk_id, c.text) for c in d.chunks] == want


def test_report(spark):
    chunks = spark.createDataFrame([("d", 0, "zebra quagga lion"), ("d", 1, "apple pear zebra quagga"), ("d", 2, "apple pear plum")], "doc_id string, id long, text string")
    row = evaluation.report(chunks).first()
    each = [r.similarity for r in evaluation.boundary_integrity(chunks).collect()]
    assert (row.num_chunks, row.coherence, row.boundary, row.retrieval) == (3, 0.0, round(sum(each) / 2, 6), 1.0) and row.boundary > 0
    none = evaluation.report(chunks.limit(0)).first()
    assert (none.num_chunks, none.coherence, none.boundary, none.retrieval) == (0, 0.0, 0.0, 0.0)

"""Queries of the library read every row and every line of their inputs."""

import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.plans import inputs as I
from quarry.plans import queries as Q

SF = "/root/testdata/sf0.001"


def stored(spark, folder, *rows):
    spark.createDataFrame(list(rows), "doc_id long, source string, text string").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_layout_lines_are_all_lines(spark):
    want = Counter((r.doc_id, r.line) for r in I.derived(spark, SF).select("doc_id", F.explode(T.lines(F.col("text"))).alias("line")).collect())
    rows = Q.layout_lines(spark, SF).select("doc_id", "page_num", "line_no", F.col("spans")[0]["text"].alias("line")).collect()
    assert Counter((r.doc_id, r.line) for r in rows) == want
    assert len({(r.doc_id, r.page_num, r.line_no) for r in rows}) == len(rows) and max(r.line_no for r in rows) < 12


def test_layout_queries_meet_what_stands_late(spark, tmp_path):
    long = "word " * 40 + "ends here"
    late = [f"line {k} of the text" for k in range(30)] + [long, "Figure 7 shows late things", "and goes on", "", "1. Note at the foot"]
    sf = stored(spark, tmp_path, (12, "s", "one line"), (25, "s", "\n".join(late)))
    pages = {r.page_num: r for r in Q.layout_pages(spark, sf).collect()}
    assert sorted(pages) == [1, 2, 3, 4] and long in pages[4].text.split("\n") and pages[4].footnotes == "1. Note at the foot"
    assert {r.page_num: r.caption for r in Q.layout_captions(spark, sf).collect()}[4] == "Figure 7 shows late things and goes on"


def test_doi_queries_read_every_row(spark, tmp_path):
    sf = stored(spark, tmp_path, *[(k, "s", f"see 10.5555/x.{k}).") for k in range(26)], (38, "s", "none"), (51, "s", "none"))
    texts = {r.row_id: r.text for r in I.derived(spark, sf).collect()}
    want = {k: re.sub(r"[.,;:\]\)>]+$", "", m[1]) if (m := re.search(r"\b(10\.\d{4,}/\S+)", t)) else "" for k, t in texts.items()}
    assert {r.row_id: r.doi for r in Q.doi_extract(spark, sf).collect()} == want and want[12] == "10.5555/x.12" and want[38] == ""
    links = {r.row_id: r.link for r in Q.doi_link(spark, sf).collect()}
    assert links == {k: ("http://x/" if k % 2 == 0 else "https://doi.org/") + d if d else "" for k, d in want.items()}

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import sections as S


def one(spark, f, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


#: Texts, and what has to be left of them when citations are gone.
CITED = {
    "as shown (Doe et al.,\n2019) and (see below) twice": "as shown  and (see below) twice",
    "lists [1, 2–4] and [ 7 ] and [a]": "lists  and  and [a]",
    "a text12. word 7, rest": "a text. word, rest",
    "end. 94 Next and end. 94": "end. Next and end. ",
    "year (1799) stays, (1899) goes": "year (1799) stays,  goes",
    "x 7, y (1899)": "x, y ",
    "": "",
    "plain": "plain",
}


def test_citations(spark):
    assert one(spark, T.remove_citations, *CITED) == list(CITED.values())


def test_citations_follow_unicode(spark):
    assert one(spark, T.remove_citations, "text١. more", "café 12, more") == ["text. more", "café 12, more"]


def test_lines_words_and_strips(spark):
    texts = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f", "\n", "  a b c "]
    assert one(spark, T.lines, *texts) == [t.splitlines() for t in texts]
    assert one(spark, T.words, *texts) == [t.split() for t in texts]
    assert one(spark, T.strip, *texts) == [t.strip() for t in texts]


def test_doi_names_and_ocr(spark):
    assert one(spark, T.extract_doi, "see 10.1234/ab.c).,; x", "none 10.12/x", "a 10.55555/q 10.1234/z") == ["10.1234/ab.c", "", "10.55555/q"]
    assert one(spark, T.doi_link, "http://x", "10.1/2") == ["http://x", "https://doi.org/10.1/2"]
    assert one(spark, T.clean_ocr, " hy-\nphen\n\n\na \t b ") == ["hyphen\na b"]
    assert one(spark, lambda c: T.source_name(c, True), "a_b.pdf.json") == ["a b"]
    assert one(spark, T.or_query, "it's  a test") == ["its | a | test"]


def test_table_rows_and_page_numbers(spark):
    assert one(spark, T.is_table_row, "12  34", "12  34.", "a b c", "1 2 3 a", "", "12 %") == [True, False, False, True, False, True]
    assert one(spark, T.is_page_number, " 12 ", "12a", "١") == [True, False, True]


def test_markdown_normalisation(spark):
    text = "a **----- Start of picture text -----**<br>\nx\ny **----- End of picture text -----**<br>\nb ![i](p.png) **==> Picture [2] intentionally omitted <==** c"
    assert one(spark, T.normalize_markdown, text) == ["a b   c"]
    assert one(spark, T.normalize_layout, " a   b \n\n###SEC###  T  \n c") == ["a b\n###SEC###  T  \nc"]


@pytest.mark.parametrize("n", [0, 1, 249, 250, 251, 300, 301, 550, 551])
def test_word_windows(spark, n):
    words = [f"w{k}" for k in range(n)]
    want, start = [], 0
    while start < n:
        want.append((len(want), " ".join(words[start : start + 300]), start, min(start + 300, n)))
        start += 250
    assert [tuple(c) for c in one(spark, S.word_windows, " ".join(words))[0]] == want


def test_overlap_must_be_less_than_size():
    with pytest.raises(ValueError):
        S.word_windows(None, 50, 50)
    with pytest.raises(ValueError):
        S.table_windows(None, 50, 60)


def test_table_aware_chunks():
    row = "| a | b |"
    text = "\n".join(["one two three"] * 2 + [row] * 5 + ["four five"] * 3)
    got = S.table_aware_chunks(text, 10, 2)
    assert all(c[3] - c[2] == len(c[1].split()) for c in got) and [c[2] for c in got] == [10 * k for k in range(len(got))]
    # the table is not cut: its five rows stand in the first chunk
    assert got[0][1].count(row) == 5
    assert S.table_aware_chunks("", 10, 2) == [] and S.table_aware_chunks("a\n\nb", 10, 2) == [(0, "a\n\n b \n", 0, 2)]
    words = [f"w{k}" for k in range(1000)]
    got = S.table_aware_chunks("\n".join(" ".join(words[k : k + 7]) for k in range(0, 1000, 7)), 300, 50)
    assert set(w for c in got for w in c[1].split()) == set(words) and all(c[3] - c[2] <= 306 + 56 for c in got)

import numpy as np

from quarry.llm import html as H
from quarry.llm import html_train as T
from tests.llm.fixtures import SMALL


def test_held_out_accuracy():
    w = H.load_model()
    assert T.accuracy(w, pages=120, seed=990) > 0.985


def test_gradients_are_right(monkeypatch):
    monkeypatch.setattr(T, "HIDDEN", 3)
    xs, ys = T.examples(3, 5)
    w = T.start(2)
    _, g = T.gradients(xs, ys, w)
    for k in w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        sides = []
        for e in (1e-5, -1e-5):
            w[k][at] += e
            sides.append(T.gradients(xs, ys, w)[0])
            w[k][at] -= e
        assert abs((sides[0] - sides[1]) / 2e-5 - g[k][at]) < 1e-6


def test_whole_table_against_its_structure(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = H.op10_block_lstm(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        want = "\n".join(b[0] for b in H.blocks(pages[r.page_id].html) if "article" in b[1])
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


def test_batches_label_like_single_pages():
    w = H.load_model()
    pages = [H.vectors(H.blocks(T.Maker(k).page())) for k in range(40)] + [H.vectors([])]
    for together, page in zip(H.label(pages, w, group=7), pages):
        assert np.allclose(together, H.label([page], w)[0], atol=1e-5)


def test_reading():
    one = lambda page: [b[0] for b in H.blocks(page)]
    assert one("<p>a&nbsp; b<br>c <b>d</b>e&amp;<!-- <p>x --> f<p>g") == ["a b c de& f", "g"]
    assert one("<script>if (a<b) '</p>'</script><style>p</style>x<title>no</title>") == ["x"]
    assert one("<p title='a>b' class=\"c\">x</p><a href=") == ["x"]
    assert one("<ul><li>a<ul><li>b</ul><li>c") == ["a", "b", "c"] and one("<div>" * 3000 + "x") == ["x"]
    assert one(None) == one("") == one("<") [:0] == [] and one("a < b") == ["a < b"]
    assert [b[1] for b in H.blocks("<table><tr><td>a<td>b<tr><td>c</table>")][2] == ("table", "tr", "td")


def test_skipped_elements_without_an_end():
    one = lambda page: [b[0] for b in H.blocks(page)]
    assert one("<svg width='1' /><p>a</p><svg><text>no</text></svg><p>b</p>") == ["a", "b"]
    for tag in ("svg", "object data=x", "video", "audio", "canvas", "template", "noscript"):
        assert one(f"<p>a</p><{tag}><p>b</p><{tag}><p>c</p>") == ["a", "b", "c"]
    assert one("<p>a <math/>b <math><mi>x</mi><mo>=</mo><mn>1</mn></math> c</p>") == ["a b x=1 c"]
    assert one("<p>a</p><script>b<p>c") == one("<p>a</p><style>b<p>c") == ["a"]


def test_awkward_rows(spark):
    page = "<body><nav><a href=/>Home</a></nav><article><h1>Title words here</h1><p>" + "long text of words. " * 20_000 + "</p></article><footer>&copy; us</footer></body>"
    rows = [(1, "u", page), (1, "u", page), (None, None, None), (2, "v", ""), (3, "w", "<p"), (4, None, "<nav><a href=/>Home</a></nav>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1.5D as rest", "array(1, 2) as blocks")
    got = H.extract(df)
    assert got.columns == ["page_id", "url", "text", "rest", "blocks", "_text"]
    out = got.collect()
    assert len(out) == 6 and out[0]["_text"] == out[1]["_text"] == "Title words here\n" + " ".join(["long text of words."] * 20_000)
    assert out[2]["_text"] == out[3]["_text"] == out[4]["_text"] == ""
    assert H.extract(df.limit(0)).count() == 0

"""Rules on lines with their place on the page.

Lines are rows of doc_id, page_num, page_w, page_h, block_no, line_no, x0, y0, x1, y1 (of the
block), ly (top of the line), spans array<struct<text,size,color>>, tables
array<struct<x0,y0,x1,y1>>, drawings array<struct<y0,height,width>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T

MARGIN = 0.12
# Shapes of headings, captions and notes.
BAD_TITLE = r"(?U)^\s*[\-\.\,\)\:–—•◦]\s+|;|^\d+\s*$|\.{3,}"
CAPTION = r"(?iU)^(figura|figure|fig\.|tabela|table|tab\.|quadro|chart|graph|imagem|image|fonte|source)\b"
SOURCE = r"(?iU)^(fonte|source|adaptado de|adapted from)\b"
BAD_START = (
    r"(?iU)^(de facto|no entanto|entretanto|todavia|assim|portanto|deste modo|furthermore|moreover|however|nevertheless|according to|consequently|"
    r"apesar|embora|consoante|tendo em conta|relativamente|quanto|outro exemplo)"
)
BAD_END = r"(?iU)\b(a|o|as|os|um|uma|de|da|do|das|dos|em|na|no|nas|nos|por|para|com|se|que|e|ou|à|às|of|the|and|or|in|on|at|to|for|with|by|from|is|are)\s*$"
NOTE_START = r"(?U)^\s*(\(?\d+\)?|[\*\†\‡])[\.\)\s]\s*[A-ZÀ-Úa-z]"
NUMBERED_TITLE, CAPITALS = r"(?U)^\d+(\.\d+)*\s+", r"(?U)^[A-ZÀ-Ü\s\-]{4,}$"
PREAMBLE = "Introduction/Preamble"
FIGURE = r"(?iU)\b(Figure|Fig\.|Figura|FIGURE|Table|Tabela|TABLE)\s*\d+"


def body_style(lines: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The most frequent rounded size and colour of spans that are not blank; the first seen wins ties."""
    spans = lines.select(*by, "page_num", "block_no", "line_no", F.posexplode("spans").alias("k", "s")).where(T.strip(F.col("s.text")) != "")
    place = F.struct("page_num", "block_no", "line_no", "k")
    out = lines.select(*by).distinct()
    for name, value, missing in (("body_size", F.bround(F.col("s.size"), 1), 11.0), ("body_color", F.col("s.color"), 0)):
        counts = spans.groupBy(*by, value.alias("v")).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
        best = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "first"))
        out = out.join(counts.withColumn("r", best).where("r = 1").select(*by, F.col("v").alias(name)), list(by), "left").withColumn(name, F.coalesce(name, F.lit(missing)))
    return out


def footnote_zone(drawings: Column, height: Column) -> Column:
    """The top of the highest thin, wide drawing in the lowest third, else 85 % of the page."""
    found = F.array_min(F.transform(F.filter(drawings, lambda d: (d["y0"] > height * 0.66) & (d["height"] < 5) & (d["width"] > 50)), lambda d: d["y0"]))
    return F.coalesce(found, height * 0.85)


def inside_table(x: Column, y: Column, tables: Column) -> Column:
    return F.exists(tables, lambda t: (t["x0"] < x) & (x < t["x1"]) & (t["y0"] < y) & (y < t["y1"]))


def page_lines(lines: DataFrame) -> DataFrame:
    """Lines of text off the side margins and out of tables, page numbers and loose data left out, with full, avg_size and colored."""
    # one row a document, which may have a large share of the lines
    rows = lines.join(F.broadcast(body_style(lines)), "doc_id")
    rows = rows.where(~((F.col("x1") < F.col("page_w") * MARGIN) | (F.col("x0") > F.col("page_w") * (1 - MARGIN))))
    rows = rows.where(~inside_table((F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2, F.col("tables")))
    rows = rows.withColumn("full", T.strip(F.array_join(F.transform("spans", lambda s: s["text"]), " ")))
    rows = rows.where((F.col("full") != "") & ~T.is_page_number(F.col("full")) & ~T.is_table_row(F.col("full")))
    solid = F.filter("spans", lambda s: T.strip(s["text"]) != "")
    size = F.aggregate(solid, F.lit(0.0), lambda a, s: a + s["size"]) / F.size(solid)
    return rows.withColumn("avg_size", F.when(F.size(solid) > 0, size).otherwise(F.col("body_size"))).withColumn("colored", F.col("spans")[0]["color"] != F.col("body_color"))


def is_title(slides: Column) -> Column:
    """Large or coloured lines off the top and bottom that read like a heading."""
    t = F.col("full")
    limit = F.when(F.col("colored"), F.col("body_size")).otherwise(F.col("body_size") + F.when(slides, 4.0).otherwise(0.5))
    placed = (F.col("ly") >= F.when(slides, 0.0).otherwise(F.col("page_h") * 0.1)) & (F.col("ly") <= F.col("page_h") * 0.9)
    spaces = (F.length(t) - F.length(F.replace(t, F.lit("  "), F.lit("")))) / 2
    barred = t.rlike(BAD_TITLE) | t.rlike(CAPTION) | t.rlike(BAD_START) | t.rlike(BAD_END) | (F.length(t) > 120) | F.contains(t, F.lit(",")) | (spaces > 3) | ((F.length(t) < 4) & ~t.rlike(r"(?U)^\d+\."))
    before = F.regexp_extract(t, r"^(\P{L}*)\p{Ll}", 1)
    lower_first = t.rlike(r"^\P{L}*\p{Ll}") & ~before.rlike(r"(?U)\d")
    short_caps = (F.length(t) < 6) & (F.upper(t) == t) & t.rlike(r"\p{L}") & ~t.rlike(r"^(I|V|X|L|M)+\.?$") & ~t.isin("RESUMO", "ABSTRACT", "INTRO")
    return (F.col("avg_size") >= limit) & placed & ~barred & ~lower_first & ~t.rlike(r"^\p{Ll}") & ~short_caps


def slide_documents(lines: DataFrame) -> DataFrame:
    """doc_id, is_slides: whether the first page is wider than high."""
    first = F.min(F.struct("page_num", "page_w", "page_h"))
    return lines.groupBy("doc_id").agg(first.alias("p")).select("doc_id", (F.col("p.page_w") > F.col("p.page_h")).alias("is_slides"))


def assemble_notes(lines: DataFrame, by: tuple[str, ...] = ("doc_id", "page_num")) -> DataFrame:
    """Lines (ly, block_no, line_no, full) -> notes: a line that looks like the start of a note opens one, later lines go on with it."""
    order = Window.partitionBy(*by).orderBy("ly", "block_no", "line_no")
    rows = lines.withColumn("note", F.sum(F.col("full").rlike(NOTE_START).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("note > 0")
    own = F.struct("ly", "block_no", "line_no", "full")
    notes = rows.groupBy(*by, "note").agg(F.array_join(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["full"]), " ").alias("text"))
    return notes.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("note", "text"))), lambda x: x["text"]), "\n\n").alias("footnotes"))


def read_pages(lines: DataFrame) -> DataFrame:
    """doc_id, page_num, text, footnotes: marked headings and body lines in order, captions left out, notes apart."""
    slides = F.broadcast(slide_documents(lines))
    rows = page_lines(lines).join(slides, "doc_id")
    note = (F.col("ly") >= footnote_zone(F.col("drawings"), F.col("page_h"))) & (F.col("avg_size") <= F.col("body_size") - 0.5)
    rows = rows.withColumn("is_note", note).withColumn("is_title", is_title(F.col("is_slides")))
    body = rows.where(~F.col("is_note") & ~F.col("full").rlike(CAPTION) & ~F.col("full").rlike(SOURCE))
    line = F.when(F.col("is_title"), F.concat(F.lit(T.SECTION_MARK + " "), "full")).otherwise(F.col("full"))
    texts = body.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", "line_no", line.alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    every = lines.select("doc_id", "page_num").distinct().join(slides, "doc_id")
    out = every.join(texts, ["doc_id", "page_num"], "left").join(assemble_notes(rows.where("is_note")), ["doc_id", "page_num"], "left")
    text = F.coalesce("text", F.lit(""))
    marked = F.when(F.col("is_slides") & ~F.contains(F.substring(text, 1, 100), F.lit(T.SECTION_MARK)), F.concat(F.lit(f"{T.SECTION_MARK} Slide "), "page_num", F.lit("\n"), text)).otherwise(text)
    return out.select("doc_id", "page_num", marked.alias("text"), F.coalesce("footnotes", F.lit("")).alias("footnotes"))


def is_header(text: Column, size: Column, bold: Column, body_size: Column) -> Column:
    """Larger than the body and no sentence, or numbered, or bold capitals; not long."""
    n, numbered = F.length(text), text.rlike(NUMBERED_TITLE)
    large = (size > body_size + 0.5) & (n < 150) & (numbered | ~T.strip(text).rlike("[.:;]$"))
    return large | ((n < 100) & (numbered | (bold & text.rlike(CAPITALS))))


def sections_by_headers(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, page_num, line_no, text, size, is_bold, body_size) -> doc_id, section_no (from 0), title, text, page_num.

    Lines before the first header are a preamble; a header without lines vanishes; a null size or weight marks no header.
    """
    order = Window.partitionBy("doc_id").orderBy("page_num", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.coalesce(is_header(F.col("text"), F.col("size"), F.coalesce("is_bold", F.lit(False)), F.col("body_size")), F.lit(False))
    rows = lines.withColumn("_opens", opens).withColumn("_island", F.sum(F.col("_opens").cast("long")).over(order))
    place = F.struct("page_num", "line_no", "text")
    found = rows.groupBy("doc_id", "_island").agg(F.max(F.when(F.col("_opens"), F.col("text"))).alias("title"), F.array_sort(F.collect_list(F.when(~F.col("_opens"), place))).alias("l"), F.min("page_num").alias("page_num"))
    text = T.normalize_layout(F.array_join(F.transform("l", lambda x: x["text"]), " "))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("_island")) - 1
    return found.where(F.size("l") > 0).select("doc_id", number.alias("section_no"), F.coalesce("title", F.lit(PREAMBLE)).alias("title"), text.alias("text"), "page_num")


def captions(lines: DataFrame) -> DataFrame:
    """doc_id, page_num, caption: figure lines of the lower 60 % of a page and the lines that go on with them, five at most."""
    own = F.struct("block_no", "line_no", F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("t"))
    rows = lines.where(F.col("ly") >= F.col("page_h") * 0.4).groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(own)).alias("all"))
    # the state: caption lines so far; done once a blank line or a line in title case follows one
    step = f"""aggregate(all, named_struct('out', cast(array() as array<string>), 'done', false), (s, x) -> CASE
        WHEN s.done OR size(s.out) >= 5 THEN s
        WHEN x.t rlike r'{FIGURE}' THEN named_struct('out', concat(s.out, array(trim(x.t))), 'done', false)
        WHEN size(s.out) = 0 THEN s
        WHEN trim(x.t) = '' OR trim(x.t) rlike r'(?U)^[A-Z][a-z]+\\s+[A-Z]' THEN named_struct('out', s.out, 'done', true)
        ELSE named_struct('out', concat(s.out, array(trim(x.t))), 'done', false) END, s -> s.out)"""
    text = T.strip(F.regexp_replace(F.array_join(F.expr(step), " "), r"(?U)\s+", " "))
    return rows.select("doc_id", "page_num", F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(text).alias("caption"))


def image_links(pages: DataFrame) -> DataFrame:
    """doc_id, page_num, image_no, path of the images that a page's Markdown names."""
    return pages.select("doc_id", "page_num", F.posexplode(F.regexp_extract_all("text", F.lit(r"!\[.*?\]\((.*?)\)"), F.lit(1))).alias("image_no", "path"))


def large_images(images: DataFrame, least: int = 150) -> DataFrame:
    return images.where((F.col("width") >= least) & (F.col("height") >= least))

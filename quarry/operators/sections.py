"""Sections and chunks of page texts, in reading order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import places
from quarry.operators.pages import part_of
from quarry.profiles import LAYOUT, Profile
from quarry.session import saved

UNLABELED = "UNLABELED_SECTION"
DOCUMENT_START = {"markdown": "Início do Documento", "multimodal": "Document Start"}


def split_sections(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """doc_id, section_no (from 0), title, text, page_num.

    layout: marked lines open a section and are not part of it; a heading without text
    vanishes. markdown: lines that start with # open one and stay in it.

    Each page is cut by itself; its pieces are numbered by the headings before it, counted by
    parts of the document, and the pieces of a section meet. No task holds a whole document.
    """
    layout = profile.name == "layout"
    opens = (lambda x: F.startswith(x, F.lit(T.SECTION_MARK))) if layout else (lambda x: F.startswith(T.strip(x), F.lit("#")))
    lines = F.filter(T.lines(F.col("text")), lambda x: T.strip(x) != "") if layout else T.lines(F.col("text"))
    headings = F.coalesce(F.greatest(F.size(F.filter(lines, opens)), F.lit(0)), F.lit(0))
    rows = places.running(pages.select("doc_id", "page_num", "text"), "doc_id", part_of(F.coalesce("page_num", F.lit(0))), "page_num", headings, "_to")

    def pieces(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(x)), lambda i: (i == 1) | opens(F.get(x, i - 1)))
        # the first piece of a page goes on with the section before it, unless it opens one
        opened = F.when(opens(F.get(x, F.lit(0))), 1).otherwise(0)

        def piece(i: Column, j: Column) -> Column:
            head = F.get(x, i - 1)
            own = F.slice(x, i, j - i)
            if layout:
                own = F.transform(F.when(opens(head), F.slice(x, i + 1, j - i - 1)).otherwise(own), T.strip)
            return F.struct(opens(head).alias("opens"), (T.strip(head) if layout else head).alias("head"), F.array_join(own, " " if layout else "\n").alias("body"))

        found = T.let(starts, lambda a: F.zip_with(a, F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(x) + 1)), piece))
        return F.when(F.size(x) > 0, F.transform(found, lambda p, k: F.struct((k + opened).alias("n"), p.alias("p"))))

    before = F.col("_to") - headings
    # plain explode would add a condition on the array, which works it out twice
    raw = rows.select("doc_id", "page_num", before.alias("before"), F.explode_outer(T.let(lines, pieces)).alias("e")).where("e is not null")
    own = F.struct("page_num", F.col("e.n").alias("n"), F.col("e.p.opens").alias("opens"), F.col("e.p.head").alias("head"), F.col("e.p.body").alias("body"))
    grouped = raw.groupBy("doc_id", (F.col("before") + F.col("e.n")).alias("island")).agg(F.array_sort(F.collect_list(own)).alias("all"))
    first = F.col("all")[0]
    if layout:
        title = T.strip(F.replace(first["head"], F.lit(T.SECTION_MARK), F.lit("")))
        title = F.when(first["opens"] & (title != ""), title).otherwise(UNLABELED)
        body = F.array_join(F.transform(F.filter("all", lambda x: x["body"] != ""), lambda x: x["body"]), " ")
    else:
        title = F.when(first["opens"], T.strip(F.replace(first["head"], F.lit("#"), F.lit("")))).otherwise(DOCUMENT_START[profile.name])
        body = F.array_join(F.transform("all", lambda x: x["body"]), "\n")
    out = saved(grouped.select("doc_id", "island", title.alias("title"), body.alias("text"), first["page_num"].alias("page_num")), "sections")
    out = out.where("text != ''") if layout else out
    out = places.running(out, "doc_id", part_of(F.col("island")), "island", F.lit(1), "_to")
    return out.select("doc_id", (F.col("_to") - 1).cast("int").alias("section_no"), "title", "text", "page_num")


def word_windows(text: Column, size: int = 300, overlap: int = 50) -> Column:
    """Windows of words as array of struct(chunk_no, text, start_word, end_word)."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    step = size - overlap

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s, i: F.struct(i.alias("chunk_no"), F.array_join(F.slice(w, s + 1, size), " ").alias("text"), s.alias("start_word"), F.least(s + size, F.size(w)).alias("end_word")))

    return T.let(T.words(text), cut)


def table_aware_chunks(text: str, size: int = 300, overlap: int = 50, first_equal: bool = True) -> list[tuple[int, str, int, int]]:
    """Chunks by whole lines, closed at `size` words but not inside a Markdown table.

    The next chunk opens with whole lines up to `overlap` words from the end; with first_equal
    they are counted back from the first line equal to the last, as the rule has it.
    """
    lines = text.splitlines()
    closed, held, count, in_table = [], [], 0, False

    def put(tokens: list[str], n: int) -> None:
        k = len(closed)
        closed.append((k, " ".join(tokens).replace(" \n ", "\n"), k * size, k * size + n))

    for i, line in enumerate(lines):
        bare, own = line.strip(), line.split()
        if bare.startswith("|") and bare.endswith("|"):
            in_table = True
        elif not bare.startswith("|"):
            in_table = False
        held += [*own, "\n"]
        count += len(own)
        if count < size or in_table:
            continue
        put(held, count)
        held, count = [], 0
        back = lines.index(line) if first_equal else i
        while back >= 0 and count < overlap:
            own = lines[back].split()
            held = [*own, "\n", *held]
            count += len(own)
            back -= 1
    if count:
        put(held, count)
    return closed


CHUNKS = "array<struct<chunk_no:int,text:string,start_word:int,end_word:int>>"


def table_windows(text: Column, size: int = 300, overlap: int = 50) -> Column:
    """As word_windows, by whole lines and tables. Each boundary depends on the one before, so it is a pandas function."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    @F.pandas_udf(CHUNKS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: [dict(zip(("chunk_no", "text", "start_word", "end_word"), c)) for c in table_aware_chunks(t or "", size, overlap)])

    return run(text)


def chunk_sections(sections: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """doc_id, chunk_id (from 0 in the document), section, text, start_word, end_word, type, page_num. Chunks are counted by parts of a document."""
    cut = word_windows if profile.name == "layout" else table_windows
    rows = saved(sections.withColumn("c", cut(F.col("text"), profile.chunk_size, profile.overlap)).drop("text"), "chunks").where(F.size("c") > 0)
    rows = places.running(rows, "doc_id", part_of(F.col("section_no")), "section_no", F.size("c"), "_to")
    rows = rows.select("*", (F.col("_to") - F.size("c")).alias("_before"), F.posexplode("c").alias("_i", "_c"))
    number = (F.col("_before") + F.col("_i")).cast("int")
    return rows.select("doc_id", number.alias("chunk_id"), F.col("title").alias("section"), F.col("_c.text").alias("text"), F.col("_c.start_word").alias("start_word"), F.col("_c.end_word").alias("end_word"), F.lit("body").alias("type"), "page_num")


def footnote_chunks(notes: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """doc_id, footnotes (notes parted by blank lines) -> doc_id, chunk_id, text, type, word_count."""
    each = notes.select("doc_id", F.posexplode(F.filter(F.transform(F.split("footnotes", "\n\n", -1), T.strip), lambda x: x != "")).alias("i", "note"))
    n = F.size(T.words(F.col("note")))
    whole = each.where(n <= profile.note_size).select("doc_id", F.concat(F.lit("fn_"), "i").alias("chunk_id"), F.col("note").alias("text"), F.lit("footnote_whole").alias("type"), n.alias("word_count"))
    cut = word_windows if profile.name == "layout" else table_windows
    parts = each.where(n > profile.note_size).withColumn("c", F.explode(cut(F.col("note"), profile.note_size, 0)))
    parts = parts.select("doc_id", F.concat_ws("_", F.lit("fn"), "i", "c.chunk_no").alias("chunk_id"), F.col("c.text").alias("text"), F.lit("footnote_part").alias("type"), F.size(T.words(F.col("c.text"))).alias("word_count"))
    return whole.union(parts)

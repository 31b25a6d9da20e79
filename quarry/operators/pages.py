"""Classification of documents and filters of their pages. Pages are rows of doc_id, page_num, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from quarry.functions import text as T
from quarry.profiles import LAYOUT, TOC_HEADERS, Profile
from quarry.session import saved

#: Shapes of contents lines, by profile.
TOC_LAYOUT = r"(?U)^.*[\.\s]{3,}\s*\d+$|^.+\s{2,}\d+$"
TOC_LINK, TOC_DOTS = r"(?U)\[.*?\]\(#page=\d+\)", r"(?U)(\.{3,}|\s{4,})\s*(\d+|[ivxlcdmIVXLCDM]+)[\*\|\s]*$"


#: Pages, or sections, of a document that one task may hold.
PART = 512


def part_of(number: Column) -> Column:
    return F.floor(number / PART)


def with_facts(pages: DataFrame, facts: DataFrame) -> DataFrame:
    """pages with what holds for their whole document, one short row each, which is broadcast: texts are not dealt out by document, as one may be a large share of them."""
    return pages.join(F.broadcast(facts.withColumnRenamed("doc_id", "_of")), F.col("doc_id").eqNullSafe(F.col("_of")), "left").drop("_of")


def document_stats(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Pages, characters, words and keyword flags of each document. A keyword is looked for page by page."""
    low = F.lower("text")
    flags = [F.max(T.contains_any(low, terms)).alias(f"has_{kind}") for kind, terms in profile.keywords.items()]
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.sum(F.size(T.words(F.col("text")))).cast("long").alias("words"), *flags)


def scanned(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    return document_stats(pages, profile).select("doc_id", "chars", (F.col("chars") < profile.scanned_chars).alias("is_scanned"))


def classify(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """scanned, slides, thesis, article or report."""
    kind = (
        F.when(F.col("chars") < profile.scanned_chars, "scanned").when(F.col("words") / F.col("pages") < profile.slide_words, "slides")
        .when(F.col("has_toc") & (F.col("pages") > profile.thesis_pages), "thesis").when(F.col("has_abstract") & F.col("has_references"), "article").otherwise("report")
    )
    return document_stats(pages, profile).select("doc_id", "pages", "words", kind.alias("document_type"))


def own(upto: bool = False) -> WindowSpec:
    """Pages of a document; those up to each one."""
    of = Window.partitionBy("doc_id")
    return of.orderBy("page_num").rowsBetween(Window.unboundedPreceding, 0) if upto else of


def no_front_matter(profile: Profile) -> Column:
    """Whether a page is neither empty nor opens with front matter."""
    head = F.lower(T.first_lines(T.strip(F.col("text")), 3))
    if profile.name != "layout":
        head = T.strip(F.replace(head, F.lit("#"), F.lit("")))
    return (T.strip(F.col("text")) != "") & ~T.contains_any(head, profile.front_matter)


def drop_front_matter(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Among the first pages those that are empty or open with front matter go."""
    first = pages.select("doc_id", "page_num", F.row_number().over(own(True)).alias("_k")).where(F.col("_k") <= profile.front_pages)
    rows = with_facts(pages, first.groupBy("doc_id").agg(F.max("page_num").alias("_first")))
    return rows.where((F.col("page_num") > F.col("_first")) | no_front_matter(profile)).select(*pages.columns)


def no_contents(profile: Profile, share: float = 0.4) -> Column:
    """Whether a page has lines, and not too large a share of them looks like contents."""

    def tell(lines: Column) -> Column:
        n = F.size(lines)
        if profile.name == "layout":
            told = T.contains_any(F.lower(F.array_join(F.slice(lines, 1, 3), " ")), TOC_HEADERS)
            few = F.size(F.filter(lines, lambda x: x.rlike(TOC_LAYOUT))) / n <= F.when(told, 0.15).otherwise(share)
        else:
            few = (n <= 5) | (F.size(F.filter(lines, lambda x: x.rlike(TOC_LINK) | T.strip(x).rlike(TOC_DOTS))) / n <= 0.15)
        return F.when(n > 0, few).otherwise(False)

    return T.let(T.lines(F.col("text")), tell)


def drop_contents(pages: DataFrame, profile: Profile = LAYOUT, share: float = 0.4) -> DataFrame:
    """Empty pages go, and those with too large a share of lines that look like contents."""
    return pages.where(no_contents(profile, share))


def opens_appendix(profile: Profile) -> Column:
    """Whether a page opens with an appendix heading."""

    def heading(x):
        clean = F.lower(T.strip(F.replace(x, F.lit("#"), F.lit(""))))
        return x.startswith("#") & T.contains_any(clean, profile.appendix) & (F.length(clean) < 60)

    def tell(lines: Column) -> Column:
        if profile.name == "layout":
            return (F.size(lines) > 0) & T.contains_any(F.lower(F.array_join(F.slice(lines, 1, 3), " ")), profile.appendix) & (F.length(F.get(lines, F.lit(0))) < 60)
        return F.exists(F.slice(lines, 1, 5), heading)

    return T.let(T.lines(T.strip(F.col("text"))), tell)


def appendix_page(rows: DataFrame, profile: Profile, stays: Column) -> DataFrame:
    """rows (doc_id, page_num, _opens) with _cut, the first page of an appendix among those that stay; the markdown profile looks in the second half only."""
    rows = rows.withColumn("_ord", F.sum(stays.cast("long")).over(own(True)) - 1).withColumn("_n", F.sum(stays.cast("long")).over(own()))
    looked = F.lit(True) if profile.name == "layout" else F.col("_ord") >= F.floor(F.col("_n") * 0.5)
    return rows.withColumn("_cut", F.min(F.when(stays & F.col("_opens") & looked, F.col("page_num"))).over(own()))


BEFORE_CUT = "(_cut is null or page_num < _cut)"


def cut_appendices(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Pages before the first that opens with an appendix heading; the markdown profile looks in the second half only."""
    told = appendix_page(pages.select("doc_id", "page_num", opens_appendix(profile).alias("_opens")), profile, F.lit(True))
    return with_facts(pages, told.groupBy("doc_id").agg(F.max("_cut").alias("_cut"))).where(BEFORE_CUT).select(*pages.columns)


def reference_at(profile: Profile) -> Column:
    """The place, from 1, of a page's first line that is a reference heading."""

    def heading(x):
        if profile.name == "layout":
            clean = F.lower(T.strip(F.replace(x, F.lit(T.SECTION_MARK), F.lit(""))))
            clean = F.regexp_replace(F.regexp_replace(clean, r"(?U)^\d+(\.\d+)*\s+", ""), r"[.:;]+$", "")
            return clean.isin(profile.references) & (F.length(clean) < 30)
        clean = F.lower(T.strip(F.replace(F.replace(x, F.lit("#"), F.lit("")), F.lit("*"), F.lit(""))))
        return T.strip(x).startswith("#") & F.regexp_replace(clean, r"(?U)^\d+(\.\d+)*\s+", "").isin(profile.references)

    told = F.transform(T.lines(F.col("text")), lambda x, i: F.struct(heading(x).alias("h"), (i + 1).alias("i")))
    return F.array_min(F.transform(F.filter(told, lambda s: s["h"]), lambda s: s["i"]))


def reference_page(rows: DataFrame, profile: Profile, stays: Column) -> DataFrame:
    """rows (doc_id, page_num, _at) with _page, the last page with a reference heading among those that stay; the markdown profile looks in the last pages only."""
    rows = rows.withColumn("_ord", F.sum(stays.cast("long")).over(own(True)) - 1).withColumn("_n", F.sum(stays.cast("long")).over(own()))
    looked = F.lit(True) if profile.name == "layout" else F.col("_ord") >= F.col("_n") - F.floor(F.col("_n") * 0.4)
    return rows.withColumn("_page", F.max(F.when(stays & F.col("_at").isNotNull() & looked, F.col("page_num"))).over(own()))


def before_references(rows: DataFrame, profile: Profile, at: Column, kept: Column) -> DataFrame:
    """rows with _page, cut there; kept: rows that stay as they are."""
    on = (F.col("page_num") == F.col("_page")) & ~kept
    cut = F.array_join(F.slice(T.lines(F.col("text")), 1, F.greatest(at - 1, F.lit(0))), "\n")
    text = F.when(on, cut if profile.name == "layout" else T.strip(cut)).otherwise(F.col("text"))
    rows = rows.where(kept | F.col("_page").isNull() | (F.col("page_num") <= F.col("_page"))).withColumn("text", text)
    return rows if profile.name == "layout" else rows.where(F.coalesce(~on, F.lit(True)) | (F.col("text") != ""))


def cut_references(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Everything from the first reference heading of the last page that has one goes."""
    told = reference_page(pages.select("doc_id", "page_num", reference_at(profile).alias("_at")), profile, F.lit(True))
    rows = with_facts(pages, told.groupBy("doc_id").agg(F.max("_page").alias("_page")))
    return before_references(rows, profile, reference_at(profile), F.lit(False)).select(*pages.columns)


def filtered(pages: DataFrame, kinds: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Pages of documents that are not scans through all filters above, front matter of articles and scans left as they are; document_type is added.

    Only marks of pages are dealt out by document: a few bytes each. pages are read several
    times, so what is costly should have been saved.
    """
    marks = {"_front": no_front_matter(profile), "_contents": no_contents(profile), "_opens": opens_appendix(profile), "_at": reference_at(profile)}
    marked = saved(with_facts(pages, kinds.select("doc_id", "document_type")).select("*", *[c.alias(n) for n, c in marks.items()]), "pages")
    scan, article = F.col("document_type") == "scanned", F.col("document_type") == "article"
    told = marked.select("doc_id", "page_num", "document_type", *marks).withColumn("_k", F.row_number().over(own(True)))
    told = told.withColumn("_first", F.max(F.when(F.col("_k") <= profile.front_pages, F.col("page_num"))).over(own()))
    stays = ~scan & (article | (F.col("page_num") > F.col("_first")) | F.col("_front")) & F.col("_contents")
    told = appendix_page(told, profile, stays)
    told = reference_page(told, profile, stays & F.expr(BEFORE_CUT))
    told = told.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in ("_first", "_cut", "_page")])
    rows = with_facts(marked, told).where(scan | (stays & F.expr(BEFORE_CUT)))
    return before_references(rows, profile, F.col("_at"), scan).select(*pages.columns, "document_type")


def repeated_lines(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """doc_id, line, hits of the lines that occur, by count over pages, in too large a share."""
    line = T.strip(F.col("_line"))
    each = pages.select("doc_id", F.explode(T.lines(F.col("text"))).alias("_line")).select("doc_id", line.alias("line"))
    each = each.where((F.length("line") > 3) & (F.length("line") < profile.longest_repeated_line))
    if profile.name != "layout":
        each = each.where(~F.col("line").startswith("|") & ~F.col("line").startswith("#"))
    # counted by line first, so that a line of every page is summed in part
    counts = each.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("hits"))
    sizes = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return with_facts(counts.where("doc_id is not null"), sizes).where(F.col("hits") / F.col("n") >= profile.repeated_share).select("doc_id", "line", "hits")


def strip_repeated_lines(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Pages without repeated lines; the layout profile drops blank lines too.

    A document's lines are one array: they are few, as each fills a share of its pages. They
    meet its pages part by part, as one document may be a large share of all.
    """
    known = repeated_lines(pages, profile).groupBy("doc_id").agg(F.collect_set("line").alias("_known"))
    part = part_of(F.coalesce("page_num", F.lit(0)))
    of = pages.select(F.col("doc_id").alias("_of"), part.alias("_of_part")).distinct().join(known, F.col("_of") == F.col("doc_id")).drop("doc_id")
    rows = pages.withColumn("_part", part)
    rows = rows.join(of, (F.col("doc_id") == F.col("_of")) & (F.col("_part") == F.col("_of_part")), "left")
    kept = F.filter(T.lines(F.col("text")), lambda x: ~F.array_contains(F.coalesce("_known", F.array().cast("array<string>")), T.strip(x)) & ((T.strip(x) != "") if profile.name == "layout" else F.lit(True)))
    return rows.select(*[F.array_join(kept, "\n").alias("text") if c == "text" else F.col(c) for c in pages.columns])

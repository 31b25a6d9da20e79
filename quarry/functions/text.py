"""Text functions on columns. Regular expressions follow Unicode, as the rules were written for it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
SECTION_MARK = "###SEC###"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def lines(c: Column) -> Column:
    """Lines without their ends; a final line end opens no line."""
    parts = F.split(c, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def words(c: Column) -> Column:
    return F.filter(F.split(c, rf"(?U){SPACE}+"), lambda w: w != "")


def contains_any(c: Column, terms) -> Column:
    """One alternation, so that the column is worked out once."""
    return c.rlike("|".join(re.escape(t) for t in dict.fromkeys(terms)))


def let(c: Column, f) -> Column:
    """f of a column that is worked out once, though f uses it inside a function of array elements."""
    return F.transform(F.array(c), f)[0]


def first_lines(c: Column, n: int) -> Column:
    return F.array_join(F.slice(lines(c), 1, n), " ")


# What counts as a citation, and what takes its place. They have to be these for equal results.
CITATIONS = (
    (r"(?Us)\([^\)]*?\b(?:18|19|20)\d{2}\b[^\)]*?\)", ""),
    (r"(?U)\[\s*\d+(?:[–-]\d+)?(?:,\s*\d+(?:[–-]\d+)?)*\s*\]", ""),
    (r"(?U)(?<=[a-z])\d{1,3}(?=[.,;:]|\s)", ""),
    (r"(?U)(?<=[a-z])\s+\d{1,3}(?=[.,;:])", ""),
    (r"(?Ud)(?<=\.)\s+\d{1,3}\s*(?=[A-Z]|$)", " "),
)


def remove_citations(c: Column) -> Column:
    """Parenthetical years, bracketed numbers, and numbers glued or loose after text."""
    for pattern, by in CITATIONS:
        c = F.regexp_replace(c, pattern, by)
    return c


def normalize_layout(c: Column) -> Column:
    """Citations removed; each line's white space collapsed, empty lines dropped, marked headings as they are."""
    one = lambda x: F.when(F.startswith(x, F.lit(SECTION_MARK)), x).otherwise(strip(F.regexp_replace(x, rf"(?U){SPACE}+", " ")))
    return F.array_join(F.filter(F.transform(lines(remove_citations(c)), one), lambda x: x != ""), "\n")


def normalize_markdown(c: Column) -> Column:
    """Parenthetical and bracketed citations, picture texts, picture marks and image links removed; white space kept."""
    for pattern in (
        r"(?Us)\([^\)]*?\b(?:18|19|20)\d{2}\b[^\)]*?\)",
        r"(?U)\[\s*\d+(?:[–-]\d+)?(?:,\s*\d+(?:[–-]\d+)?)*\s*\]",
        r"(?is)\*\*----- Start of picture text -----\*\*.*?\*\*----- End of picture text -----\*\*(?:<br>|\n)*",
        r"(?i)\*\*==>\s*picture.*?intentionally omitted\s*<==\*\*",
        r"!\[.*?\]\(.*?\)",
    ):
        c = F.regexp_replace(c, pattern, "")
    return c


def clean_ocr(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "-\n", ""), "\n+", "\n"), "[ \t]+", " "))


def extract_doi(c: Column) -> Column:
    """The first DOI without trailing punctuation, or an empty text."""
    return F.regexp_replace(F.regexp_extract(c, r"(?U)\b(10\.\d{4,}/[^\s]+)", 1), r"[.,;:\]\)>]+$", "")


def doi_link(c: Column) -> Column:
    """A DOI as a link; one that is a link already, or empty, as it is."""
    return F.when(F.startswith(c, F.lit("http")) | (c == ""), c).otherwise(F.concat(F.lit("https://doi.org/"), c))


def source_name(c: Column, spaced: bool = False) -> Column:
    out = F.replace(F.replace(c, F.lit(".json"), F.lit("")), F.lit(".pdf"), F.lit(""))
    return F.replace(out, F.lit("_"), F.lit(" ")) if spaced else out


def or_terms(c: Column) -> Column:
    """The words of a question without apostrophes, as the terms of an OR query."""
    return words(F.replace(c, F.lit("'"), F.lit("")))


def or_query(c: Column) -> Column:
    return F.array_join(or_terms(c), " | ")


def search_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def is_table_row(c: Column) -> Column:
    """Loose data: columns of numbers, or less than half letters; not what ends as a sentence."""
    solid = F.replace(c, F.lit(" "), F.lit(""))
    share = F.length(F.regexp_replace(c, r"\P{L}", "")) / F.length(solid)
    return ~strip(c).rlike("[.:;]$") & (c.rlike(r"(?U)\d+\s{2,}\d+") | ((F.length(solid) > 0) & (share < 0.5)))


def is_page_number(c: Column) -> Column:
    return c.rlike(r"(?Ud)^\s*\d+\s*$")


def is_section_title(c: Column) -> Column:
    """Numbered, all capitals, or title case; short, without comma or final stop."""
    t = strip(c)
    kind = t.rlike(r"(?U)^\d+(\.\d+)*\s+") | t.rlike(r"^[A-ZÀ-Ü\s\-]{4,}$") | (F.initcap(t) == t)
    return (F.length(t) > 0) & (F.length(t) <= 120) & (F.size(words(t)) <= 12) & ~F.contains(t, F.lit(",")) & ~F.endswith(t, F.lit(".")) & kind


def enriched(text: Column, section: Column, kind: Column, caption: Column, profile: str) -> Column:
    """The text that is embedded for a chunk."""
    if profile == "layout":
        return text
    if profile == "markdown":
        note = F.concat(F.lit("Nota de Rodapé: "), text)
        body = F.concat(F.lit("Secção: "), section, F.lit("\nConteúdo: "), text)
    else:
        note = F.concat(F.lit("Footnote: "), text)
        body = F.concat(F.lit("Section: "), section, F.lit("\nContent: "), text)
    figure = F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("Caption: "), caption, F.lit("\n\nDescription: "), text)).otherwise(F.concat(F.lit("Figure Description: "), text))
    return F.when(kind.startswith("footnote"), note).when(kind == "figure", figure).otherwise(body)

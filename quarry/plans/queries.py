"""The library's queries over the test tables, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import answers, evaluation, index, layout, models, pages, places, retrieval, sections
from quarry.plans import inputs as I
from quarry.profiles import APPENDIX_LAYOUT, APPENDIX_MARKDOWN, FRONT_MATTER_LAYOUT, KEYWORDS_LAYOUT, LAYOUT, MARKDOWN, MULTIMODAL, REFERENCES_LAYOUT, REFERENCES_MARKDOWN, TOC_HEADERS
from quarry.session import bounded
from quarry.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def any_of(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in dict.fromkeys(terms)) + ")"


#: Lines of a text in the oracle, which has line feeds only.
LINES = "CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(text, chr(10))[1:len(string_split(text, chr(10))) - 1] ELSE string_split(text, chr(10)) END"
WORDS = "list_filter(regexp_split_to_array({}, '\\s+'), lambda w: w <> '')"
NUMBERED = f"{I.DERIVED_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) - 1 AS ord, count(*) OVER (PARTITION BY doc_id) AS n, {LINES} AS l FROM p)"
OUT = "SELECT doc_id, page_num, text FROM"


def page_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "page_num", "text")


# --- retrieval ---

COSINE = "(1 - list_inner_product(e, v) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(v, v))))"
DENSE_SQL = f"""c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), v AS (SELECT e AS v FROM c WHERE id = 7),
d AS (SELECT id, round({COSINE}, 6) AS distance FROM c, v)"""
TERMS_SQL = """t AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM benchmark WHERE item_id = 0),
k AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM documents),
h AS (SELECT id, count(*) AS hits FROM k SEMI JOIN t USING (term) GROUP BY id ORDER BY hits DESC, id LIMIT 20)"""


@query(f"""WITH {DENSE_SQL}, a AS (SELECT id, rank() OVER (ORDER BY distance) AS dense_rank FROM (SELECT * FROM d ORDER BY distance, id LIMIT 20)), {TERMS_SQL},
b AS (SELECT id, rank() OVER (ORDER BY hits DESC) AS keyword_rank FROM h)
SELECT coalesce(a.id, b.id) AS id, dense_rank, keyword_rank, round(coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0), 9) AS rrf_score
FROM a FULL JOIN b ON a.id = b.id ORDER BY rrf_score DESC, id LIMIT 10""")
def hybrid_rrf(spark, sf_dir):
    return retrieval.hybrid(I.chunks(spark, sf_dir), I.query_vector(spark, sf_dir), I.query_terms(spark, sf_dir), 10)


@query(f"WITH {DENSE_SQL} SELECT id, distance FROM d ORDER BY distance, id LIMIT 5")
def dense_topk(spark, sf_dir):
    return retrieval.dense(I.chunks(spark, sf_dir), I.query_vector(spark, sf_dir), 5).select("id", "distance")


@query(f"WITH {DENSE_SQL} SELECT id, source AS source_file, round(1 - distance, 6) AS similarity FROM d LEFT JOIN documents ON doc_id = id ORDER BY distance, id LIMIT 3")
def dense_similarity(spark, sf_dir):
    rows = I.chunks(spark, sf_dir)
    return retrieval.dense(rows, I.query_vector(spark, sf_dir), 3).join(rows.select("id", "source_file"), "id").select("id", "source_file", "similarity")


@query(f"WITH {TERMS_SQL} SELECT * FROM h")
def keyword_topk(spark, sf_dir):
    return retrieval.keyword(I.chunks(spark, sf_dir), I.query_terms(spark, sf_dir), 20)


@query("""WITH t AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM benchmark),
k AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM documents),
f AS (SELECT id, term, count(*) AS tf FROM k GROUP BY ALL), s AS (SELECT query_id, id, CAST(sum(tf) AS BIGINT) AS hits FROM f JOIN t USING (term) GROUP BY ALL)
SELECT query_id, id, hits, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, id) AS rank FROM s QUALIFY rank <= 4""")
def keyword_batch(spark, sf_dir):
    docs = I.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return retrieval.keyword_all(docs, I.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"), 4)


@query()
def indexed_topk(spark, sf_dir):
    """The ten nearest to the stored vector of id 7, found in the 16 nearest cells of the index."""
    rows, vector = I.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), I.query_vector(spark, sf_dir)
    model = index.learn(rows, len(vector))
    return index.search(index.assign(rows, model, len(vector)), model, vector, 10)


@query(f"WITH {DENSE_SQL} SELECT id, distance FROM d ORDER BY distance, id LIMIT 10")
def indexed_exact(spark, sf_dir):
    """The same with every cell probed."""
    rows, vector = I.read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), I.query_vector(spark, sf_dir)
    model = index.learn(rows, len(vector))
    return index.search(index.assign(rows, model, len(vector)), model, vector, 10, model.summary.k).select("id", "distance")


@query("SELECT source AS doc_id, count(*) AS chunks, count(*) AS embedded FROM documents GROUP BY source")
def embedded_documents(spark, sf_dir):
    """Chunks of each source, encoded; how many have a vector of the encoder's length.

    A source may be a large share of the table, so each of its rows is encoded as a document of one chunk and the counts are added up.
    """
    bounded(spark)
    chunk = F.struct("doc_id", "text", F.col("lang").alias("section"), F.lit("body").alias("type"))
    out = models.embed_documents(I.read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.array(chunk).alias("chunks")))
    whole = F.size(F.filter("chunks", lambda c: F.size(c["embedding_dense"]) == 64)).cast("long")
    return out.groupBy("doc_id").agg(F.sum(F.size("chunks").cast("long")).alias("chunks"), F.sum(whole).alias("embedded"))


@query("SELECT item_id, array_to_string(list_filter(regexp_split_to_array(replace(text, '''', ''), '\\s+'), lambda w: w <> ''), ' | ') AS or_query FROM benchmark")
def lexical_query(spark, sf_dir):
    return I.read(spark, sf_dir, "benchmark").select("item_id", T.or_query(F.col("text")).alias("or_query"))


# --- classification ---

STATS = f"""s AS (SELECT doc_id, count(*) AS pages, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len({WORDS.format('text')})) AS BIGINT) AS words,
bool_or({any_of('lower(text)', KEYWORDS_LAYOUT['abstract'])}) AS has_abstract, bool_or({any_of('lower(text)', KEYWORDS_LAYOUT['references'])}) AS has_references, bool_or({any_of('lower(text)', TOC_HEADERS)}) AS has_toc FROM p GROUP BY doc_id)"""


@query(f"WITH {I.DERIVED_SQL}, {STATS} SELECT * FROM s")
def doc_stats(spark, sf_dir):
    return pages.document_stats(I.derived(spark, sf_dir))


@query(f"WITH {I.PLAIN_SQL} SELECT row_id AS doc_id, length(text) AS chars, length(text) < 200 AS is_scanned FROM p")
def scanned_docs(spark, sf_dir):
    return pages.scanned(I.pages(spark, sf_dir).select(F.col("row_id").alias("doc_id"), "page_num", "text"))


TYPE = "CASE WHEN chars < 200 THEN 'scanned' WHEN words / pages < 100 THEN 'slides' WHEN has_toc AND pages > 30 THEN 'thesis' WHEN has_abstract AND has_references THEN 'article' ELSE 'report' END AS document_type"


@query(f"WITH {I.DERIVED_SQL}, {STATS} SELECT doc_id, pages, words, {TYPE} FROM s")
def doc_type(spark, sf_dir):
    return pages.classify(I.derived(spark, sf_dir))


# --- page filters ---


@query(f"WITH {NUMBERED} {OUT} q WHERE ord >= 15 OR (trim(text) <> '' AND NOT {any_of('lower(array_to_string(l[1:3], chr(32)))', FRONT_MATTER_LAYOUT)})")
def front_matter_filter(spark, sf_dir):
    return page_rows(pages.drop_front_matter(I.derived(spark, sf_dir), LAYOUT))


@query(f"""WITH {NUMBERED} {OUT} q WHERE len(l) > 0 AND len(list_filter(l, lambda x: regexp_matches(x, '^.*[\\.\\s]{{3,}}\\s*\\d+$|^.+\\s{{2,}}\\d+$'))) / len(l)
<= CASE WHEN {any_of('lower(array_to_string(l[1:3], chr(32)))', TOC_HEADERS)} THEN 0.15 ELSE 0.4 END""")
def toc_filter(spark, sf_dir):
    return page_rows(pages.drop_contents(I.derived(spark, sf_dir), LAYOUT))


@query(f"""WITH {NUMBERED} {OUT} q WHERE len(l) > 0 AND (len(l) <= 5 OR len(list_filter(l, lambda x: regexp_matches(x, '\\[.*?\\]\\(#page=\\d+\\)') OR
regexp_matches(trim(x), '(\\.{{3,}}|\\s{{4,}})\\s*(\\d+|[ivxlcdmIVXLCDM]+)[\\*\\|\\s]*$'))) / len(l) <= 0.15)""")
def toc_filter_markdown(spark, sf_dir):
    return page_rows(pages.drop_contents(I.derived(spark, sf_dir), MARKDOWN))


@query(f"""WITH {NUMBERED}, c AS (SELECT *, min(CASE WHEN len(l) > 0 AND length(l[1]) < 60 AND {any_of('lower(array_to_string(l[1:3], chr(32)))', APPENDIX_LAYOUT)} THEN ord END) OVER (PARTITION BY doc_id) AS cut FROM q)
{OUT} c WHERE cut IS NULL OR ord < cut""")
def appendix_cut(spark, sf_dir):
    return page_rows(pages.cut_appendices(I.derived(spark, sf_dir), LAYOUT))


@query(f"""WITH {NUMBERED}, c AS (SELECT *, min(CASE WHEN ord >= floor(n * 0.5) AND len(list_filter(l[1:5], lambda x: starts_with(x, '#') AND length(trim(replace(x, '#', ''))) < 60
AND {any_of("lower(trim(replace(x, '#', '')))", APPENDIX_MARKDOWN)})) > 0 THEN ord END) OVER (PARTITION BY doc_id) AS cut FROM q) {OUT} c WHERE cut IS NULL OR ord < cut""")
def appendix_cut_markdown(spark, sf_dir):
    return page_rows(pages.cut_appendices(I.derived(spark, sf_dir), MARKDOWN))


def reference_sql(heading: str, looked: str, cut: str, last: str) -> str:
    return f"""WITH {NUMBERED}, g AS (SELECT *, list_min(list_filter(list_transform(l, lambda x, i: CASE WHEN {heading} THEN i END), lambda i: i IS NOT NULL)) AS place FROM q),
c AS (SELECT *, max(CASE WHEN place IS NOT NULL AND {looked} THEN ord END) OVER (PARTITION BY doc_id) AS cut FROM g),
f AS (SELECT doc_id, page_num, ord, cut, CASE WHEN ord = cut THEN {cut} ELSE text END AS text FROM c WHERE cut IS NULL OR ord <= cut)
{OUT} f{last}"""


def listed(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


@query(reference_sql(f"regexp_replace(regexp_replace(lower(trim(replace(x, '###SEC###', ''))), '^\\d+(\\.\\d+)*\\s+', ''), '[.:;]+$', '') IN ({listed(REFERENCES_LAYOUT)})", "true", "array_to_string(l[1:place - 1], chr(10))", ""))
def reference_cut(spark, sf_dir):
    return page_rows(pages.cut_references(I.derived(spark, sf_dir), LAYOUT))


@query(reference_sql(f"starts_with(trim(x), '#') AND regexp_replace(lower(trim(replace(replace(x, '#', ''), '*', ''))), '^\\d+(\\.\\d+)*\\s+', '') IN ({listed(REFERENCES_MARKDOWN)})", "ord >= n - floor(n * 0.4)", "trim(array_to_string(l[1:place - 1], chr(10)))", " WHERE cut IS NULL OR ord < cut OR text <> ''"))
def reference_cut_markdown(spark, sf_dir):
    return page_rows(pages.cut_references(I.derived(spark, sf_dir), MARKDOWN))


HEADED = "CASE WHEN row_id % 3 <> 0 THEN 'Running head of ' || doc_id || chr(10) || text ELSE text END"
HEADED_SQL = f"{I.PAGES_SQL}, p AS (SELECT doc_id, page_num, {HEADED} AS text FROM pages_raw), e AS (SELECT doc_id, trim(unnest({LINES})) AS line FROM p)"
REPEATED_SQL = f"{HEADED_SQL}, z AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1), rep AS (SELECT doc_id, line, count(*) AS hits FROM e WHERE length(line) > 3 AND length(line) < 300 GROUP BY ALL), r AS (SELECT doc_id, line, hits FROM rep JOIN z USING (doc_id) WHERE hits / n >= 0.6)"


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.pages(spark, sf_dir).select("doc_id", "page_num", F.expr(HEADED).alias("text"))


@query(f"WITH {REPEATED_SQL} SELECT * FROM r")
def repeated_lines(spark, sf_dir):
    return pages.repeated_lines(headed(spark, sf_dir))


@query(f"""WITH {REPEATED_SQL}, g AS (SELECT doc_id, list(line) AS known FROM r GROUP BY 1)
SELECT p.doc_id, page_num, array_to_string(list_filter({LINES}, lambda x: trim(x) <> '' AND NOT list_contains(coalesce(known, []), trim(x))), chr(10)) AS text FROM p LEFT JOIN g ON p.doc_id = g.doc_id""")
def strip_repeated_lines(spark, sf_dir):
    return page_rows(pages.strip_repeated_lines(headed(spark, sf_dir)))


LINE_ROWS = f"{I.DERIVED_SQL}, e AS (SELECT row_id, unnest({LINES}) AS line, generate_subscripts({LINES}, 1) - 1 AS line_no FROM p)"


def line_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.derived(spark, sf_dir).select("row_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "line"))


@query(f"""WITH {LINE_ROWS} SELECT row_id, line_no, line FROM e WHERE NOT regexp_matches(trim(line), '[.:;]$') AND (regexp_matches(line, '\\d+\\s{{2,}}\\d+') OR
(length(replace(line, ' ', '')) > 0 AND length(regexp_replace(line, '\\P{{L}}', '', 'g')) / length(replace(line, ' ', '')) < 0.5))""")
def table_row_lines(spark, sf_dir):
    return line_rows(spark, sf_dir).where(T.is_table_row(F.col("line")))


@query(f"WITH {LINE_ROWS} SELECT row_id, line_no, line FROM e WHERE regexp_matches(line, '^\\s*\\d+\\s*$')")
def page_number_lines(spark, sf_dir):
    return line_rows(spark, sf_dir).where(T.is_page_number(F.col("line")))


# --- text ---


@query(f"""WITH {I.DERIVED_SQL} SELECT row_id, trim(regexp_replace(regexp_replace(replace(text, '-' || chr(10), ''), '\\n+', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(10)) AS text FROM p""")
def ocr_clean(spark, sf_dir):
    return I.derived(spark, sf_dir).select("row_id", T.clean_ocr(F.col("text")).alias("text"))


CITED = "regexp_replace(regexp_replace(text, '(?s)\\([^\\)]*?\\b(?:18|19|20)\\d{2}\\b[^\\)]*?\\)', '', 'g'), '\\[\\s*\\d+(?:[–-]\\d+)?(?:,\\s*\\d+(?:[–-]\\d+)?)*\\s*\\]', '', 'g')"
#: No look-behind in the oracle: what stands before is put back.
STRIPPED = f"regexp_replace(regexp_replace({CITED}, '([a-z])\\d{{1,3}}([.,;:]|\\s)', '\\1\\2', 'g'), '([a-z])\\s+\\d{{1,3}}([.,;:])', '\\1\\2', 'g')"
STRIPPED = f"regexp_replace({STRIPPED}, '\\.\\s+\\d{{1,3}}\\s*([A-Z]|$)', '. \\1', 'g')"


@query(f"WITH {I.DERIVED_SQL} SELECT row_id, {STRIPPED} AS text FROM p")
def citation_strip(spark, sf_dir):
    return I.derived(spark, sf_dir).select("row_id", T.remove_citations(F.col("text")).alias("text"))


@query(f"""WITH {I.DERIVED_SQL}, s AS (SELECT row_id, {STRIPPED} AS text FROM p) SELECT row_id, array_to_string(list_filter(list_transform({LINES}, lambda x: CASE WHEN starts_with(x, '###SEC###') THEN x ELSE trim(regexp_replace(x, '\\s+', ' ', 'g')) END), lambda x: x <> ''), chr(10)) AS text FROM s""")
def normalize_lines(spark, sf_dir):
    return I.derived(spark, sf_dir).select("row_id", T.normalize_layout(F.col("text")).alias("text"))


@query(f"""WITH {I.DERIVED_SQL} SELECT row_id, regexp_replace(regexp_replace(regexp_replace({CITED}, '(?is)\\*\\*----- Start of picture text -----\\*\\*.*?\\*\\*----- End of picture text -----\\*\\*(?:<br>|\\n)*', '', 'g'),
'(?i)\\*\\*==>\\s*picture.*?intentionally omitted\\s*<==\\*\\*', '', 'g'), '!\\[.*?\\]\\(.*?\\)', '', 'g') AS text FROM p""")
def markdown_normalize(spark, sf_dir):
    return I.derived(spark, sf_dir).select("row_id", T.normalize_markdown(F.col("text")).alias("text"))


DOI = "regexp_replace(regexp_extract(text, '\\b(10\\.\\d{4,}/[^\\s]+)', 1), '[.,;:\\]\\)>]+$', '')"


@query(f"WITH {I.DERIVED_SQL} SELECT row_id, {DOI} AS doi FROM p")
def doi_extract(spark, sf_dir):
    return I.derived(spark, sf_dir).select("row_id", T.extract_doi(F.col("text")).alias("doi"))


@query(f"WITH {I.DERIVED_SQL}, d AS (SELECT row_id, {DOI} AS doi FROM p) SELECT row_id, CASE WHEN doi = '' THEN '' WHEN row_id % 2 = 0 THEN 'http://x/' || doi ELSE 'https://doi.org/' || doi END AS link FROM d")
def doi_link(spark, sf_dir):
    doi = T.extract_doi(F.col("text"))
    doi = F.when(doi != "", F.concat(F.when(F.col("row_id") % 2 == 0, "http://x/").otherwise(""), doi)).otherwise(doi)
    return I.derived(spark, sf_dir).select("row_id", T.doi_link(doi).alias("link"))


@query("SELECT doc_id, replace(replace(source || '_part.pdf.json', '.json', ''), '.pdf', '') AS name, replace(replace(replace(source || '_part.pdf.json', '.json', ''), '.pdf', ''), '_', ' ') AS spaced FROM documents")
def source_names(spark, sf_dir):
    name = F.concat("source", F.lit("_part.pdf.json"))
    return I.read(spark, sf_dir, "documents").select("doc_id", T.source_name(name).alias("name"), T.source_name(name, True).alias("spaced"))


@query(f"""WITH {LINE_ROWS}, t AS (SELECT *, trim(line, ' ' || chr(9)) AS t FROM e) SELECT row_id, line_no, line FROM t WHERE length(t) BETWEEN 1 AND 120 AND len({WORDS.format('t')}) <= 12 AND NOT contains(t, ',') AND NOT ends_with(t, '.')
AND (regexp_matches(t, '^\\d+(\\.\\d+)*\\s+') OR regexp_matches(t, '^[A-ZÀ-Ü\\s-]{{4,}}$') OR array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') = t)""")
def section_titles(spark, sf_dir):
    return line_rows(spark, sf_dir).where(T.is_section_title(F.col("line")))


# --- sections and chunks ---

SECTION_SQL = f"""WITH {I.DERIVED_SQL}, r AS (SELECT doc_id, page_num, generate_subscripts({LINES}, 1) AS line_no, unnest({LINES}) AS line FROM p), {{islands}}"""


@query(SECTION_SQL.format(islands="""i AS (SELECT *, CAST(sum(CASE WHEN starts_with(line, '###SEC###') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_num, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM r WHERE trim(line) <> ''),
g AS (SELECT doc_id, island, first(line ORDER BY page_num, line_no) AS head, first(page_num ORDER BY page_num, line_no) AS page_num, string_agg(CASE WHEN starts_with(line, '###SEC###') THEN NULL ELSE trim(line) END, ' ' ORDER BY page_num, line_no) AS text FROM i GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS section_no, CASE WHEN starts_with(head, '###SEC###') AND trim(replace(head, '###SEC###', '')) <> '' THEN trim(replace(head, '###SEC###', '')) ELSE 'UNLABELED_SECTION' END AS title, text, page_num FROM g WHERE text IS NOT NULL AND text <> ''"""))
def sections_layout(spark, sf_dir):
    return sections.split_sections(I.derived(spark, sf_dir), LAYOUT)


@query(SECTION_SQL.format(islands="""i AS (SELECT *, CAST(sum(CASE WHEN starts_with(trim(line), '#') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_num, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM r),
g AS (SELECT doc_id, island, first(line ORDER BY page_num, line_no) AS head, first(page_num ORDER BY page_num, line_no) AS page_num, string_agg(line, chr(10) ORDER BY page_num, line_no) AS text FROM i GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS section_no, CASE WHEN starts_with(trim(head), '#') THEN trim(replace(head, '#', '')) ELSE 'Início do Documento' END AS title, text, page_num FROM g"""))
def sections_markdown(spark, sf_dir):
    return sections.split_sections(I.derived(spark, sf_dir), MARKDOWN)


CHUNK_SQL = f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
c AS (SELECT doc_id, unnest(range(0, len(w), 250)) AS start_word, w FROM w WHERE len(w) > 0)"""


@query(f"{CHUNK_SQL} SELECT doc_id, CAST(start_word / 250 AS INTEGER) AS chunk_no, array_to_string(w[start_word + 1 : start_word + 300], ' ') AS text, start_word, least(start_word + 300, len(w)) AS end_word FROM c")
def word_chunks(spark, sf_dir):
    return I.read(spark, sf_dir, "documents").select("doc_id", F.explode(sections.word_windows(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query(f"""WITH {I.PLAIN_SQL}, w AS (SELECT doc_id, page_num, {WORDS.format('text')} AS w FROM p), c AS (SELECT doc_id, page_num, unnest(range(0, len(w), 250)) AS start_word, w FROM w WHERE len(w) > 0)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, start_word) - 1 AS chunk_id, 'page' AS section, array_to_string(w[start_word + 1 : start_word + 300], ' ') AS text, start_word, least(start_word + 300, len(w)) AS end_word, 'body' AS type, page_num FROM c""")
def chunk_ids(spark, sf_dir):
    rows = I.pages(spark, sf_dir).select("doc_id", F.col("page_num").alias("section_no"), F.lit("page").alias("title"), "text", "page_num")
    return sections.chunk_sections(rows, LAYOUT)


@query()
def table_chunks(spark, sf_dir):
    bounded(spark)
    return sections.chunk_sections(sections.split_sections(I.derived(spark, sf_dir), MARKDOWN), MARKDOWN)


NOTES = "'1. ' || text || chr(10) || chr(10) || '   ' || chr(10) || chr(10) || '2. short note ' || CAST(row_id AS STRING)"


@query(f"""WITH {I.PLAIN_SQL}, n AS (SELECT row_id, string_split({NOTES}, chr(10) || chr(10)) AS parts FROM p),
t AS (SELECT row_id, list_filter(list_transform(parts, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS notes FROM n),
e AS (SELECT row_id, generate_subscripts(notes, 1) - 1 AS i, unnest(notes) AS note FROM t), w AS (SELECT *, {WORDS.format('note')} AS w FROM e)
SELECT row_id AS doc_id, 'fn_' || i AS chunk_id, note AS text, 'footnote_whole' AS type, len(w) AS word_count FROM w WHERE len(w) <= 200
UNION ALL SELECT row_id, 'fn_' || i || '_' || CAST(s / 200 AS INTEGER), array_to_string(w[s + 1 : s + 200], ' '), 'footnote_part', len(w[s + 1 : s + 200]) FROM (SELECT *, unnest(range(0, len(w), 200)) AS s FROM w WHERE len(w) > 200)""")
def footnote_chunks(spark, sf_dir):
    return sections.footnote_chunks(I.pages(spark, sf_dir).select(F.col("row_id").alias("doc_id"), F.expr(NOTES).alias("footnotes")), LAYOUT)


LINKS = "regexp_extract_all(text, '!\\[.*?\\]\\((.*?)\\)', 1)"


@query(f"WITH {I.DERIVED_SQL} SELECT doc_id, page_num, generate_subscripts({LINKS}, 1) - 1 AS image_no, unnest({LINKS}) AS path FROM p")
def image_links(spark, sf_dir):
    return layout.image_links(I.derived(spark, sf_dir))


@query(f"WITH {I.DERIVED_SQL}, i AS (SELECT doc_id, page_num, generate_subscripts({LINKS}, 1) - 1 AS image_no, unnest({LINKS}) AS path FROM p), s AS (SELECT *, 100 + 10 * (page_num % 13) AS width, 120 + 10 * (page_num % 7) AS height FROM i) SELECT * FROM s WHERE width >= 150 AND height >= 150")
def image_size_filter(spark, sf_dir):
    images = layout.image_links(I.derived(spark, sf_dir)).withColumn("width", 100 + 10 * (F.col("page_num") % 13)).withColumn("height", 120 + 10 * (F.col("page_num") % 7))
    return layout.large_images(images)


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Section: ' || source || chr(10) || 'Content: ' || text WHEN 1 THEN 'Footnote: ' || text WHEN 2 THEN 'Caption: ' || lang || chr(10) || chr(10) || 'Description: ' || text ELSE 'Figure Description: ' || text END AS multimodal,
CASE doc_id % 4 WHEN 0 THEN 'Secção: ' || source || chr(10) || 'Conteúdo: ' || text WHEN 1 THEN 'Nota de Rodapé: ' || text WHEN 2 THEN 'Caption: ' || lang || chr(10) || chr(10) || 'Description: ' || text ELSE 'Figure Description: ' || text END AS markdown FROM documents""")
def enriched_text(spark, sf_dir):
    kind = F.expr("CASE doc_id % 4 WHEN 0 THEN 'body' WHEN 1 THEN 'footnote_whole' ELSE 'figure' END")
    caption = F.expr("CASE WHEN doc_id % 4 = 2 THEN lang ELSE '' END")
    rows = I.read(spark, sf_dir, "documents")
    return rows.select("doc_id", *[T.enriched(F.col("text"), F.col("source"), kind, caption, p).alias(p) for p in ("multimodal", "markdown")])


@query()
def process_pages(spark, sf_dir):
    bounded(spark)
    return models.process(I.derived(spark, sf_dir).select("doc_id", "page_num", "text"), MULTIMODAL)


@query()
def process_documents(spark, sf_dir):
    """Every source as one document with metadata, kind, chunks and notes."""
    rows = I.derived(spark, sf_dir).select("doc_id", "page_num", "text", F.when(F.col("row_id") % 10 == 0, F.concat(F.lit("1. Note of page "), "page_num")).otherwise("").alias("footnotes"))
    files = rows.select("doc_id").distinct().select("doc_id", F.concat("doc_id", F.lit(".pdf")).alias("filename"), F.concat(F.lit("data/"), "doc_id", F.lit(".pdf")).alias("filepath"), F.lit("").alias("title"), F.lit("").alias("author"))
    return models.process_documents(rows, files, LAYOUT)


# --- chunk table ---


@query("""WITH a AS (SELECT source AS source_file, doc_id AS chunk_id, text FROM documents), b AS (SELECT source_file, chunk_id + 1000000 AS chunk_id, 'new ' || text AS text FROM a WHERE source_file < 'src13' AND chunk_id % 2 = 0)
SELECT * FROM a WHERE source_file NOT IN (SELECT source_file FROM b) UNION ALL SELECT * FROM b""")
def replace_by_document(spark, sf_dir):
    rows = I.read(spark, sf_dir, "documents").select(F.col("source").alias("source_file"), F.col("doc_id").alias("chunk_id"), "text")
    new = rows.where("source_file < 'src13' and chunk_id % 2 = 0").select("source_file", (F.col("chunk_id") + 1000000).alias("chunk_id"), F.concat(F.lit("new "), "text").alias("text"))
    return store.replaced(rows, new)


#: Vectors with faults: another length, NaN, zero, a long norm, a missing one.
FAULTY = "CASE vec_id % 11 WHEN 1 THEN {short} WHEN 2 THEN {nan} WHEN 3 THEN {zero} WHEN 4 THEN {long} WHEN 5 THEN NULL ELSE {e} END"
FAULTY_SPARK = FAULTY.format(e="e", short="slice(e, 1, 10)", nan="transform(e, (x, i) -> if(i = 3, double('NaN'), x))", zero="transform(e, x -> double(0))", long="transform(e, x -> x * double(1.06))")
FAULTY_DUCK = FAULTY.format(e="e", short="e[1:10]", nan="list_transform(e, lambda x, i: CASE WHEN i = 4 THEN 'NaN'::DOUBLE ELSE x END)", zero="list_transform(e, lambda x: 0::DOUBLE)", long="list_transform(e, lambda x: x * 1.06::DOUBLE)")
FAULTY_SQL = f"f AS (SELECT 'file' || (vec_id % 7) AS file, vec_id AS id, {FAULTY_DUCK} AS e FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))"


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select(F.expr("concat('file', vec_id % 7)").alias("file"), F.col("vec_id").alias("id"), F.expr(FAULTY_SPARK).alias("embedding"))


@query(f"WITH {FAULTY_SQL} SELECT file, id FROM f WHERE len(e) = 64")
def dimension_filter(spark, sf_dir):
    return faulty(spark, sf_dir).where(F.size("embedding") == 64).select("file", "id")


ISSUE_SQL = f"""{FAULTY_SQL}, i AS (
SELECT file, id, 'missing dense' AS issue FROM f WHERE e IS NULL
UNION ALL SELECT file, id, 'nan' FROM f WHERE len(list_filter(e, lambda x: isnan(x))) > 0
UNION ALL SELECT file, id, 'zero' FROM f WHERE e IS NOT NULL AND len(list_filter(e, lambda x: abs(x) > 1e-8)) = 0
UNION ALL SELECT file, id, 'norm' FROM f WHERE e IS NOT NULL AND (sqrt(list_sum(list_transform(e, lambda x: x * x))) <= 0.95 OR sqrt(list_sum(list_transform(e, lambda x: x * x))) >= 1.05)
UNION ALL SELECT file, NULL, 'several dimensions' FROM f GROUP BY file HAVING count(DISTINCT len(e)) > 1)"""


@query(f"WITH {ISSUE_SQL} SELECT * FROM i")
def embedding_issues(spark, sf_dir):
    return evaluation.embedding_issues(faulty(spark, sf_dir))


@query(f"WITH {ISSUE_SQL} SELECT f.file, f.n AS chunks, coalesce(g.n, 0) AS issues, g.n IS NULL AS passed FROM (SELECT file, count(*) AS n FROM f GROUP BY 1) f LEFT JOIN (SELECT file, count(*) AS n FROM i GROUP BY 1) g USING (file)")
def files_passed(spark, sf_dir):
    return evaluation.files_passed(faulty(spark, sf_dir))


# --- answers ---

HITS = "CASE WHEN id % 3 = 0 THEN '' ELSE 'Title ' || CAST(id AS STRING) END AS title, CASE WHEN id % 5 = 0 THEN '10.1234/' || CAST(id AS STRING) WHEN id % 5 = 1 THEN 'http://x' ELSE '' END AS doi"
KEYWORD_HITS = ORACLES["keyword_batch"].replace("QUALIFY rank <= 4", "").replace("SELECT query_id, id, hits, row_number()", "SELECT query_id, id, row_number()") + "QUALIFY rank <= 4"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = I.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit(".json")).alias("source_file"), (F.col("doc_id") % 50).alias("page_num"), "text")
    return keyword_batch(spark, sf_dir).join(docs, "id").selectExpr("*", *[x.strip() for x in HITS.split(", CASE WHEN id % 5")[:1]], "CASE WHEN id % 5" + HITS.split(", CASE WHEN id % 5")[1])


CONTEXT_SQL = f"""k AS ({KEYWORD_HITS}), x AS (SELECT k.query_id, k.rank, k.id, source || '.json' AS source_file, doc_id % 50 AS page_num, text FROM k JOIN documents ON doc_id = k.id), y AS (SELECT *, {HITS} FROM x)"""


@query(f"""WITH {CONTEXT_SQL} SELECT query_id, string_agg('[Source ' || rank || '] ' || CASE WHEN title <> '' THEN title ELSE replace(source_file, '.json', '') END || ', Page ' || page_num ||
CASE WHEN doi = '' THEN '' WHEN starts_with(doi, 'http') THEN chr(10) || 'DOI: ' || doi ELSE chr(10) || 'DOI: https://doi.org/' || doi END || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS context FROM y GROUP BY query_id""")
def context_blocks(spark, sf_dir):
    return answers.contexts(hits(spark, sf_dir))


@query("SELECT 'Answer from the sources only and cite them as [Name, Page n].' || chr(10) || chr(10) || 'ctx' || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM benchmark")
def prompts(spark, sf_dir):
    return I.read(spark, sf_dir, "benchmark").select(answers.prompt(F.col("text"), F.lit("ctx")).alias("prompt"))


ANSWER = "'See [src' || CAST(conv_id % 20 AS STRING) || ', Page 3] and [ Title ' || CAST(turn AS STRING) || ' ,page 12] [src1, Page 2](u) [a, b, Page 1] ' || text"


@query(f"SELECT conv_id, turn, list_sort(list_distinct(list_transform(regexp_extract_all({ANSWER}, '(?i)\\[([^,\\]]+),\\s*Page\\s+\\d+\\]', 1), lambda x: trim(x)))) AS cited FROM conversations")
def cited_sources(spark, sf_dir):
    return I.read(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_sort(answers.cited_sources(F.expr(ANSWER))).alias("cited"))


@query("""WITH s AS (SELECT DISTINCT source FROM documents), c AS (SELECT item_id, ['SRC' || (item_id % 20), 'title x'] AS cited FROM benchmark)
SELECT item_id, source, len(list_filter(cited, lambda c: contains(lower(source), lower(c)) OR contains(lower(c), lower(source)) OR (source = 'src3' AND (contains('a title x y', lower(c)) OR contains(lower(c), 'a title x y'))))) > 0 AS matched FROM s, c""")
def citation_match(spark, sf_dir):
    names = I.read(spark, sf_dir, "documents").select("source").distinct()
    asked = I.read(spark, sf_dir, "benchmark").select("item_id", F.array(F.concat(F.lit("SRC"), F.col("item_id") % 20), F.lit("title x")).alias("cited"))
    title = F.when(F.col("source") == "src3", "A Title X y").otherwise("")
    # distinct sources and questions: both few, and every pair is the result
    return names.join(asked, F.length("source") > 0).select("item_id", "source", answers.matches(F.concat("source", F.lit(".json")), title, F.col("cited")).alias("matched"))


@query(f"""WITH {CONTEXT_SQL}, i AS (SELECT query_id, rank, source_file, 'images/' || id || '.png' AS image_path FROM y WHERE id % 2 = 0), a AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS name FROM benchmark),
m AS (SELECT i.* FROM i JOIN a USING (query_id) WHERE contains(replace(source_file, '.json', ''), name) OR contains(name, replace(source_file, '.json', '')))
SELECT * FROM m UNION ALL SELECT * FROM (SELECT query_id, min(rank) AS rank, first(source_file ORDER BY rank) AS source_file, first(image_path ORDER BY rank) AS image_path FROM i WHERE query_id NOT IN (SELECT query_id FROM m) GROUP BY 1)""")
def figure_fallback(spark, sf_dir):
    rows = hits(spark, sf_dir).withColumn("chunk_type", F.when(F.col("id") % 2 == 0, "image").otherwise("text")).withColumn("image_path", F.concat(F.lit("images/"), "id", F.lit(".png"))).withColumn("title", F.lit(""))
    told = I.read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("as in [src"), F.col("item_id") % 20, F.lit(", Page 1]")).alias("answer"))
    return answers.cited_figures(rows, told)


@query("SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def chat_history(spark, sf_dir):
    rows = I.read(spark, sf_dir, "conversations")
    return answers.replay(answers.append_turns(rows.where("turn < 2"), rows))


@query("""SELECT item_id, CASE item_id % 5 WHEN 0 THEN 'quota exceeded' WHEN 1 THEN 'service unavailable' WHEN 2 THEN 'model not found' ELSE 'unexpected error' END AS message, CASE WHEN item_id % 2 = 0 THEN text ELSE 'expanded' END AS query FROM benchmark""")
def service_answers(spark, sf_dir):
    message = F.expr("CASE item_id % 5 WHEN 0 THEN 'Quota hit' WHEN 1 THEN 'HTTP 503' WHEN 2 THEN '404 none' ELSE 'boom' END")
    expanded = F.when(F.col("item_id") % 2 == 1, "expanded").when(F.col("item_id") % 4 == 0, " ")
    return I.read(spark, sf_dir, "benchmark").select("item_id", answers.error_message(message).alias("message"), answers.search_query(F.col("text"), expanded).alias("query"))


# --- evaluation ---


@query(f"WITH c AS (SELECT len({WORDS.format('text')}) AS n FROM documents) SELECT count(*) AS num_chunks, round(avg(n), 6) AS avg_size, round(stddev_pop(n), 6) AS std_size, min(n) AS min_size, max(n) AS max_size FROM c")
def chunk_stats(spark, sf_dir):
    return evaluation.chunk_stats(I.read(spark, sf_dir, "documents"))


def chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_ids(spark, sf_dir).select("doc_id", F.col("chunk_id").alias("id"), "text")


#: Words that carry weight, and pairs of neighbours among them, in the oracle.
GRAMS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in evaluation.STOP_WORDS) + "], w))"
PAIRS = "list_concat({0}, list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
BOUNDARY_SQL = f"""wc AS (SELECT source AS doc_id, doc_id AS page_num, {WORDS.format('text')} AS w FROM documents), cc AS (SELECT doc_id, page_num, unnest(range(0, len(w), 250)) AS s, w FROM wc WHERE len(w) > 0),
ch AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, s) - 1 AS id, w[s + 1 : s + 300] AS w FROM cc), ed AS (SELECT doc_id, id, w[-40:] AS a, lead(w[1:40]) OVER (PARTITION BY doc_id ORDER BY id) AS b FROM ch),
bt AS (SELECT doc_id, id, 0 AS side, unnest({GRAMS.format("array_to_string(a, ' ')")}) AS term FROM ed WHERE b IS NOT NULL UNION ALL SELECT doc_id, id, 1, unnest({GRAMS.format("array_to_string(b, ' ')")}) FROM ed WHERE b IS NOT NULL),
bp AS (SELECT doc_id, id, term, count(*) FILTER (side = 0) AS a, count(*) FILTER (side = 1) AS b FROM bt GROUP BY ALL), bw AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN 1 ELSE ln(1.5) + 1 END AS i FROM bp),
bs AS (SELECT doc_id, id, sum(a * b * i * i) / nullif(sqrt(sum(a * a * i * i)) * sqrt(sum(b * b * i * i)), 0) AS v FROM bw GROUP BY ALL),
boundary AS (SELECT ed.doc_id, ed.id, coalesce(v, 0) AS similarity FROM ed LEFT JOIN bs ON ed.doc_id = bs.doc_id AND ed.id = bs.id WHERE ed.b IS NOT NULL)"""
COHERENCE_SQL = f"""se AS (SELECT doc_id AS chunk, list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 30) AS l FROM documents), st AS (SELECT chunk, len(l) AS n, generate_subscripts(l, 1) AS id, unnest(l) AS text FROM se WHERE len(l) >= 2),
sg AS (SELECT chunk, n, id, unnest({GRAMS.format('text')}) AS term FROM st), sc AS (SELECT chunk, n, id, term, count(*) AS tf FROM sg GROUP BY ALL), sw AS (SELECT chunk, n, id, term, tf * (ln((1 + n) / (1 + count(*) OVER (PARTITION BY chunk, term))) + 1) AS w FROM sc),
su AS (SELECT chunk, id, term, w / sqrt(sum(w * w) OVER (PARTITION BY chunk, id)) AS w FROM sw), sq AS (SELECT chunk, sum(w) AS w, sum(w * w) AS own FROM su GROUP BY chunk, term), sv AS (SELECT chunk, sum(w * w) - sum(own) AS v FROM sq GROUP BY chunk),
coherence AS (SELECT se.chunk AS id, coalesce(v, 0) / (len(l) * (len(l) - 1)) AS coherence FROM se LEFT JOIN sv ON se.chunk = sv.chunk WHERE len(l) >= 2)"""
RETRIEVED_SQL = f"""rg AS (SELECT doc_id AS id, {GRAMS.format('text')} AS g, {GRAMS.format(f"array_to_string({WORDS.format('text')}[1:15], ' ')")} AS h FROM documents), rt AS (SELECT id, unnest({PAIRS.format('g')}) AS term FROM rg), rc AS (SELECT id, term, count(*) AS tf FROM rt GROUP BY ALL),
rd AS (SELECT term, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS i FROM rc GROUP BY term HAVING count(*) >= 2), rw AS (SELECT id, term, tf * i AS w, i FROM rc JOIN rd USING (term)),
ru AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w, i FROM rw), rq AS (SELECT id AS q, term, count(*) AS tf FROM (SELECT id, unnest({PAIRS.format('h')}) AS term FROM rg) GROUP BY ALL),
rs AS (SELECT q, id, round(sum(tf * i * w), 9) AS s FROM rq JOIN ru USING (term) GROUP BY ALL), rb AS (SELECT q, arg_max(id, (s, -id)) AS found FROM rs GROUP BY q),
retrieved AS (SELECT doc_id AS id, coalesce(found, (SELECT min(doc_id) FROM documents)) AS found FROM documents LEFT JOIN rb ON q = doc_id)"""


@query(f"WITH {BOUNDARY_SQL} SELECT doc_id, id, round(similarity, 9) AS similarity FROM boundary")
def boundary_integrity(spark, sf_dir):
    return evaluation.boundary_integrity(chunked(spark, sf_dir)).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {COHERENCE_SQL} SELECT id, round(coherence, 9) AS coherence FROM coherence")
def intra_chunk_coherence(spark, sf_dir):
    return evaluation.intra_chunk_coherence(I.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).withColumn("coherence", F.round("coherence", 9))


@query(f"WITH {RETRIEVED_SQL} SELECT * FROM retrieved")
def self_retrieval(spark, sf_dir):
    return evaluation.self_retrieval(I.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query(f"""WITH {COHERENCE_SQL}, {RETRIEVED_SQL}, ed AS (SELECT source AS doc_id, doc_id AS id, {WORDS.format('text')}[-40:] AS a, lead({WORDS.format('text')}[1:40]) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
{BOUNDARY_SQL[BOUNDARY_SQL.index('bt AS'):]}, n AS (SELECT len({WORDS.format('text')}) AS n FROM documents)
SELECT count(*) AS num_chunks, round(avg(n), 6) AS avg_size, round(stddev_pop(n), 6) AS std_size, min(n) AS min_size, max(n) AS max_size, round((SELECT avg(coherence) FROM coherence), 6) AS coherence,
round((SELECT avg(similarity) FROM boundary), 6) AS boundary, round((SELECT avg(CASE WHEN id = found THEN 1.0 ELSE 0.0 END) FROM retrieved), 6) AS retrieval FROM n""")
def chunk_report(spark, sf_dir):
    return evaluation.report(I.read(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), "text"))


RESULT = "CAST(doc_id AS STRING) AS question, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE CAST(quality AS DOUBLE) END AS faithfulness, CASE WHEN doc_id % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(toxic AS DOUBLE) END AS answer_relevancy, CAST(quality + toxic AS DOUBLE) AS context_precision, CAST(doc_id % 3 AS DOUBLE) AS context_recall"
COMPLETE = "faithfulness IS NOT NULL AND NOT isnan(answer_relevancy)"


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, depth, last = [], 0, 0
    for k, ch in enumerate(RESULT):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and not depth:
            parts.append(RESULT[last:k])
            last = k + 1
    return I.read(spark, sf_dir, "labels").selectExpr(*parts, RESULT[last:])


@query(f"WITH r AS (SELECT {RESULT} FROM labels) SELECT CAST(doc_id AS STRING) AS question FROM documents WHERE CAST(doc_id AS STRING) NOT IN (SELECT question FROM r WHERE {COMPLETE})")
def eval_pending(spark, sf_dir):
    asked = I.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("question"))
    return evaluation.pending(asked, results(spark, sf_dir))


@query(f"WITH r AS (SELECT {RESULT} FROM labels), n AS (SELECT question, 1.0::DOUBLE AS faithfulness, 1.0::DOUBLE AS answer_relevancy, 1.0::DOUBLE AS context_precision, 1.0::DOUBLE AS context_recall FROM r WHERE NOT ({COMPLETE})) SELECT * FROM r WHERE {COMPLETE} UNION ALL SELECT * FROM n")
def eval_upsert(spark, sf_dir):
    rows = results(spark, sf_dir)
    new = evaluation.pending(rows.select("question"), rows).select("question", *[F.lit(1.0).alias(m) for m in evaluation.METRICS])
    return evaluation.upsert(rows, new)


@query(f"""WITH r AS (SELECT {RESULT} FROM labels) SELECT round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevancy) FILTER (NOT isnan(answer_relevancy)), 6) AS answer_relevancy,
round(avg(context_precision), 6) AS context_precision, round(avg(context_recall), 6) AS context_recall, count(*) FILTER ({COMPLETE}) AS complete, count(*) AS rows FROM r""")
def eval_means(spark, sf_dir):
    return evaluation.metric_means(results(spark, sf_dir))


@query("""WITH j AS (SELECT CAST(conv_id AS STRING) AS question, turn + 1 AS rank, CASE WHEN (conv_id + turn) % 3 <> 0 THEN 1 ELSE 0 END AS hit FROM conversations),
h AS (SELECT *, sum(hit) OVER (PARTITION BY question ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits FROM j)
SELECT question, round(coalesce(sum(hit * hits / rank) / nullif(sum(hit), 0), 0), 9) AS context_precision FROM h GROUP BY question""")
def ranked_precision(spark, sf_dir):
    rows = I.read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("question"), (F.col("turn") + 1).alias("rank"), ((F.col("conv_id") + F.col("turn")) % 3 != 0).alias("relevant"))
    return evaluation.context_precision(rows)


# --- layout ---


#: Lines of a made-up page.
PER_SHEET = 12


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of the derived pages with made-up places: headings larger, notes small at the foot, every ninth document landscape.

    A text goes on over as many pages as its lines fill. Its first page has a line on the margin and one in a table.
    """
    texts = I.derived(spark, sf_dir).select("doc_id", "page_num", "row_id", T.lines(F.col("text")).alias("l"))
    sheets = F.ceil(F.greatest(F.size("l"), F.lit(0)) / PER_SHEET)
    # the sum stands before the lines are dealt out, as it would run over them otherwise
    summed = places.running(texts.withColumn("sheets", sheets), "doc_id", F.floor(F.col("page_num") / 1024), "page_num", F.col("sheets"), "upto")
    rows = summed.select("doc_id", (F.col("upto") - F.col("sheets")).alias("before"), "row_id", F.posexplode("l").alias("k", "line"))
    rows = rows.select("doc_id", (F.col("before") + F.floor(F.col("k") / PER_SHEET) + 1).cast("int").alias("page_num"), "row_id", (F.col("k") < PER_SHEET).alias("opens"), (F.col("k") % PER_SHEET).alias("line_no"), "line")
    head, foot = F.col("line_no") == 1, F.col("line_no") >= 10
    span = F.struct(F.col("line").alias("text"), F.when(head, 14.0).when(foot, 8.0).otherwise(11.04).alias("size"), F.when(F.col("line_no") == 3, 255).otherwise(0).alias("color"))
    grid = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(295.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(310.0).alias("y1")))
    return rows.select(
        "doc_id", "page_num", (F.when(F.col("row_id") % 9 == 0, 900.0).otherwise(600.0)).alias("page_w"), F.lit(800.0).alias("page_h"), F.col("line_no").alias("block_no"), "line_no",
        F.when(F.col("opens") & (F.col("line_no") == 4), 590.0).otherwise(100.0).alias("x0"), (F.col("line_no") * 60.0).alias("y0"), F.lit(500.0).alias("x1"), (F.col("line_no") * 60.0 + 12).alias("y1"), (F.col("line_no") * 60.0).alias("ly"),
        F.array(span).alias("spans"), F.when(F.col("opens"), grid).otherwise(F.slice(grid, 1, 0)).alias("tables"),
        F.array(F.struct(F.lit(590.0).alias("y0"), F.lit(1.0).alias("height"), F.lit(200.0).alias("width"))).alias("drawings"),
    )


@query()
def layout_pages(spark, sf_dir):
    return layout.read_pages(layout_lines(spark, sf_dir))


@query(f"""WITH {LINE_ROWS}, z AS (SELECT row_id, line_no, line, CASE WHEN line_no % 9 = 0 THEN 14.0 ELSE 11.0 END AS size, line_no % 4 = 0 AS bold FROM e),
o AS (SELECT *, (size > 11.5 AND length(line) < 150 AND (regexp_matches(line, '^\\d+(\\.\\d+)*\\s+') OR NOT regexp_matches(trim(line), '[.:;]$'))) OR (length(line) < 100 AND (regexp_matches(line, '^\\d+(\\.\\d+)*\\s+') OR (bold AND regexp_matches(line, '^[A-ZÀ-Ü\\s-]{{4,}}$')))) AS opens FROM z),
i AS (SELECT *, sum(opens::INT) OVER (PARTITION BY row_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM o),
g AS (SELECT row_id AS doc_id, island, max(line) FILTER (opens) AS title, string_agg(line, ' ' ORDER BY line_no) FILTER (NOT opens) AS text FROM i GROUP BY ALL HAVING count(*) FILTER (NOT opens) > 0),
s AS (SELECT doc_id, island, title, {STRIPPED} AS text FROM g)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY island) - 1 AS INTEGER) AS section_no, coalesce(title, 'Introduction/Preamble') AS title,
array_to_string(list_filter(list_transform({LINES}, lambda x: CASE WHEN starts_with(x, '###SEC###') THEN x ELSE trim(regexp_replace(x, '\\s+', ' ', 'g')) END), lambda x: x <> ''), chr(10)) AS text, 1 AS page_num FROM s""")
def header_sections(spark, sf_dir):
    n = F.col("line_no")
    lines = line_rows(spark, sf_dir).select(F.col("row_id").alias("doc_id"), F.lit(1).alias("page_num"), "line_no", F.col("line").alias("text"), F.when(n % 9 == 0, 14.0).otherwise(11.0).alias("size"), (n % 4 == 0).alias("is_bold"), F.lit(11.0).alias("body_size"))
    return layout.sections_by_headers(lines)


@query()
def layout_captions(spark, sf_dir):
    return layout.captions(layout_lines(spark, sf_dir))


@query(f"""WITH {LINE_ROWS}, l AS (SELECT row_id AS doc_id, line_no, line, sum(CASE WHEN regexp_matches(line, '^\\s*(\\(?\\d+\\)?|[*†‡])[\\.\\)\\s]\\s*[A-ZÀ-Úa-z]') THEN 1 ELSE 0 END) OVER (PARTITION BY row_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS note FROM e),
g AS (SELECT doc_id, note, string_agg(line, ' ' ORDER BY line_no) AS text FROM l WHERE note > 0 GROUP BY ALL) SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY note) AS footnotes FROM g GROUP BY doc_id""")
def footnote_notes(spark, sf_dir):
    rows = line_rows(spark, sf_dir).select(F.col("row_id").alias("doc_id"), F.lit(0).alias("block_no"), "line_no", F.col("line_no").alias("ly"), F.col("line").alias("full"))
    return layout.assemble_notes(rows, ("doc_id",))

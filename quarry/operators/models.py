"""Stages that stand for models and services: parsers, embedders, describers, generators, judges.

Each is a function on lists of texts or bytes, loaded once for a worker and run over Arrow
batches. The stand-ins here need no network and give the same result at every run.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import pages as P
from quarry.operators import sections as S
from quarry.profiles import LAYOUT, Profile
from quarry.session import saved

_LOADED: dict = {}


def loaded(maker: Callable) -> object:
    """The model of a maker, one in a process."""
    if maker not in _LOADED:
        _LOADED[maker] = maker()
    return _LOADED[maker]


def hashing_embedder(dimension: int = 64) -> Callable[[list[str]], list[tuple[list[float], dict[str, float]]]]:
    """Stand-in for an encoder: hashed words, of unit length, and their weights."""

    def run(texts: list[str]) -> list[tuple[list[float], dict[str, float]]]:
        out = []
        for text in texts:
            dense, sparse = np.zeros(dimension), {}
            for w in text.lower().split():
                h = zlib.crc32(w.encode())
                dense[h % dimension] += 1 if h >> 16 & 1 else -1
                sparse[str(h)] = sparse.get(str(h), 0.0) + 1.0
            n = float(np.linalg.norm(dense)) or 1.0
            out.append(((dense / n).tolist(), {k: v / len(sparse) for k, v in sparse.items()}))
        return out

    return run


def embed(chunks: DataFrame, text: Column, maker: Callable = hashing_embedder) -> DataFrame:
    """chunks with embedding_dense and embedding_sparse of a text."""

    @F.pandas_udf("struct<dense:array<float>,sparse:map<string,double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loaded(maker)
        for batch in batches:
            found = model(batch.fillna("").tolist())
            yield pd.DataFrame({"dense": [d for d, _ in found], "sparse": [s for _, s in found]})

    return chunks.withColumn("_e", run(text)).select("*", F.col("_e.dense").alias("embedding_dense"), F.col("_e.sparse").alias("embedding_sparse")).drop("_e")


VECTORS = "array<struct<dense:array<float>,sparse:map<string,double>>>"


def embed_documents(documents: DataFrame, profile: Profile = LAYOUT, maker: Callable = hashing_embedder) -> DataFrame:
    """Documents (chunks: array of structs with text, section, type and perhaps caption) with embedding_dense and embedding_sparse in every chunk.

    The layout profile leaves documents without chunks out; the others keep them as they are. Nothing is shuffled.
    """
    from quarry.functions import text as T

    fields = documents.schema["chunks"].dataType.elementType.names
    get = lambda c, f: c[f] if f in fields else F.lit(None).cast("string")

    @F.pandas_udf(VECTORS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(maker)
        for batch in batches:
            yield batch.map(lambda texts: [{"dense": d, "sparse": s} for d, s in model([t or "" for t in texts])])

    chunks = F.coalesce("chunks", F.array().cast(documents.schema["chunks"].dataType))
    rows = documents.withColumn("chunks", chunks)
    rows = rows.where(F.size("chunks") > 0) if profile.name == "layout" else rows
    texts = F.transform("chunks", lambda c: T.enriched(c["text"], get(c, "section"), F.coalesce(get(c, "type"), F.lit("body")), get(c, "caption"), profile.name))
    own = [f for f in fields if f not in ("embedding_dense", "embedding_sparse")]
    both = F.zip_with("chunks", "_v", lambda c, v: F.struct(*[c[f].alias(f) for f in own], v["dense"].alias("embedding_dense"), v["sparse"].alias("embedding_sparse")))
    return rows.withColumn("_v", run(texts)).withColumn("chunks", both).drop("_v")


def generate(prompts: Column, maker: Callable, attempts: int = 1, wait: float = 65.0) -> Column:
    """Struct of answer and error: what a service says to each prompt, or the message of what went wrong after so many attempts."""

    @F.pandas_udf("struct<answer:string,error:string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = with_retry(loaded(maker), attempts, wait)
        for batch in batches:
            rows = []
            for text in batch:
                try:
                    rows.append((call(text), None))
                except Exception as e:  # one question does not stop the others
                    rows.append((None, str(e)))
            yield pd.DataFrame(rows, columns=["answer", "error"], dtype=object)

    return run(prompts)


def parse(files: DataFrame, maker: Callable) -> DataFrame:
    """Files (filename, content) -> doc_id, page_num (from 1), text, error. A file that fails gives one row with the error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = loaded(maker)
        for batch in batches:
            rows = []
            for name, content in zip(batch["filename"], batch["content"]):
                try:
                    rows += [(name, k + 1, t, None) for k, t in enumerate(parser(content))]
                except Exception as e:  # one file does not stop the others
                    rows.append((name, None, None, str(e)))
            yield pd.DataFrame({"doc_id": [r[0] for r in rows], "page_num": pd.array([r[1] for r in rows], "Int32"), "text": [r[2] for r in rows], "error": [r[3] for r in rows]})

    return files.select("filename", "content").mapInPandas(run, "doc_id string, page_num int, text string, error string")


def ocr_pages(texts: DataFrame) -> DataFrame:
    """doc_id, text of recognised pages under '# PAGE n' marks -> pages. The part before the first mark counts as page 1, so pages are one off, as the stored documents have it."""
    from quarry.functions import text as T

    out = texts.select("doc_id", F.posexplode(F.split("text", "\n# PAGE", -1)).alias("k", "text"))
    return out.select("doc_id", (F.col("k") + 1).alias("page_num"), T.clean_ocr(F.col("text")).alias("text")).where("text != ''")


def describe(images: DataFrame, pages: DataFrame, maker: Callable) -> DataFrame:
    """Figure chunks of images (doc_id, page_num, image_no, path, caption, width, height), described from the caption or the start of the page."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = loaded(maker)
        for batch in batches:
            yield pd.Series(model(batch.tolist()), dtype=object)

    rows = images.join(pages.select("doc_id", "page_num", F.col("text").alias("_page")), ["doc_id", "page_num"], "left")
    hint = F.when(F.coalesce("caption", F.lit("")) != "", F.col("caption")).otherwise(F.substring(F.coalesce("_page", F.lit("")), 1, 1000))
    return rows.select(
        "doc_id", F.concat(F.lit("img_"), "image_no").alias("chunk_id"), F.lit("Extracted Figure").alias("section"), run(hint).alias("text"), "caption", F.col("path").alias("image_path"), "page_num",
        F.concat_ws("x", "width", "height").alias("image_size"), F.lit("figure").alias("type"),
    )


def with_retry(call: Callable, attempts: int = 5, wait: float = 65.0, sleep: Callable = time.sleep) -> Callable:
    """call, tried again after a wait where it fails; the last failure is raised."""

    def run(*args, **kwargs):
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception:
                if k + 1 == attempts:
                    raise
                sleep(wait)

    return run


def judge_overlap(rows: list[tuple[str, str, list[str], str]]) -> list[dict[str, float]]:
    """Stand-in for a judge: shares of words that question, answer, contexts and truth have in common."""
    bag = lambda t: set(t.lower().split())
    share = lambda a, b: len(a & b) / len(a) if a else 0.0
    out = []
    for question, answer, contexts, truth in rows:
        c = set().union(*map(bag, contexts)) if contexts else set()
        hits = [share(bag(truth), bag(x)) > 0.3 for x in contexts]
        precision = sum(sum(hits[: k + 1]) / (k + 1) for k, h in enumerate(hits) if h) / max(1, sum(hits))
        out.append({"faithfulness": share(bag(answer), c), "answer_relevancy": share(bag(question), bag(answer)), "context_precision": precision, "context_recall": share(bag(truth), c)})
    return out


def cleaned(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Pages of documents, classified, filtered by kind and normalised; further columns are kept."""
    from quarry.functions import text as T

    rows = P.filtered(pages.where("doc_id is not null"), P.classify(pages, profile), profile)
    if profile.name == "layout":
        clean = P.strip_repeated_lines(rows.select(*pages.columns), profile)
        clean = clean.withColumn("text", T.normalize_layout(F.col("text")))
    else:
        body = P.strip_repeated_lines(rows.where("document_type != 'scanned'").select(*pages.columns), profile)
        clean = body.unionByName(rows.where("document_type = 'scanned'").select(*pages.columns)).withColumn("text", T.normalize_markdown(F.col("text")))
    return saved(clean, "clean")


def process(pages: DataFrame, profile: Profile = LAYOUT) -> DataFrame:
    """Pages of documents -> their body chunks: classify, filter pages by kind, normalise, cut into sections and chunks, in one plan."""
    return S.chunk_sections(S.split_sections(cleaned(pages, profile), profile), profile)


#: Chunks of a row of process_documents; a document of more has several rows, as a row is bounded at 2 GB.
ROW_CHUNKS = 50_000


def _listed(rows: DataFrame, order: list, name: str, row: Column | None = None) -> DataFrame:
    """doc_id, _row and the other columns of its rows as one array."""
    fields = [c for c in rows.columns if c != "doc_id"]
    sorted_ = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("k"), F.struct(*fields).alias("v"))))
    return rows.withColumn("_row", F.lit(0) if row is None else row.cast("int")).groupBy("doc_id", "_row").agg(F.transform(sorted_, lambda x: x["v"]).alias(name))


def process_documents(pages: DataFrame, files: DataFrame, profile: Profile = LAYOUT, figures: DataFrame | None = None) -> DataFrame:
    """Pages (doc_id, page_num, text, footnotes) and files -> one row a document: doc_id, metadata, document_type, chunks, footnote_chunks, image_chunks.

    Notes are those of the pages that the filters keep. figures are rows as describe() gives them.
    A document of more than ROW_CHUNKS chunks has a row for each so many, by ascending chunk_id,
    with the same metadata; its notes and figures stand in the first.
    """
    from quarry.sources import store

    clean = cleaned(pages, profile)
    chunks = S.chunk_sections(S.split_sections(clean, profile), profile)
    body = _listed(chunks, ["chunk_id"], "chunks", F.floor(F.col("chunk_id") / ROW_CHUNKS))
    note = F.when(F.trim(F.coalesce("footnotes", F.lit(""))) != "", F.struct("page_num", F.trim("footnotes").alias("t")))
    notes = clean.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(note)), lambda x: x["t"]), "\n\n").alias("footnotes"))
    rows = S.footnote_chunks(notes, profile)
    rows = _listed(rows, [F.split("chunk_id", "_")[1].cast("int"), F.coalesce(F.get(F.split("chunk_id", "_"), F.lit(2)).cast("int"), F.lit(0))], "footnote_chunks")
    meta = store.metadata_of(pages, files)
    out = meta.select("doc_id", F.struct(*[c for c in meta.columns if c != "doc_id"]).alias("metadata")).join(P.classify(pages, profile).select("doc_id", "document_type"), "doc_id")
    most = chunks.groupBy("doc_id").agg(F.max("chunk_id").alias("_most"))
    out = out.join(most, "doc_id", "left").withColumn("_row", F.explode(F.sequence(F.lit(0), F.floor(F.coalesce("_most", F.lit(0)) / ROW_CHUNKS).cast("int")))).drop("_most")
    parts = [body, rows] + ([_listed(figures, ["page_num", "chunk_id"], "image_chunks")] if figures is not None else [])
    for part in parts:
        name = part.columns[2]
        out = out.join(part, ["doc_id", "_row"], "left").withColumn(name, F.coalesce(name, F.array().cast(part.schema[name].dataType)))
    return out.drop("_row")

"""Contexts, prompts, citations, figures and chat history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import models, retrieval

CITATION = r"(?iU)\[([^,\]]+),\s*Page\s+\d+\]"


def context_block(number: Column, title: Column, source: Column, page: Column, text: Column, doi: Column | None = None) -> Column:
    """A numbered source: the title, or else the file's name, its page, the DOI where there is one, and the text."""
    name = F.when(F.coalesce(title, F.lit("")) != "", title).otherwise(T.source_name(source))
    link = F.when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("\nDOI: "), T.doi_link(doi))).otherwise(F.lit("")) if doi is not None else F.lit("")
    return F.concat(F.lit("[Source "), number, F.lit("] "), name, F.lit(", Page "), page, link, F.lit("\n"), text)


def contexts(hits: DataFrame) -> DataFrame:
    """query_id, rank, title, source_file, page_num, text, doi -> query_id, context: the blocks in rank order."""
    block = context_block(F.col("rank"), F.col("title"), F.col("source_file"), F.col("page_num"), F.col("text"), F.col("doi"))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("context"))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the sources only and cite them as [Name, Page n].\n\n"), context, F.lit("\n\nQuestion: "), question)


def error_message(message: Column) -> Column:
    """What a user is told of a failed call."""
    low = F.lower(message)
    has = lambda *terms: T.contains_any(low, terms)
    return F.when(has("429", "quota"), "quota exceeded").when(has("503"), "service unavailable").when(has("404"), "model not found").otherwise("unexpected error")


def answered(questions: DataFrame, maker: Callable, attempts: int = 1, wait: float = 65.0) -> DataFrame:
    """query_id, question, context -> with answer, or, where the call fails, what a user is told of it."""
    rows = questions.withColumn("_r", models.generate(prompt(F.col("question"), F.col("context")), maker, attempts, wait))
    return rows.withColumn("answer", F.when(F.col("_r.error").isNull(), F.col("_r.answer")).otherwise(error_message(F.col("_r.error")))).drop("_r")


def expanded(questions: DataFrame, maker: Callable) -> DataFrame:
    """query_id, question -> with search_query: the keywords a service names, or the question where it fails or names none."""
    rows = questions.withColumn("_r", models.generate(F.col("question"), maker))
    return rows.withColumn("search_query", search_query(F.col("question"), F.col("_r.answer"))).drop("_r")


def answer_question(chunks: DataFrame, question: str, maker: Callable, encode: Callable, k: int = 4) -> str | None:
    """The answer to one question from the k nearest chunks; None for a blank question or where there are no chunks."""
    if not question.strip():
        return None
    vector = encode()([question])[0][0]
    near = retrieval.dense(chunks, vector, k)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("distance", "id"))  # k rows
    hits = near.withColumn("rank", place).join(chunks.drop("embedding"), "id").withColumn("query_id", F.lit(0))
    asked = contexts(hits).withColumn("question", F.lit(question))
    found = answered(asked, maker).select("answer").first()
    return found[0] if found else None


def search_query(question: Column, expanded: Column) -> Column:
    """The expanded keywords, or the question itself."""
    return F.coalesce(F.nullif(T.strip(expanded), F.lit("")), question)


def cited_sources(answer: Column) -> Column:
    """Distinct names in [Name, Page n]."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(CITATION), F.lit(1)), T.strip))


def matches(source: Column, title: Column, cited: Column) -> Column:
    """Whether a cited name and the file's name or the title hold one another; an empty title matches nothing."""
    name, head = F.lower(T.source_name(source, spaced=True)), F.lower(F.coalesce(title, F.lit("")))

    def one(c: Column) -> Column:
        c = F.lower(c)
        return F.contains(name, c) | F.contains(c, name) | ((head != "") & (F.contains(head, c) | F.contains(c, head)))

    return F.exists(cited, one)


def cited_figures(hits: DataFrame, answers: DataFrame) -> DataFrame:
    """The image rows of a query's context that its answer cites, or else the first of them."""
    images = hits.where("chunk_type = 'image' and image_path is not null").join(answers.select("query_id", cited_sources(F.col("answer")).alias("_cited")), "query_id")
    cited = images.where(matches(F.col("source_file"), F.col("title"), F.col("_cited"))).select("query_id", "rank", "source_file", "image_path")
    first = images.join(cited.select("query_id").distinct(), "query_id", "left_anti").groupBy("query_id").agg(F.min(F.struct("rank", "source_file", "image_path")).alias("f"))
    return cited.union(first.select("query_id", "f.rank", "f.source_file", "f.image_path"))


def append_turns(history: DataFrame, turns: DataFrame) -> DataFrame:
    """History with new turns; a turn that is there already stays as it was."""
    return history.unionByName(turns.join(history.select("conv_id", "turn"), ["conv_id", "turn"], "left_anti"))


def replay(history: DataFrame) -> DataFrame:
    """conv_id, turns, transcript in the order of turns."""
    line = F.concat("role", F.lit(": "), "text")
    return history.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("transcript"))

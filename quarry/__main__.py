"""One question to a chunk table: python -m quarry PATH [QUESTION].

The encoder and the service are stand-ins unless --models names a module with functions
`encoder` and `service`, each of which makes one.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import functions as F

from quarry.operators import answers, models
from quarry.session import local_session


def first_source():
    """Stand-in for a service: the sources it was given."""
    return lambda prompt: prompt.split("\n\n", 1)[1].rsplit("\n\nQuestion: ", 1)[0]


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("path", help="chunk table (Parquet)")
    parser.add_argument("question", nargs="?")
    parser.add_argument("--models", help="module with functions encoder and service")
    parser.add_argument("--top", type=int, default=4)
    args = parser.parse_args(argv)
    question = args.question if args.question is not None else input("Question: ")
    module = importlib.import_module(args.models) if args.models else None
    spark = local_session()
    table = spark.read.parquet(args.path)
    field = lambda name: F.coalesce(F.get_json_object("metadata", f"$.{name}"), F.lit(""))
    rows = table.select(F.concat_ws("/", "source_file", "chunk_id").alias("id"), F.col("embedding_dense").alias("embedding"), "source_file", "text", "page_num", field("title").alias("title"), field("doi").alias("doi"))
    dimension = len((table.select("embedding_dense").first() or [[]])[0])
    encode = module.encoder if module else lambda: models.hashing_embedder(dimension)
    said = answers.answer_question(rows, question, module.service if module else first_source, encode, args.top)
    print(said if said is not None else "Nothing was found.")
    return 0 if said is not None else 1


if __name__ == "__main__":
    raise SystemExit(main())

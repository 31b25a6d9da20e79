"""Token files: frequency-ranked ids in byte-aligned variable-length coding.

A file holds the documents of a range of ids, ascending. Its ids are replaced by their rank
in the file's own frequencies, so frequent ids take one byte. A rank takes 1 to 4 bytes,
little-endian; its two control bits stand apart, four to a control byte, so that a reader
can look up, for a whole control byte at once, how long its four codes are and where they
begin, and gathers the bytes of all codes with numpy.

    magic "QTF1", then little-endian 32-bit: documents, ranked ids, codes (64-bit), data bytes (64-bit)
    ranked ids: 32 bits each, most frequent first, ties by id
    document ids: 64 bits each; presence of an id: 8 bits each; tokens of each document: 32 bits each
    control bytes: a quarter of the codes, rounded up
    data bytes

Files are rows of a Parquet table with the number of the file, so that they are written
and committed by Spark on any store that it writes to, and a lost task leaves none behind.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.common import bounded, shared_dir, table, written
from quarry.llm.tokens import encoder

MAGIC = b"QTF1"
HEADER = struct.Struct("<4sIIQQ")
#: The id that ends a document.
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Ids of a file, about; a document is never cut.
FILE_IDS = 1_000_000
#: Ids below it are counted in an array.
MOST_COUNTED = 1 << 22
#: Lengths of the four codes of a control byte, and their sum.
_CODES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1
_SUM = _CODES.sum(1).astype(np.int64)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_file(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """One file of documents in the given order."""
    ids = np.concatenate([np.asarray(d, np.uint32) for d in docs]) if docs else np.empty(0, np.uint32)
    if len(ids) and int(ids.max()) < MOST_COUNTED:  # a vocabulary's ids are counted, others are sorted
        counts = np.bincount(ids)
        values = np.flatnonzero(counts)
        by = np.lexsort((values, -counts[values]))
        rank = np.empty(len(counts), np.uint32)
        rank[values[by]] = np.arange(len(values), dtype=np.uint32)
        codes = rank[ids]
    else:
        values, where, counts = np.unique(ids, return_inverse=True, return_counts=True)
        by = np.lexsort((values, -counts))
        rank = np.empty(len(values), np.uint32)
        rank[by] = np.arange(len(values), dtype=np.uint32)
        codes = rank[where]
    size = 1 + (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    bits = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    bits[: len(codes)] = size - 1
    control = (bits.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    ends = np.cumsum(size, dtype=np.int64)
    data = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        more = np.flatnonzero(size > k)
        data[ends[more] - size[more] + k] = codes[more] >> np.uint32(8 * k) & np.uint32(0xFF)
    return b"".join((
        HEADER.pack(MAGIC, len(docs), len(values), len(codes), len(data)), values[by].astype("<u4").tobytes(),
        np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), np.array([d is not None for d in doc_ids], np.uint8).tobytes(),
        np.array([len(d) for d in docs], "<u4").tobytes(), control.tobytes(), data.tobytes(),
    ))


def read_file(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, tokens of each document, and all ids in a row."""
    magic, docs, values, codes, data = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, n, at)
        at += out.nbytes
        return out

    table_, ids, present, tokens = take("<u4", values), take("<i8", docs), take("u1", docs), take("<u4", docs)
    control, raw = take("u1", -(-codes // 4)), take("u1", data)
    size = _CODES[control].reshape(-1)[:codes].astype(np.int64)
    # where each control byte's codes begin, then where each code does
    base = np.cumsum(_SUM[control]) - _SUM[control]
    inner = np.cumsum(_CODES, axis=1, dtype=np.int64) - _CODES
    start = (base[:, None] + inner[control]).reshape(-1)[:codes]
    raw = np.concatenate((raw, np.zeros(4, np.uint8)))
    out = np.zeros(codes, np.uint32)
    for k in range(4):
        more = size > k
        out[more] |= raw[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    names = [i if p else None for i, p in zip(ids.tolist(), present.tolist())]
    return names, tokens.astype(np.int64), table_[out] if values else np.empty(0, np.uint32)


def write_files(docs: DataFrame, to: str, path: str | None = None, end: int = END, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as token files in ascending id order, null ids first; rows of one id by text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = encoder(path or tokenizer_path())
        names: list = []
        ids: list[np.ndarray] = []
        held = k = 0
        for batch in batches:
            for doc, has, x in zip(batch["id"].tolist(), batch["has"].tolist(), tok.ids(batch["text"].tolist())):
                names.append(doc if has else None)
                ids.append(np.append(x, np.uint32(end)))
                held += len(x) + 1
                if held >= FILE_IDS:
                    yield pd.DataFrame({"part": [int(batch["part"].iloc[0])], "k": [k], "docs": [len(names)], "tokens": [held], "content": [pack_file(names, ids)]})
                    names, ids, held, k = [], [], 0, k + 1
            part = int(batch["part"].iloc[0]) if len(batch) else 0
        tok.forget()
        if names:
            yield pd.DataFrame({"part": [part], "k": [k], "docs": [len(names)], "tokens": [held], "content": [pack_file(names, ids)]})

    bounded(docs.sparkSession)
    key = F.col(f"`{id_col}`").cast("long")
    rows = docs.select(key.alias("key"), F.coalesce(key, F.lit(0)).alias("id"), key.isNotNull().alias("has"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    # ids spread over range partitions; equal ids meet in one, and are few
    rows = (rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")).sortWithinPartitions("key", "text")
    rows = rows.select(F.spark_partition_id().alias("part"), "id", "has", "text")
    rows.mapInPandas(run, "part int, k int, docs long, tokens long, content binary").write.parquet(to)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (32-bit little-endian) of each document of the files."""
    bounded(spark)
    files = spark.read.parquet(path)
    # sums by partition of the files first: each is a bounded number of rows
    parts = files.groupBy("part").agg(F.sum("tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    sizes = files.select("part", "k", "tokens").join(before, "part")
    inner = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    starts = sizes.select("part", "k", (F.col("before") + F.sum("tokens").over(inner) - F.col("tokens")).alias("first"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, content in zip(batch["first"], batch["content"]):
                names, tokens, ids = read_file(content)
                ends = np.cumsum(tokens)
                bytes_ = ids.astype("<u4").tobytes()
                yield pd.DataFrame({
                    "id": [n or 0 for n in names], "has": [n is not None for n in names], "start": int(first) + ends - tokens, "n_tokens": tokens,
                    "ids": [bytes_[4 * (e - t) : 4 * e] for e, t in zip(ends.tolist(), tokens.tolist())],
                })

    # as a table of known size it is broadcast where that is small, and then no content is shuffled
    out = files.join(written(starts, "file-starts"), ["part", "k"]).select("first", "content").mapInPandas(run, "id long, has boolean, start long, n_tokens long, ids binary")
    return out.select(F.when(F.col("has"), F.col("id")).alias("doc_id"), "start", "n_tokens", "ids")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, size and checksum, as read back from its token file."""
    path = f"{shared_dir(spark)}/quarry/token-files-{uuid.uuid4().hex}"
    write_files(table(spark, sf_dir, "documents"), path)
    # worked out by Spark: a second Python stage would be a second worker a task, and take all ids once more
    return read_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op9_token_files": op9_token_files}
ORACLES: dict[str, str] = {}

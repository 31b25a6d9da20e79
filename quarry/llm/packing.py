"""Packing by first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids end with an id of their own and are cut into pieces of at most one
sequence. Full pieces are sequences by themselves. The last pieces of a group of documents
are placed in descending length, each into the first sequence with room for it. A
tournament tree over the room of the sequences holds in each node the most room below it,
so the first fit is found by one walk down the tree.

A group is chosen by a hash of the whole document, so it is as random as the hash and has
a bounded size; groups are packed independently. Copies of one document are spread over
groups by their number among equal rows of a task's batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded, table
from quarry.llm.tokens import encoder

LENGTH = 1024
#: The id that ends a document.
END = 0
#: Documents of a group, on average.
GROUP = 4096
#: Ids that a task holds before it passes them on.
YIELD_IDS = 1_000_000
TOKENIZER = "byte_bpe_50k.json"
#: Placed pieces, and those with a checksum in place of their ids.
PLACED = "doc_id long, start long, length long, ids binary, width int, doc_tokens long, sequence_id long, offset long"
DIGESTED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class RoomTree:
    """Room of sequences in the leaves, the most of both children in each node."""

    def __init__(self, length: int, leaves: int = 1):
        self.length, self.used = length, 0
        self.size = 1
        while self.size < leaves:
            self.size *= 2
        self.most = [length] * (2 * self.size)

    def first(self, need: int) -> int:
        """Place a piece into the first sequence with room for it; every new sequence has."""
        if self.most[1] < need:
            self._grow()
        at = 1
        while at < self.size:
            at *= 2
            if self.most[at] < need:
                at += 1
        self.most[at] -= need
        bin_ = at - self.size
        self.used = max(self.used, bin_ + 1)
        while at > 1:
            at //= 2
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])
        return bin_

    def _grow(self) -> None:
        old, size = self.most[self.size :], self.size * 2
        self.most = [0] * size + old + [self.length] * self.size
        self.size = size
        for at in range(size - 1, 0, -1):
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])


def first_fit_decreasing(lengths: list[int], length: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each piece; equal lengths keep their order."""
    tree, filled = RoomTree(length), []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        at = tree.first(lengths[k])
        while at >= len(filled):
            filled.append(0)
        out[k] = (at, filled[at])
        filled[at] += lengths[k]
    return out


def pieces(docs: DataFrame, path: str, groups: int, length: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, has_id, start, length, ids (little-endian 16 or 32 bits), width, doc_tokens and group of every piece."""

    def cut(rows: list[tuple[int, bool, int]], ids: list[np.ndarray], width: int) -> pa.RecordBatch:
        doc, has, group = zip(*rows)
        n = np.array([len(x) + 1 for x in ids], np.int64)
        ends = np.cumsum(n)
        flat = np.full(int(ends[-1]), end, f"<u{width}")
        own = np.ones(len(flat), bool)
        own[ends - 1] = False
        flat[own] = np.concatenate(ids)
        # the pieces follow each other in flat without a gap
        count = -(-n // length)
        of = np.repeat(np.arange(len(n)), count)
        start = (np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)) * length
        sizes = np.minimum(length, n[of] - start)
        at = (np.concatenate(([0], np.cumsum(sizes))) * width).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(of), [None, pa.py_buffer(at), pa.py_buffer(flat)])
        columns = [np.array(doc, np.int64)[of], np.array(has, bool)[of], start, sizes, data, np.full(len(of), width, np.int32), n[of], np.array(group, np.int64)[of]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "has_id", "start", "length", "ids", "width", "doc_tokens", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        width = 2 if max(tok.tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else 4
        seen: dict[int, int] = {}
        for batch in batches:
            doc_ids, present, texts, keys = (c.to_pylist() for c in batch.columns)
            rows, held, size = [], [], 0
            for doc, has, key, ids in zip(doc_ids, present, keys, tok.ids(texts)):
                seen[key] = n = seen.get(key, -1) + 1
                rows.append((doc, has, ((key + n * 0x9E3779B97F4A7C15) >> 11) % groups))
                held.append(ids)
                size += len(ids) + 1
                if size > YIELD_IDS:
                    yield cut(rows, held, width)
                    rows, held, size = [], [], 0
            if rows:
                yield cut(rows, held, width)
        tok.forget()

    rows = docs.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0)).alias("doc_id"), F.col(f"`{id_col}`").isNotNull().alias("has_id"), F.col(f"`{text_col}`").alias("text"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"),
    )
    return rows.mapInArrow(run, "doc_id long, has_id boolean, start long, length long, ids binary, width int, doc_tokens long, group long")


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end: int = END, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text", then: Callable[[pd.DataFrame], pd.DataFrame] | None = None, gives: str = PLACED) -> DataFrame:
    """Every piece with its place: doc_id, start, length, ids, width, doc_tokens, sequence_id, offset.

    ids are little-endian unsigned numbers of `width` bytes. Sequences hold at most `length`
    ids and are padded to it when they are read, except those that end at a power of two. A
    null or empty text is the end id alone. Repeated rows are packed as often as they stand;
    a null id stays null. An empty table gives no rows. then: what is made of the placed pieces
    of a group, rows with has_id too, in the task that placed them; gives: its schema without has_id.
    """
    if length < 1:
        raise ValueError("length must be positive")
    bounded(docs.sparkSession)
    groups = max(1, round(docs.count() / group))

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["has_id", "doc_id", "doc_tokens", "start", "ids"], kind="stable").reset_index(drop=True)
        full = (rows["length"] == length).to_numpy()
        sequence, offset = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        sequence[full] = np.arange(full.sum())
        placed = first_fit_decreasing(rows["length"][~full].tolist(), length)
        sequence[~full] = [int(full.sum()) + s for s, _ in placed]
        offset[~full] = [o for _, o in placed]
        placed_rows = rows.drop(columns="group").assign(sequence_id=(int(key[0]) << 32) + sequence, offset=offset)
        return then(placed_rows) if then else placed_rows

    found = pieces(docs, path or tokenizer_path(), groups, length, end, id_col, text_col)
    out = found.groupBy("group").applyInPandas(place, f"{gives}, has_id boolean")
    return out.withColumn("doc_id", F.when(F.col("has_id"), F.col("doc_id"))).drop("has_id")


def checksums(placed: pd.DataFrame) -> pd.DataFrame:
    """Placed pieces with ids_crc32, the checksum of ids as 32-bit numbers, in place of ids."""
    crc = [zlib.crc32(np.frombuffer(x, f"<u{w}").astype("<u4").tobytes()) for x, w in zip(placed["ids"], placed["width"])]
    return placed.drop(columns=["ids", "width"]).assign(ids_crc32=crc)


def digest(docs: DataFrame) -> DataFrame:
    """The packed pieces of documents with their checksums. Ids leave no task twice."""
    return pack(docs, then=checksums, gives=DIGESTED)


def op7_tournament_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its checksum and place."""
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op7_tournament_packing": op7_tournament_packing}
ORACLES: dict[str, str] = {}

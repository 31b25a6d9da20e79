"""N-gram Jaccard join by T-occurrence search.

A text's set is its distinct n-word shingles as 64-bit hashes. Texts with equal sets form a
class and are represented by one set. Two sets link when 100 * |both| >= percent * |either|.

Candidates. Inverted lists are built of all shingles of all classes; they travel as blocks,
four bytes a shingle. Shingles in one class only are dropped, and every class gets back its
shared ones with the lengths of their lists. A set of n shingles has to share
T = ceil(percent * n / 100) of them with any partner: a class with fewer shared ones has no
partner. The others keep their n - T + 1 shingles of the shortest lists: one of those is
shared with any partner. Each of these lists is cut where sizes are too far apart to link;
its smallest class is the centre, and gathers the list's sets into its bucket. Every pair
that shares a short list meets in a bucket, and no pair is written out.

Search. Sets are queries for T-occurrences: a query's longest lists are set aside, the
short ones are merged with a heap, and sets found there are probed by binary search in the
long lists (DivideSkip). The bucket's centre is the first query; as only what is connected
is asked for, sets that it finds need no query of their own, but every other set does. A bucket
beyond `BLOCK` sets or `BLOCK_BYTES` bytes is dealt into blocks; the centre is a query of
each, and each pair of blocks, but pairs of sets linked to the centre, is searched by a task
of its own. Nothing is capped.

Components. Links form components by min-label propagation with pointer jumping over
tables in the shared folder.

Classes are known by 64 bits of a hash of their set. Two of n classes share a name with a
chance of about n * n / 4e19: one in 400,000 at ten million classes.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded, free_name, table, written

WORDS = 5
PERCENT = 80
#: Entries of inverted lists that one task gathers, on average (about 40 bytes each). The list of one shingle is not split.
ENTRIES = 2_000_000
#: Shingles that a task holds before it passes them on as blocks.
HELD = 2_000_000
#: Sets that one task searches against each other, and bytes of their shingles.
BLOCK, BLOCK_BYTES = 512, 2 << 20
#: Stands for a missing id where rows pass through pandas; the least of all numbers can be no id itself.
NO_ID = -(1 << 63)
#: Bytes of text that are hashed at once, about 50 bytes each; words beyond LONG_WORD bytes have a hash of another kind.
CHUNK, LONG_WORD = 1 << 19, 1 << 16

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_GAPS = [bytes([c]) for c in (32, *range(9, 14))]
_GAP = re.compile(b"[" + b"".join(_GAPS) + b"]")
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD[0])


def _places(n: int, kept: list[np.ndarray] = [np.empty(0, np.uint64)]) -> np.ndarray:
    """Odd factors of the places in a word, as many as asked for."""
    if len(kept[0]) < n:
        kept[0] = _mix(np.arange(1, max(n, 64) * 2, dtype=np.uint64) * _ODD[1]) | np.uint64(1)
    return kept[0]


def _long_hash(word: bytes) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), "<u8")


def _word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of bytes that end with a space: the sum of a number for each byte times one for its place."""
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.empty(0, np.uint64), starts
    ends = np.flatnonzero(space & np.concatenate(([False], ~space[:-1])))
    sizes = ends - starts
    inside = np.flatnonzero(~space)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(first, sizes)
    h = np.add.reduceat(_BYTES[raw[inside]] * _places(int(sizes.max()))[place], first)
    h = _mix(h ^ (sizes.astype(np.uint64) * _ODD[2]))
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        h[k] = _long_hash(raw[starts[k] : ends[k]].tobytes())[0]
    return h, starts


def _combined(h: np.ndarray, words: int) -> np.ndarray:
    """A hash of every `words` word hashes in a row."""
    n = max(0, len(h) - words + 1)
    whole = np.full(n, words, np.uint64)
    for i in range(words):
        whole = (whole ^ h[i : i + n]) * _ODD[i % 8]
        whole ^= whole >> np.uint64(29)
    return _mix(whole)


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of a text that is hashed piece by piece, cut at white space."""
    out, at = [], 0
    while at < len(text):
        m = _GAP.search(text, at + CHUNK)
        end = m.start() if m else len(text)
        if end - at > CHUNK + LONG_WORD:  # the word at the end of the piece is a long one
            begin = max(at, 1 + max(text.rfind(c, at, at + CHUNK) for c in _GAPS))
            out.append(_word_hashes(np.frombuffer(text[at:begin] + b" ", np.uint8))[0])
            out.append(_long_hash(text[begin:end]))
        else:
            out.append(_word_hashes(np.frombuffer(text[at:end] + b" ", np.uint8))[0])
        at = end
    return np.concatenate(out)


def _chunk(texts: list[bytes], words: int) -> list[np.ndarray]:
    """Shingles of each text, not yet distinct."""
    if len(texts) == 1 and len(texts[0]) > 2 * CHUNK:
        h = _long_words(texts[0])
        word_ends = np.array([len(h)])
    else:
        h, starts = _word_hashes(np.frombuffer(b" ".join(texts) + b" ", np.uint8))
        word_ends = np.searchsorted(starts, np.cumsum([len(t) + 1 for t in texts]))
    whole = _combined(h, words)
    out, a = [], 0
    for b in word_ends.tolist():
        if b - a >= words:
            out.append(whole[a : b - words + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for i in range(b - a):
                one = (one ^ h[a + i]) * _ODD[i % 8]
                one ^= one >> np.uint64(29)
            out.append(_mix(one))
        else:
            out.append(np.empty(0, np.uint64))
        a = b
    return out


def shingles(texts: list[bytes | None], words: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each whole text, ascending; fewer words than n are one shingle, none are none."""

    def done(some: list[bytes]) -> Iterator[np.ndarray]:
        for x in _chunk(some, words):
            x = np.sort(x)
            yield x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x

    held, size = [], 0
    for text in texts:
        text = (text or b"").translate(_LOWER)
        if held and size + len(text) > CHUNK:
            yield from done(held)
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield from done(held)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def name_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _bytes(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def signatures(rows: DataFrame, words: int) -> DataFrame:
    """id, text -> id, name (of the class; null without shingles), n_shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(name_of(s) if len(s) else None, len(s)) for s in shingles(_bytes(batch, 1), words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["id", "name", "n_shingles"])

    found = rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text").mapInArrow(run, "id long, name long, n_shingles long")
    return found.withColumn("id", F.nullif("id", F.lit(NO_ID)))


def _dealt(key: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by part, and (part, start, end) of each that has rows."""
    part = (key % np.uint64(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[by], np.arange(parts + 1))
    return by, [(k, int(ends[k]), int(ends[k + 1])) for k in np.flatnonzero(np.diff(ends)).tolist()]


BLOCK_SCHEMA = "part int, tokens binary, owners binary, names binary, sizes binary, lengths binary, home int"
#: Bytes of a token in a block; the part that it is dealt to adds bits of its own.
TOKEN = 5


def _least(x: np.ndarray, kinds: tuple[str, ...]) -> bytes:
    """Whole numbers in the narrowest of the kinds that holds them all; the first byte is its width."""
    most = int(x.max()) if len(x) else 0
    kind = next(k for k in kinds if most < 1 << 8 * np.dtype(k).itemsize)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _widened(x: bytes) -> np.ndarray:
    return np.frombuffer(x, f"<u{x[0]}", offset=1).astype(np.int64)


def _cut(x: np.ndarray, width: int) -> bytes:
    """The lower `width` bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _uncut(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").reshape(-1)


def _block(part: int, tokens: np.ndarray, owners: np.ndarray, names: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, home: int) -> tuple:
    """A block of list entries: owners, ascending, are a count of entries by each of the block's own names."""
    own, local = np.unique(owners, return_inverse=True)
    per = np.bincount(local)
    return part, _cut(tokens, TOKEN), _least(per, ("<u1", "<u2", "<u4")), names[own].astype("<i8").tobytes(), _least(sizes[own], ("<u2", "<u4")), lengths.astype("<u2").tobytes(), home


def _unblock(blocks: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """tokens, names, sizes, lengths of every entry."""
    tokens = np.concatenate([_uncut(x, TOKEN) for x in blocks["tokens"]])
    per = np.concatenate([_widened(x) for x in blocks["owners"]])
    names = np.repeat(np.concatenate([np.frombuffer(x, "<i8") for x in blocks["names"]]), per)
    sizes = np.repeat(np.concatenate([_widened(x) for x in blocks["sizes"]]), per)
    return tokens, names, sizes, np.concatenate([np.frombuffer(x, "<u2") for x in blocks["lengths"]])


def sharing_classes(rows: DataFrame, words: int, percent: int, parts: int) -> DataFrame:
    """id, text -> name, n, shared, data, short: each class that shares as many shingles as any link takes.

    shared: how many those are; data: the shared shingles, 48 bits each; short: those of them in its short lists.
    """

    none = np.empty(0, np.uint16)

    def blocks_of(sets: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets])
        token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        by, dealt = _dealt(token, parts)
        token, owner, names = (token >> np.uint64(64 - 8 * TOKEN))[by], owner[by], np.array(names, np.int64)
        return pa.RecordBatch.from_pandas(pd.DataFrame([_block(k, token[a:b], owner[a:b], names, sizes, none, 0) for k, a, b in dealt], columns=BLOCK_COLUMNS), _BLOCK_ARROW, preserve_index=False)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sets, names, held = set(), [], [], 0
        for batch in batches:
            for s in shingles(_bytes(batch, 0), words):
                if len(s) and (name := name_of(s)) not in seen:
                    seen.add(name)
                    sets.append(s)
                    names.append(name)
                    held += len(s)
                    if held >= HELD:
                        yield blocks_of(sets, names)
                        sets, names, held = [], [], 0
        if sets:
            yield blocks_of(sets, names)

    def share(key: tuple, blocks: pd.DataFrame) -> pd.DataFrame:
        tokens, names, sizes, _ = _unblock(blocks)
        by = np.argsort(tokens, kind="stable")
        tokens = tokens[by]
        again = np.concatenate(([False], tokens[1:] == tokens[:-1]))
        again[:-1] |= again[1:]
        tokens, by = tokens[again], by[again]
        names, sizes = names[by], sizes[by]
        # copies of one class in several tasks are one entry
        by = np.lexsort((names, tokens))
        tokens, names, sizes = tokens[by], names[by], sizes[by]
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (names[1:] != names[:-1]))) if len(tokens) else np.empty(0, bool)
        tokens, names, sizes = tokens[new], names[new], sizes[new]
        starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.empty(0, np.int64)
        length = np.diff(np.append(starts, len(tokens)))
        each = np.repeat(length, length)
        tokens, names, sizes, each = tokens[each > 1], names[each > 1], sizes[each > 1], np.minimum(each[each > 1], 65535)
        by = np.argsort(names, kind="stable")
        tokens, names, sizes, each = tokens[by], names[by], sizes[by], each[by]
        owner = np.cumsum(np.concatenate(([False], names[1:] != names[:-1]))) if len(names) else np.empty(0, np.int64)
        first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(names) else np.empty(0, np.int64)
        by, dealt = _dealt(_mix(names.view(np.uint64)), parts)
        tokens, each, owner = tokens[by], each[by], owner[by]
        return pd.DataFrame([_block(k, tokens[a:b], owner[a:b], names[first], sizes[first], each[a:b], int(key[0])) for k, a, b in dealt], columns=BLOCK_COLUMNS)

    def choose(blocks: pd.DataFrame) -> pd.DataFrame:
        tokens, names, sizes, lengths = _unblock(blocks)
        home = np.repeat(blocks["home"].to_numpy(np.uint64), [len(x) // TOKEN for x in blocks["tokens"]])
        # of the shingle's 64 bits, its place among the parts and the 40 of its token are known
        whole = _mix((home << np.uint64(8 * TOKEN)) ^ tokens) & np.uint64((1 << 8 * DATA) - 1)
        by = np.lexsort((whole, lengths, names))
        names, sizes, whole = names[by], sizes[by], whole[by]
        starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        out = []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(names)]):
            n, shared = int(sizes[a]), b - a
            if shared >= least_overlap(n, percent):
                # the n - shared others come first in the order of lists, and nobody else is in theirs
                out.append((int(names[a]), n, shared, _cut(np.sort(whole[a:b]), DATA), _cut(whole[a : a + shared - least_overlap(n, percent) + 1], DATA)))
        return pd.DataFrame(out, columns=["name", "n", "shared", "data", "short"])

    entries = rows.select("text").mapInArrow(post, BLOCK_SCHEMA).groupBy("part").applyInPandas(share, BLOCK_SCHEMA)
    return entries.groupBy("part").applyInPandas(choose, "name long, n long, shared long, data binary, short binary")


BLOCK_COLUMNS = ["part", "tokens", "owners", "names", "sizes", "lengths", "home"]


_BLOCK_ARROW = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in BLOCK_COLUMNS[1:-1]), ("home", pa.int32())])
#: Bytes of a shared shingle in a set's data.
DATA = 6


def _whole(data: bytes) -> np.ndarray:
    return _uncut(data, DATA)


def short_lists(classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """name, n, short -> centre, name: the members of each centre's bucket, centres included."""

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sets = [_whole(x) for x in batch["short"]]
                token, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                by, dealt = _dealt(token, parts)
                token, owner, none = (token >> np.uint64(8 * (DATA - TOKEN)))[by], owner[by], np.empty(0, np.uint16)
                yield pd.DataFrame([_block(k, token[a:b], owner[a:b], batch["name"].to_numpy(), batch["n"].to_numpy(), none, 0) for k, a, b in dealt], columns=BLOCK_COLUMNS)

    def gather(blocks: pd.DataFrame) -> pd.DataFrame:
        tokens, names, sizes, _ = _unblock(blocks)
        by = np.lexsort((sizes, tokens))
        tokens, names, sizes = tokens[by], names[by], sizes[by].astype(np.int64)
        # a list is cut where the next set is too large for the one before
        start = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (sizes[1:] * percent > sizes[:-1] * 100)))
        starts = np.flatnonzero(start)
        length = np.diff(np.append(starts, len(tokens)))
        centre = np.repeat(np.minimum.reduceat(names, starts), length)
        some = np.repeat(length, length) > 1
        found = pd.DataFrame({"centre": centre[some], "name": names[some]}).drop_duplicates()
        return found

    return classes.select("name", "n", "short").mapInPandas(post, BLOCK_SCHEMA).groupBy("part").applyInPandas(gather, "centre long, name long").distinct()


def divide_skip(lists: list[list[int]], need, probes: int, skip) -> Iterator[int]:
    """Members that stand in at least need(member) of a query's lists.

    All but the `probes` shortest lists are long. The short lists are merged by a heap; a
    member that occurs there often enough to reach its need with every long list is probed
    in those by binary search. skip(member) leaves out what needs no answer.
    """
    lists = sorted(lists, key=len)
    short, long = lists[:probes], lists[probes:]
    for member, times in groupby(heapq.merge(*short)):
        if skip(member):
            continue
        wanted, count = need(member), sum(1 for _ in times)
        for left, one in zip(range(len(long), 0, -1), long):
            if count >= wanted or count + left < wanted:
                break
            at = bisect_left(one, member)
            count += at < len(one) and one[at] == member
        if count >= wanted:
            yield member


def _index(sets: list[np.ndarray]) -> dict[int, list[int]]:
    """Inverted lists, ascending, of what more than one set holds."""
    tokens, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    by = np.argsort(tokens, kind="stable")
    tokens, owners = tokens[by], owners[by]
    starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    ends = np.append(starts[1:], len(tokens))
    more = ends - starts > 1
    return {t: owners[a:b].tolist() for t, a, b in zip(tokens[starts[more]].tolist(), starts[more].tolist(), ends[more].tolist())}


def search(sets: list[np.ndarray], n: list[int], percent: int, centre: int | None = None, tied: list[bool] | None = None, left: list[bool] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is connected among the sets (ascending arrays).

    n: whole sizes; what sets lack of them nobody shares. The centre, if given, is the first
    query, and what it finds is tied. Tied sets are known to be connected with each other,
    so they are no queries. With left given, only pairs of a left and another set are asked
    for; tied sets are not left.
    """
    if not sets:
        return []
    index, parent = _index(sets), list(range(len(sets)))
    tied = [False] * len(sets) if tied is None else list(tied)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def found(q: int, skip) -> Iterator[int]:
        least, most = least_overlap(n[q], percent), n[q] * 100 // percent
        lists = [index[t] for t in sets[q].tolist() if t in index]
        # of n - least + 1 lists any partner stands in one; those that nobody else stands in are of no use
        probes = len(lists) - least + 1
        if probes > 0:
            yield from divide_skip(lists, lambda m: -(-percent * (n[q] + n[m]) // (100 + percent)), probes, lambda m: m == q or not least <= n[m] <= most or skip(m))

    out: list[tuple[int, int]] = []
    if centre is not None:
        tied[centre] = True
        for m in found(centre, lambda m: False):
            tied[m] = True
            out.append((centre, m))
    together = [i for i, t in enumerate(tied) if t]
    for i in together:
        parent[i] = together[0]
    for q in range(len(sets)):
        if tied[q] or left is not None and not left[q]:
            continue
        # a pair of queries is asked for by the first of them
        asked = (lambda m: left[m]) if left is not None else (lambda m: m < q and not tied[m])
        for m in found(q, lambda m: asked(m) or root(m) == root(q)):
            x, y = root(q), root(m)
            parent[max(x, y)] = min(x, y)
            out.append((q, m))
    return out


EDGES = "a long, b long"


def _frame(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")


def links(rows: DataFrame, sig: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links between classes, enough to connect every component."""
    total = sig.where("name is not null").groupBy("name").agg(F.first("n_shingles").alias("n")).agg(F.sum("n")).first()[0] or 0
    classes = written(sharing_classes(rows, words, percent, max(16, -(-int(total) // ENTRIES))), "sharing-classes")
    entries = classes.agg(F.sum(F.octet_length("short")) / DATA).first()[0] or 0
    met = written(short_lists(classes, percent, max(16, -(-int(entries) // ENTRIES))), "buckets")
    data = classes.select("name", "n", "data")
    # more bytes or more sets than one task takes
    blocks = F.greatest(F.ceil(F.sum("shared") * DATA / BLOCK_BYTES), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks")
    large = written(met.join(classes.select("name", "shared"), "name").groupBy("centre").agg(blocks).where("blocks > 1"), "large-buckets")

    def bucket(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        names = members["name"].tolist()
        found = search([_whole(x) for x in members["data"]], members["n"].tolist(), percent, names.index(key[0]))
        return _frame([(names[i], names[j]) for i, j in found])

    if large.isEmpty():
        return met.join(data, "name").groupBy("centre").applyInPandas(bucket, EDGES)
    small = met.join(large, "centre", "left_anti").join(data, "name").groupBy("centre").applyInPandas(bucket, EDGES)
    return small.union(_large_links(met.join(large, "centre"), classes, percent))


def _large_links(met: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The links of buckets that are dealt into blocks; met: centre, name, blocks."""
    data = classes.select("name", "n", "data")

    def ask(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        """The centre as the query of a block."""
        names = members["name"].tolist()
        at = names.index(key[0])
        near = {j for _, j in search([_whole(x) for x in members["data"]], members["n"].tolist(), percent, at, left=[False] * len(names))}
        own = [i for i in range(len(names)) if i != at]
        return pd.DataFrame({"centre": key[0], "name": np.array([names[i] for i in own], np.int64), "tied": np.array([i in near for i in own], bool)})

    # the centre comes to every block
    dealt = met.where("name != centre").select("centre", "name", F.pmod(F.xxhash64("name"), "blocks").alias("k"))
    every = met.where("name = centre").select("centre", "name", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("k"))
    tested = written(dealt.union(every).join(data, "name").groupBy("centre", "k").applyInPandas(ask, "centre long, name long, tied boolean"), "tested")
    sized = tested.join(classes.select("name", "shared"), "name")
    count = lambda own: F.greatest(F.ceil(F.sum(F.when(own, F.col("shared"))) * DATA / BLOCK_BYTES), F.ceil(F.count_if(own) / BLOCK)).cast("int")
    # the centre is among the tied, so that a bucket without a free set has nothing left to ask
    blocks = sized.groupBy("centre").agg(F.coalesce(count(~F.col("tied")), F.lit(0)).alias("nf"), F.coalesce(count(F.col("tied")), F.lit(0)).alias("nt")).where("nf > 0")
    dealt = tested.join(blocks, "centre").withColumn("k", F.when(F.col("tied"), F.pmod(F.xxhash64("name"), F.col("nt"))).otherwise(F.pmod(F.xxhash64("name"), F.col("nf"))).cast("int"))
    # task (i, j): free block i with free block j >= i; (i, -1 - j): free block i with tied block j
    pair = "named_struct('i', {}, 'j', {})"
    free = f"concat(transform(sequence(k, nf - 1), x -> {pair.format('k', 'x')}), if(k = 0, array(), transform(sequence(0, k - 1), x -> {pair.format('x', 'k')})), if(nt = 0, array(), transform(sequence(0, nt - 1), x -> {pair.format('k', '-1 - x')})))"
    near = f"transform(sequence(0, nf - 1), x -> {pair.format('x', '-1 - k')})"
    tasks = dealt.withColumn("task", F.explode(F.expr(f"if(tied, {near}, {free})"))).select("centre", F.col("task.i").alias("i"), F.col("task.j").alias("j"), "name", "tied", "k")

    def task(key: tuple, members: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        names, sets, tied = members["name"].tolist(), [_whole(x) for x in members["data"]], members["tied"].tolist()
        left = None if i == j else [not t and k == i for t, k in zip(tied, members["k"])]
        return _frame([(names[a], names[b]) for a, b in search(sets, members["n"].tolist(), percent, tied=tied, left=left)])

    found = tasks.join(data, "name").groupBy("centre", "i", "j").applyInPandas(task, EDGES)
    return tested.where("tied").select(F.col("centre").alias("a"), F.col("name").alias("b")).union(found)


def component_labels(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges: the smallest node that is reachable.

    Each round takes the smallest label nearby and follows labels to labels, so paths halve.
    Each is written to the shared folder, and what comes to the driver is whether one changed.
    """
    edges = written(edges.union(edges.select("b", "a")).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("label")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        jump = labels.select(F.col("node").alias("place"), F.col("label").alias("far"))
        new = own.join(jump, own.label == jump.place, "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "was")
        new = written(new, "labels")
        if new.where("label != was").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's doc_id, n_shingles and component_id: the smallest id that links reach, its own included.

    Words are runs of other than ASCII white space, A-Z lower-cased. A null, empty or blank
    text has no shingles and is linked with nothing. A row without an id takes part; its
    component_id is the smallest id of the others, or null. Repeated rows stay repeated. An
    empty table gives no rows.
    """
    if words < 1 or not 50 < percent <= 100:
        raise ValueError("words must be positive and percent above 50, at most 100")
    bounded(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sig = written(signatures(rows, words), "signatures")
    labels = component_labels(links(rows, sig, words, percent))
    classes = sig.where("name is not null").groupBy("name").agg(F.min("id").alias("least"))
    grouped = classes.join(labels.withColumnRenamed("node", "name"), "name", "left").select("name", "least", F.coalesce("label", "name").alias("label"))
    roots = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = grouped.join(roots, "label").select("name", "component_id")
    out = sig.join(of_class, "name", "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("name").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: the one of the smallest id. Rows without an id can't be named, and stay.

    Where ids repeat, one of the rows with the same id and text stays.
    """
    found = written(ngram_join(docs, words, percent, id_col, text_col), "components")
    kept = found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    # what is kept grows with the input, so it is not broadcast at any size
    name = free_name(docs, "keep")
    one = docs.join(kept.select(F.col("doc_id").alias(name)).hint("merge"), F.col(f"`{id_col}`") == F.col(name), "left_semi")
    if not kept.where("n > 1").isEmpty():
        one = one.dropDuplicates([id_col, text_col])
    return one.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))


def op1_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and near-duplicate component."""
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM (SELECT s.* FROM s JOIN f USING (g)) a JOIN (SELECT s.* FROM s JOIN f USING (g)) b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(r.b) FROM r WHERE r.a = d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op1_divide_skip_join": op1_divide_skip_join}
ORACLES = {"op1_divide_skip_join": ORACLE}

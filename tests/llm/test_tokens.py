import json
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import packing, tokenfiles, tokens
from tests.llm.fixtures import SMALL, docs, plain

HARD = ["", None, " ", "a  b", "\n", "a \nb", "a\n b", "  x", "x ", "x\n", "\nabc def", "Don't stop'll we're", "É ü ñandú ß", "😀 a 😀b", "<|endoftext|> x <|startoftext|>", "x<|endoftext|>y", "<|endoftext", "a\n\nb", "a\n\n\nb", "a\n\n", "\n\na",
        "a b c  d", "tab\tb \t c", "1234 a1b2 ||| | a|b", "x y z", "’quoted’ “a”", "İstanbul ΑΣ Σ ªº ŉa ǅ", "ｆｕｌｌ ﬁ é é ́a", "\x1ca b\x1c c", "a'sb 'll 'd x's", "| |", "a |   | b", "Word. WORD, word!? (word) w-w 12, 12.5 ###", "a\x0b \x0cb", "\u2028 a\u2028b"]


def library(path):
    """The truth of all these tests: the library's tokenizer as the file gives it."""
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def hard_texts():
    pick = random.Random(4)
    return HARD + ["".join(pick.choices("ab é\n|'.,#9  😀", k=pick.randint(1, 60))) for _ in range(400)]


@pytest.mark.parametrize("path", [packing.tokenizer_path(), tokenfiles.tokenizer_path()])
def test_words_give_the_ids_of_the_library(path, monkeypatch):
    e, truth, texts = tokens.Encoder(path), library(path), hard_texts()
    want = [truth(t) for t in texts]
    assert e.make
    for _ in range(2):
        assert [x.tolist() for x in e.ids(texts)] == want
    assert [next(e.ids([t])).tolist() for t in texts] == want
    # words that are forgotten, and texts that are looked up in parts
    monkeypatch.setattr(tokens, "MEMORY", 20)
    monkeypatch.setattr(tokens, "CHARACTERS", 25)
    assert [x.tolist() for x in e.ids(texts)] == want
    e.forget(5)
    assert len(e.places) <= 5 and [x.tolist() for x in e.ids(texts)] == want


def test_other_vocabularies_are_encoded_whole(tmp_path):
    made = json.load(open(packing.tokenizer_path()))
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(made))
    path = str(tmp_path / "other.json")
    e, truth = tokens.Encoder(path), library(path)
    assert e.make is None and [x.tolist() for x in e.ids(HARD)] == [truth(t) for t in HARD]


def test_first_fit_decreasing_against_brute_force():
    pick = random.Random(2)
    for _ in range(50):
        sizes = [pick.randint(1, 100) for _ in range(pick.randint(0, 120))]
        bins, want = [], [None] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            at = next((b for b, used in enumerate(bins) if used + sizes[k] <= 100), len(bins))
            if at == len(bins):
                bins.append(0)
            want[k] = (at, bins[at])
            bins[at] += sizes[k]
        assert packing.first_fit_decreasing(sizes, 100) == want


def whole(rows, path, end):
    truth = library(path)
    return sorted((repr(r[0]), zlib.crc32(np.array([*truth(r[1]), end], "<u4").tobytes())) for r in rows)


def test_packing_keeps_every_id_once(spark):
    rows = [tuple(r)[:5] for r in docs(spark).collect()]
    got = packing.pack(docs(spark), length=64, group=3).collect()
    by = {}
    for r in got:
        by.setdefault((r.sequence_id), []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own]])[:-1].tolist() and sum(r.length for r in own) <= 64
    assert sum(r.length for r in got) == sum(r.doc_tokens for r in got if r.start == 0)
    single = {i for i, n in __import__("collections").Counter(r[0] for r in rows).items() if n == 1}
    crc = []
    for i in single:
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, f"<u{r.width}") for r in own])
        assert len(ids) == own[0].doc_tokens
        crc.append((repr(i), zlib.crc32(ids.astype("<u4").tobytes())))
    assert sorted(crc) == [x for x in whole([r for r in rows if r[0] in single], packing.tokenizer_path(), 0)]
    assert packing.pack(plain(spark, [])).count() == 0


def test_packing_whole_table(spark):
    got = packing.op7_tournament_packing(spark, SMALL).collect()
    tokens_, sequences = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert tokens_ / (1024 * sequences) > 0.97
    truth = library(packing.tokenizer_path())
    whole_ids = {r.doc_id: [*truth(r.text), 0] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    pieces = {}
    for r in got:
        ids = whole_ids[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    assert set(pieces) == set(whole_ids)
    for doc, own in pieces.items():
        assert [a for a, _ in sorted(own)] == np.cumsum([0, *[n for _, n in sorted(own)]])[:-1].tolist() and sum(n for _, n in own) == len(whole_ids[doc])


def test_files_round_trip():
    pick = np.random.default_rng(3)
    for n, top in ((0, 5), (1, 2), (7, 300), (50, 70_000), (20, 2**32 - 1)):
        made = [np.minimum(pick.zipf(1.2, pick.integers(0, 400)), top).astype(np.uint32) for _ in range(n)]
        made += [pick.integers(0, top, 1000, dtype=np.uint32) for _ in range(n > 20)]
        names = [None if k == 3 else k - 5 for k in range(len(made))]
        got, sizes, ids = tokenfiles.read_file(tokenfiles.pack_file(names, made))
        assert got == names and sizes.tolist() == [len(m) for m in made]
        assert ids.tolist() == (np.concatenate(made).tolist() if made else [])
    many = np.arange(70_000, dtype=np.uint32)
    assert tokenfiles.read_file(tokenfiles.pack_file([1], [many]))[2].tolist() == many.tolist()


def test_files_of_whole_table(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_IDS", 20_000)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    truth = library(tokenfiles.tokenizer_path())
    got = sorted(tokenfiles.op9_token_files(spark, SMALL).collect(), key=lambda r: r.doc_id)
    start = 0
    for r in got:
        ids = [*truth(texts[r.doc_id]), 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_files_of_awkward_rows(spark, tmp_path):
    tokenfiles.write_files(docs(spark), f"{tmp_path}/a")
    got = tokenfiles.read_files(spark, f"{tmp_path}/a").collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(r.doc_id) for r in docs(spark).collect())
    tokenfiles.write_files(plain(spark, []), f"{tmp_path}/b")
    assert tokenfiles.read_files(spark, f"{tmp_path}/b").count() == 0


def python_stages(df):
    return len(re.findall(r"MapInPandas|MapInArrow|FlatMapGroupsInPandas|ArrowEvalPython", df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]))


def test_one_python_worker_for_a_task(spark):
    """A Python stage after another in one task is a second worker, and takes all ids once more."""
    assert python_stages(tokenfiles.op9_token_files(spark, SMALL)) == 1
    assert python_stages(packing.op7_tournament_packing(spark, SMALL)) == 2  # with an exchange between them


def test_pieces_of_batches_and_long_documents(spark, monkeypatch):
    monkeypatch.setattr(packing, "YIELD_IDS", 50)
    texts = [None, "", *(" ".join(["word"] * n) for n in (63, 64, 65, 300)), "one two"] * 2
    truth = library(packing.tokenizer_path())
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    own = {}
    for r in packing.pieces(rows, packing.tokenizer_path(), 3, 64, 0, "doc_id", "text").collect():
        own.setdefault(r.doc_id, []).append((r.start, r.length, np.frombuffer(r.ids, f"<u{r.width}").tolist(), r.doc_tokens))
    for k, text in enumerate(texts):
        ids = [*truth(text or ""), 0]
        assert sorted(own[k]) == [(a, len(ids[a : a + 64]), ids[a : a + 64], len(ids)) for a in range(0, len(ids), 64)]

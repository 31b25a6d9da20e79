import random

import pytest

from quarry.llm import ngram_join as nj
from tests.llm.fixtures import docs, plain


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").encode().translate(nj._LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(r[0], least.get(root(i), r[0]))
    return sorted((repr(r[0]), len(sets[i]), repr(least.get(root(i)))) for i, r in enumerate(rows))


def got(df):
    return sorted((repr(r.doc_id), r.n_shingles, repr(r.component_id)) for r in df.collect())


def families(seed=3, base=12, copies=14):
    """Texts and copies of copies with a few changed words, around the threshold; a passage that all share."""
    pick = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = pick.choices(vocabulary, k=30)
    rows, n = [], 0
    for _ in range(base):
        text = pick.choices(vocabulary, k=pick.randint(30, 160))
        for c in range(copies):
            if c:
                text = list(pick.choice(texts))
                for _ in range(pick.randint(0, max(1, len(text) // 40))):
                    text[pick.randrange(len(text))] = pick.choice(vocabulary)
            texts = [text] if not c else [*texts, text]
            n += 1
            rows.append((n * 7 % 1009, " ".join(text + passage * pick.randint(0, 1)), "en", "s", 0))
    return rows


def test_awkward_rows(spark):
    rows = [tuple(r)[:5] for r in docs(spark).collect()]
    assert got(nj.ngram_join(docs(spark))) == brute(rows)
    assert nj.ngram_join(plain(spark, [])).count() == 0
    assert nj.keep_first(plain(spark, [])).count() == 0
    kept = nj.keep_first(docs(spark))
    assert kept.columns == docs(spark).columns
    # 1 stands for 1, 2, 2 and 8; the row without an id stays
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(map(repr, [1, 3, 4, 5, 6, 7, 9, 10, None]))


@pytest.mark.parametrize("block, size, chunk", [(4096, 1 << 30, 1 << 21), (5, 1 << 30, 300), (100, 1500, 300)])
def test_families_against_brute_force(spark, monkeypatch, block, size, chunk):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "BLOCK_BYTES", size)
    monkeypatch.setattr(nj, "CHUNK", chunk)
    rows = families()
    want = brute(rows)
    assert len({w[2] for w in want}) < len(rows) / 2
    assert got(nj.ngram_join(plain(spark, rows))) == want


@pytest.mark.parametrize("centre", [None, 0, 9])
def test_search_finds_what_is_connected(centre):
    import numpy as np

    def linked(a, b):
        both = len(np.intersect1d(a, b))
        return both > 0 and 100 * both >= 80 * (len(a) + len(b) - both)

    pick = random.Random(1)
    sets = []
    for _ in range(40):
        base = pick.sample(range(10**6), 60)
        for _ in range(4):
            sets.append(np.unique(np.array(base[: pick.randint(45, 60)] + pick.sample(range(10**6), 3), np.uint64)))
    found = nj.search(sets, [len(s) for s in sets], 80, centre)
    for a, b in found:
        assert linked(sets[a], sets[b])
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in found:
        parent[root(a)] = root(b)
    for a in range(len(sets)):
        for b in range(a):
            if linked(sets[a], sets[b]):
                assert root(a) == root(b)


@pytest.mark.parametrize("chunk, long_word", [(1 << 19, 1 << 16), (40, 12), (200, 3000)])
def test_shingles_against_words(monkeypatch, chunk, long_word):
    monkeypatch.setattr(nj, "CHUNK", chunk)
    monkeypatch.setattr(nj, "LONG_WORD", long_word)
    texts = ["x " * 200 + "b" * 5000, "b" * 200 + " " + "c" * 41 + " d e f g h " * 20, "", None, " ", "a", "A b", "a b c d e f a b c d e", "x\x0by\x0cz \t\r\n w v u", "é É ü\u00a0x y z w v", "b" * 5000 + " c d e f g", "a a a a a a a a a"]
    got = list(nj.shingles([t and t.encode() for t in texts], 5))
    known = {}
    for text, s in zip(texts, got):
        w = (text or "").encode().translate(nj._LOWER).split()
        want = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(s) == len(want)
        for one in want:
            known[one] = list(nj.shingles([b" ".join(one)], 5))[0][0]
        assert {known[one] for one in want} == set(s)
    assert len(set(known.values())) == len(known)

import re
from collections import defaultdict

from quarry.llm import quality
from tests.llm.fixtures import SMALL, docs, plain


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_whole_table_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    rows = quality.op6_robust_outliers(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)
    clean = [r.kept for r in rows if good.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r.kept for r in rows if good.get(r.doc_id) == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.3


def test_awkward_rows(spark):
    out = quality.judge(docs(spark))
    rows = out.collect()
    assert len(rows) == docs(spark).count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].base_failed and by_id[4].base_failed and by_id[5].n_words == 0
    assert by_id[6].n_words == 20_000 and by_id[6].kept
    assert by_id[10].n_repeat_words == 96 and not by_id[10].kept
    assert by_id[9].n_dup_lines == 1
    assert quality.judge(plain(spark, [])).count() == 0
    assert quality.keep_good(docs(spark)).columns == docs(spark).columns


def test_the_estimate_rejects_what_lies_far_off(spark):
    import random

    pick = random.Random(5)
    good = [(i, " ".join("".join(pick.choices("abcdefghij", k=pick.randint(2, 8))) for _ in range(80)), "en", "s", 0) for i in range(300)]
    bad = [(1000 + i, " ".join("###" + t for t in good[i][1].split()), "en", "s", 0) for i in range(60)]
    rows = quality.judge(plain(spark, good + bad)).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in rows)


def least_determinant(x):
    """A plain search: many random starts, exact concentration steps on the nearest rows until they stay."""
    import numpy as np

    pick, n = np.random.default_rng(1), len(x)
    h, floors = int(np.ceil(quality.SHARE * n)), np.diag(np.array(quality.FLOORS) ** 2)
    best = None
    for _ in range(60):
        own = pick.choice(n, 12, replace=False)
        for _ in range(50):
            mean, cov = x[own].mean(0), np.cov(x[own].T, bias=True)
            left = x - mean
            d = (left @ np.linalg.inv(cov + floors) * left).sum(1)
            new = np.argsort(d, kind="stable")[:h]
            if set(new) == set(own):
                break
            own = new
        det = np.linalg.slogdet(np.cov(x[own].T, bias=True) + floors)[1]
        if best is None or det < best[0]:
            best = (det, own)
    own = x[best[1]]
    grow = quality.SHARE / quality.chi2_cdf(quality.chi2_quantile(quality.SHARE, quality.D), quality.D + 2)
    left = x - own.mean(0)
    return (left @ np.linalg.inv(np.cov(own.T, bias=True) * grow + floors) * left).sum(1)


def test_verdicts_against_a_plain_search(spark):
    import random

    import numpy as np

    pick = random.Random(12)
    rows = []
    for i in range(400):
        # two groups with spread statistics, a fifth of their rows far off, each in its own way
        long, far = (3, 9) if i % 2 else (2, 6), i % 5 == 0
        words = ["".join(pick.choices("abcdefghij", k=pick.randint(*long) * (4 if far and i % 3 == 0 else 1))) for _ in range(120)]
        if far and i % 3 == 1:
            words = [w + "#$%&" for w in words]
        elif far and i % 3 == 2:
            words = [w for w in words[:60] for _ in range(2)]
        elif i % 7 == 0:
            words[pick.randrange(100)] = "***"
        lines = [" ".join(words[k : k + 12]) for k in range(0, 120, 12)]
        rows.append((i, "\n".join(lines + lines[: pick.randint(0, 1)]), "en", f"s{i % 2}", 0))
    got = {r.doc_id: r for r in quality.judge(plain(spark, rows)).collect()}
    features = [f.alias(f"x{k}") for k, f in enumerate(quality._features())]
    x = {r.doc_id: list(r[1:]) for r in quality.statistics(plain(spark, rows)).select("doc_id", *features).collect()}
    cut = quality.chi2_quantile(1 - quality.TAIL, quality.D)
    for source in (0, 1):
        own = [i for i in x if i % 2 == source and not got[i].base_failed]
        want = least_determinant(np.array([x[i] for i in own]) / quality.SCALE)
        near = [(i, d) for i, d in zip(own, want) if not 0.8 * cut < d < 1.25 * cut]
        assert len(near) > 0.95 * len(own) and {d > cut for _, d in near} == {True, False}
        assert [got[i].kept for i, _ in near] == [d <= cut for _, d in near]


def test_small_groups_are_judged_by_their_language_and_then_by_the_whole_table(spark):
    import random

    pick = random.Random(9)
    text = lambda: " ".join("".join(pick.choices("abcdefghij", k=pick.randint(2, 8))) for _ in range(80))
    far = lambda: " ".join("###" + t for t in text().split())
    rows = [(i, text(), "en", "large", 0) for i in range(200)]
    # a small pair beside a large one of its language, a rare language, and rows without any
    small = [("en", "small"), ("es", "x"), ("es", "y"), (None, None)]
    rows += [(1000 + 10 * k + i, far() if i == 0 else text(), *g, 0) for k, g in enumerate(small) for i in range(5)]
    out = {r.doc_id: r for r in quality.judge(plain(spark, rows)).collect()}
    assert len(out) == len(rows) and all(r._distance is not None for r in out.values())
    assert [d for d, r in sorted(out.items()) if not r.kept] == [1000, 1010, 1020, 1030]
    # the whole table is too small for a model
    assert all(r.kept and r._distance is None for r in quality.judge(plain(spark, rows[150:])).collect())


def test_chi_square():
    assert abs(quality.chi2_cdf(quality.chi2_quantile(0.975, 4), 4) - 0.975) < 1e-9
    assert abs(quality.chi2_quantile(0.95, 2) - 5.99146) < 1e-4

import numpy as np
import pytest

from quarry.llm import neighbours as nn

SF = "/root/testdata/sf0.1"


def exact(rows, top=20, every=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for k in np.flatnonzero(ids % every == 0):
        score = (x * x[k]).sum(1)
        by = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[k]][:top]
        out[int(ids[k])] = [(int(ids[i]), float(score[i])) for i in by]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / max(1, len(want[q])) for q in want])


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_and_the_exact_way(spark, sf):
    sf = f"/root/testdata/{sf}"
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()])
    got = found(nn.op3_multiprobe(spark, sf))
    assert got.keys() == want.keys() and all(len(got[q]) == len(want[q]) for q in want)
    assert recall(got, want) >= 0.9
    got = found(nn.nearest(df, success=1.0))
    for q in want:
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], rtol=0, atol=1e-12)


def test_recall_with_small_buckets_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(nn, "PER_BUCKET", 64)
    monkeypatch.setattr(nn, "CHUNK", 50)
    monkeypatch.setattr(nn, "PER_TASK", 300)
    monkeypatch.setattr(nn, "QUERIES_PER_TASK", 30)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert recall(found(nn.op3_multiprobe(spark, SF)), exact(rows)) >= 0.9


@pytest.mark.parametrize("per_bucket", [1024, 4])
def test_awkward_rows(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(nn, "PER_BUCKET", per_bucket)
    nan, inf = float("nan"), float("inf")
    rows = [(20 + i, [1.0, 2.0, 2.0]) for i in range(50)]  # a hot vector, ties
    rows += [(0, [1.0, 0.0, 0.0]), (40, [1.0, 2.0, 2.0]), (100, [-1.0, -9.0, 3.0]), (101, [30.0, 0.0, 1.0]), (102, [0.5, 0.5, 0.5])]
    bad = [(120, None), (140, [0.0, 0.0, 0.0]), (160, [1.0, None, 2.0]), (180, [nan, 1.0, 1.0]), (200, [inf, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (220, []), (240, [1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad], "vec_id long, embedding array<float>, score int")
    assert found(nn.nearest(df, success=1.0)) == exact(list(dict((r[0], r) for r in rows).values()))
    two = spark.createDataFrame([(20, [1.0]), (40, [2.0])], "vec_id long, embedding array<double>")
    assert found(nn.nearest(two)) == {20: [(40, 2.0)], 40: [(20, 2.0)]}
    assert nn.nearest(two.limit(0)).count() == 0
    assert found(nn.nearest(df)).keys() == {0, 20, 40, 60, 100}
    one = spark.createDataFrame([(20, [1.0])], "vec_id long, embedding array<double>")
    assert nn.nearest(one).count() == 0


@pytest.mark.parametrize("per_bucket", [1024, 40])
def test_ties_of_distinct_vectors_go_to_the_smaller_id(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(nn, "PER_BUCKET", per_bucket)
    # all of the same product with query 0; ids against the order of the vectors, and equal vectors among them
    rows = [(0, [0.0, 1.0, 0.0])] + [(1001 - i, [float(i), 1.0, 0.0]) for i in range(1, 301)] + [(5001 + i, [300.0 - i, 1.0, 0.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(nn.nearest(df, every=100_000, success=1.0))
    assert got == exact(rows, every=100_000) and [v for v, _ in got[0]] == list(range(701, 721))

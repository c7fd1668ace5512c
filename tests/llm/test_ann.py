"""Nearest neighbours against brute force."""

import numpy as np
import pytest

ann = pytest.importorskip("folioscope.llm.ann")


def brute(ids, x, every, top):
    out = {}
    for i, v in zip(ids, x, strict=True):
        if i % every == 0:
            s = x @ v
            rows = sorted((-a, j) for a, j in zip(s, ids, strict=True) if j != i)[:top]
            out[i] = [(j, -a) for a, j in rows]
    return out


def result(df, **kw):
    out = {}
    for r in df.collect() if not kw else ann.nearest(df, **kw).orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_recall_and_scores(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 1500)] + 0.7 * rng.standard_normal((1500, 16))).astype(np.float32)
    x *= rng.uniform(0.5, 2, (1500, 1)).astype(np.float32)  # norms differ
    x[300:800] = x[300]  # a third of equal vectors
    ids = np.arange(1500)
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>, score int")
    got = result(df, every=20, top=20)
    want = brute(ids.tolist(), x.astype(np.float64), 20, 20)
    assert set(got) == set(want)
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9
    for q, rows in got.items():
        assert np.allclose([s for _, s in rows], [x[q].astype(float) @ x[j].astype(float) for j, _ in rows], rtol=0, atol=1e-9)
        assert rows == sorted(rows, key=lambda r: (-r[1], r[0])) and len(rows) == 20 and q not in {j for j, _ in rows}


@pytest.mark.parametrize("few,scale", [(1, 1e6), (40, 1e4)])
def test_outlier_norms(spark, few, scale):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1600, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[rng.permutation(1600)[:few]] *= scale
    ids = np.arange(1600)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got, want = result(df, every=20, top=20), brute(ids.tolist(), x, 20, 20)
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.9, np.mean(hits)


def test_few_rows_and_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.0]), (9, [1.0]), (20, [0.0, 2.0]), (40, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(df, every=20, top=3)
    assert got == {0: [(2, 1.0), (1, 0.5), (20, 0.0)], 20: [(1, 1.0), (0, 0.0), (2, 0.0)]}
    assert result(df.limit(0), every=20, top=3) == {}
    assert result(df.filter("vec_id = 0"), every=20, top=3) == {}


@pytest.mark.parametrize("walks", [None, ()])
def test_vectors_without_clusters(spark, monkeypatch, walks):
    if walks is not None:
        monkeypatch.setattr(ann, "WALKS", walks)  # scans alone: exact
    rng = np.random.default_rng(8)
    x = rng.standard_normal((4000 if walks is None else 700, 48)) * np.exp(rng.normal(0, 0.3, (4000 if walks is None else 700, 1)))
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    got, want = result(df, every=20, top=20), brute(ids.tolist(), x, 20, 20)
    hits = [len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= (0.9 if walks is None else 1.0), np.mean(hits)

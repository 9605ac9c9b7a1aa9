"""Whitening against the eigenvectors of a plainly summed covariance."""

import random

import numpy as np
import pytest

from vectrail.llm import merging
from vectrail.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, n string, component string, y string, part string, whitened int"


def plain(rows):
    """{(id, place): row} by exact sums and eigh; ids repeat, so rows are listed."""
    usable = [(i, [int(np.floor(64.0 * np.float32(c).astype(float))) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[(n * x[j] - total[j]) / n for j in range(d)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    out = []
    for i, x in usable:
        deviation = sum((n * x[j] - total[j]) ** 2 for j in range(d))
        for c in range(min(16, d, int((e > 1e-9 * e[0]).sum()))):
            out.append((i, c + 1, n, deviation, float(np.array([(n * x[j] - total[j]) / n for j in range(d)]) @ v[:, c] / np.sqrt(e[c])), e[c] / e.sum()))
    return out


def frame(spark, rows, parts=7):
    return spark.createDataFrame([(i, v, 3, "n", "c", "y", "p", 1) for i, v in rows], SCHEMA).repartition(parts)


def vectors(n=300, d=20, seed=4):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, d)) * np.linspace(1, 6, d) + r.normal(size=d)).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, rows[5][1]), (n, None), (n + 1, []), (n + 2, [float("nan")] * d), (n + 3, [float("inf"), *rows[0][1][1:]]), (n + 4, [None, *rows[0][1][1:]]), (n + 5, [0.0] * d), (n + 6, [-0.0] * d)]
    random.Random(seed).shuffle(rows)
    return rows


def same(found, rows):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], round(abs(r[4]), 6))
    want = sorted(plain(rows), key=key)
    got = sorted(((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in found), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    sign = {}
    for g, w in zip(got, want, strict=True):
        assert abs(g[4]) == pytest.approx(abs(w[4]), abs=1e-7) and g[5] == pytest.approx(w[5], rel=1e-9)
        if abs(w[4]) > 1e-6:
            assert sign.setdefault(g[1], g[4] * w[4] > 0) == (g[4] * w[4] > 0)
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error < 1e-9


@pytest.mark.parametrize("parts", [1, 7, 45])
def test_equals_eigenvectors(spark, parts):
    rows = vectors()
    same(W.whiten(frame(spark, rows, parts)).collect(), rows)


def test_levels_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 40)
    rows = vectors(60, 8)
    usable = W.rounded(frame(spark, rows, 9))
    assert len(W.fit_whitening(usable).directions) == 8
    state = lambda n: spark.range(n, numPartitions=3).selectExpr("id AS part", "cast(cast(id AS string) AS binary) AS state")
    assert merging.merge_states(state(100), b",".join, fan_in=3) == b",".join(str(i).encode() for i in range(100))
    assert merging.merge_states(state(1), b",".join) == b"0" and merging.merge_states(state(0), b",".join) is None


def test_merge_is_lossless():
    r = np.random.default_rng(1)
    a, b = r.integers(-90, 90, (30, 12)), r.integers(500, 600, (5, 12))
    m = W.merged(W.factors_of(a), W.factors_of(b))
    whole = np.vstack((a, b))
    centred = whole - whole.mean(axis=0)
    assert np.allclose(m.vt.T @ (m.s[:, None] ** 2 * m.vt), centred.T @ centred) and m.sums == whole.sum(axis=0).tolist()
    assert len(m.s) == 12


def test_no_variance_and_no_rows(spark):
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert W.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect() == []
    flat = [(i, [i / 10.0, 1.0, i / 10.0]) for i in range(9)]
    same(W.whiten(frame(spark, flat)).collect(), flat)  # one direction varies


def test_long_sums():
    w = W.Whitening(3 * 10**6, [5, -7], np.eye(2), np.ones(2), 2.0)
    y = np.array([[100, -200], [2**40, 1]])
    exact = [sum((w.n * v - s) ** 2 for v, s in zip(row, w.sums, strict=True)) for row in y.tolist()]
    assert w.deviations(y) == [exact[0], None] and exact[1] >= 1 << 63 and w.deviations(y[:1]) == exact[:1]


def test_unequal_dimensions_fail(spark):
    with pytest.raises(Exception, match="dimensions"):
        W.whiten(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])], 1)).collect()


def test_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    found = W.op11_whitening(spark, sf).collect()
    assert len(found) == 16 * len(rows)
    same(found, rows)

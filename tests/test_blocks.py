"""Blocks of queries against a gallery that is written once."""

import numpy as np
import pytest

from vectrail.operators import blocks, ranking
from vectrail.operators import metrics as M
from vectrail.operators import verification as V

SIDE = "pos long, embedding array<float>, vehicle_id int, camera_id long"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v], i % 4, i % 3) for i, v in enumerate(x)], SIDE).repartition(3)


def plain(s, k):
    return [np.lexsort((np.arange(s.shape[1]), -row))[:k] for row in s]


def test_float_sums_keep_their_order_and_few_are_made(spark, monkeypatch):
    r = np.random.default_rng(2)
    q, g = (r.normal(size=(n, 24)).astype(np.float32) for n in (30, 400))
    q[0, 0], g[5, 3], g[7] = np.nan, np.inf, g[6]
    with np.errstate(invalid="ignore"):
        s = np.cumsum(q[:, None] * g[None], axis=2, dtype=np.float32)[:, :, -1]
    got = {}
    for row in V.float_top(frame(spark, q), frame(spark, g), 6, block=8).orderBy("qpos", "rank").collect():
        got.setdefault(row["qpos"], []).append((row["gpos"], row["score"]))
    for i, want in enumerate(plain(s, 6)):
        assert [p for p, _ in got[i]] == want.tolist()
        assert i == 0 or [x for _, x in got[i]] == [float(x) for x in s[i, want]]
    made, real = [], blocks.dots
    monkeypatch.setattr(blocks, "dots", lambda q, rows, i, j: made.append(len(i)) or real(q, rows, i, j))
    best = blocks.Best(29, 6)
    for at in range(20, 400, 95):
        blocks.add_best(best, q[1:], np.arange(at, min(400, at + 95)), g[at : at + 95])
    assert [p.tolist() for p in best.pos] == [(w + 20).tolist() for w in plain(s[1:, 20:], 6)]
    assert sum(made) < 29 * 6 * 5


def test_results_go_with_pieces_of_the_gallery_not_with_blocks(spark):
    r = np.random.default_rng(3)
    q, g = r.normal(size=(25, 6)).astype(np.float32), r.normal(size=(90, 6)).astype(np.float32)
    d = ranking.scored(frame(spark, q), frame(spark, g), 5, block=7)
    assert d.count() <= 3 * 25 * 5  # three partitions of the gallery; it has 13 blocks of seven rows
    assert "CartesianProduct" in d._jdf.queryExecution().toString()
    h = ranking.hardest(frame(spark, g), block=7).collect()
    s = g.astype(float) @ g.T.astype(float)
    for row in h:
        i = row["pos"]
        same = np.arange(90) % 4 == i % 4
        assert row["hardest_negative"] == pytest.approx(s[i, ~same].max())
        assert row["hardest_positive"] == pytest.approx(s[i, same & (np.arange(90) != i)].min())


def test_equal_vectors_tie_wherever_they_stand(spark):
    g = np.repeat(np.random.default_rng(4).normal(size=(1, 9)), 50, axis=0).astype(np.float32)
    got = ranking.top_k(frame(spark, g[:9]), frame(spark, g), 4).collect()
    assert {(r["rank"], r["gpos"]) for r in got} == {(i + 1, i) for i in range(4)}


def test_unequal_lengths_fail(spark):
    d = frame(spark, [[1, 2, 3], [1, 2], [1, 2, 3, 4]]).coalesce(1)
    with pytest.raises(Exception, match="unequal"):
        ranking.hardest(d).collect()


@pytest.mark.parametrize("block", [6, 4096])
def test_sums_of_ranks(spark, block, monkeypatch):
    monkeypatch.setattr(ranking, "SCORES", 500)
    x = np.random.default_rng(5).integers(-2, 3, (110, 3)).astype(np.float32)
    q, g = frame(spark, x[:20]), frame(spark, x[20:])
    whole = M.average_precision(M.labelled(ranking.top_k(q, g, None), q, g), M.positives(q, g), None)
    ours = M.precision_of_sums(ranking.ranked_sums(q, g, block), M.positives(q, g))
    show = lambda d: sorted((r["qpos"], r["n_pos"], round(r["ap"], 9), round(r["inp"], 9), r["first_hit"]) for r in d.collect())
    assert show(ours) == show(whole)

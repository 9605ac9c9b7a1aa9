"""Whole rankings from the ranks of positives, thresholds without a one-task window."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.operators import metrics, ranking

SIDE = "pos long, embedding array<float>, vehicle_id int, camera_id long"


def sides(spark, n_q=25, n_g=90):
    r = np.random.default_rng(6)
    x = r.integers(-2, 3, (n_q + n_g, 3)).astype(np.float32)  # many equal scores
    rows = [(i, [float(c) for c in v], int(r.integers(0, 5)), int(r.integers(0, 3))) for i, v in enumerate(x)]
    return spark.createDataFrame(rows[:n_q], SIDE), spark.createDataFrame(rows[n_q:], SIDE), rows[:n_q], rows[n_q:]


@pytest.mark.parametrize("block", [7, 4096])
def test_ranks_of_positives(spark, block):
    q, g, qs, gs = sides(spark)
    want = {}
    for a in qs:
        rest = sorted((b for b in gs if b[2:] != a[2:]), key=lambda b: (-float(np.dot(a[1], b[1])), b[0]))
        want |= {(a[0], b[0]): i + 1 for i, b in enumerate(rest) if b[2] == a[2]}
    got = {(r["qpos"], r["gpos"]): r["rank"] for r in ranking.positive_ranks(q, g, block).collect()}
    assert got == want and len(want) > 100
    whole = metrics.average_precision(metrics.labelled(ranking.top_k(q, g, None), q, g), metrics.positives(q, g), None)
    ours = metrics.precision_of_ranks(ranking.positive_ranks(q, g, block), metrics.positives(q, g))
    show = lambda d: sorted((r["qpos"], r["n_pos"], round(r["ap"], 9), round(r["inp"], 9), r["first_hit"]) for r in d.collect())
    assert show(ours) == show(whole)


def test_an_unreachable_rate_fails(spark):
    curve = spark.createDataFrame([(0.1, 0.9, 0.2), (0.2, 0.8, 0.5), (0.3, 0.7, None)], "threshold double, q double, tnr double")
    assert metrics.pick(curve, "q", 0.5).first()["threshold"] == 0.2
    assert metrics.pick(curve, "q", 0.9).first()["threshold"] == 0.3
    with pytest.raises(Exception, match="no threshold"):
        metrics.pick(curve.where("tnr IS NOT NULL"), "q", 0.9).collect()


def test_plateaus(spark):
    def plain(points, last):
        t = sorted(points)
        cuts = [(t[0][0] - 1e-3, t[0][1]), *(((a[0] + b[0]) / 2, b[1]) for a, b in zip(t, t[1:], strict=False)), (t[-1][0] + 1e-3, last)]
        top, runs = max(q for _, q in cuts), []
        for k, (c, q) in enumerate(cuts):
            if abs(q - top) <= 1e-8:
                if k and abs(cuts[k - 1][1] - top) <= 1e-8:
                    runs[-1][1] = c
                else:
                    runs.append([c, c])
        lo, hi = max(runs, key=lambda r: (r[1] - r[0], -r[0]))
        return (lo + hi) / 2, top

    r = np.random.default_rng(1)
    for _ in range(6):
        points = [(float(t), float(q)) for t, q in zip(r.permutation(40)[:12] / 64, r.integers(0, 3, 12) / 2, strict=True)]
        last = float(r.integers(0, 3) / 2)
        d = spark.createDataFrame(points, "threshold double, q double").withColumn("q_none", F.lit(last))
        got = metrics.midpoint(d).first()
        assert (got["threshold"], got["q"]) == pytest.approx(plain(points, last))


def test_best_columns_with_ties():
    r = np.random.default_rng(3)
    for k in (1, 4, 9):
        s, pos = r.integers(0, 6, (50, 12)).astype(float), r.permutation(12)
        got = ranking._best(s, pos, k)
        for row, own in zip(s, got, strict=True):
            assert set(own) == set(sorted(range(12), key=lambda c: (-row[c], pos[c]))[:k])

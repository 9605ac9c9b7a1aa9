"""The stored approximate index against exact search."""

import numpy as np
import pytest

from vectrail.operators import ivfpq, ranking

SCHEMA = "pos long, embedding array<float>"


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(c) for c in v]) for i, v in enumerate(x)], SCHEMA).repartition(3)


def clustered(n, d, seed=1, around=12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(around, d))
    x = centres[r.integers(0, around, n)] + r.normal(size=(n, d)) * 0.35
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def exact(q, g, k=10):
    s = q.astype(float) @ g.astype(float).T
    return [set(np.lexsort((np.arange(len(g)), -row))[:k].tolist()) for row in s]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    x = clustered(1500, 20)
    return x, ivfpq.build(frame(spark, x), f"file://{tmp_path_factory.mktemp('index')}/ix")


def test_recall_with_few_rows_scored(spark, index):
    x, ix = index
    q = clustered(40, 20, 2)
    d = frame(spark, q)
    r = ivfpq.sweep(d, ix, ranking.top_k(d, frame(spark, x)), [(2, 100), (8, 100)]).collect()
    assert r[0]["recall"] <= r[1]["recall"] and r[1]["recall"] >= 0.9 and r[1]["scored"] <= 0.1 and r[1]["compared"] < 0.5 and r[1]["n"] == 40
    found: dict[int, set[int]] = {}
    for row in ivfpq.search(d, ix, 8, 100).collect():
        found.setdefault(row["qpos"], set()).add(row["gpos"])
        assert row["score"] == pytest.approx(float(q[row["qpos"]].astype(float) @ x[row["gpos"]].astype(float)))
    hits = np.mean([len(found[i] & want) / 10 for i, want in enumerate(exact(q, x))])
    assert hits == pytest.approx(r[1]["recall"])


def test_all_cells_and_rows_are_exact(spark, index, monkeypatch):
    monkeypatch.setattr(ivfpq, "BLOCK", 100)
    monkeypatch.setattr(ivfpq, "QUERIES", 7)
    x, ix = index
    q = clustered(30, 20, 3)
    got = ivfpq.search(frame(spark, q), ix, len(ix.model.centres), len(x)).collect()
    want = exact(q, x)
    assert {(r["qpos"], r["gpos"]) for r in got} == {(i, g) for i, s in enumerate(want) for g in s}
    assert {r["rank"] for r in got} == set(range(1, 11))


def test_every_row_is_indexed_and_opened_again(spark, index, tmp_path):
    x, ix = index
    assert sorted(r["pos"] for r in ix.codes.collect()) == list(range(len(x))) and ix.rows == len(x)
    assert len(ix.model.centres) == ivfpq.cells_for(len(x)) == 32 and ivfpq.cells_for(10**6) == 1024 and ivfpq.cells_for(10**12) == ivfpq.MOST_CELLS
    path = f"file://{tmp_path}/few"
    few = ivfpq.build(frame(spark, x[:3, :7]), path, cells=2)  # fewer rows than code words, parts that don't divide
    again = ivfpq.load(spark, path)
    assert np.allclose(again.model.centres, few.model.centres) and again.rows == 3
    assert ivfpq.search(frame(spark, x[:1, :7]), again, 2, 3).count() == 3
    with pytest.raises(FileExistsError):
        ivfpq.build(frame(spark, x[:3]), path)


def test_ties_go_to_the_smaller_position(spark, tmp_path):
    x = np.repeat(clustered(1, 8), 30, axis=0)
    ix = ivfpq.build(frame(spark, x), f"file://{tmp_path}/ties", cells=4)
    assert [r["gpos"] for r in ivfpq.search(frame(spark, x[:1]), ix, 4, 10).orderBy("rank").collect()] == list(range(10))


def test_what_a_search_passes_on_does_not_go_with_the_rerank(spark, index, monkeypatch):
    monkeypatch.setattr(ivfpq, "ESTIMATES", 4000)  # two queries a task
    x, ix = index
    q = frame(spark, clustered(9, 20, 4))
    near = ivfpq._near(q, ix, 5)
    cut = {r["qpos"]: r for r in ivfpq.cutoffs(near, ix, 5, 150).collect()}
    assert len(cut) == 9  # a row a query
    assert np.isneginf([r["least"] for r in ivfpq.cutoffs(near, ix, 5, len(x)).collect()]).all()
    cells = {r["pos"]: (r["cell"], r["code"]) for r in ix.codes.collect()}
    for row in near.collect():
        e = {}
        for pos, (cell, code) in cells.items():
            if cell in row["near"]:
                words = np.concatenate([w[c] for w, c in zip(ix.model.words, code, strict=True)])[:20]
                e[pos] = np.float32(np.dot(row["v"], words + ix.model.centres[cell]))
        c = cut[row["pos"]]
        assert row["compared"] == len(e)
        assert sum(v > c["least"] or (v == c["least"] and p <= c["last"]) for p, v in e.items()) == pytest.approx(min(150, len(e)), abs=1)


@pytest.mark.parametrize("rounds", [0, 4])  # a task for the whole index, and pieces
def test_settings_that_are_searched_together_are_a_plain_model_s(spark, tmp_path, monkeypatch, rounds):
    monkeypatch.setattr(ivfpq, "QUERIES", 5)
    monkeypatch.setattr(ivfpq, "ROUNDS", rounds)
    x = np.repeat(clustered(300, 20, 5), 3, axis=0)[:899]  # copies, so that re-ranks end among equal estimates
    ix = ivfpq.build(frame(spark, x), f"file://{tmp_path}/ix", cells=16)
    q = clustered(12, 20, 6)
    settings = [(3, 31), (16, 40), (7, 40), (16, 899), (16, 11), (7, 40)]
    model, rounded = ivfpq._rounded_model(ix.model), ivfpq._rounded_queries(q.astype(float))
    cell, code = (np.array(c) for c in zip(*[(r["cell"], list(r["code"])) for r in ix.codes.orderBy("pos").collect()], strict=True))
    rows = np.concatenate([w[code[:, p]] for p, w in enumerate(model.words)], axis=1)[:, :20] + model.centres[cell]
    e, score = (rounded @ rows.T).astype(np.float32), q.astype(float) @ x.astype(float).T
    places = np.argsort(np.argsort(-(rounded @ model.centres.T), axis=1, kind="stable"), axis=1)
    want = set()
    for s, (probes, rerank) in enumerate(settings):
        for i in range(len(q)):
            there = np.flatnonzero(places[i, cell] < probes)
            there = there[np.lexsort((there, -e[i, there]))][:rerank]
            there = there[np.lexsort((there, -np.round(score[i, there], 12)))][:10]
            want |= {(s, i, int(g), r + 1) for r, g in enumerate(there)}
    d = frame(spark, q)
    assert {(r["setting"], r["qpos"], r["gpos"], r["rank"]) for r in ivfpq.searches(d, ix, settings).collect()} == want
    alone = {(r["qpos"], r["gpos"], r["rank"]) for r in ivfpq.search(d, ix, 7, 40).collect()}
    assert alone == {x[1:] for x in want if x[0] == 2}


def test_a_sweep_reads_the_index_as_often_for_many_settings_as_for_one(spark, index):
    x, ix = index
    d = frame(spark, clustered(9, 20, 7))
    best = ranking.top_k(d, frame(spark, x)).localCheckpoint()
    times = [ivfpq.sweep(d, ix, best, s)._jdf.queryExecution().executedPlan().toString().count("CartesianProduct") for s in ([(8, 100)], [(2, 50), (8, 100), (32, 100), (32, 150)])]
    assert times[0] == times[1] > 0


def test_a_sweep_of_no_queries(spark, index):
    x, ix = index
    d = frame(spark, clustered(9, 20, 7))
    none = ivfpq.sweep(d.where("pos < 0"), ix, ranking.top_k(d, frame(spark, x)), [(2, 50), (32, 100)]).orderBy("probes").collect()
    assert [(r["probes"], r["rerank"], r["n"], r["recall"]) for r in none] == [(2, 50, 0, None), (32, 100, 0, None)]

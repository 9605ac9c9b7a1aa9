"""Language-model scores against plain counting."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import rows
from vectrail.llm import lm_score
from vectrail.llm.lm_score import MU


def plain(data, quantise):
    """(id, held_out, n_tokens, n_known, N, base, score) by dictionaries of tuples."""
    toks = [[*[w.lower() for w in rows.words(t)], b"\n"] for _, t in data]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    c = [Counter(), Counter(), Counter()]
    for t, h in zip(toks, held, strict=True):
        if not h:
            c[0].update((x,) for x in t)
            c[1].update(zip([b"\n", *t], t))  # noqa: B905
            c[2].update(zip([b"\n", *t], t, t[1:]))  # noqa: B905
    n, v = sum(c[0].values()), len(c[0])
    exact = Counter(c[0])
    if quantise:
        c = [{g: float(lm_score.expected(lm_score.levels(np.array([k])))[0]) for g, k in x.items()} for x in c]
    out = []
    for (i, _), t, h in zip(data, toks, held, strict=True):
        base = sum(math.log10((exact[(x,)] + 1) / (n + v + 1)) for x in t)
        score = 0.0
        for k, x in enumerate(t):
            before = t[k - 1] if k else b"\n"
            one, history, pair = c[0].get((x,), 0), c[0].get((before,), 0), c[1].get((before, x), 0)
            p = (one + 1) / (n + v + 1)
            p = (min(pair, history) + MU[0] * p) / (history + MU[0])
            if k:
                context = c[1].get((t[k - 2] if k > 1 else b"\n", before), 0)
                triple = c[2].get((t[k - 2] if k > 1 else b"\n", before, x), 0)
                p = (min(triple, context) + MU[1] * p) / (context + MU[1])
            score += math.log10(p)
        out.append((i, h, len(t), sum((x,) in exact for x in t), n, base, score))
    return out


@pytest.mark.parametrize("source", ["awkward", "sf", "empty"])
def test_op10(spark, sf, tmp_path, monkeypatch, source):
    """Counts and base are exact; scores equal those of quantised counts, but for the filter's rare false hits."""
    where = sf if source == "sf" else rows.stored(rows.frame(spark, [] if source == "empty" else None), tmp_path)
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    monkeypatch.setattr(lm_score, "BATCH", 17)
    got = sorted(map(tuple, lm_score.op10_lm_score(spark, where).collect()), key=repr)
    theirs = plain(data, True)
    assert sorted(((*r[:5], round(r[5], 4)) for r in got), key=repr) == sorted(((*r[:5], round(r[5], 4)) for r in theirs), key=repr)
    by = {}
    for r in theirs:
        by.setdefault((r[0], r[2], round(r[5], 3)), []).append(r[6])
    off = [abs(r[6] - by[r[0], r[2], round(r[5], 3)][0]) / r[2] for r in got]
    assert sum(x > 0.08 for x in off) <= 0.02 * len(off) and sum(off) <= 0.01 * len(off)
    if source == "sf":
        assert sum(r[6] for r in got if r[1]) > sum(r[5] for r in got if r[1])


def test_batches_and_ranges_do_not_matter(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = [(a, round(b, 6)) for a, b in rows.found(lm_score.score_documents(docs), "doc_id", "base_score")]
    for name, value in (("BATCH", 3), ("BATCH_BYTES", 2000), ("LEAST_RANGES", 900)):
        monkeypatch.setattr(lm_score, name, value)
    assert [(a, round(b, 6)) for a, b in rows.found(lm_score.score_documents(docs), "doc_id", "base_score")] == one


def test_ids_of_any_type_and_other_columns(spark):
    docs = spark.createDataFrame([("a", "x y z", 1), (None, None, 2), ("a", "x y z", 1)], "doc_id string, text string, score int")
    assert [r["n_tokens"] for r in lm_score.score_documents(docs).orderBy("n_tokens").collect()] == [1, 4, 4]


def test_filter_never_underestimates():
    h = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    level = lm_score.levels(np.arange(5000) % 900)
    found = lm_score.probe(np.frombuffer(lm_score.bloom(h, level), np.uint8), h)
    assert (found >= level).all() and (found > level).mean() < 0.05


def test_texts_seen_twice_score_apart(spark):
    """What is in training once or twice scores above what isn't; counts are known to a factor of sqrt(2)."""
    r = np.random.default_rng(5)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 != 2]
    say = lambda: " ".join(f"w{x}" for x in r.zipf(1.3, 120) % 5000)
    texts = {i: say() for i in train[:200]}
    again = {j: texts[i] for i, j in zip(train[:20], train[200:220], strict=True)}
    held = {i: say() for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2}
    docs = spark.createDataFrame([*texts.items(), *again.items(), *held.items()], "doc_id long, text string")
    score = {x["doc_id"]: x["score"] / x["n_tokens"] for x in lm_score.score_documents(docs).collect()}
    twice, once, never = ([score[i] for i in ids] for ids in (again, train[20:200], held))
    assert min(twice) > np.median(once) > max(never)
    c = np.arange(1, 5000)
    ratio = lm_score.expected(lm_score.levels(c)) / c
    assert ratio.max() < 1.42 and ratio.min() > 1 / 1.42

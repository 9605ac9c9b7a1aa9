"""The chain of toxicity models against a plain dense version with features by name."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import toxicity as T


def plain_features(text):
    """Words, beginnings of words ('~'), beginnings that two distinct words have ('~~'), and the text's shape."""
    words = re.findall(r"\w+", (text or "").lower())
    n, kinds, out = max(1, len(words)), sorted(set(words)), set(words)
    for k in (4, 5, 6, 7, 8):
        starts = [w[:k] for w in kinds if len(w) > k]
        out |= {f"{s}~" for s in starts} | {f"{s}~~" for s in starts if starts.count(s) > 1}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    lines = (text or "").count("\n")
    return out | {f"\0length {n.bit_length()}", f"\0distinct {10 * len(kinds) // n}", f"\0symbols {min(9, 20 * symbols // n)}", f"\0lines {min(9, 40 * lines // n)}"}


def plain_fit(x, earlier, y):
    """(bias, weights, weights of earlier probabilities) by full gradient steps."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    n, n1, have = len(y), y.sum(), x.sum(axis=0)
    hit = x.T @ y
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = n * (hit * n - have * n1) ** 2 / (have * n1 * (n - have) * (n - n1))
    chosen = (have >= 4) & (hit * n > have * n1) & (chi >= 20)
    bias, w, e = math.log(rate / (1 - rate)), np.zeros(x.shape[1]), np.zeros(earlier.shape[1])
    sw, se, sb = np.full(x.shape[1], 1e-8), np.full(earlier.shape[1], 1e-8), 1e-8
    for _ in range(120):
        g = y - 1 / (1 + np.exp(-np.clip(bias + x @ w + earlier @ e, -30, 30)))
        gw, ge, gb = np.where(chosen, x.T @ g / n - 1e-3 * w, 0), earlier.T @ g / n - 1e-3 * e, g.mean()
        sw, se, sb = sw + gw**2, se + ge**2, sb + gb**2
        w, e, bias = w + 0.2 * gw / np.sqrt(sw), e + 0.1 * ge / np.sqrt(se), bias + 0.1 * gb / math.sqrt(sb)
    return bias, w, e


def plain_chain(texts, labels, asked):
    """Probabilities of the ``asked`` texts by a chain fitted to texts and labels (documents x categories)."""
    found = [plain_features(t) for t in texts]
    names = sorted({f for s in found for f in s})
    names = [f for f in names if sum(f in s for s in found) >= 4]
    dense = lambda sets: np.array([[f in s for f in names] for s in sets], float).reshape(len(sets), len(names))
    x, q, fold = dense(found), dense([plain_features(t) for t in asked]), np.arange(len(texts)) % 5
    earlier, p = np.zeros((len(texts), 0)), np.zeros((len(asked), 0))
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    for k in range(labels.shape[1]):
        y, out = labels[:, k].astype(float), np.zeros(len(texts))
        for f in range(5):
            bias, w, e = plain_fit(x[fold != f], earlier[fold != f], y[fold != f])
            out[fold == f] = sigmoid(bias + x[fold == f] @ w + earlier[fold == f] @ e)
        bias, w, e = plain_fit(x, earlier, y)
        p = np.column_stack((p, sigmoid(np.clip(bias + q @ w + p @ e, -30, 30))))
        earlier = np.column_stack((earlier, out))
    return p


def test_chain_equals_the_plain_version(spark):
    r = random.Random(11)
    calm, rude = [f"calm{i}word" for i in range(60)], ["idiotic", "idiots", "scum", "scummy", "vermin"]
    data, labels = [], []
    for i in range(260):
        toxic = r.random() < 0.35
        junk = r.random() < 0.4
        words = [r.choice(calm) for _ in range(r.randint(3, 40))] + [r.choice(rude) for _ in range(r.randint(1, 4) * toxic)] + ["$$$ <b>", "BUYnow"] * (2 * junk)
        r.shuffle(words)
        data.append((i, r.choice([" ", "\n"]).join(words)))
        labels.append((i, int(not junk), int(toxic)))
    data += [(1000, None), (1001, ""), (1002, "Scum! idiots " * 50), (None, "vermin"), (3, data[3][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    order = [x["doc_id"] for x in known.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    text, label = dict(data), {i: (t, t * (1 - q)) for i, q, t in labels}
    want = plain_chain([text[i] for i in order], np.array([label[i] for i in order]), [t for _, t in data])
    got = T.score(docs.coalesce(1), *T.fit(T.sample(docs, known))).collect()
    assert [x["doc_id"] for x in got] == [i for i, _ in data]
    for x, p in zip(got, want, strict=True):
        assert (x["p_toxic"], x["p_toxic_junk"]) == pytest.approx(tuple(p), abs=1e-7)
    assert sum(x["toxic"] for x in got) > 50 and got[-3]["toxic"]


def test_clashing_columns_and_ties(spark, tmp_path):
    """Other columns don't matter, equal rows get equal scores, rows of one id are scored each."""
    rows = [(i % 7 if i % 5 else None, ["scum idiot", "calm day", None][i % 3], "x", 0.5, True) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic string, p_toxic double, features boolean")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(7)] + [(3, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = T.op9_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 60 and {c for c in got[0].asDict()} == {"doc_id", "p_toxic", "toxic", "p_toxic_junk", "toxic_junk"}
    assert len({(x["p_toxic"], x["p_toxic_junk"]) for x in got}) <= 3

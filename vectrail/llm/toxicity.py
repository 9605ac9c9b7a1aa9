"""Toxicity by a classifier chain of linear models over words.

Categories are predicted one after the other; the probabilities of the earlier ones are
features of the later ones. While training, those come from models that did not see the
document (out of fold), so a later model learns how far an earlier one can be trusted.

The models are fitted on at most ``SAMPLE`` labelled documents, the first by hash of their
id, and of these on as many as have ``ENTRIES`` features together, in one task on an executor;
all their words are features. The models' non-zero weights, at most ``SPACE`` numbers a
category, are broadcast; every document is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, table

SAMPLE, ENTRIES, LEAST_DOCS, FOLDS = 12_000, 24_000_000, 4, 5
#: The chain: category and its label (0 or 1) as SQL over the label columns. The labels know
#: toxic texts, and of these the ones that are junk besides.
CHAIN = {"toxic": "toxic", "toxic_junk": "toxic * (1 - quality)"}
#: Features are words and word beginnings, hashed to SPACE even numbers; the odd number
#: after a beginning says that two distinct words or more have it.
SPACE, BEGINNINGS = 1 << 21, (4, 5, 6, 7, 8)
#: A feature enters a model if its association with the label has this chi-square at least.
CHI_SQUARE = 20.0
ROUNDS, RIDGE = 120, 1e-3

WORD = re.compile(r"\w+")


class Features(dict):
    """Feature numbers of words, kept for words that come again; bounded."""

    LIMIT = 200_000

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.LIMIT:
            self.clear()
        parts = [word, *[f"{word[:k]}~" for k in BEGINNINGS if len(word) > k]]
        f = self[word] = tuple(zlib.crc32(p.encode()) % SPACE & ~1 for p in parts)
        return f


def signals(text: str, words: list[str], distinct: int) -> list[int]:
    """Feature numbers of a text's shape: length, share of distinct words, symbols, line breaks."""
    n = max(len(words), 1)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    shape = (f"length {n.bit_length()}", f"distinct {10 * distinct // n}", f"symbols {min(9, 20 * symbols // n)}", f"lines {min(9, 40 * text.count(chr(10)) // n)}")
    return [zlib.crc32(f"\0{x}".encode()) % SPACE & ~1 for x in shape]


def features_of(text: str, cache: Features) -> np.ndarray:
    """Sorted feature numbers of a text."""
    words = WORD.findall(text.lower())
    distinct = set(words)
    often = Counter(f for w in distinct for f in cache[w])
    return np.array(sorted({*often, *[f + 1 for f, n in often.items() if n > 1], *signals(text, words, len(distinct))}), np.int32)


@dataclass
class Model:
    """log odds = bias + sum of word weights + sum of earlier probabilities times their weights."""

    bias: float
    weights: np.ndarray
    earlier: np.ndarray
    cutoff: float = 0.5


def _odds(starts: np.ndarray, cols: np.ndarray, extra: np.ndarray, m: Model) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(m.weights[cols])))
    return m.bias + sums[starts[1:]] - sums[starts[:-1]] + extra @ m.earlier


def associated(starts: np.ndarray, cols: np.ndarray, y: np.ndarray, n_features: int) -> np.ndarray:
    """Which features go with the label, by chi-square of presence."""
    n, n1 = len(y), y.sum()
    have = np.bincount(cols, minlength=n_features).astype(float)
    hit = np.bincount(cols, np.repeat(y, np.diff(starts)), n_features)
    delta = hit * n - have * n1
    below = have * n1 * (n - have) * (n - n1)
    chi = np.where((delta > 0) & (below > 0), n * delta**2 / np.maximum(below, 1), 0.0)
    chi[have < LEAST_DOCS] = 0
    return chi >= CHI_SQUARE


def _fit(starts: np.ndarray, cols: np.ndarray, extra: np.ndarray, y: np.ndarray, n_features: int) -> Model:
    """Logistic regression on associated features by Adagrad steps, with a ridge penalty."""
    rate = min(max(y.mean() if len(y) else 0.0, 1e-3), 1 - 1e-3)
    m = Model(math.log(rate / (1 - rate)), np.zeros(n_features), np.zeros(extra.shape[1]))
    if not len(y):
        return m
    chosen = associated(starts, cols, y, n_features)
    kept = chosen[cols]
    starts, cols = np.concatenate(([0], np.cumsum(kept)))[starts], cols[kept]
    n, size = len(y), np.diff(starts)
    seen_w, seen_e, seen_b = np.full(n_features, 1e-8), np.full(extra.shape[1], 1e-8), 1e-8
    for _ in range(ROUNDS):
        g = y - 1 / (1 + np.exp(-np.clip(_odds(starts, cols, extra, m), -30, 30)))
        gw = np.bincount(cols, np.repeat(g, size), n_features) / n - RIDGE * m.weights
        ge, gb = extra.T @ g / n - RIDGE * m.earlier, g.mean()
        seen_w, seen_e, seen_b = seen_w + gw**2, seen_e + ge**2, seen_b + gb**2
        m.weights = m.weights + np.where(chosen, 0.2 * gw / np.sqrt(seen_w), 0.0)
        m.earlier, m.bias = m.earlier + 0.1 * ge / np.sqrt(seen_e), m.bias + 0.1 * gb / math.sqrt(seen_b)
    return m


def _rows(starts: np.ndarray, cols: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.diff(starts)
    return np.concatenate(([0], np.cumsum(size[keep]))), cols[np.repeat(keep, size)]


def _best_cutoff(p: np.ndarray, y: np.ndarray) -> float:
    """The cutoff with the best F1 on out-of-fold probabilities, half-way to the next one."""
    if not y.any() or y.all():
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    after = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(min(max((p[order[k]] + after) / 2, 0.05), 0.95))


def train_chain(docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, list[Model], np.ndarray]:
    """Feature numbers, chain of models and out-of-fold probabilities for documents x categories."""
    starts = np.concatenate(([0], np.cumsum([len(r) for r in docs]))).astype(np.int64)
    cols = np.concatenate(docs) if docs else np.zeros(0, np.int32)
    vocabulary = np.flatnonzero(np.bincount(cols, minlength=SPACE) >= LEAST_DOCS)
    place = np.full(SPACE, -1, np.int32)
    place[vocabulary] = np.arange(len(vocabulary))
    cols = place[cols]
    starts, cols = np.concatenate(([0], np.cumsum(cols >= 0)))[starts], cols[cols >= 0]
    fold = np.arange(len(docs)) % FOLDS
    extra, models, out = np.zeros((len(docs), 0)), [], np.zeros(labels.shape)
    for k in range(labels.shape[1]):
        y, odds = labels[:, k].astype(float), np.zeros(len(docs))
        for f in range(FOLDS):
            inside = fold != f
            if inside.any() and (~inside).any():
                m = _fit(*_rows(starts, cols, inside), extra[inside], y[inside], len(vocabulary))
                odds[~inside] = _odds(*_rows(starts, cols, ~inside), extra[~inside], m)
        out[:, k] = 1 / (1 + np.exp(-odds))
        model = _fit(starts, cols, extra, y, len(vocabulary))
        model.cutoff = _best_cutoff(out[:, k], y)
        models.append(model)
        extra = np.column_stack([extra, out[:, k]])
    return vocabulary, models, out


MODEL = "feature long, weights array<double>"


def sample(docs: DataFrame, labels: DataFrame, chain: dict[str, str] = CHAIN, size: int = SAMPLE) -> DataFrame:
    """(id, features, labels...) of at most ``size`` labelled documents, the first by hash of the id.

    Label rows of an id that disagree or are null, and null ids, are left out. Of documents
    that share an id one counts, that with the smallest features, so reruns agree.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id")
    known = known.agg(*[f(F.expr(e)).alias(f"{k}_{n}") for k, e in chain.items() for n, f in (("lo", F.min), ("hi", F.max))])
    known = known.where(" AND ".join(f"{k}_lo = {k}_hi" for k in chain))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size).select(F.col("doc_id").alias("_id"), *[F.col(f"{k}_lo").cast("int").alias(k) for k in chain])
    picked = materialize(picked, "label-sample")
    d = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))  # at most `size` rows

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Features()
        for batch in batches:
            found = pa.array([features_of(t, cache).tobytes() for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), found, *batch.columns[2:]], names=["id", "features", *chain])

    rows = d.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("features"), *chain)
    rows = rows.mapInArrow(featurise, rows.withColumn("features", F.lit(None).cast("binary")).schema)
    return rows.groupBy("id").agg(F.min(F.struct("features", *chain)).alias("x")).select("id", "x.*")


def fit(rows: DataFrame, chain: dict[str, str] = CHAIN, entries: int = ENTRIES) -> tuple[dict[int, np.ndarray], list[tuple[float, np.ndarray, float]]]:
    """Weights by feature and (bias, weights of earlier categories, cutoff) by category, fitted in one task on ``sample``.

    The task takes rows by hash of the id until they have ``entries`` features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, labels, room = [], [], entries
        for batch in batches:
            for data, *y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                room -= len(data) // 4
                if room >= 0:
                    docs.append(np.frombuffer(data, np.int32))
                    labels.append(y)
        vocabulary, models, _ = train_chain(docs, np.array(labels, np.int64).reshape(-1, len(chain)))
        used = np.flatnonzero(np.any([m.weights != 0 for m in models], axis=0))
        out = [(int(vocabulary[i]), [float(m.weights[i]) for m in models]) for i in used]
        out += [(-1 - k, [m.bias, m.cutoff, *map(float, m.earlier)]) for k, m in enumerate(models)]
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.int64()), pa.array([w for _, w in out], pa.list_(pa.float64()))], names=["feature", "weights"])

    one = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").select("features", *chain)
    found = {r["feature"]: np.array(r["weights"]) for r in one.mapInArrow(run, MODEL).collect()}
    heads = [found.pop(-1 - k, np.zeros(2 + k)) for k in range(len(chain))]
    return found, [(float(h[0]), h[2:], float(h[1]) or 0.5) for h in heads]


def score(docs: DataFrame, weights_of: dict[int, np.ndarray], heads_of: list[tuple[float, np.ndarray, float]], chain: dict[str, str] = CHAIN, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and per category p_<category> and <category> (boolean) of each document."""
    sent = docs.sparkSession.sparkContext.broadcast((weights_of, heads_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, heads = sent.value
        wanted = {f & ~1 for f in weights}
        every, cache = Features(), {}

        def some(word: str) -> tuple[int, ...]:
            if len(cache) >= Features.LIMIT:
                cache.clear()
            f = cache[word] = tuple(x for x in every.__missing__(word) if x in wanted)
            return f

        for batch in batches:
            odds = np.zeros((batch.num_rows, len(heads)))
            for i, text in enumerate(batch.column(len(keep)).to_pylist()):
                often: dict[int, int] = {}
                words = WORD.findall(text.lower())
                distinct = set(words)
                for w in distinct:
                    f = cache.get(w)
                    for x in some(w) if f is None else f:
                        often[x] = often.get(x, 0) + 1
                for x in signals(text, words, len(distinct)):
                    often.setdefault(x, 1)
                own = [weights[x] for x in often if x in weights] + [weights[x + 1] for x, n in often.items() if n > 1 and x + 1 in weights]
                if own:
                    odds[i] = np.sum(own, axis=0)
            p = np.zeros_like(odds)
            for k, (bias, earlier, _) in enumerate(heads):
                p[:, k] = 1 / (1 + np.exp(-np.clip(odds[:, k] + bias + p[:, :k] @ earlier, -30, 30)))
            out = [a for k, h in enumerate(heads) for a in (pa.array(p[:, k]), pa.array(p[:, k] >= h[2]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], names=[*keep, *[n for k in chain for n in (f"p_{k}", k)]])

    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    schema = docs.select(*keep, *[F.lit(None).cast(t).alias(n) for k in chain for n, t in ((f"p_{k}", "double"), (k, "boolean"))]).schema
    return d.mapInArrow(run, schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability and verdict per category of every document.

    Null and empty texts get the models' biases. Repeated rows are scored each, equal texts
    alike. A probability at the cutoff counts as the category. Only doc_id and text are read,
    so other columns don't matter. An empty table gives no rows; without labels nothing is
    toxic (probability 0.001).
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, *fit(sample(docs, table(spark, sf_dir, "labels"))))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLES: dict[str, str] = {}

"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.rows import documents, frame, stored
from vectrail.llm import collocations as C

EXTRA = ("k", 1, "s", "t", "kept", 5, "r")


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for w in pieces(text):
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, top=2000):
    f, n = counts(rows)
    candidates = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= 30}
    gone = {(lang, p[i : i + k]) for (lang, p), b in candidates.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= 80 * f[lang, p[i : i + k]]}
    scored = []
    for (lang, p), a in candidates.items():
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        if (lang, p) not in gone:
            scored.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, rank = [], Counter()
    for lang, s, a, p, left, right in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def texts(seed=5, n=3000):
    r = random.Random(seed)
    words = ["The", "of", "new york", "NEW YORK city hall", "x", "Über", "a\tb", "日本 語", "machine learning model zoo", "ß", "\x00", "e\x1fe", "don't"]
    rows = []
    for i in range(n):
        t = "".join(r.choice(words) + r.choice([" ", "  ", " ", " ", " ", " ", ". ", ",", "\n", "\r\n", " \x0b", "?", "-"]) for _ in range(r.randint(0, 40)))
        rows.append((i, t, r.choice(["en", "en", "en", "de", None, "und", "a\nb"]), None, 0, *EXTRA))
    return rows + [(n, None, "en", None, 0, *EXTRA), (n, "", None, None, 0, *EXTRA), (n, "la la " * 9000, "fr", None, 0, *EXTRA), (n, "one " * 45, "it", None, 0, *EXTRA)]


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


@pytest.mark.parametrize("limit,range_bytes", [(1 << 20, 1 << 20), (97, 2000)])
def test_equals_plain_counting(spark, limit, range_bytes):
    rows = texts()
    want = plain(rows)
    assert len(want) > 100 and len({w[0] for w in want}) >= 5
    assert rows_of(C.collocations(frame(spark, rows), limit=limit, range_bytes=range_bytes)) == want


def test_rank_limit(spark):
    rows = texts(8)
    assert rows_of(C.collocations(frame(spark, rows), top=7)) == plain(rows, 7)


def test_awkward_rows(spark, tmp_path):
    rows = documents() * 3
    found = C.op12_collocations(spark, stored(frame(spark, rows), tmp_path))
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(found) == plain(rows)


def test_empty_table(spark):
    assert C.collocations(frame(spark, [])).collect() == []
    assert C.collocations(frame(spark, [(1, None, None, None, 0, *EXTRA)])).collect() == []


def test_longer_phrase_replaces_its_parts(spark):
    rows = [(i, "red green blue", "en", None, 0, *EXTRA) for i in range(80)] + [(i, "red green", "en", None, 0, *EXTRA) for i in range(20)]
    assert [(r[2], r[3]) for r in rows_of(C.collocations(frame(spark, rows)))] == [("red green blue", 80)]  # 80 of 100 is enough
    rows.append((0, "red green", "en", None, 0, *EXTRA))
    assert [(r[2], r[3]) for r in rows_of(C.collocations(frame(spark, rows)))] == [("red green", 101), ("red green blue", 80)]


@pytest.mark.parametrize("limit", [1, 3, 5, 64, 10_000])
def test_shards_count_every_phrase_once(limit, monkeypatch):
    monkeypatch.setattr(C, "SLICE", 37)
    rows = texts(2, 40)
    f, _ = counts(rows)
    batch = pa.RecordBatch.from_arrays([pa.array(["und" if r[2] is None else r[2] for r in rows]), pa.array([(r[1] or "").encode() for r in rows])], names=["lang", "text"])
    got = Counter()
    for shard in C.shards(iter([batch]), limit):
        ids, starts = shard.sequence()
        of, names = shard.bounds()
        for k, at, n in C.intervals(ids, starts):
            for p, c in zip(at.tolist(), n.tolist(), strict=True):
                got[names[of[ids[p]]], tuple(shard.words[i].decode() for i in ids[p : p + k])] += c
    assert got == f


def test_order_and_common_prefixes():
    r = np.random.default_rng(2)
    ids = r.integers(0, 4, 300).astype(np.int32)
    order, common = C.suffix_order(ids)
    suffix = lambda i: tuple(ids[i : i + 4]) + (-1,) * (i + 4 - len(ids))
    assert [suffix(i) for i in order] == sorted(map(suffix, range(len(ids))))
    for a, b, c in zip(order, order[1:], common[1:], strict=False):
        same = 0
        while same < 4 and suffix(a)[same] == suffix(b)[same] > 0:
            same += 1
        assert same == c

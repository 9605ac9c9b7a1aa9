"""All spans of personal data against a plain model: candidates, votes, reliabilities, classifier."""

from collections import Counter

import numpy as np
import pytest
import regex

from tests.llm import rows
from tests.llm.test_rest import PRIVATE, plain_spans
from vectrail.llm import pii

A = regex.ASCII
MORE = ["tel (555) 010-9999, fax: 555 010 9999 or 1-555-010-9999x", "order 4111111111111112 card 4111111111111112", "set password: hunter2hunter2 and token=abcdefgh", "version 10.0.0.1, from 8.8.8.8 server 0.1.2.3", "isbn 9780306406157001 konto 9780306406157002"]


def digits(m):
    return regex.sub("[^0-9]", "", m)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_candidates(text):
    """[(kind, start, end, base, votes)] by kind, then start."""
    text = text or ""
    base = {k: [] for k in pii.BASE}
    for k, a, b in plain_spans(text):
        base[k].append((a, b))
    spans = lambda p, flags=0: [(m.start(), m.end()) for m in regex.finditer(p, text, A | flags)]
    runs = [(a, b) for a, b in spans(r"[0-9](?:[\x20-]?[0-9])+") if 13 <= len(digits(text[a:b])) <= 19]
    found = {**base, "account": [(a, b) for a, b in runs if not luhn(digits(text[a:b]))], "tel": spans(pii.TEL), "secret": spans(pii.SECRET)}
    has = lambda p, m: bool(regex.search(p, m, A))
    sign = lambda yes: 1 if yes else -1
    out = []
    for kind in pii.KINDS:
        for a, b in found[kind]:
            m, before, after = text[a:b], text[max(0, a - 24) : a], text[b : b + 1]
            form = {"account": -1, "secret": sign(has("[0-9]", m))}.get(kind, 1)
            known = {
                "email": lambda m: int(has(pii.PROVIDERS, m)), "ip": lambda m: sign(not has(pii.RESERVED_NETS, m)), "phone": lambda m: sign(has(pii.COUNTRY_CODES, m)),
                "tel": lambda m: int(m.startswith("(")), "secret": lambda m: sign(has(pii.KEY_NAMES, m)),
            }.get(kind, lambda m: sign(has(pii.ISSUERS, digits(m))))(m)
            context = 1 if has(pii.CUES[kind], before) else -1 if has(pii.AGAINST, before) else 0
            touches = has("[A-Za-z0-9]$", before) or has("^[A-Za-z0-9]", after)
            out.append((kind, a, b, kind in pii.BASE, (form, known, context, -1 if touches else 1)))
    return out


def plain_accepts(texts):
    """Whether a (kind, votes) pattern is kept: EM over all spans one by one, then logistic regression on the posteriors."""
    n = Counter((k, v) for t in texts for k, _, _, _, v in plain_candidates(t))
    patterns = sorted(n)
    if not patterns:
        return {}
    count = np.array([n[p] for p in patterns], float)
    votes = np.array([v for _, v in patterns])
    kinds = np.array([pii.KINDS.index(k) for k, _ in patterns])
    post = np.clip(0.5 + votes.sum(axis=1) / 8.0, 0.1, 0.9)
    for _ in range(60):
        odds = np.zeros(len(patterns))
        for k in set(kinds.tolist()):
            of = kinds == k
            prior = (1 + (post * count)[of].sum()) / (2 + count[of].sum())
            odds[of] += np.log(prior / (1 - prior))
        for j in range(4):
            yes = np.array([1 + (post * count)[votes[:, j] == x].sum() for x in (-1, 0, 1)])
            no = np.array([1 + ((1 - post) * count)[votes[:, j] == x].sum() for x in (-1, 0, 1)])
            odds += (np.log(yes / yes.sum()) - np.log(no / no.sum()))[votes[:, j] + 1]
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    x = np.column_stack((np.eye(len(pii.KINDS))[kinds], *[votes[:, j] == s for j in range(4) for s in (1, -1)])).astype(float)
    w, weight = np.zeros(x.shape[1]), np.sqrt(count)
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += 0.5 * (4 * (x.T @ (weight * (post - p))) / weight.sum() - 0.001 * w)
    return dict(zip(patterns, (x @ w).tolist(), strict=True))


@pytest.mark.parametrize("source", ["awkward", "sf"])
def test_spans_equal_the_plain_model(spark, sf, tmp_path, source):
    extra = [(1000 + i, t, "en", "web", len(t), "k", 1, "s", "t", "kept", 5, "r") for i, t in enumerate(PRIVATE + MORE)]
    where = sf if source == "sf" else rows.stored(rows.frame(spark, rows.documents() + extra), tmp_path)
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    score = plain_accepts([t for _, t in data])
    assert min(map(abs, score.values())) > 1e-9
    want = [(i, ",".join(f"{k}:{a}:{b}" for k, a, b, base, v in plain_candidates(t) if base or score[k, v] > 0)) for i, t in data]
    assert rows.found(pii.op8_pii_spans(spark, where), "doc_id", "spans") == sorted(want, key=repr)
    assert {k for k, _ in score} >= ({*pii.KINDS} if source == "awkward" else {"email", "card"})

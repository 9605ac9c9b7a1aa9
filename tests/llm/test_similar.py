"""Groups of similar shingle sets against all pairs."""

import numpy as np
import pytest

from vectrail.llm import simhash


def plain(sets, sides, similarity):
    """Each set's group, named by its first member, by joining all similar pairs (across sides where given)."""
    label = list(range(len(sets)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sides is not None and sides[i] == sides[j]:
                continue
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if a and b and len(a & b) >= similarity * len(a | b) - 1e-9:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(sets))]


@pytest.mark.parametrize("similarity", [0.5, 0.8, 1.0])
def test_equals_all_pairs(similarity):
    r = np.random.default_rng(7)
    joined = 0
    for _ in range(60):
        bases = [r.integers(0, 60, r.integers(1, 30)) for _ in range(4)]
        sets = []
        for _ in range(r.integers(2, 40)):
            x = bases[r.integers(4)].copy()
            x[r.integers(0, len(x), r.integers(0, 4))] = r.integers(0, 80)
            sets.append(np.unique(x).astype(np.uint64) if r.random() > 0.05 else np.zeros(0, np.uint64))
        if not any(map(len, sets)):
            continue
        for sides in (None, r.integers(0, 2, len(sets))):
            members, firsts = simhash.similar(sets, sides, similarity)
            want = plain(sets, sides, similarity)
            got = list(range(len(sets)))
            for a, b in zip(members.tolist(), firsts.tolist(), strict=True):
                got[a] = b
            same = lambda x: [[i == j for j in x] for i in x]
            assert same(got) == same(want)
            joined += len(members)
    assert joined > 100


def test_a_common_passage_makes_no_comparisons(monkeypatch):
    r = np.random.default_rng(1)
    shared = r.integers(0, 2**60, 100)
    sets = [np.unique(np.concatenate((shared, r.integers(0, 2**60, 200)))).astype(np.uint64) for _ in range(300)]
    calls = []
    monkeypatch.setattr(simhash, "_merge", lambda *a: calls.append(a))
    assert len(simhash.similar(sets, None, 0.8)[0]) == 0 and not calls

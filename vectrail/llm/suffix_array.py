"""Suffix arrays of shards of text by induced sorting, and permuted common prefixes.

The steps are those of the linear-time construction, each over whole arrays: suffixes are
classified as smaller (S) or larger (L) than their right neighbour; the leftmost-smaller
(LMS) positions cut the text into substrings, which are named in sorted order; the string
of names is sorted by prefix doubling, each round ordering runs of twice as many names among
those still tied (not by a second induction: its buckets are as many as the names, each a
step of its own); and from the order of the LMS suffixes the order of all L and then all S suffixes is induced, bucket
by bucket from one end of the alphabet to the other.
"""

from __future__ import annotations

import numpy as np


def classify(t: np.ndarray) -> np.ndarray:
    """Whether the suffix at each position is smaller than its right neighbour (S)."""
    n = len(t)
    less = np.zeros(n, bool)
    less[:-1] = t[:-1] < t[1:]
    # equal neighbours are of the type that follows the run
    differs = np.ones(n, bool)
    differs[:-1] = t[:-1] != t[1:]
    at = np.where(differs, np.arange(n), n - 1)
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return less[nearest]


def _name(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ranks of substrings codes[start : end + 1]; equal ones share the first rank of the group."""
    per, bits = 6, 10
    rank, size, at = np.zeros(len(starts), np.int64), ends - starts + 1, 0
    active = np.arange(len(starts))
    while len(active):
        word = np.zeros(len(active), np.int64)
        for k in range(per):
            p = starts[active] + at + k
            word = word << bits | np.where(at + k < size[active], codes[np.minimum(p, len(codes) - 1)] + 1, 0)
        order = np.lexsort((word, rank[active]))
        a, w = active[order], word[order]
        r = rank[a]
        group = np.concatenate(([True], r[1:] != r[:-1]))
        new = group | np.concatenate(([True], w[1:] != w[:-1]))
        begin = np.maximum.accumulate(np.where(group, np.arange(len(a)), 0))
        place = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        rank[a] = r + place - begin
        at += per
        active = active[size[active] > at]
    return rank


def _sort_names(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of ranks, by rounds over those still tied."""
    n, step = len(rank), 1
    rank = rank.copy()
    while True:
        count = np.bincount(rank, minlength=n)
        active = np.flatnonzero(count[rank] > 1)
        if not len(active):
            return np.argsort(rank, kind="stable")
        follow = np.where(active + step < n, rank[np.minimum(active + step, n - 1)] + 1, 0)
        order = np.lexsort((follow, rank[active]))
        a, f = active[order], follow[order]
        r = rank[a]
        group = np.concatenate(([True], r[1:] != r[:-1]))
        new = group | np.concatenate(([True], f[1:] != f[:-1]))
        begin = np.maximum.accumulate(np.where(group, np.arange(len(a)), 0))
        place = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        rank[a] = r + place - begin
        step *= 2


def _deal(j: np.ndarray, chars: np.ndarray, to: list[list[np.ndarray]], low: int, high: int) -> None:
    """Append positions to the buckets of their characters, in order."""
    order = np.argsort(chars, kind="stable")
    j, chars = j[order], chars[order]
    cuts = np.searchsorted(chars, np.arange(low, high + 2))
    for c in range(low, high + 1):
        if cuts[c - low] < cuts[c - low + 1]:
            to[c].append(j[cuts[c - low] : cuts[c - low + 1]])


def suffix_array(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, suffix array) of the pieces, joined with a separator after each.

    Separators are smaller than all bytes and ordered among themselves by position, so no
    two suffixes are equal and no common prefix goes beyond a piece. In ``text`` bytes are
    1 to 256 and separators 0.
    """
    joined = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    ends = np.cumsum([len(p) + 1 for p in pieces]) - 1
    t = joined.astype(np.int16) + 1
    t[ends] = 0
    n = len(t)
    smaller = classify(t)
    smaller[ends] = True  # the last separator, too, stands before everything
    lms = np.flatnonzero(smaller & np.concatenate(([False], ~smaller[:-1])) | (t == 0))
    codes = t.astype(np.int64) * 2 + smaller
    # a separator's name is its own, and ends the substring before it
    upto = np.append(lms[1:], n - 1)
    rank = np.zeros(len(lms), np.int64)
    sep = t[lms] == 0
    rank[sep] = np.arange(sep.sum())
    rank[~sep] = sep.sum() + _name(codes, lms[~sep], upto[~sep])
    order = lms[_sort_names(rank)]
    # induce L from the LMS suffixes, from the smallest character on
    by_char = np.searchsorted(t[order], np.arange(258))
    large: list[list[np.ndarray]] = [[] for _ in range(257)]

    def induce(i: np.ndarray, wanted: bool, to: list[list[np.ndarray]], low: int, high: int) -> None:
        j = i[i > 0] - 1
        j = j[(smaller[j] == wanted) & (t[j] > 0)]
        if len(j):
            _deal(j, t[j].astype(np.uint16), to, low, high)

    sorted_large: list[np.ndarray] = []
    for c in range(257):
        done = 0
        while done < len(large[c]):  # a run of one character induces its own bucket
            done += 1
            induce(large[c][done - 1], False, large, c, 256)
        sorted_large.append(np.concatenate(large[c]) if large[c] else np.zeros(0, np.int64))
        induce(order[by_char[c] : by_char[c + 1]], False, large, c, 256)
    # induce S from the L suffixes, from the largest character down
    small: list[list[np.ndarray]] = [[] for _ in range(257)]
    out: list[np.ndarray] = []
    for c in range(256, 0, -1):
        done = 0
        while done < len(small[c]):
            done += 1
            induce(small[c][done - 1], True, small, 1, c)
        down = np.concatenate(small[c]) if small[c] else np.zeros(0, np.int64)
        induce(sorted_large[c][::-1], True, small, 1, c)
        out.append(down[::-1])
        out.append(sorted_large[c])
    out.append(order[by_char[0] : by_char[1]])
    return t, np.concatenate(out[::-1])


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phi, common prefix with phi) by text position; phi is the suffix before it in order.

    Where the characters before a suffix and its phi are equal, the common prefix is one
    shorter than that of the position before; only the other, irreducible ones are compared,
    eight bytes at a time. Separators end every common prefix.
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    before = np.concatenate(([-1], t[:-1]))
    irreducible = (phi < 0) | (before != before[phi]) | (before == 0)
    at = np.flatnonzero(irreducible & (phi >= 0))
    other, length = phi[at], np.zeros(n, np.int64)
    wide = np.concatenate((t.astype(np.int64), np.zeros(8, np.int64)))
    active, k = np.arange(len(at)), 0
    while len(active):
        a, b, alive = at[active] + k, other[active] + k, np.ones(len(active), bool)
        for step in range(8):
            x, y = wide[np.minimum(a + step, n)], wide[np.minimum(b + step, n)]
            alive &= (x == y) & (x > 0)
            length[at[active[alive]]] += 1
        active, k = active[alive], k + 8
    source = np.maximum.accumulate(np.where(irreducible, np.arange(n), 0))
    lcp = np.maximum(length[source] - (np.arange(n) - source), 0)
    lcp[phi < 0] = 0
    return phi, lcp

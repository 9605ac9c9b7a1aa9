"""Near-duplicates, suffix-array and substring deduplication against brute force."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import rows
from vectrail.llm import components, simhash, substring_dedup, suffix_array, suffix_dedup


def plain_fingerprint(text, k):
    w = [x.lower() for x in rows.words(text)]
    grams = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([b" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(prints, radius):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("source", ["awkward", "sf"])
def test_op1(spark, sf, tmp_path, source):
    docs = rows.frame(spark) if source == "awkward" else spark.read.parquet(f"{sf}/documents.parquet")
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    prints = [plain_fingerprint(t, 4) for _, t in data]
    low = defaultdict(lambda: None)
    roots = plain_components(prints, 4)
    for (i, _), c in zip(data, roots, strict=True):
        if i is not None:
            low[c] = i if low[c] is None else min(i, low[c])
    want = sorted(((i, f"{p:016x}", low[c]) for (i, _), p, c in zip(data, prints, roots, strict=True)), key=repr)
    got = simhash.op1_simhash(spark, rows.stored(docs, tmp_path))
    assert rows.found(got, "doc_id", "fingerprint", "component_id") == want


def test_bucket_of_many_blocks(spark):
    """A bucket beyond the block size is cut into pairs of blocks and loses no link."""
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 12, 400, dtype=np.int64)  # all agree on the upper bits
    df = spark.createDataFrame([(int(p), int(p)) for p in set(prints.tolist())], "node long, f0 long")
    found = components.components(simhash.links(df, 1, 2, simhash.exact_tables(2, 4), block=16))
    values = sorted(set(prints.tolist()))
    roots = plain_components(values, 2)
    groups = defaultdict(set)
    for v, c in zip(values, roots, strict=True):
        groups[c].add(v)
    ours = defaultdict(set)
    for r in found.collect():
        ours[r["root"]].add(r["node"])
    assert sorted(map(sorted, ours.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_exact_tables_lose_nothing():
    """Any 4 flipped bits leave one table whole."""
    tables, rng = simhash.exact_tables(), np.random.default_rng(1)
    for _ in range(300):
        flipped = set(rng.choice(64, 4, replace=False).tolist())
        assert any(not flipped & set(t) for t in tables)


def test_near_copies_go(spark):
    """Of each group of near-copies the smallest id stays; distinct texts all stay; columns stay."""
    r = np.random.default_rng(5)
    base = [" ".join(f"v{x}" for x in r.integers(0, 5000, 300)) for _ in range(30)]
    data = []
    for i, t in enumerate(base):
        data.append((i, t))
        if i < 12:
            w = t.split()
            w[150] = "changed"
            data += [(100 + i, " ".join(w)), (200 + i, t)]
    clash = ("en", "web", 1, "k", 1, "s", "t", "kept", 5, "r")
    out = simhash.drop_near_copies(rows.frame(spark, [(*x, *clash) for x in data]))
    assert sorted(x["doc_id"] for x in out.collect()) == list(range(30))
    assert out.columns == rows.frame(spark, []).columns
    assert simhash.drop_near_copies(rows.frame(spark, [])).count() == 0
    awkward = simhash.drop_near_copies(rows.frame(spark))
    assert awkward.where("trim(coalesce(text, '')) = ''").count() == 1


def test_unrelated_texts_without_own_id_stay(spark):
    """Null or shared ids don't make one group of distinct texts."""
    r = np.random.default_rng(6)
    a, b, c, d = (" ".join(f"v{x}" for x in r.integers(0, 5000, 200)) for _ in range(4))
    clash = ("en", "web", 1, "k", 1, "s", "t", "kept", 5, "r")
    data = [(None, a), (None, b), (None, b), (7, c), (7, d), (7, d)]
    out = simhash.drop_near_copies(rows.frame(spark, [(*x, *clash) for x in data]))
    assert rows.found(out, "doc_id", "text") == sorted([(None, a), (None, b), (7, c), (7, d)], key=repr)


def test_near_copies_are_those_by_shingles(spark):
    """Pairs at 0.6 to 0.9, a chain and repeated lines: rows stay as by brute force on the sets of shingles."""
    r = np.random.default_rng(8)
    say = lambda k: [f"v{x}" for x in r.integers(0, 100_000, k)]
    texts = []
    for share in np.linspace(0.55, 0.92, 60):  # shared start, own ends
        n = 200
        common = round(2 * n * share / (1 + share))
        start = say(common)
        texts += [start + say(n - common), start + say(n - common)]
    start = say(240)
    texts += [start[20 * i : 20 * i + 160] for i in range(5)]  # each near the next alone
    line = say(8)
    texts += [line * 40 + say(150), line * 40 + say(150)]
    texts = [" ".join(t) for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                parent = [parent[j] if x == parent[i] else x for x in parent]
    want = [min(i for i, x in enumerate(parent) if x == root) for root in set(parent)]
    clash = ("en", "web", 1, "k", 1, "s", "t", "kept", 5, "r")
    out = simhash.drop_near_copies(rows.frame(spark, [(i, t, *clash) for i, t in enumerate(texts)]))
    assert sorted(x["doc_id"] for x in out.collect()) == sorted(want)


def test_candidates_in_blocks(spark):
    """A group of candidates cut into many pairs of blocks has the links of one block."""
    r = np.random.default_rng(9)
    bases = r.integers(0, 2**62, (6, 40)).astype(np.uint64)
    sets = [np.unique(np.concatenate([bases[i % 6][int(r.integers(0, 9)) :], r.integers(0, 2**62, int(r.integers(1, 8))).astype(np.uint64)])) for i in range(60)]
    df = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sets)], "node long, set binary")
    roots = df.selectExpr("node", "0L AS root")
    one, many = ({(x["node"], x["root"]) for x in components.components(simhash.verified(roots, df, 0.8, block=n)).collect()} for n in (1000, 7))
    assert one == many and len(one) > 5 and len({c for _, c in one}) > 1


def test_tables_find_pairs_at_the_similarity():
    """The share of pairs at 0.8 that are candidates is as stated at every size."""
    for n in (1000, 10**5, 10**6, 3 * 10**7):
        tables = simhash.sampled_tables(n)
        assert simhash.found_share(len(tables[0]), len(tables)) >= 0.99


def plain_op2(data):
    texts = {}
    for i, t in data:
        texts.setdefault((i, t), (t or "").encode())
    seen = Counter(t[p : p + 200] for t in texts.values() for p in range(len(t) - 199))
    out = {}
    for k, t in texts.items():
        gone = bytearray(len(t))
        for p in range(len(t) - 199):
            if seen[t[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        out[k] = (len(t), sum(gone), sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone)), hashlib.sha256(left).hexdigest())
    return sorted(((k[0], *out[k]) for k in data), key=repr)


@pytest.mark.parametrize("source", ["awkward", "sf", "empty"])
def test_op2(spark, sf, tmp_path, source):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "sf" else rows.frame(spark, [] if source == "empty" else None)
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = suffix_dedup.op2_suffix_dedup(spark, rows.stored(docs, tmp_path))
    assert rows.found(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_op2(data)


def plain_op3(data):
    order = sorted(set(data), key=lambda x: (x[0] is None, x[0] or 0))
    texts, seen, out = {k: rows.words(k[1]) for k in order}, set(), {}
    for k, w in texts.items():
        gone = [False] * len(w)
        for p in range(len(w) - 19):
            x = tuple(w[p : p + 20])
            if x in seen:
                gone[p : p + 20] = [True] * 20
            seen.add(x)
        out[k] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return sorted(((k[0], *out[k]) for k in data), key=repr)


@pytest.mark.parametrize("source", ["awkward", "sf", "empty"])
def test_op3(spark, sf, tmp_path, source):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "sf" else rows.frame(spark, [] if source == "empty" else None)
    data = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = substring_dedup.op3_substring_dedup(spark, rows.stored(docs, tmp_path))
    assert rows.found(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_op3(data)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40).map(lambda b: bytes(x % 3 + 97 for x in b)), min_size=1, max_size=6))
def test_suffix_array(pieces):
    t, sa = suffix_array.suffix_array(pieces)
    # separators are ordered by position and below all bytes
    seq, k = [], 0
    for x in t.tolist():
        seq.append((0, k) if x == 0 else (1, x))
        k += x == 0
    want = sorted(range(len(seq)), key=lambda i: seq[i:])
    assert sa.tolist() == want
    phi, lcp = suffix_array.permuted_lcp(t, sa)
    for a, b in zip(want, want[1:], strict=False):
        n = 0
        while a + n < len(seq) and b + n < len(seq) and seq[a + n] == seq[b + n]:
            n += 1
        assert lcp[b] == n and phi[b] == a

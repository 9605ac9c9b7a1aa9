"""SimHash near-duplicates by bit-sliced comparison.

A document's fingerprint is the majority of its shingles' hashes, bit by bit. Distinct
fingerprints are the nodes; two link at ``radius`` or fewer differing bits. Tables of bit
positions bring candidates together: fingerprints that agree on all positions of a table
share a bucket. Within a bucket, fingerprints are stored vertically -- one machine word
holds one bit of 64 of them -- and the distances of a query to a whole block of lanes grow
in carry-save bit counters, plane by plane; a query leaves a block as soon as all its
lanes exceed the radius.

Two sets of tables:

* ``exact_tables``: the bits are cut into segments, and every choice of segments - radius
  of them is a table. Two fingerprints within the radius agree on that many whole
  segments, so no link is missed.
* ``sampled_tables``: for the wide radius that a shingle similarity of 0.8 needs, no exact
  set of tables is small enough; random positions, as many tables as find a pair at that
  similarity with probability ``RECALL`` over the distances that such a pair can have, and
  keys that get longer as the corpus grows. What these find are candidates: the documents
  of a group of candidates are held against each other on their shingles (``similar``).

Buckets of over ``BLOCK`` fingerprints are cut into blocks, and pairs of blocks go to
separate tasks. A bucket returns a star per group of linked fingerprints, never all pairs.
Copies share one fingerprint, so a group of copies is one node however large it is.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, table, text_bytes, unused
from vectrail.llm.components import components

RADIUS, SEGMENTS, BLOCK = 4, 6, 4096
#: Of shingle-similar documents: words of a fingerprint, radius of candidates over its
#: 64 * WIDE bits (a similarity of 0.8 differs in 39 of 256 on average, in over 58 once in
#: 2000 pairs), chance that a pair at 0.8 is within the radius and in one of the buckets.
WIDE, WIDE_RADIUS, RECALL = 4, 58, 0.99
#: Shingles of one block of a group of candidates.
BLOCK_SHINGLES = 1 << 20
#: Buckets up to this size are compared many at a time.
SMALL = 48
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: bytes, words_per_shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of a text, repeats included."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, k = b" ".join(words), min(words_per_shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1].tolist()
    return np.array([xxhash.xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(first: np.ndarray, width: int = 1) -> np.ndarray:
    """The fingerprint of shingles as ``width`` unsigned 64-bit words; zero without shingles.

    The first word comes from the shingles' hashes, further ones from mixing them.
    """
    if not len(first):
        return np.zeros(width, np.uint64)
    h = np.empty((len(first), width), np.uint64)
    h[:, 0] = first
    for j in range(1, width):
        x = first + np.uint64(j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h[:, j] = x ^ (x >> np.uint64(31))
    ones = np.zeros(64 * width, np.int64)
    for i in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8 * width), axis=1).sum(0, dtype=np.uint16)
    return np.packbits(2 * ones > len(h)).view(">u8").astype(np.uint64)


def names(width: int) -> list[str]:
    """Columns of a fingerprint's words."""
    return [f"f{j}" for j in range(width)]


def with_fingerprint(docs: DataFrame, words_per_shingle: int, width: int = 1, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and a fingerprint (f0, f1, ...) of each document, no shuffle."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            prints = np.array([fingerprint(shingles(x, words_per_shingle), width) for x in texts], np.uint64).reshape(-1, width).view(np.int64)
            arrays = [*batch.columns[: len(keep)], *[pa.array(np.ascontiguousarray(prints[:, j])) for j in range(width)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names(width)])

    schema = docs.select(*keep, *[F.lit(None).cast("long").alias(c) for c in names(width)]).schema
    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(measure, schema)


def with_shingle_set(docs: DataFrame, words_per_shingle: int, width: int, keep: tuple[str, ...], sets: bool = False) -> DataFrame:
    """The columns ``keep``, a key of the set of shingles (node), and its fingerprint or, with ``sets``, the set."""
    made = [("set", "binary")] if sets else [(c, "long") for c in names(width)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(shingles(x, words_per_shingle)) for x in batch.column(len(keep)).to_pylist()]
            node = pa.array(np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in own], np.uint64).view(np.int64))
            if sets:
                arrays = [pa.array([x.tobytes() for x in own], pa.binary())]
            else:
                prints = np.array([fingerprint(x, width) for x in own], np.uint64).reshape(-1, width).view(np.int64)
                arrays = [pa.array(np.ascontiguousarray(prints[:, j])) for j in range(width)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], node, *arrays], names=[*keep, "node", *[c for c, _ in made]])

    schema = docs.select(*keep, F.lit(None).cast("long").alias("node"), *[F.lit(None).cast(t).alias(c) for c, t in made]).schema
    return docs.select(*keep, text_bytes().alias("_text")).mapInArrow(measure, schema)


def bits_of(prints: np.ndarray) -> np.ndarray:
    """n x 64w array of bits of n x w fingerprints."""
    return np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1)


def planes(prints: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of all fingerprints, 64 lanes a word."""
    bits = bits_of(prints)
    wide = np.zeros((bits.shape[1], -(-len(prints) // 64) * 64), np.uint8)
    wide[:, : len(prints)] = bits.T
    return np.packbits(wide, axis=1).view(np.uint64)


class Counter:
    """Carry-save counters of many lanes: bit slices and a sticky overflow."""

    def __init__(self, shape: tuple[int, ...], radius: int) -> None:
        self.radius = radius
        self.slices = [np.zeros(shape, np.uint64) for _ in range(radius.bit_length())]
        self.over = np.zeros(shape, np.uint64)

    def add(self, carry: np.ndarray) -> None:
        for s in self.slices:
            carry, s[...] = s & carry, s ^ carry
        self.over |= carry

    def beyond(self) -> np.ndarray:
        """Lanes whose count exceeds the radius."""
        more, same = np.zeros_like(self.over), np.full_like(self.over, ONES)
        for bit in reversed(range(len(self.slices))):
            s = self.slices[bit]
            if self.radius >> bit & 1:
                same &= s
            else:
                more |= same & s
                same &= ~s
        return self.over | more

    def keep(self, rows: np.ndarray) -> None:
        self.slices, self.over = [s[rows] for s in self.slices], self.over[rows]


def near(lanes: np.ndarray, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(query index, linked lanes) for each query with links, by bit-sliced comparison."""
    p = planes(lanes)
    n_planes, width = p.shape
    step = max(1, 8192 // width)
    for first in range(0, len(queries), step):
        q = queries[first : first + step]
        masks = np.where(bits_of(q).astype(bool), ONES, np.uint64(0))
        active, counts = np.arange(len(q)), Counter((len(q), width), radius)
        for b in range(n_planes):
            counts.add(p[b][None, :] ^ masks[active, b][:, None])
            if b % 8 == 7 and b > 2 * radius:  # leave the block where every lane is beyond the radius
                alive = (counts.beyond() != ONES).any(axis=1)
                if not alive.all():
                    active = active[alive]
                    if not len(active):
                        break
                    counts.keep(alive)
        if len(active):
            for row, i in zip(~counts.beyond(), active, strict=True):
                found = np.flatnonzero(np.unpackbits(row.view(np.uint8))[: len(lanes)])
                if len(found):
                    yield first + int(i), found


def _merge(labels: np.ndarray, lanes: np.ndarray) -> None:
    own = labels[lanes]
    low = own.min()
    if (own != low).any():
        labels[np.isin(labels, own)] = low


def bucket_links(prints: np.ndarray, sides: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, its group's first) of a bucket; sides: of a pair of blocks, which is which."""
    labels = np.arange(len(prints))
    if sides is None:
        for i, found in near(prints, prints, radius):
            _merge(labels, np.append(found, i))
    else:
        a, b = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
        if len(a) and len(b):
            for i, found in near(prints[a], prints[b], radius):
                _merge(labels, np.append(a[found], b[i]))
    moved = np.flatnonzero(labels != np.arange(len(prints)))
    return moved, labels[moved]


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, its group's first) of the groups that the links a - b make among n lanes."""
    labels = np.arange(n)
    while True:
        low, new = np.minimum(labels[a], labels[b]), labels.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == labels).all():
            moved = np.flatnonzero(labels != np.arange(n))
            return moved, labels[moved]
        labels = new


def small_links(prints: np.ndarray, runs: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of many small buckets at once: lane i is held against lane i + d for each d."""
    out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(1, int(np.bincount(runs).max(initial=1))):
        at = np.flatnonzero(runs[d:] == runs[:-d])
        if not len(at):
            break
        x = planes(prints[at] ^ prints[at + d])
        counts = Counter((x.shape[1],), radius)
        for b in range(len(x)):
            counts.add(x[b])
            if b % 32 == 31 and b > 2 * radius and (counts.beyond() == ONES).all():
                break
        hit = at[np.flatnonzero(np.unpackbits((~counts.beyond()).view(np.uint8))[: len(at)])]
        out_a.append(hit)
        out_b.append(hit + d)
    return _stars(len(prints), np.concatenate(out_a), np.concatenate(out_b))


def _link_sorted(batches: Iterator[pa.RecordBatch], width: int, radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by (key, i, j, node); a bucket may run over several batches."""
    rest: list[np.ndarray] = []

    def solve(key, i, j, side, node, prints, last):
        new = np.flatnonzero((np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1
        bounds = np.concatenate(([0], new, [len(key)]))
        if not last:
            bounds = bounds[:-1]
        size = np.diff(bounds)
        done = int(bounds[-1])
        runs = np.repeat(np.arange(len(size)), size)
        little = np.flatnonzero(np.repeat((size <= SMALL) & (size > 1), size) & (i[:done] == j[:done]))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in np.array_split(little, max(1, len(little) // 100_000)):  # a run cut in two is solved whole below
            if len(at):
                a, b = small_links(prints[at], np.unique(runs[at], return_inverse=True)[1], radius)
                found.append((at[a], at[b]))
        cut = {int(runs[at[0]]) for at in np.array_split(little, max(1, len(little) // 100_000))[1:] if len(at)}
        for k in np.flatnonzero(size > 1):
            s, e = bounds[k], bounds[k + 1]
            if size[k] > SMALL or i[s] != j[s] or int(k) in cut:
                a, b = bucket_links(prints[s:e], None if i[s] == j[s] else side[s:e], radius)
                found.append((a + s, b + s))
        a, b = (np.concatenate([x[n] for x in found] or [np.zeros(0, np.int64)]) for n in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"]), done

    for batch in batches:
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "side", "node")]
        now.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names(width)], axis=1).view(np.uint64))
        if rest:
            now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
        if len(now[0]):
            out, done = solve(*now, last=False)
            rest = [x[done:] for x in now]
            yield out
    if rest and len(rest[0]):
        yield solve(*rest, last=True)[0]


def exact_tables(radius: int = RADIUS, segments: int = SEGMENTS) -> list[list[int]]:
    """Bit positions of the tables that find every link of 64-bit fingerprints."""
    parts = [list(map(int, x)) for x in np.array_split(np.arange(64), segments)]
    return [sum(chosen, []) for chosen in combinations(parts, segments - radius)]


def found_share(bits: int, count: int, width: int = WIDE, radius: int = WIDE_RADIUS, similarity: float = 0.8) -> float:
    """Chance that a pair of sets at ``similarity`` is within the radius and agrees on a table.

    The number of differing bits is binomial; a table of random positions is whole with the
    chance that they all fall on agreeing bits.
    """
    n, p = 64 * width, math.acos(2 * similarity / (1 + similarity)) / math.pi
    share = 0.0
    for d in range(radius + 1):
        whole = math.comb(n - d, bits) / math.comb(n, bits)
        share += math.comb(n, d) * p**d * (1 - p) ** (n - d) * (1 - (1 - whole) ** count)
    return share


def sampled_tables(n: int, width: int = WIDE, similarity: float = 0.8, recall: float = RECALL, radius: int = WIDE_RADIUS) -> list[list[int]]:
    """Random bit positions of as many tables as the recall needs.

    Keys have enough bits that n unrelated fingerprints make buckets of a few.
    """
    bits = max(14, math.ceil(math.log2(max(n, 2))) - 2)
    if found_share(bits, 1 << 20, width, radius, similarity) < recall:
        raise ValueError("the radius is too narrow for the recall")
    count = 1
    while found_share(bits, count, width, radius, similarity) < recall:
        count += max(1, count // 50)
    rng = np.random.default_rng(42)
    return [sorted(map(int, rng.choice(64 * width, bits, replace=False))) for _ in range(count)]


def similar(sets: list[np.ndarray], sides: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, its group's first) of the distinct sets that links of at least ``similarity`` join.

    Similar sets share one of their rarest shingles: of each set's, ordered by rarity here, the
    first size - similarity * size + 1. Only sets that do (sides: across) are held against
    each other, but for those that are in one group already; so a group of near-copies takes
    about one comparison a member, and sets that share frequent shingles alone take none.
    """
    n, size = len(sets), np.array([len(x) for x in sets])
    values, codes, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(times, kind="stable")] = np.arange(len(values))
    codes = [np.sort(x) for x in np.split(rank[codes], np.cumsum(size)[:-1])]
    labels, mark = np.arange(n), np.zeros(len(values), bool)
    rarest = [x[: len(x) - math.ceil(similarity * len(x) - 1e-6) + 1] for x in codes]
    owner = np.repeat(np.arange(n), [len(x) for x in rarest])
    tokens = np.concatenate(rarest)
    by = np.argsort(tokens, kind="stable")
    owner, first = owner[by], np.searchsorted(tokens[by], np.arange(len(values) + 1))
    for x in range(1, n) if sides is None else np.flatnonzero(sides == 1):
        near = np.zeros(n, bool)
        for t in rarest[x]:
            near[owner[first[t] : first[t + 1]]] = True
        others = np.flatnonzero(near[:x] if sides is None else near & (sides == 0))
        low, high = np.minimum(size[others], size[x]), np.maximum(size[others], size[x])
        others = others[(low > 0) & (low >= similarity * high - 1e-6)]
        mark[codes[x]], step = True, 1
        while True:
            others = others[labels[others] != labels[x]]
            if not len(others):
                break
            now = np.sort(np.unique(labels[others], return_index=True)[1])[:step]  # one of each group
            pick, others = others[now], np.delete(others, now)
            common = np.add.reduceat(mark[np.concatenate([codes[y] for y in pick])].astype(np.int64), np.cumsum(size[pick]) - size[pick])
            linked = pick[common / (size[pick] + size[x] - common) >= similarity]
            if len(linked):
                _merge(labels, np.append(linked, x))
            step = min(2 * step, 512)
        mark[codes[x]] = False
    moved = np.flatnonzero(labels != np.arange(n))
    return moved, labels[moved]


def _similar_sorted(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of rows (root, i, j, side, node, set) sorted by (root, i, j); a group may run over several batches."""
    now, waiting = None, []

    def solve():
        node = np.array([r[1] for r in waiting], np.int64)
        sides = None if now[1] == now[2] else np.array([r[0] for r in waiting])
        a, b = similar([np.frombuffer(r[2], np.uint64) for r in waiting], sides, similarity) if len(waiting) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(node[a] if len(a) else [], pa.int64()), pa.array(node[b] if len(b) else [], pa.int64())], names=["a", "b"])

    for batch in batches:
        for root, i, j, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if (root, i, j) != now:
                if len(waiting) > 1:
                    yield solve()
                now, waiting = (root, i, j), []
            waiting.append(row)
    if len(waiting) > 1:
        yield solve()


def verified(roots: DataFrame, sets: DataFrame, similarity: float, shingles_per_block: int = BLOCK_SHINGLES, block: int = BLOCK) -> DataFrame:
    """Star links (a, b) of the nodes of each group of ``roots`` (node, root) whose ``sets`` (node, set) are similar.

    Groups beyond a block are cut into blocks, and pairs of blocks go to separate tasks.
    """
    rows = materialize(roots.join(sets, "node"), "candidate-sets")
    blocks = F.ceil(F.greatest(F.sum(F.length("set")) / (8 * shingles_per_block), F.count("*") / block)).cast("int").alias("blocks")
    hot = materialize(rows.groupBy(F.col("root").alias("k")).agg(blocks).where("blocks > 1"), "hot-groups")
    rows = rows.join(hot, F.col("root") == F.col("k"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("root", F.least("own", "o").cast("int").alias("i"), F.greatest("own", "o").cast("int").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), "node", "set")
    rows = rows.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    return rows.mapInArrow(lambda b: _similar_sorted(b, similarity), "a long, b long")


def links(prints: DataFrame, width: int, radius: int, tables: list[list[int]], block: int = BLOCK) -> DataFrame:
    """Star links (a, b) of ``prints`` (distinct; node, f0, ...) that share a bucket."""
    if max(map(len, tables)) > 40:
        raise ValueError("a key has at most 40 bits")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, batch.num_rows, 4096)):
                bits = bits_of(np.stack([part.column(c).to_numpy() for c in names(width)], axis=1)).astype(np.int64)
                for t, at in enumerate(tables):
                    key = bits[:, at] @ (1 << np.arange(len(at), dtype=np.int64)) | t << 40
                    yield pa.RecordBatch.from_arrays([pa.array(key), *part.columns], names=["key", *part.schema.names])

    columns = ["node", *names(width)]
    rows = prints.select(*columns).mapInArrow(spread, ", ".join(f"{c} long" for c in ["key", *columns]))
    hot = rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("k"), F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    rows = rows.join(materialize(hot, "hot-buckets"), F.col("key") == F.col("k"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("own", "o").cast("int").alias("i"), F.greatest("own", "o").cast("int").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"), *columns)
    # a star's centre is its smallest node, so that the tables' stars of a group mostly coincide
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return rows.mapInArrow(lambda b: _link_sorted(b, width, radius), "a long, b long")


def classes(prints: DataFrame, width: int, radius: int, tables: list[list[int]], check: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, root, component_id) of the distinct nodes of ``prints`` (doc_id, node, f0, ...).

    With ``check``, links are candidates, and those count that it returns for their groups
    (node, root). component_id is the smallest doc_id reachable over links, its own rows
    included. Only the root names a component: ids may be null or shared.
    """
    distinct = prints.groupBy("node", *names(width)).agg(F.min("doc_id").alias("low"))
    distinct = materialize(distinct, "fingerprints")
    roots = components(links(distinct, width, radius, tables))
    if check:
        roots = components(check(materialize(roots, "candidates")))
    roots = roots.withColumnRenamed("node", "n")
    found = distinct.join(roots, F.col("node") == F.col("n"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    found = materialize(found, "classes")
    return found.join(found.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("node", "root", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    Null, empty and blank texts have fingerprint zero. Repeated rows are rows each, in one
    component. Null ids don't name a component unless there is no other. An empty table
    gives no rows. Only doc_id and text are read, so other columns don't matter.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    prints = materialize(with_fingerprint(docs, 4).withColumn("node", F.col("f0")), "doc-fingerprints")
    found = classes(prints, 1, RADIUS, exact_tables()).withColumnRenamed("node", "n")
    return prints.join(found, F.col("node") == F.col("n")).select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, words_per_shingle: int = 5, similarity: float = 0.8, width: int = WIDE, radius: int = WIDE_RADIUS) -> DataFrame:
    """One document of each group of near-duplicates: that with the smallest id.

    Documents link when the Jaccard similarity of their sets of five-word shingles is at
    least ``similarity``; a pair right at 0.8 becomes a candidate with probability
    ``RECALL`` (model of ``found_share``, for sets of more than a few shingles). Rows that
    repeat the smallest id of a group stay once. Blank texts are one group. All columns are
    kept; null ids stay only in groups without other ids. An empty table stays empty.
    """
    key, place, row = unused("node", docs), unused("place", docs), unused("row", docs)
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce("text", F.lit(""))))
    prints = with_shingle_set(keyed.select("doc_id", "text", F.col(key).alias("_k")), words_per_shingle, width, ("doc_id", "_k"))
    prints = materialize(prints, "doc-fingerprints")
    n = prints.agg(F.approx_count_distinct("node")).first()[0]

    def check(roots: DataFrame) -> DataFrame:
        wanted = materialize(prints.groupBy("node").agg(F.min("_k").alias("_k")).join(roots, "node").select("_k"), "candidate-keys")
        texts = keyed.select(F.col(key).alias("_k"), "text").join(wanted, "_k").groupBy("_k").agg(F.first("text").alias("text"))
        sets = with_shingle_set(texts, words_per_shingle, width, ("_k",), sets=True).drop("_k")
        return verified(roots, sets, similarity)

    found = classes(prints.drop("_k"), width, radius, sampled_tables(n, width, similarity, radius=radius), check)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "_k")).alias("x")
    chosen = prints.join(found.select(F.col("node").alias("n"), "root"), F.col("node") == F.col("n")).groupBy("root").agg(first)
    chosen = chosen.select(F.xxhash64("x.id", "x._k").alias(row), F.col("x._k").alias(key))
    # repeats go first, in the map tasks; the join then finds the texts dealt as it wants them
    one = Window.partitionBy(row, key).orderBy(F.lit(0))
    d = keyed.withColumn(row, F.xxhash64("doc_id", key)).withColumn(place, F.row_number().over(one)).where(F.col(place) == 1)
    return d.join(chosen, [row, key]).drop(row, key, place)


QUERIES = {"op1_simhash": op1_simhash}
ORACLES: dict[str, str] = {}

"""Phrases of words that occur together, from suffix arrays over word numbers.

A shard is a stretch of pieces of about ``SHARD`` words. Its words are numbered, each language
apart, and its suffixes are sorted by prefix doubling in numpy: by one word, by two, by four.
No phrase is longer, so the doubling ends there, and common prefixes beyond four words are
read as four. Suffixes that share at least k words are one interval, whose size is the count
of that k-gram in the shard; a phrase that is everywhere is one entry of a shard.

Most n-grams are rare, so before counts travel under their text, a lossless sieve finds
the others: shards send the cells of their n-grams' hashes with counts, packed, one row per
hash range, and the range's task adds them up and tells each shard which of its cells reach
``LEAST``. An n-gram that reaches it always passes, whatever else has its cell. The shards
then send these n-grams as text, and their exact counts are merged globally by (language,
phrase). Parts of a frequent phrase are as frequent, so the merged table holds all
counts that scores need. Scores, the suppression by longer phrases and the ranks are joins,
groupings and windows of DataFrames.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, table, text_bytes
from vectrail.llm.packing import mix, pack, unpack

#: Words of the longest phrase, least count of a candidate, share (%) of its occurrences from which a longer phrase replaces it.
LONGEST, LEAST, COVERED = 4, 30, 80
#: Scores are multiples of 1 / SCORE; phrases of a language in the result.
SCORE, TOP = 2_000_000, 2000
#: Words of a shard, bytes of text that a hash range stands for, and ranges at least.
SHARD, RANGE_BYTES, LEAST_RANGES = 1 << 19, 8 << 20, 12
#: Cells of a range as a power of two: two for a byte of its text, several for each n-gram that shards send it.
CELL_BITS = 24
#: Bytes of text that are split at once.
SLICE = 4 << 20
#: Pieces end at these characters (written as line breaks), words at blanks.
SEPARATORS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\t", b"\n\n\n\n\n\n\n\n\n ")
BLANK = re.compile(b"[ \n]").search
NO_LANGUAGE = "und"


class Numbers(dict):
    """Numbers of the words of one language in a shard, from 1 on; 0 is the end of a piece."""

    def __init__(self, shard: Shard, language: str) -> None:
        super().__init__({b"\n": 0})
        self.shard, self.seed = shard, xxhash.xxh64_intdigest(language.encode())

    def __missing__(self, word: bytes) -> int:
        self.shard.words.append(word)
        self.shard.hashes.append(xxhash.xxh64_intdigest(word, self.seed))
        n = self[word] = len(self.shard.words) - 1
        return n


class Shard:
    """Word numbers of many pieces, each ended by a 0, with the language of each number."""

    def __init__(self) -> None:
        self.words, self.hashes, self.languages = [b""], [0], {}
        self.ids: list[np.ndarray] = []
        #: Runs of places that only continue a piece of the next shard and start no phrase.
        self.ghosts: list[tuple[int, int]] = []
        self.size = 0

    def add(self, language: str, words: list[bytes]) -> None:
        of = self.languages.setdefault(language, Numbers(self, language))
        self.ids.append(np.fromiter(map(of.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def bounds(self) -> tuple[np.ndarray, list[str]]:
        """The language of every word number, as an index, and the languages."""
        of = np.zeros(len(self.words), np.int32)
        for i, numbers in enumerate(self.languages.values()):
            own = np.fromiter(numbers.values(), np.int64, len(numbers))
            of[own] = i
        return of, list(self.languages)

    def sequence(self) -> tuple[np.ndarray, np.ndarray]:
        """(word numbers, whether a phrase starts there)."""
        ids = np.concatenate(self.ids)
        starts = ids > 0
        for a, b in self.ghosts:
            starts[a:b] = False
        return ids, starts


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, b'\\n' at ends of pieces, in lists for slices of it."""
    t, at = text.lower().translate(SEPARATORS), 0
    while at < len(t):
        end = found.start() if (found := BLANK(t, at + SLICE)) else len(t)
        yield list(filter(None, t[at:end].replace(b"\n", b" \n ").split(b" ")))
        at = end


def shards(stream: Iterator[pa.RecordBatch], limit: int = SHARD) -> Iterator[Shard]:
    """Shards of batches of (language, text), filled in order.

    A text that crosses the end of a shard is cut there: its next LONGEST - 1 words follow as
    ghosts, so that phrases across the cut are counted, once.
    """
    shard = Shard()
    for batch in stream:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words: list[bytes] = []
            for more in word_lists(text):
                words += more
                while len(words) > (room := max(0, limit - shard.size)) + LONGEST:
                    shard.add(language, words[:room])
                    shard.ghosts.append((shard.size, shard.size + LONGEST - 1))
                    shard.add(language, [*words[room : room + LONGEST - 1], b"\n"])
                    yield shard
                    shard, words = Shard(), words[room:]
            shard.add(language, [*words, b"\n"])
    if shard.size:
        yield shard


def _order(key: np.ndarray, top: int) -> np.ndarray:
    """Places by key (0 to ``top``); short keys are sorted together with their places."""
    bits = len(key).bit_length()
    if top.bit_length() + bits > 63:
        return np.argsort(key)
    return (np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)).astype(np.int64)


def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of words by the next LONGEST words, words in common with the one before), both by prefix doubling.

    Ends of pieces are ordinary symbols, smaller than words; a common prefix stops at one.
    """
    n = len(ids)
    rank, step = ids.astype(np.int64), 1
    while step < LONGEST:
        follow = np.zeros(n, np.int64)
        follow[: n - step] = rank[step:] + 1
        width = int(follow.max(initial=0)) + 1
        key = rank * width + follow
        order = _order(key, int(rank.max(initial=0) + 1) * width)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([False], sorted_key[1:] != sorted_key[:-1])))
        step *= 2
    padded = np.concatenate((ids, np.zeros(LONGEST, ids.dtype)))
    common, alive = np.zeros(n, np.int8), np.ones(n, bool)
    alive[:1] = False
    for k in range(LONGEST):
        own = padded[order + k]
        alive[1:] &= (own[1:] == own[:-1]) & (own[1:] > 0)
        common += alive
    return order, common


def intervals(ids: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first places, counts) of the distinct k-grams of a shard."""
    order, common = suffix_order(ids)
    padded = np.concatenate((ids, np.zeros(LONGEST, ids.dtype)))
    inside = np.ones(len(order), bool)
    for k in range(1, LONGEST + 1):
        inside &= padded[order + k - 1] > 0
        if not inside.any():
            return
        first = np.flatnonzero(inside & (common < k))
        counted = np.cumsum(np.concatenate(([0], inside & starts[order])))
        ends = np.append(first[1:], len(order))
        n = counted[ends] - counted[first]
        some = n > 0
        yield k, order[first[some]], n[some]


def hashed(shard: Shard, ids: np.ndarray, k: int, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the k-grams at the places ``at``; the words' hashes hold their language."""
    of = np.array(shard.hashes, np.uint64)
    h = np.full(len(at), k, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + of[ids[at + i]], i)
    return h


def counted(shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, count, k, place) of all n-grams of a shard, and its word numbers."""
    ids, starts = shard.sequence()
    parts = [(hashed(shard, ids, k, at), n.astype(np.int32), np.full(len(at), k, np.int8), at.astype(np.int32)) for k, at, n in intervals(ids, starts)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(0, np.int32), ids
    return *(np.concatenate(c) for c in zip(*parts, strict=True)), ids


def cells_of(h: np.ndarray, ranges: int) -> np.ndarray:
    """Cells of hashes: the number of a range (at most 2**24), then CELL_BITS within it."""
    return (h >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(40 - CELL_BITS)


def sieved(h: np.ndarray, n: np.ndarray, ranges: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(range, sorted distinct cells in it, their counts up to LEAST)."""
    if not len(h):
        return
    key = np.sort(cells_of(h, ranges) << np.uint64(6) | np.minimum(n, LEAST).astype(np.uint64))
    cell = key >> np.uint64(6)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    times = np.minimum(np.add.reduceat(key & np.uint64(63), first), np.uint64(LEAST))
    cell = cell[first]
    of = cell >> np.uint64(CELL_BITS)
    cuts = np.append(np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))), len(cell))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(of[a]), cell[a:b] & np.uint64((1 << CELL_BITS) - 1), times[a:b]


SENT = "range int, shard long, data binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], names=["range", "shard", "data"])


def _numbered(stream: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, Shard]]:
    """Shards of batches of (language, text, partition) with numbers that no other one has."""
    part = None

    def seen() -> Iterator[pa.RecordBatch]:
        nonlocal part
        for batch in stream:
            if batch.num_rows:
                part = batch.column(2)[0].as_py()
                yield batch

    for i, shard in enumerate(shards(seen(), limit)):
        yield part << 32 | i, shard


def _sums(_: tuple[pa.Scalar, ...], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one hash range: for each shard, which of its cells reach LEAST over all shards."""
    rows = [r for part in stream for r in zip(*(part.column(c).to_pylist() for c in ("range", "shard", "data")), strict=True)]
    total = np.zeros(1 << CELL_BITS, np.uint8)
    for _, _, data in rows:
        cell, n = unpack(data)
        total[cell] = np.minimum(total[cell] + n.astype(np.uint8), LEAST)
    for r, shard, data in rows:
        often = total[unpack(data)[0]] >= LEAST
        yield _rows([(r, shard, zstandard.compress(np.packbits(often).tobytes(), 1))])


def _content(shard: Shard) -> bytes:
    """A shard as bytes, for its way to the answers."""
    ids = np.concatenate(shard.ids)
    of, languages = shard.bounds()
    parts = [pack(np.zeros(len(ids)), ids), pack(np.zeros(len(of)), of), np.array(shard.ghosts, "<i8").tobytes(), zstandard.compress(b"\n".join(shard.words), 1), json.dumps(languages).encode()]
    return b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *parts])


def _restored(data: bytes) -> tuple[Shard, np.ndarray, list[str]]:
    """The shard of ``_content``, the language of every word number, and the languages."""
    ends = 40 + np.cumsum(np.frombuffer(data, "<i8", 5))
    ids, of, ghosts, words, languages = (data[a:b] for a, b in zip([40, *ends[:-1]], ends, strict=True))
    shard = Shard()
    shard.ids, shard.ghosts = [unpack(ids)[1].astype(np.int32)], np.frombuffer(ghosts, "<i8").reshape(-1, 2).tolist()
    shard.words, names, of = zstandard.decompress(words).split(b"\n"), json.loads(languages), unpack(of)[1].astype(np.int32)
    seeds = [xxhash.xxh64_intdigest(x.encode()) for x in names]
    shard.hashes = [0, *(xxhash.xxh64_intdigest(w, seeds[i]) for w, i in zip(shard.words[1:], of[1:].tolist(), strict=True))]
    return shard, of, names


GRAMS = "lang string, phrase binary, n long"


def _named(parts: Iterator[pa.RecordBatch], ranges: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, count) of a shard's n-grams that the sieve let through, and its words by language (phrase '')."""
    answers, content = [], b""
    for part in parts:
        for r, data in zip(part.column("range").to_pylist(), part.column("data").to_pylist(), strict=True):
            if r < 0:
                content = data
            else:
                answers.append((r, data))
    if not content:
        raise RuntimeError("the documents came in other shards than before: materialize them first")
    shard, language, names = _restored(content)
    h, n, k, at, ids = counted(shard)
    found, often = dict(answers), [np.zeros(0, np.uint64)]
    for r, cell, _ in sieved(h, n, ranges):
        if r not in found:
            raise RuntimeError("the documents came in other shards than before: materialize them first")
        bits = np.unpackbits(np.frombuffer(zstandard.decompress(found[r]), np.uint8), count=len(cell)).astype(bool)
        often.append(cell[bits] | np.uint64(r << CELL_BITS))
    own, often = cells_of(h, ranges), np.concatenate(often)
    flagged = often[np.minimum(np.searchsorted(often, own), len(often) - 1)] == own if len(often) else np.zeros(len(h), bool)
    del h, own
    words, size = np.array(shard.words, object), np.bincount(language[ids[at[k == 1]]], n[k == 1], len(names)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([b""] * len(names), pa.binary()), pa.array(size)], names=["lang", "phrase", "n"])
    for m in range(1, LONGEST + 1):
        own = np.flatnonzero(flagged & (k == m))
        for i in range(0, len(own), 100_000):
            some = own[i : i + 100_000]
            phrases = words[ids[at[some]]]
            for j in range(1, m):
                phrases = phrases + b" " + words[ids[at[some] + j]]
            columns = [pa.array(np.array(names, object)[language[ids[at[some]]]], pa.string()), pa.array(phrases, pa.binary()), pa.array(n[some].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "n"])


def frequent_phrases(docs: DataFrame, limit: int = SHARD, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, phrase, words, n): exact counts of the phrases of 1 to LONGEST words that occur LEAST times or more.

    For every language, the phrase of no words ('') counts all its words.
    """
    d = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), text_bytes().alias("text"), F.spark_partition_id().cast("long").alias("part"))
    size = d.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // range_bytes))

    def sieve(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard in _numbered(stream, limit):
            h, n, *_ = counted(shard)
            for r, cell, times in sieved(h, n, ranges):
                yield _rows([(r, number, pack(cell, times))])

    def contents(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard in _numbered(stream, limit):
            yield _rows([(-1, number, _content(shard))])

    def named(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _named(parts, ranges)

    answers = d.mapInArrow(sieve, SENT).groupBy("range").applyInArrow(_sums, SENT)
    grams = answers.unionByName(d.mapInArrow(contents, SENT)).groupBy("shard").applyInArrow(named, GRAMS)
    merged = grams.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).withColumn("phrase", F.col("phrase").cast("string"))
    merged = merged.where((F.col("n") >= LEAST) | (F.col("phrase") == ""))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ", -1)))
    return merged.select("lang", "phrase", words.alias("words"), "n")


def _part(first: Column, words: Column | int) -> Column:
    """Of the array column ``w``: words from ``first`` (1 on), joined."""
    return F.array_join(F.slice("w", first, words), " ")


def collocations(docs: DataFrame, top: int = TOP, limit: int = SHARD, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 to LONGEST words.

    a counts the phrase, l and r the two parts of its lowest-scoring cut (equal scores: the
    first), n the language's words; score = floor(SCORE * a / (l + r)). Phrases of which a longer
    candidate covers COVERED percent are left out. Ties of score go to the larger a, then to the
    phrase in byte order.

    Null text counts as empty, a null language as 'und'. Repeated rows are counted each; an
    empty table gives no rows. Other columns are left out, so their names don't matter. A
    text may be of any length: shards cut it. ``docs`` should be a table or another plan that
    gives the same rows in the same order when a task runs again; ``materialize`` others first.
    """
    grams = materialize(frequent_phrases(docs, limit, range_bytes), "phrases")
    candidates = grams.where("words >= 2").select("lang", "phrase", F.col("words").alias("m"), F.col("n").alias("a"), F.split("phrase", " ", -1).alias("w"))
    counts = grams.where(f"words BETWEEN 1 AND {LONGEST - 1}").select("lang", F.col("phrase").alias("part"), F.col("n").alias("f"))
    both = lambda k: F.array(F.struct(k.alias("k"), F.lit("l").alias("side"), _part(F.lit(1), k).alias("part")), F.struct(k.alias("k"), F.lit("r").alias("side"), _part(k + 1, F.col("m") - k).alias("part")))
    sides = candidates.select("lang", "phrase", "a", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.col("m") - 1), both))).alias("x"))
    sides = sides.select("lang", "phrase", "a", "x.*").join(counts, ["lang", "part"])
    of = lambda k, side: F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("f"))).alias(f"{side}{k}")
    cuts = sides.groupBy("lang", "phrase", "a").agg(*[of(k, side) for k in range(1, LONGEST) for side in "lr"])
    score = lambda k: F.expr(f"cast(cast({SCORE} * cast(a AS decimal(20, 0)) AS decimal(38, 0)) DIV (cast(l{k} AS decimal(20, 0)) + cast(r{k} AS decimal(20, 0))) AS long)")
    lowest = F.array_min(F.array_compact(F.array(*[F.when(F.col(f"l{k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))) for k in range(1, LONGEST)])))
    cut = cuts.select("lang", "phrase", "a", lowest.alias("cut"))
    # sub-phrases of candidates of three and more words
    inner = candidates.where("m >= 3").select("lang", "a", "m", "w", F.explode(F.sequence(F.lit(2), F.col("m") - 1)).alias("k"))
    inner = inner.select("lang", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("m") - F.col("k") + 1), lambda i: F.array_join(F.slice("w", i, F.col("k")), " "))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    wide = lambda c, k: F.col(c).cast("decimal(20, 0)") * k
    kept = cut.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (wide("longer", 100) < wide("a", COVERED)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most rows: each of its parts is cut to the best before they meet
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    sizes = grams.where("words = 0").select("lang", "n")
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2000 phrases of every language; nulls, repeats and empty tables as in ``collocations``."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {"op12_collocations": op12_collocations}

ORACLES = {
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(pieces) AS piece FROM p)),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f FROM s, (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k AS m, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
u AS (SELECT lang, phrase, m, a, w, unnest(range(1, m)) AS k FROM c),
x AS (SELECT u.lang, u.phrase, u.a, u.k, b.f AS l, e.f AS r, CAST(2000000 * u.a::HUGEINT // (b.f + e.f) AS BIGINT) AS score
FROM u JOIN g b ON b.lang = u.lang AND b.phrase = array_to_string(u.w[1 : u.k], ' ') JOIN g e ON e.lang = u.lang AND e.phrase = array_to_string(u.w[u.k + 1 :], ' ')),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, a FROM (SELECT lang, a, w, k, unnest(range(1, m - k + 2)) AS i FROM (SELECT lang, a, w, m, unnest(range(2, m)) AS k FROM c WHERE m > 2))),
o AS (SELECT lang, phrase, max(a) AS longer FROM t GROUP BY ALL),
q AS (SELECT y.* FROM y LEFT JOIN o ON o.lang = y.lang AND o.phrase = y.phrase WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT q.lang, row_number() OVER v AS rank, phrase, a, l, r, n, score FROM q JOIN n ON n.lang = q.lang WINDOW v AS (PARTITION BY q.lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER v <= 2000
""",
}

"""Language-model scores from a log-frequency Bloom filter in segments.

The training documents' n-grams of one to three tokens are counted exactly: a batch of
documents sends each distinct n-gram once, with its count, in one packed row per hash range,
and a range's task adds up what all batches sent, so a frequent word is one entry a batch.
Counts are quantised logarithmically, level(c) = 1 + floor(log_b c), and an n-gram is stored
under the keys (n-gram, 1) .. (n-gram, level). Reading asks for level after level until a
key is missing, so a count is never underestimated by more than its quantisation.

The filter has ``BITS_PER_KEY`` bits a key: its error rate is the same for every corpus and it
grows with the corpus. A broadcast of all of it has no size bound, so each worker gets the
segments of its hash ranges: a range's task builds the segment, writes it with the model, and
probes it for the n-grams that each batch asked for. The levels go back by batch, where they
meet the token sequence, packed word numbers from a second reading of the texts. There are
two readings whatever the size of the corpus.

    P(y)      = (c(y) + 1) / (N + V + 1)
    P(y | x)  = (c(xy) + MU[0] * P(y)) / (c(x) + MU[0])
    P(z | xy) = (c(xyz) + MU[1] * P(z | y)) / (c(xy) + MU[1])

The exact add-one base score needs the counts of words alone; a range's task sends those of
a batch's words along with the levels. No vocabulary is collected or broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, table, text_bytes
from vectrail.llm.packing import WordHashes, mix, pack, unpack

#: Log base of the levels, bits per stored key, probes per key.
LEVEL_BASE, BITS_PER_KEY, PROBES = 2.0**0.5, 12, 4
#: Weights of the lower orders, fitted on held-out documents of sf0.1 (log10 a token there:
#: -3.42; a third of the weights or three times as much: -3.45).
MU = (300.0, 5.0)
#: Input characters that one hash range stands for, and ranges at least.
RANGE_CHARS, LEAST_RANGES = 16 << 20, 12
#: Documents and text bytes of a batch (a longer text is a batch of its own).
BATCH, BATCH_BYTES = 2000, 8 << 20

END = b"\n"  # no word holds a line break, so it stands for the end of a text
#: Orders of packed rows: tokens, pairs, triples, and the batch's documents.
ORDERS, TEXT = (0, 1, 2), 3
#: Hashes of pairs and triples keep so many bits beyond those that number the corpus's bytes,
#: so two of them are taken for one equally seldom (once in 65 536 at most) at every size.
SPARE_BITS = 16


def tokens(text: bytes) -> list[bytes]:
    """Words of the lower-cased text, then the end."""
    return [*text.lower().split(), END]


def low_bits(size: int) -> np.uint64:
    """How many low bits of pairs' and triples' hashes are left out for a corpus of ``size`` bytes."""
    return np.uint64(max(1, 64 - size.bit_length() - SPARE_BITS))


def ngrams(h: np.ndarray, starts: np.ndarray, low: np.uint64) -> list[np.ndarray]:
    """Hashes of the token, the pair and the triple that end at each place.

    Pairs and triples are made of the upper bits of their tokens. The first token of a text follows an end; it has no triple (0, which no other one has).
    """
    before, token = np.empty_like(h), h >> low
    before[1:] = token[:-1]
    before[starts] = np.uint64(WordHashes()[END]) >> low
    two = mix(mix(before, 1) + token, 2) >> low << low
    before[1:] = two[:-1]
    three = np.maximum(mix(mix(before, 3) + token, 4) >> low, np.uint64(1)) << low
    three[starts] = 0
    return [h, two, three]


def _range_of(h: np.ndarray, ranges: int) -> np.ndarray:
    return (h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)


def _cuts(h: np.ndarray, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, first, end) of the ranges that sorted hashes fall into."""
    if not len(h):
        return
    of = _range_of(h, ranges)
    first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    yield from zip(of[first].tolist(), first.tolist(), np.append(first[1:], len(h)).tolist(), strict=True)


def _batches(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in stream:
        size = np.cumsum(pa.compute.binary_length(whole.column(2)).to_numpy(zero_copy_only=False))
        at = 0
        while at < whole.num_rows:
            room = (size[at - 1] if at else 0) + BATCH_BYTES
            end = max(at + 1, min(at + BATCH, int(np.searchsorted(size, room, "right"))))
            yield whole.slice(at, end - at)
            at = end


PACKED = "range int, order int, batch long, data binary, n long, v long"


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], names=["range", "order", "batch", "data", "n", "v"])


def _framed(*parts: bytes) -> bytes:
    return b"".join([np.array([len(parts), *map(len, parts)], "<i8").tobytes(), *parts])


def _unframed(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data, "<i8", n, 8))
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends[:-1]], ends, strict=True)]


def _distinct(grams: np.ndarray, counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, whose lowest bit is 0, and how many of each are counted."""
    x = np.sort(grams | counted.astype(np.uint64))
    h = x & ~np.uint64(1)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.add.reduceat(x & np.uint64(1), first).astype(np.int64) if len(first) else first


def _numbered(stream: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(number, batch, token hashes, tokens of each document) of the batches of (id, held_out, text, partition)."""
    cache = WordHashes()
    for seq, batch in enumerate(_batches(stream)):
        part = batch.column(3)[0].as_py()
        parts = [cache.array(tokens(t)) for t in batch.column(2).to_pylist()]
        yield part << 32 | seq, batch, np.concatenate(parts), np.array([len(p) for p in parts], np.int64)


def _sent(stream: Iterator[pa.RecordBatch], ranges: int, low: np.uint64) -> Iterator[pa.RecordBatch]:
    """Packed rows of batches of (id, held_out, text): one per order and hash range, with the
    batch's distinct n-grams and their counts in training documents."""
    for key, batch, h, n in _numbered(stream):
        out, counted = [], np.repeat(~batch.column(1).to_numpy(zero_copy_only=False).astype(bool), n)
        for order, grams in zip(ORDERS, ngrams(h, np.cumsum(n) - n, low), strict=True):
            if order == 0:
                found = np.unique(grams)
                times = np.bincount(np.searchsorted(found, grams[counted]), minlength=len(found)).astype(np.int64)
            else:
                found, times = _distinct(grams[grams > 0], counted[grams > 0])
            shift = low if order else np.uint64(0)
            out += [(r, order, key, pack(found[a:b] >> shift, times[a:b]), None, None) for r, a, b in _cuts(found, ranges)]
        yield _packed(out)


def _texts(stream: Iterator[pa.RecordBatch], low: np.uint64) -> Iterator[pa.RecordBatch]:
    """One packed row per batch with its documents: ids, lengths, distinct words, word numbers."""
    for key, batch, h, n in _numbered(stream):
        words, numbers = np.unique(h, return_inverse=True)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.select([0, 1]).schema) as writer:
            writer.write_batch(batch.select([0, 1]))
        end = np.searchsorted(words, WordHashes()[END])
        about = _framed(zstandard.compress(sink.getvalue().to_pybytes(), 1), np.append(n, end).astype("<i8").tobytes(), pack(words >> low), pack(np.zeros(len(numbers)), numbers))
        yield _packed([(None, TEXT, key, about, None, None)])


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised logarithms: 0 for 0, else 1 + floor(log_b c)."""
    out = np.zeros(len(counts), np.int64)
    seen = counts > 0
    out[seen] = 1 + np.floor(np.log(counts[seen].astype(float)) / np.log(LEVEL_BASE) + 1e-9).astype(np.int64)
    return out


def expected(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of the counts of that level."""
    low = np.ceil(LEVEL_BASE ** (level - 1.0) - 1e-9)
    high = np.maximum(low, np.ceil(LEVEL_BASE ** level.astype(float) - 1e-9) - 1)
    return np.where(level > 0, (low + high) / 2, 0.0)


def _places(h: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """Places of the keys (hash, level) for one probe after the other; segments have under 2**32 bits."""
    x = mix(h, 16 + level)
    y = (x << np.uint64(32) | x >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
    for _ in range(PROBES):
        yield (x >> np.uint64(32)) * np.uint64(bits) >> np.uint64(32)
        x = x + y


def bloom(h: np.ndarray, level: np.ndarray) -> bytes:
    """A filter segment that holds each hash under the keys 1 .. its level."""
    bits = max(64, -(-int(level.sum()) * BITS_PER_KEY // 8) * 8)
    cells = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        all_of_level = h[level >= j]
        for i in range(0, len(all_of_level), 1 << 16):
            for at in _places(all_of_level[i : i + (1 << 16)], j, bits):
                cells[at] = True
    return np.packbits(cells, bitorder="little").tobytes()


def probe(segment: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Levels of hashes, by repeated membership probes of a segment."""
    out, alive, bits = np.zeros(len(h), np.uint8), np.arange(len(h)), len(segment) * 8
    j = 0
    while len(alive):
        j += 1
        hit = np.ones(len(alive), bool)
        for at in _places(h[alive], j, bits):
            hit &= (segment[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            if not hit.any():
                break
        alive = alive[hit]
        out[alive] = j
    return out


def _fold(counts: tuple[np.ndarray, np.ndarray], more: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    h = np.concatenate([counts[0], *[x[0] for x in more]])
    n = np.concatenate([counts[1], *[x[1] for x in more]])
    if not len(h):
        return h, n
    by = np.argsort(h, kind="stable")
    h, n = h[by], n[by]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    return h[first], np.add.reduceat(n, first)


def _counted(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch], low: np.uint64) -> Iterator[pa.RecordBatch]:
    """Of one (range, order): the filter segment with totals, and for each batch the levels of
    its n-grams by probes of the segment; of tokens the exact counts, too.

    What batches sent stays packed; a range holds that, its distinct hashes with counts,
    and one unpacked batch at a time.
    """
    at, order = key[0].as_py(), key[1].as_py()
    rows = ((b, d) for part in parts for b, d in zip(part.column("batch").to_pylist(), part.column("data").to_pylist(), strict=True))
    rows, shift = list(rows), low if order else np.uint64(0)
    counts, more, waiting = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0
    for _, data in rows:
        h, times = unpack(data)
        some = times > 0
        more.append((h[some] << shift, times[some].astype(np.int64)))
        waiting += len(more[-1][0])
        if waiting > len(counts[0]) // 2 + 500_000:
            counts, more, waiting = _fold(counts, more), [], 0
    h, n = _fold(counts, more)
    data = bloom(h, levels(n))
    yield _packed([(at, order, None, data, int(n.sum()), len(h))])
    segment = np.frombuffer(data, np.uint8)
    for b, sent in rows:
        asked = unpack(sent)[0] << shift
        found = [zstandard.compress(probe(segment, asked).tobytes(), 1)]
        if order == 0:
            exact = np.zeros(len(asked), np.int64)
            if len(h):
                place = np.minimum(np.searchsorted(h, asked), len(h) - 1)
                exact = np.where(h[place] == asked, n[place], 0)
            found.append(pack(np.zeros(len(exact)), exact))
        yield _packed([(at, order, b, _framed(*found), None, None)])


def probabilities(one: np.ndarray, two: np.ndarray, three: np.ndarray, end: float, starts: np.ndarray, n_all: int, v_all: int) -> np.ndarray:
    """The smoothed probability of each token from the counts of the n-grams that end there.

    ``end``: count of the end, which every text follows. A count is at most its history's.
    """
    history = np.empty_like(one)
    history[1:] = one[:-1]
    history[starts] = end
    pair = np.empty_like(two)
    pair[1:] = two[:-1]
    pair[starts] = 0
    p = (one + 1) / (n_all + v_all + 1)
    p = (np.minimum(two, history) + MU[0] * p) / (history + MU[0])
    longer = (np.minimum(three, pair) + MU[1] * p) / (pair + MU[1])
    longer[starts] = p[starts]
    return longer


def _scored(parts: Iterator[pa.RecordBatch], n_all: int, v_all: int, low: np.uint64) -> Iterator[pa.RecordBatch]:
    """The documents of one batch with their scores, from the answers of all ranges."""
    answers: dict[int, list[tuple[int, bytes]]] = {k: [] for k in ORDERS}
    about = b""
    for part in parts:
        for r, order, data in zip(*(part.column(c).to_pylist() for c in ("range", "order", "data")), strict=True):
            if order == TEXT:
                about = data
            else:
                answers[order].append((r, data))
    ids, n, words, numbers = _unframed(about)
    *n, end = np.frombuffer(n, "<i8")
    n, words, numbers = np.array(n, np.int64), unpack(words)[0], unpack(numbers)[1].astype(np.int64)
    starts, c = np.cumsum(n) - n, []
    for order, grams in zip(ORDERS, ngrams(words[numbers] << low, starts, low), strict=True):
        found, back = (words, numbers) if order == 0 else np.unique(grams, return_inverse=True)
        none = int(order == 2 and found[0] == 0)  # of texts' first places
        got = [_unframed(d) for _, d in sorted(answers[order])]
        level = np.frombuffer(b"\0" * none + b"".join(zstandard.decompress(g[0]) for g in got), np.uint8)
        if len(level) != len(found):
            raise RuntimeError("the documents came in other batches than before: materialize them first")
        value = expected(np.arange(256))[level]
        c.append(value[back])
        if order == 0:
            exact, at_end = np.concatenate([unpack(g[1])[1] for g in got]).astype(np.int64)[numbers], float(value[end])
    score = np.add.reduceat(np.log10(probabilities(*c, at_end, starts, n_all, v_all)), starts)
    base = np.add.reduceat(np.log10(exact + 1.0), starts) - n * np.log10(n_all + v_all + 1.0)
    seen = np.add.reduceat((exact > 0).astype(np.int64), starts)
    with pa.ipc.open_stream(zstandard.decompress(ids)) as reader:
        own = reader.read_all().combine_chunks().to_batches()[0]
    columns = [own.column(0), own.column(1), pa.array(n), pa.array(seen), pa.array(np.full(len(n), n_all)), pa.array(base), pa.array(score)]
    yield pa.RecordBatch.from_arrays(columns, names=[own.schema.names[0], "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``.

    Null text counts as empty: its only token is the end. A null id is in training. Repeated
    rows are rows each, in training and in the result. An empty table gives no rows. Other
    columns are left out, so their names don't matter; doc_id may have any type. ``docs``
    should be a table or another plan that gives the same rows in the same order when a task
    runs again, for batches are numbered by task; ``materialize`` others first.
    """
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    d = docs.select("doc_id", out.alias("held_out"), text_bytes().alias("text"), F.spark_partition_id().alias("part"))
    size = d.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_CHARS))
    low = low_bits(size)

    def counted_of(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(key, parts, low)

    parts = d.mapInArrow(lambda b: _sent(b, ranges, low), PACKED)
    counted = materialize(parts.groupBy("range", "order").applyInArrow(counted_of, PACKED), "ngram-counts")
    n_all, v_all = (x or 0 for x in counted.where("order = 0 AND batch IS NULL").agg(F.sum("n"), F.sum("v")).first())
    answers = counted.where("batch IS NOT NULL").union(d.mapInArrow(lambda b: _texts(b, low), PACKED)).select("range", "order", "batch", "data")
    schema = docs.select("doc_id", F.lit(True).alias("held_out"), *[F.lit(None).cast("long").alias(c) for c in ("n_tokens", "n_known", "train_tokens")], *[F.lit(None).cast("double").alias(c) for c in ("base_score", "score")]).schema

    def scored(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scored(parts, n_all, v_all, low)

    return answers.groupBy("batch").applyInArrow(scored, schema)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model scores of all documents; nulls, repeats and empty tables as in ``score_documents``."""
    return score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op10_lm_score": op10_lm_score}
ORACLES: dict[str, str] = {}

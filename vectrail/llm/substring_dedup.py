"""Removal of repeated 20-word windows behind a count-min prefilter.

First pass: every batch of documents sketches its windows, and the sketches are merged by
hash range (``repeats``), so that a cell is never smaller than the count of any window it
stands for. A window is sketched through its anchor, a run of ``ANCHOR`` of its words that
all equal windows choose alike (winnowing); a window occurs at most as often as its anchor,
so the estimate of the anchor is an overestimate of the window's count, and anchors are a
seventh as many as windows. Second pass: only windows whose estimate is two or more are
grouped, by 104 bits of hash, exactly; a window that occurs twice has an anchor that occurs
twice and is never lost.

A batch of documents keeps the first occurrence of each window among its own and marks the
others, so a window that is everywhere reaches the task of its hash range once per batch;
what it sends is packed, one row per range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import row_key, table, text_bytes
from vectrail.llm.packing import WordHashes, mix, pack, unpack
from vectrail.llm.repeats import MARKS, Finder, batch_ids, by_document, mark_rows, marks, ordinals, packed_rows, range_or_batch, repeated_anchors
from vectrail.llm.winnow import anchors, rolling

#: Words of a window and of its anchor.
WINDOW, ANCHOR = 20, 8
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: Documents of a batch; characters of text that a hash range stands for, and ranges at least.
DOCS, RANGE_CHARS, LEAST_RANGES = 2000, 16 << 20, 12


def _anchored(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows owned) of a document's windows."""
    grams = mix(rolling(words, ANCHOR, BASES[0]), 3)
    at, first, owned = anchors(grams, WINDOW - ANCHOR + 1)
    return grams[at], first, owned


def anchor_finder() -> Finder:
    """Hashes of a text's anchors."""
    cache = WordHashes()
    return lambda text: _anchored(cache.array(text.split()))[0]


def _new(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows: whether a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


ROWS = pa.schema([("range", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("data", pa.binary())])


def _table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(ROWS)], schema=ROWS)


def _candidates(batch: pa.RecordBatch, number: int, cache: WordHashes, ranges: int) -> pa.RecordBatch:
    """Packed first occurrences of a batch's likely windows by hash range, and its later ones.

    The later ones are marks, under no range (-1). For ranges, ``keys`` holds (id is null,
    id, key) of the documents that the packed rows name.
    """
    about = np.stack([batch.column(0).is_null().to_numpy(zero_copy_only=False).astype(np.int64), batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy()])
    parts = []
    for i, (text, flagged) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
        words = cache.array(text.split())
        h, _, owned = _anchored(words)
        may = np.zeros(len(h), bool)
        may[ordinals(flagged)] = True
        pos = np.flatnonzero(np.repeat(may, owned))  # owned runs lie one after the other
        if len(pos):
            a = mix(rolling(words, WINDOW, BASES[1])[pos], 5)
            b = mix(rolling(mix(words, 7), WINDOW, BASES[2])[pos], 6) >> np.uint64(24)
            parts.append((a, b, np.full(len(pos), i), pos))
    if not parts:
        return _table([])
    h, g, doc, pos = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort(about[::-1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(_new(*about[:, order])) - 1  # equal documents have one rank
    by = np.lexsort((pos, rank[doc], g, h))
    h, g, doc, pos = h[by], g[by], doc[by], pos[by]
    first, place = _new(h, g), _new(h, g, rank[doc], pos)
    later = place & ~first
    rows = [(-1, *row) for row in marks(number, about[2], doc[later], pos[later])]
    h, g, doc, pos = h[first], g[first], doc[first], pos[first]
    cuts = np.searchsorted((h >> np.uint64(40)) * np.uint64(ranges) >> np.uint64(24), np.arange(ranges + 1))
    for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            own, local = np.unique(doc[a:b], return_inverse=True)
            rows.append((r, number, about[:, own].astype("<i8").tobytes(), pack(h[a:b], g[a:b], local, pos[a:b])))
    return _table(rows)


def _resolved(_: tuple[pa.Scalar, ...], stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Window starts to remove: all occurrences in a hash range but the first of each window."""
    numbers, about, columns, starts = [], [], [], [0]
    for batch in stream:
        own = batch.column("range").to_numpy() < 0
        yield mark_rows(packed_rows(batch, own))
        for number, docs, data in packed_rows(batch, ~own):
            h, g, doc, pos = unpack(data)
            numbers.append(number)
            about.append(np.frombuffer(docs, "<i8").reshape(3, -1))
            columns.append((h, g, doc.astype(np.int32) + starts[-1], pos.astype(np.int32)))
            starts.append(starts[-1] + about[-1].shape[1])
    if not columns:
        return
    null, ids, keys = np.concatenate(about, axis=1)
    order = np.lexsort((keys, ids, null))
    rank = np.empty(len(order), np.int32)
    rank[order] = np.cumsum(_new(null[order], ids[order], keys[order])) - 1
    h, g, doc, pos = (np.concatenate(c) for c in zip(*columns, strict=True))
    columns.clear()
    by = np.lexsort((pos, rank[doc], g, h))
    h, g, doc, pos = h[by], g[by], doc[by], pos[by]
    # a document that stands in several batches is at the same place in each
    first = _new(h, g)
    start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    later = (rank[doc] != rank[doc[start]]) | (pos != pos[start])
    doc, pos = doc[later], pos[later]
    by = np.argsort(doc, kind="stable")
    doc, pos = doc[by], pos[by]
    cuts = np.searchsorted(doc, starts)
    for number, a, b in zip(numbers, cuts[:-1], cuts[1:], strict=True):
        yield mark_rows(marks(number, keys, doc[a:b], pos[a:b]))


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(key, at): starts of windows of ``docs`` (doc_id, key, text) that also start earlier.

    ``at`` is an array of pieces, little-endian 32-bit word positions each. Order of
    occurrences: doc_id, null last, then position. Rows of one key are one document; of
    different texts under one id, that with the smaller key comes first.
    """
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-size // RANGE_CHARS))
    likely = repeated_anchors(docs, anchor_finder).withColumnRenamed("key", "_key")
    # the columns of `docs` stay as they are: its exchange is used again to cut the texts
    d = docs.join(likely, F.col("key") == F.col("_key")).select("doc_id", "key", "text", "flagged")

    def emit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, ids = WordHashes(), batch_ids()
        for whole in stream:
            for i in range(0, whole.num_rows, DOCS):
                yield _candidates(whole.slice(i, DOCS), next(ids), cache, ranges)

    rows = d.mapInArrow(emit, f"range int, {MARKS}")
    return by_document(rows.groupBy(range_or_batch(ranges)).applyInArrow(_resolved, MARKS), "at")


def with_spans(docs: DataFrame, spans: DataFrame, column: str = "spans") -> DataFrame:
    """``docs`` (with ``key``) and the sorted spans of each as array<struct<start, end>>.

    A document has at most its length of distinct spans, so the list of one is bounded by
    its text.
    """
    by_key = spans.groupBy(F.col("key").alias("_key")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(column))
    return docs.join(by_key, F.col("key") == F.col("_key"), "left").drop("_key")


def union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Union of sorted spans."""
    out: list[tuple[int, int]] = []
    for s in spans or ():
        a, b = s["start"], s["end"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each document; ``kept`` is the text that is left.

    Null texts have no words. Rows that repeat id and text are one document and get the
    same result.
    """
    d = docs.select("doc_id", row_key().alias("key"), text_bytes().alias("text"))
    found = repeated_windows(d).withColumnRenamed("key", "_key")
    d = d.join(found, F.col("key") == F.col("_key"), "left").select("doc_id", "text", "at")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, at, kept = text.split(), 0, []
                for a, b in union([{"start": p, "end": p + WINDOW} for p in ordinals(found or []).tolist()]):
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(b"").alias("kept")).schema
    return d.mapInArrow(cut, schema)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed from every document, and a digest of what is left.

    Nulls and repeats as in ``remove_repeats``; texts of under 20 words lose nothing. An empty
    table gives no rows. Only doc_id and text are read, so other columns don't matter.
    """
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op3_substring_dedup": op3_substring_dedup}

ORACLES = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM g) WHERE k > 1),
p AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS kept, count(*) AS n FROM x LEFT JOIN p ON x.doc_id = p.doc_id AND x.p = p.p WHERE p.p IS NULL GROUP BY x.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
""",
}

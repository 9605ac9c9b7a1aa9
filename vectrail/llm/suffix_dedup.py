"""Removal of every byte in a 200-byte string that occurs elsewhere, by suffix arrays.

Texts are too many for one suffix array, so they are cut into shards such that all
occurrences of a string meet in one. Every 200-byte string chooses an anchor, one of its
``ANCHOR``-byte runs that all its occurrences choose alike (winnowing); an anchor owns the
strings that chose it, which start one after the other and lie in one piece of at most
353 bytes. Pieces are sharded by anchor. Anchors that surely occur once are left out first
(``repeats``), which loses none.

A shard's distinct pieces are sorted by an induced suffix array; the permuted common
prefixes tell for each owned string whether it equals another one. A piece that occurs
several times stands in the array once and repeats all its strings. A group of pieces
under one anchor that are all the same needs no array.

A task sends a piece once, however often its documents hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import row_key, table, text_bytes
from vectrail.llm.packing import mix
from vectrail.llm.repeats import Finder, ordinals, repeated_anchors
from vectrail.llm.substring_dedup import union, with_spans
from vectrail.llm.suffix_array import permuted_lcp, suffix_array
from vectrail.llm.winnow import anchors, rolling

#: Bytes of a string and of its anchor, and bytes of a shard's suffix array.
LENGTH, ANCHOR, SHARD = 200, 48, 1 << 21
BASE = 0xC2B2AE3D27D4EB4F
DOCS = 1000


def _anchored(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first string, strings owned) of a text's 200-byte strings."""
    if len(text) < LENGTH:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none
    grams = mix(rolling(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1), ANCHOR, BASE), 9)
    at, first, owned = anchors(grams, LENGTH - ANCHOR + 1)
    return grams[at], first, owned


def anchor_finder() -> Finder:
    """Hashes of a text's anchors."""
    return lambda text: _anchored(text)[0]


PIECES = pa.schema([("h", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("piece", pa.binary())])


def _pieces(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of (doc_id, key, text, flagged) under their anchors, each once a batch.

    A piece that comes twice in a batch has no key, and its places come as spans (without
    ``h``); other pieces carry the key and start of their one place.
    """
    for whole in stream:
        for batch in (whole.slice(i, DOCS) for i in range(0, whole.num_rows, DOCS)):
            places: dict[tuple[int, bytes], set[tuple[int, int]]] = {}
            for key, text, flagged in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                h, first, owned = _anchored(text)
                for i in ordinals(flagged).tolist():
                    a = int(first[i])
                    places.setdefault((int(h[i]), text[a : a + int(owned[i]) + LENGTH - 1]), set()).add((key, a))
            rows = []
            for (h, piece), at in places.items():
                h = h - (1 << 64) if h >> 63 else h
                if len(at) > 1:
                    rows.append((h, None, None, None, piece))
                    rows += [(None, key, a, a + len(piece), None) for key, a in at]
                else:
                    ((key, a),) = at
                    rows.append((h, key, a, a + len(piece), piece))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(PIECES)], schema=PIECES)


def _runs(repeated: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of runs of True."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], repeated.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def repeated_in(pieces: list[bytes]) -> list[np.ndarray]:
    """For each of distinct pieces, which of its 200-byte strings occur in another place."""
    t, sa = suffix_array(pieces)
    phi, lcp = permuted_lcp(t, sa)
    hit = lcp >= LENGTH
    repeated = hit.copy()
    repeated[phi[hit]] = True
    ends = np.cumsum([len(p) + 1 for p in pieces])
    return [repeated[e - len(p) - 1 : e - LENGTH] for p, e in zip(pieces, ends.tolist(), strict=True)]


def _judged(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Removed spans of pieces sorted by anchor; anchors share a shard up to its size."""
    shard: list[dict[bytes, list[tuple[int | None, int | None]]]] = []
    group: dict[bytes, list[tuple[int | None, int | None]]] = {}
    size, last = 0, None

    def spans(groups: list[dict]) -> pa.RecordBatch:
        out: list[tuple[int, int, int]] = []
        distinct = [(g, p) for g in groups if len(g) > 1 for p in g]
        found = repeated_in([p for _, p in distinct]) if distinct else []
        for (g, p), own in zip(distinct, found, strict=True):
            runs = [(0, len(p))] if len(g[p]) > 1 or g[p][0][0] is None else [(a, b + LENGTH - 1) for a, b in _runs(own)]
            out += [(key, start + a, start + b) for key, start in g[p] if key is not None for a, b in runs]
        for g in groups:
            if len(g) == 1:
                ((p, places),) = g.items()
                if len(places) > 1:
                    out += [(key, start, start + len(p)) for key, start in places if key is not None]
        return pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["key", "start", "end"])

    for batch in stream:
        done = batch.filter(pc.is_null(batch.column("h")))
        yield pa.RecordBatch.from_arrays([done.column(c) for c in ("key", "start", "end")], names=["key", "start", "end"])
        batch = batch.filter(pc.is_valid(batch.column("h")))
        for h, key, start, _, piece in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if h != last:
                if group:
                    shard.append(group)
                    size += sum(map(len, group)) if len(group) > 1 else 0
                    if size > SHARD or len(shard) > 50_000:
                        yield spans(shard)
                        shard, size = [], 0
                group, last = {}, h
            group.setdefault(piece, []).append((key, start))
    if group:
        shard.append(group)
    if shard:
        yield spans(shard)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, start, end) of byte spans of ``docs`` (doc_id, key, text) to remove; spans may overlap."""
    likely = repeated_anchors(docs, anchor_finder).withColumnRenamed("key", "_key")
    # the columns of `docs` stay as they are: its exchange is used again to cut the texts
    d = docs.join(likely, F.col("key") == F.col("_key")).select("doc_id", "key", "text", "flagged")
    rows = d.mapInArrow(_pieces, "h long, key long, start int, end int, piece binary")
    rows = rows.repartition(F.coalesce("h", "key")).sortWithinPartitions("h")
    return rows.mapInArrow(_judged, "key long, start int, end int")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each document; ``kept`` are the bytes left.

    Null texts are empty. Rows that repeat id and text are one document: their strings
    don't repeat each other. Texts shorter than 200 bytes lose nothing.
    """
    d = docs.select("doc_id", row_key().alias("key"), text_bytes().alias("text"))
    d = with_spans(d, repeated_spans(d)).select("doc_id", "text", "spans")

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            out = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                removed, at, kept = union(spans), 0, []
                for a, b in removed:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), len(removed), left))
            arrays = [pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    zero = F.lit(0).cast("long")
    schema = docs.select("doc_id", zero.alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.lit(b"").alias("kept")).schema
    return d.mapInArrow(cut, schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed from every document, and a digest of what is left.

    Nulls, repeats and short texts as in ``remove_repeats``. An empty table gives no rows.
    Only doc_id and text are read, so other columns don't matter.
    """
    d = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLES: dict[str, str] = {}

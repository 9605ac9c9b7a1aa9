"""Benchmark decontamination: a prefix-filtered join of document and item windows.

A window is 10 consecutive words of an item (all words of a shorter item), seen as a
sequence of shingles. Containment of the whole window needs every one of its shingles, so
one suffices as its prefix: the rarest in the documents. A document position with that
shingle is a candidate start; the start must leave room for the window (length bound) at
the offset the shingle has in it (positional bound), and then the words are compared.

Items go out in blocks of at most ``BLOCK_WINDOWS`` windows, broadcast one after the other;
each block is one pass over the documents, which carries the hits so far along.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, table, text_bytes, unused

#: Words of a window and of a shingle, and windows that are broadcast at once.
WINDOW, SHINGLE, BLOCK_WINDOWS = 10, 3, 100_000

#: Words of UTF-8 text in lower case: ASCII letters and digits, and all beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

STATE = "hits array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Words of a text with A-Z in lower case."""
    return WORD.findall(text.lower())


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    """Distinct windows of an item; none without words."""
    if len(words) <= size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def shingles(words: list[bytes] | tuple[bytes, ...], k: int) -> list[tuple[bytes, ...]]:
    return list(zip(*[words[i:] for i in range(k)], strict=False))


def blocks_of(items: DataFrame, limit: int = BLOCK_WINDOWS) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Item ids by window, in blocks; items come to the driver one partition at a time."""
    block: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), text_bytes()).toLocalIterator():
        for w in windows_of(words_of(bytes(text))):
            block.setdefault(w, set()).add(item)
            if len(block) >= limit:
                yield block
                block = {}
    if block:
        yield block


def rarity(docs: DataFrame, wanted: set[tuple[bytes, ...]], raw: str) -> dict[tuple[bytes, ...], int]:
    """How often the shingles of a block's windows occur in all documents."""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, sizes = Counter(), sorted({len(s) for s in sent.value})
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                for k in sizes:
                    found.update(filter(sent.value.__contains__, zip(*[words[i:] for i in range(k)], strict=False)))
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(s) for s in found], pa.binary()), pa.array(list(found.values()), pa.int64())], names=["s", "n"])

    rows = docs.select(raw).mapInArrow(count, "s binary, n long").groupBy("s").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r["s"]).split(b" ")): r["n"] for r in rows.toLocalIterator()}


def index_of(block: dict[tuple[bytes, ...], set[str]], often: dict[tuple[bytes, ...], int]) -> dict[int, dict]:
    """By shingle size: (offset, window, ids) of each window under its rarest shingle."""
    index: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for window, ids in block.items():
        own = shingles(window, min(SHINGLE, len(window)))
        at = min(range(len(own)), key=lambda i: (often.get(own[i], 0), own[i], i))
        index[len(own[at])][own[at]].append((at, list(window), sorted(ids)))
    return {k: dict(v) for k, v in index.items()}


def hits_in(words: list[bytes], index: dict[int, dict]) -> tuple[list[tuple[int, int]], set[str]]:
    """(start, end) of all item windows in a document, and the items."""
    spans, items = [], set()
    for k, prefix in index.items():
        for p, s in enumerate(zip(*[words[i:] for i in range(k)], strict=False)):
            if s in prefix:
                for offset, window, ids in prefix[s]:
                    start, end = p - offset, p - offset + len(window)
                    if start >= 0 and end <= len(words) and words[start:end] == window:
                        spans.append((start, end))
                        items.update(ids)
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def with_hits(docs: DataFrame, items: DataFrame, column: str, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``docs`` with a struct column: n_words, hits (start, end, start, end, ...), items."""
    spark, raw = docs.sparkSession, unused("raw_text", docs)
    kind = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
    d = docs.withColumn(raw, text_bytes())
    state = f"struct<n_words:bigint,{STATE.replace(' array', ':array').replace(', ', ',')}>"
    d = d.withColumn(column, F.lit(None).cast(state))
    schema = d.schema

    def search(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for text, old in zip(batch.column(raw).to_pylist(), batch.column(column).to_pylist(), strict=True):
                    words = words_of(text)
                    spans, ids = hits_in(words, sent.value)
                    if old:
                        spans += zip(old["hits"][::2], old["hits"][1::2], strict=True)
                        ids.update(old["items"])
                    rows.append({"n_words": len(words), "hits": [x for s in merged(spans) for x in s], "items": sorted(ids)})
                yield batch.set_column(batch.schema.get_field_index(column), column, pa.array(rows, kind))

        return run

    first = True
    for block in blocks_of(items, block_windows):
        if not first:
            d = materialize(d, "hits-so-far")
        wanted = {s for w in block for s in shingles(w, min(SHINGLE, len(w)))}
        sent = spark.sparkContext.broadcast(index_of(block, rarity(d, wanted, raw)))
        d, first = d.mapInArrow(search(sent), schema), False
    if first:  # no item has words
        d = d.mapInArrow(search(spark.sparkContext.broadcast({})), schema)
    return d.drop(raw)


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents in which no item window occurs; all columns kept.

    Null texts have no words and stay, repeated rows are judged each, and without items
    all documents stay. An empty table stays empty.
    """
    column = unused("contamination", docs)
    return with_hits(docs, items, column).where(F.size(f"{column}.hits") == 0).drop(column)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit words and items of every document.

    Item ids are compared as text; a null id is the empty one, and repeated ids count once.
    Null and empty texts have no words, and such items no windows; texts of any length are
    read whole. Repeated documents are judged each. Without items nothing is hit, an
    empty table of documents gives no rows. Only doc_id and text are read, so other columns
    don't matter.
    """
    d = with_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), "c").select("doc_id", "c.*")
    pairs = F.sequence(F.lit(0), F.size("hits") - 2, F.lit(2))
    n_hit = F.when(F.size("hits") > 0, F.aggregate(pairs, F.lit(0).cast("long"), lambda a, i: a + F.get("hits", i + 1) - F.get("hits", i))).otherwise(F.lit(0).cast("long"))
    return d.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


QUERIES = {"op4_decontaminate": op4_decontaminate}

ORACLES = {
    "op4_decontaminate": r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS gram
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT rid, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.gram = bw.gram),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN it USING (rid)
""",
}

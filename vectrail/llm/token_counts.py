"""Token counts of texts by a two-tier lookup of pre-token lengths, without a shuffle of pre-tokens.

No piece of the vocabulary has a space mark after another character, and some characters
stand in no piece beside others, so the model never merges across such places: a text's
tokens are those of its pre-tokens, the parts between them. ``Pretokens`` takes these cuts
from the model itself.

First tier: each task counts the pre-tokens of its texts in a bounded table and keeps the
most frequent; these tables are merged level by level into one of ``FREQUENT`` pre-tokens,
which is broadcast with their token counts. Its size does not depend on the corpus.
Second tier: a worker encodes what the table lacks, and keeps it in a cache of at most
``CACHED`` entries. Both tiers hold the library's own counts by the whole pre-token, so the
choice of frequent ones and a cleared cache change the speed and no result.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import table, text_bytes
from vectrail.llm.merging import merge_states

#: Pre-tokens of the broadcast table; entries of a worker's cache and of a task's counts.
FREQUENT, CACHED = 32_768, 400_000
#: Characters of a text that are cut into pre-tokens at once, and of a pre-token that is kept.
SLICE, LONGEST = 1 << 20, 64
#: The model's mark of a space, and the token limit of the query.
MARK, LIMIT = "▁", 4096


class Pretokens:
    """The cuts of a model's texts, and the token counts of the parts.

    Refuses a model whose pieces could cross a cut, or whose normaliser does more than mark spaces.
    """

    def __init__(self, model: bytes) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        m = self.model
        special = lambda i: m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not special(i)]
        joined = "".join(sorted({c for p in pieces if len(p) > 1 for c in p} - {MARK}))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or "\n" in joined or m.normalize("Ａ  b ") != f"{MARK}Ａ{MARK * 2}b{MARK}":
            raise ValueError("not a model of pieces that begin with their space marks")
        inner = re.escape(joined)
        self.parts = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|[^{inner}{MARK}]").findall
        self.begins = re.compile(f"(?<!{MARK}){MARK}").search
        self.alone = len(m.encode("\n"))

    def count(self, part: str) -> int:
        """Tokens of a part: those of it behind a line break, which joins with nothing, less the line break's own."""
        return len(self.model.encode(f"\n{part}")) - self.alone

    def slices(self, text: bytes) -> Iterator[list[str]]:
        """The parts of a text, as lists for slices of it, each cut at a space mark."""
        t = text.decode("utf-8", "replace").replace(" ", MARK)
        t = MARK + t if t else t
        at = 0
        while at < len(t):
            end = at + SLICE
            end = found.start() if end < len(t) and (found := self.begins(t, end)) else len(t)
            yield self.parts(t[at:end])
            at = end


class Lengths(dict):
    """Token counts by pre-token: the broadcast table's, and a bounded cache of others."""

    def __init__(self, pretokens: Pretokens, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.pretokens, self.frequent = pretokens, frequent

    def __missing__(self, part: str) -> int:
        n = self.pretokens.count(part)
        if len(part) <= LONGEST:
            if len(self) >= CACHED + len(self.frequent):
                self.clear()
                self.update(self.frequent)
            self[part] = n
        return n


@lru_cache(maxsize=1)
def _pretokens(model: bytes) -> Pretokens:
    """One loaded model a worker."""
    return Pretokens(model)


def _most(counts: Counter[str], keep: int) -> Counter[str]:
    """The ``keep`` most frequent, ties by the pre-token."""
    return Counter(dict(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:keep]))


def _state(counts: Counter[str], keep: int) -> bytes:
    return json.dumps(_most(counts, keep)).encode()


def frequent_pretokens(docs: DataFrame, model: bytes, keep: int = FREQUENT) -> list[str]:
    """Frequent pre-tokens of all texts of ``docs`` (text, binary), at most ``keep``.

    A task that sees more than ``CACHED`` different ones drops its rarest half, so what lies
    near the margin may be missing; the table only saves work.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens, counts, number = _pretokens(sent.value), Counter(), None
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(1)[0].as_py()
            for text in batch.column(0).to_pylist():
                for parts in pretokens.slices(text):
                    counts.update(parts)
                    if len(counts) > CACHED:
                        counts = _most(counts, CACHED // 2)
        if number is not None:
            kept = Counter({p: n for p, n in counts.items() if len(p) <= LONGEST})
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([_state(kept, keep)], pa.binary())], names=["part", "state"])

    def merge(states: list[bytes]) -> bytes:
        total: Counter[str] = Counter()
        for s in states:
            total.update(json.loads(s))
        return _state(total, keep)

    found = merge_states(docs.select("text", F.spark_partition_id().cast("long").alias("part")).mapInArrow(count, "part long, state binary"), merge)
    return list(json.loads(found)) if found else []


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each row of ``docs``: what the model makes of the whole text.

    No begin, end or other special token is added; a special token's string in a text is text.
    Null text counts as empty and has no tokens; bytes that are not UTF-8 count as the
    replacement character. Repeated rows are rows each, an empty table gives none. Other columns
    are left out, so their names don't matter; doc_id may have any type and be null. The texts
    are read twice, for the table of frequent pre-tokens and to count; neither reading is
    shuffled. ``model_path`` is a file of the driver; the model itself is sent to the workers.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    d = docs.select("doc_id", text_bytes().alias("text"))
    context, pretokens = d.sparkSession.sparkContext, Pretokens(model)
    lengths = {p: pretokens.count(p) for p in frequent_pretokens(d, model)}
    sent = context.broadcast((model, lengths))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pretokens = _pretokens(sent.value[0])
        known = Lengths(pretokens, sent.value[1])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [sum(sum(map(known.__getitem__, parts)) for parts in pretokens.slices(t)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    schema = docs.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_tokens")).schema
    return d.mapInArrow(count, schema)


def model_file(name: str = "piece_bpe_32k.model") -> str:
    """The path of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; nulls, repeats and empty tables as in ``count_tokens``."""
    d = count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), model_file())
    return d.withColumn("over_limit", F.col("n_tokens") > LIMIT)


QUERIES = {"op13_token_counts": op13_token_counts}
ORACLES: dict[str, str] = {}

"""Awkward rows that every operator gets: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node int, stats string, taken string, kept string, _k int, row_key string"
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def documents(seed: int = 7, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, ...) with passages that repeat within and across texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["naïve", "日本語", "Straße", "#", "$5", "don't", "A-B", "İstanbul"]
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    passages = [say(r.randint(25, 90)) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [say(r.randint(1, 60)) for _ in range(r.randint(1, 4))]
        if i % 3 == 0:
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        if i % 7 == 0:
            parts += [parts[0]] * 2
        out.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    out += [(n, None), (n + 1, ""), (n + 2, " \n\t "), (n + 3, "one"), (None, "text without an id"), (None, None), (n + 4, out[0][1]), (n + 4, out[0][1])]
    out += [(n + 5, say(20_000)), (n + 6, passages[0].upper()), (n + 7, "x" * 5000), (n + 8, "ab " * 3000), (n + 9, out[3][1] + " tail"), (n + 10, "\x0b\x0c" + say(30) + " " + say(3))]
    clash = ("k", 1, "s", "t", "kept", 5, "r")
    return [(a, b, (None, "en", "de")[(a or 0) % 3], (None, "web", "wiki", "code")[(a or 0) % 4], None if b is None else len(b), *clash) for a, b in out]


def frame(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(3)


def words(text: str | None) -> list[bytes]:
    return WORDS.findall((text or "").encode())


def found(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def stored(df: DataFrame, folder, name: str = "documents") -> str:
    """A folder of tables that holds ``df``."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)

"""Quality rules whose cutoffs come with a bound on the share of good documents they reject.

A stratum (a language) gets one cutoff per rule (a statistic of the text that grows with
junk), and the bound is on all its rules together. One half of the labelled documents orders
candidates: at level t each rule has the strictest cutoff that rejects at most the share t of
that half's good documents and more of its bad ones, so levels only get stricter. The other
half, the holdout, tests the levels from lenient to strict: a level passes while the exact
binomial probability of seeing at most the rejections observed among the good holdout
documents, by any rule, if the true share were ``alpha``, is at most delta / number of strata.
Testing in a fixed order and stopping at the first failure needs no further correction; the
division over strata is Bonferroni's. Of the levels that passed, the first half picks the one
that separates bad from good best. So with probability 1 - delta no stratum loses more than
``alpha`` of its good documents. A stratum with too few labels passes no level and applies no
rule beyond the base one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, table, text_bytes, unused

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
#: The largest share of a stratum's good documents that its rules may reject together, and
#: the chance that any stratum's bound fails.
ALPHA, DELTA = 0.01, 0.05
#: Cutoffs of a rule: bin / BINS.
BINS = 50
#: Shares of good documents that a rule may reject at each level, while levels are ordered.
LEVELS = (0.0, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01)
#: Good documents that a rejected bad one must outweigh when cutoffs are picked.
GOOD_WEIGHT = 20.0

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Rules: statistic in [0, 1], larger for junk.
RULES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "least(word_chars / greatest(n_words, 1), 50) / 50",
}


def text_stats(text: bytes) -> tuple[int, int, int, int, int, int]:
    """STATS of one text."""
    words = text.split()
    n = len(words)
    # code points: bytes that don't continue a character
    chars = sum(map(len, words)) if text.isascii() else len(text.decode("utf-8", "replace")) - sum(text.count(c) for c in SPACES)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, end = Counter(windows), 0
        for i, x in enumerate(windows):
            if times[x] > 1:
                repeated += i + 5 - max(end, i)
                end = i + 5
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def with_stats(docs: DataFrame, stats: str) -> DataFrame:
    """``docs`` with a struct column ``stats`` (STATS of ``text``), in one pass, no shuffle."""
    raw = unused("raw_text", docs)
    kind = pa.struct([(k, pa.int64()) for k in STATS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index(raw)
            rows = [text_stats(x) for x in batch.column(i).to_pylist()]
            column = pa.StructArray.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(len(STATS))], fields=list(kind))
            arrays = [c for j, c in enumerate(batch.columns) if j != i]
            names = [x for j, x in enumerate(batch.schema.names) if j != i]
            yield pa.RecordBatch.from_arrays([*arrays, column], names=[*names, stats])

    schema = docs.withColumn(stats, F.lit(None).cast("struct<" + ",".join(f"{k}:bigint" for k in STATS) + ">")).schema
    return docs.withColumn(raw, text_bytes()).mapInArrow(measure, schema)


def base_failed(s: str = "") -> Column:
    """Fewer than 10 words, or over a fifth of the words in repeated 5-word windows."""
    return F.expr(f"{s}n_words < 10 OR 100 * {s}n_repeat_words > 20 * {s}n_words")


def _tail(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k)."""
    total = 0.0
    for i in range(k + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p))
    return min(total, 1.0)


def order_cutoffs(counts: pd.DataFrame) -> list[float]:
    """A rule's cutoff (reject above it) at each level, from counts by (bin, good); inf where none helps."""
    share = {}
    for good in (0, 1):
        x = counts[counts.good == good].set_index("bin").n
        share[good] = [x[x.index > b].sum() / max(x.sum(), 1) for b in range(BINS + 1)]
    out = []
    for level in LEVELS:
        helps = [b for b in range(BINS + 1) if share[1][b] <= level and share[0][b] > GOOD_WEIGHT * share[1][b]]
        out.append(min(helps) / BINS if helps else math.inf)
    return [min(out[: k + 1]) for k in range(len(out))]  # a later level is never more lenient


def certified_level(counts: pd.DataFrame, alpha: float, delta: float) -> int:
    """The level to use, from counts by (at, fold, good), where ``at`` is the first level that rejects; -1 if none."""
    of = lambda fold, good: counts[(counts.fold == fold) & (counts.good == good)]
    rejected = lambda fold, good, level: int(of(fold, good).n[of(fold, good)["at"] <= level].sum())
    total = {(f, g): int(of(f, g).n.sum()) for f in (0, 1) for g in (0, 1)}
    best, chosen = 0.0, -1
    for level in range(len(LEVELS)):
        k, n = rejected(1, 1, level), total[1, 1]
        if n == 0 or k > alpha * n or _tail(k, n, alpha) > delta:
            break
        gain = rejected(0, 0, level) / max(total[0, 0], 1) - GOOD_WEIGHT * rejected(0, 1, level) / max(total[0, 1], 1)
        if gain > best:
            best, chosen = gain, level
    return chosen


def bins(s: str = "") -> dict[str, Column]:
    """Each rule's bin, 0 to BINS, from the statistics of column ``s``."""
    out = {}
    for k, e in RULES.items():
        out[k] = F.ceil(F.least(F.lit(1.0), F.expr(re.sub(r"\bn_\w+|\bword_chars", lambda m: f"{s}{m[0]}", e))) * BINS).cast("int")
    return out


def cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, cutoff) from ``stats`` (doc_id, lang, STATS) and ``labels``.

    Repeated label rows of an id count once; ids whose labels disagree, and null labels,
    are left out. Of documents that share an id one counts, that with the smallest values.
    Only counts by (stratum, rule, bin) or (stratum, level) leave the executors' partial sums.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("most")).where("good = most")
    s = stats.join(known.select(F.col("doc_id").alias("_id"), F.col("good").cast("int").alias("good")), F.col("doc_id") == F.col("_id"))
    s = s.where(~base_failed()).select("doc_id", "good", F.struct(stratum().alias("stratum"), *[b.alias(k) for k, b in bins().items()]).alias("x"))
    s = s.groupBy("doc_id").agg(F.min("good").alias("good"), F.min("x").alias("x")).select(F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("fold"), "good", "x.*")
    s = materialize(s, "quality-labelled")
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("bin")) for k in RULES])).alias("r")
    counts = s.where("fold = 0").select("stratum", "good", each).groupBy("stratum", "r.rule", "r.bin", "good").agg(F.count("*").alias("n"))

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stratum": [pdf.stratum[0]], "rule": [pdf.rule[0]], "cuts": [order_cutoffs(pdf)]})

    ordered = materialize(counts.groupBy("stratum", "rule").applyInPandas(order, "stratum string, rule string, cuts array<double>"), "quality-levels")
    wide = ordered.groupBy(F.col("stratum").alias("_s")).agg(*[F.max(F.when(F.col("rule") == k, F.col("cuts"))).alias(f"_{k}") for k in RULES])
    within = lambda k: F.size(F.filter(F.col(f"_{k}"), lambda c: F.col(k) <= c * BINS + 1e-6))
    passes = [within(k) for k in RULES]  # levels are nested: those that don't reject come first
    levels = s.join(wide, F.col("stratum") == F.col("_s")).withColumn("at", F.least(*passes)).groupBy("stratum", "at", "fold", "good").agg(F.count("*").alias("n"))
    strata = max(1, ordered.select("stratum").distinct().count())

    def certify(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"stratum": [pdf.stratum[0]], "level": [certified_level(pdf, alpha, delta / strata)]})

    chosen = levels.groupBy("stratum").applyInPandas(certify, "stratum string, level int")
    return ordered.join(chosen, "stratum").select("stratum", "rule", F.when(F.col("level") >= 0, F.get("cuts", F.greatest("level", F.lit(0)))).otherwise(float("inf")).alias("cutoff"))


def stratum() -> Column:
    """Documents without a language are a stratum of their own."""
    return F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("null"))


def judged(docs: DataFrame, found: DataFrame, s: str = "") -> DataFrame:
    """``docs`` with boolean columns base_failed and kept, by the cutoffs of its stratum.

    The cutoffs are one row per stratum; Spark broadcasts them while they are small, and
    joins by shuffle beyond that.
    """
    own, cut = unused("stratum_key", docs), {k: unused(f"cut_{k}", docs) for k in RULES}
    wide = found.groupBy(F.col("stratum").alias(own)).agg(*[F.max(F.when(F.col("rule") == k, F.col("cutoff"))).alias(cut[k]) for k in RULES])
    d = docs.join(materialize(wide, "quality-cutoffs"), stratum() == F.col(own), "left")
    broken = F.lit(False)
    for k, b in bins(s).items():
        broken = broken | F.coalesce(b > F.col(cut[k]) * BINS + 1e-6, F.lit(False))
    d = d.withColumn("base_failed", base_failed(s)).withColumn("kept", ~F.col("base_failed") & ~broken)
    return d.drop(own, *cut.values())


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass; all columns kept.

    Null or empty texts fail the base rule. Repeated rows are judged each. An empty table
    gives no rows.
    """
    q = unused("stats", docs)
    small = docs.select("doc_id", "text", "lang")
    stats = materialize(with_stats(small, "q").select("doc_id", "lang", "q.*"), "quality-stats")
    found = cutoffs(stats, labels)
    clash = [c for c in docs.columns if c in ("base_failed", "kept")]
    d = docs.withColumnsRenamed({c: unused(f"_own_{c}", docs) for c in clash})
    d = judged(with_stats(d, q), found, f"{q}.").where("kept").drop("base_failed", "kept", q)
    return d.withColumnsRenamed({unused(f"_own_{c}", docs): c for c in clash}).select(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document.

    A null text has no words and fails the base rule like any of under 10 words; a null
    language is a stratum of its own. Repeated rows are judged each, and equal texts of one
    language alike. An empty table gives no rows; without labels only the base rule applies.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    stats = materialize(with_stats(docs, "q").select("doc_id", "lang", "q.*"), "quality-stats")
    found = cutoffs(stats, table(spark, sf_dir, "labels"))
    out = judged(stats, found)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES: dict[str, str] = {}

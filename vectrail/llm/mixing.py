"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Every source is a queue with a service rate (its target). Its documents stand in a shuffled
order (by MD5 of the id), once per epoch, and are served in packets of ``PACKET`` words. A
packet's *virtual finish time* is the source's cumulative words, itself included, divided by
the source's target. All packets stand in one global order of finish time (ties: by source,
then by place in the source) and are taken until the total budget is spent; the packet in
which it ends is truncated. Nothing else decides what is taken: a source comes within a
packet of its target because the queues share the budget fairly.

Skew: the cumulative sums of a source run in two levels, over hash buckets of its documents
and within a bucket, so that no task gets a whole source; there are as many buckets as keep
``ROWS`` rows in one. The global order is cut into ranges of finish time: sums by range find
the one in which the budget ends, and only its packets are sorted. Packets are made and
summed where their document is; only ids, sizes and sums are shuffled, never texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.llm.common import materialize, row_key, table, unused

WORD = r"[^\x20\x09-\x0D]+"
#: Weights that sources take in turn, by code point of their name, null last.
WEIGHTS = (3, 1, 2)
#: Words of the mix as a multiple of all words, and the most that a source or document repeats.
SHARE, EPOCHS = 1.5, 2
#: Words of a packet; rows of a hash bucket, packets of a range of finish times (on average).
PACKET, ROWS = 128, 50_000


def words(text: str = "text") -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, queue) of each source: water-filling by weight under caps.

    A target stops at ``epochs`` times the source's size and the excess goes to the others
    by weight. With sources in order of cap per weight, the water level that holds if all
    before a source are full rises up to the first source that isn't full and falls after
    it, so the level is the maximum and a target is least(cap, weight * level). ``queue``
    numbers the sources by name, null last. The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    return (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("queue", F.row_number().over(by_name))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("queue") - 1) % len(weights) + 1).cast("double"))
        .withColumn("ratio", F.lit(float(epochs)) * F.col("source_size") / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("level", (F.lit(float(share)) * F.col("total") - float(epochs) * F.col("full_before")) / F.sum("weight").over(after))
        .withColumn("level", F.max("level").over(Window.partitionBy()))
        .select("source", "source_size", F.least(F.lit(float(epochs)) * F.col("source_size"), F.col("weight") * F.col("level")).alias("target"), "queue")
    )


def places(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``sizes`` with source_size, target, queue and ``cum``: words of the source up to and with
    this document in one epoch, in the shuffled order. Ties go by id, size and the other columns."""
    t = targets(sizes, weights, share, epochs).withColumnRenamed("source", "_source")
    rest = [c for c in sizes.columns if c not in ("doc_id", "source", "size")]
    digits = max(2, math.ceil(math.log(max(sizes.count() / ROWS, 1), 16)))
    d = sizes.withColumn("_h", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("_b", F.substring("_h", 1, digits))
    up_to = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy("source", "_b").agg(F.sum("size").alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(up_to), F.lit(0)))
    sums = sums.join(t, F.col("source").eqNullSafe(F.col("_source"))).select("_source", F.col("_b").alias("_bucket"), "_before", "source_size", "target", "queue")
    sums = materialize(sums, "mix-offsets")
    within = Window.partitionBy("source", "_b").orderBy("_h", "doc_id", "size", *rest).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_in", F.sum("size").over(within))
    d = d.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_bucket")))
    return materialize(d.withColumn("cum", F.col("_before") + F.col("_in")).drop("_h", "_b", "_in", "_before", "_source", "_bucket"), "mix-places")


def _packet(epoch: Column | int, number: Column, packet: int) -> tuple[Column, Column, Column]:
    """(finish, place, words) of the packet of this number, from 1, in an epoch."""
    served = F.least(number * packet, F.col("size"))
    place = (F.lit(epoch) if isinstance(epoch, int) else epoch) * F.col("source_size") + F.col("cum") - F.col("size") + served
    return place / F.col("target"), place, served - (number - 1) * packet


def cut(placed: DataFrame, budget: int, epochs: int = EPOCHS, packet: int = PACKET) -> tuple[float, int, int, int]:
    """(finish, queue, place, words) of the packet in which the budget ends: words of it are taken.

    Sums over ranges of finish time find the range in which the budget ends, and only that
    range's packets are sorted. A budget that never ends gives a cut behind all packets.
    """
    count = placed.agg(F.sum(F.ceil(F.col("size") / packet))).first()[0] or 0
    ranges = max(4096, math.ceil(epochs * count / ROWS))
    numbers = F.sequence(F.lit(1).cast("long"), F.ceil(F.col("size") / packet))
    d = placed.where("size > 0 AND target > 0").withColumn("_e", F.explode(F.array(*[F.lit(e).cast("long") for e in range(epochs)])))
    finish, place, words = _packet(F.col("_e"), F.col("_n"), packet)
    packets = d.withColumn("_n", F.explode(numbers)).select(finish.alias("finish"), "queue", place.alias("place"), words.alias("words"))
    packets = packets.withColumn("range", F.floor(F.col("finish") * ranges))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = packets.groupBy("range").agg(F.sum("words").alias("w")).withColumn("up_to", F.sum("w").over(before))
    ends = sums.where(F.col("up_to") > budget).orderBy("range").select("range", F.col("up_to") - F.col("w")).first()
    if ends is None:
        return float("inf"), 0, 0, 0
    order = Window.orderBy("finish", "queue", "place").rowsBetween(Window.unboundedPreceding, 0)
    last = packets.where(F.col("range") == ends[0]).withColumn("up_to", F.sum("words").over(order) + ends[1])
    last = last.where(F.col("up_to") > budget).orderBy("finish", "queue", "place").first()
    return last["finish"], last["queue"], last["place"], budget - (last["up_to"] - last["words"])


def schedule(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, packet: int = PACKET) -> DataFrame:
    """One row per row of ``sizes`` (doc_id, source, size, ...) with its place in the mix.

    Adds source_size, target and ``taken``: the words of its packets that come before the
    global cut, of all epochs, with what is taken of the packet at the cut. Ties in the
    shuffled order go by id, size and the other columns, so reruns agree. Empty table: no
    rows. Null source: a source of its own. Null text or size 0: taken 0. Repeated rows:
    queue entries each.
    """
    placed = places(sizes, weights, share, epochs)
    total = placed.agg(F.sum("size")).first()[0] or 0
    at, queue, end, part = cut(placed, math.floor(min(share, epochs) * total), epochs, packet)
    n = F.ceil(F.col("size") / packet)
    taken = F.lit(0).cast("long")
    for e in range(epochs):

        def words_of(number: Column, e: int = e) -> Column:
            finish, place, words = _packet(e, number, packet)
            same = (finish == at) & (F.col("queue") == queue) & (place == end)
            before = (finish < at) | ((finish == at) & ((F.col("queue") < queue) | ((F.col("queue") == queue) & (place < end))))
            return F.when(before, words).when(same, F.lit(part)).otherwise(F.lit(0)).cast("long")

        first, final = _packet(e, F.lit(1), packet)[0], _packet(e, n, packet)[0]
        across = F.aggregate(F.sequence(F.lit(1).cast("long"), n), F.lit(0).cast("long"), lambda s, number: s + words_of(number))  # noqa: B023
        taken = taken + F.when(final < at, F.col("size")).when(first > at, F.lit(0)).otherwise(across)
    return placed.withColumn("taken", F.when((F.col("size") > 0) & (F.col("target") > 0), taken).otherwise(F.lit(0)).cast("long")).drop("queue", "cum")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mixed documents: one row per document that the mix takes, all columns kept.

    Adds ``taken`` (words taken, at most ``epochs`` times the document's), named apart from
    the columns that are there. Rows that repeat id, text and source count as one place each.
    Null texts have no words and are never taken; a null source is a source, the last one. An
    empty table stays empty.
    """
    key, taken = unused("row_key", documents), unused("taken", documents)
    sizes = documents.select("doc_id", "source", words().alias("size"), row_key().alias("_k"))
    plan = schedule(materialize(sizes, "mix-sizes"), weights, share, epochs).where("taken > 0")
    other, of = unused("plan_key", documents), unused("plan_source", documents)
    plan = plan.groupBy(F.col("_k").alias(other), F.col("source").alias(of)).agg(F.max("taken").alias(taken))
    d = documents.withColumn(key, row_key())
    return d.join(plan, (F.col(key) == F.col(other)) & F.col("source").eqNullSafe(F.col(of))).drop(key, other, of)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source size, target and words taken of every document.

    Null and blank texts have size 0 and are never taken, a null source is the last one,
    repeated rows are rows each. An empty table gives no rows. Only doc_id, source and text
    are read, so other columns don't matter.
    """
    d = table(spark, sf_dir, "documents").select("doc_id", "source", words().alias("size"))
    return schedule(materialize(d, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op7_mix_sources": op7_mix_sources}

ORACLES = {
    "op7_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
q AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS queue FROM s),
w AS (SELECT *, CAST([3, 1, 2][(queue - 1) % 3 + 1] AS DOUBLE) AS weight FROM q),
r AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, queue, least(2.0::DOUBLE * source_size, weight * max(level) OVER ()) AS target FROM l),
p AS (SELECT row_number() OVER () AS n, doc_id, size, source_size, target, queue,
        CAST(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT n, queue, target, size, e * source_size + cum - size + least(i * 128, size) AS place, least(i * 128, size) - (i - 1) * 128 AS words
      FROM p, (SELECT unnest([0, 1]) AS e) x, unnest(range(1, (size + 127) // 128 + 1)) u(i) WHERE target > 0),
o AS (SELECT n, words, sum(words) OVER (ORDER BY place / target, queue, place ROWS UNBOUNDED PRECEDING) AS up_to FROM k),
m AS (SELECT n, sum(greatest(0, least(words, (SELECT floor(1.5::DOUBLE * sum(size)) FROM d) - (up_to - words)))) AS taken FROM o GROUP BY n)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM p LEFT JOIN m USING (n)
""",
}

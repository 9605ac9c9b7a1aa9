"""An approximate index kept on storage: cells of vectors with product-quantised codes, and an exact re-rank.

``build`` fits on at most ``SAMPLE`` vectors (the first by hash of their position): coarse centres, whose number grows
with the rows (``cells_for``), and for each of ``PARTS`` stretches of a vector ``CODES`` code words of what is left
after the centre. Every row is indexed: it is assigned to its nearest centre and kept as one byte a stretch. The index is
a folder, ``blocks`` of a cell's rows (positions, codes, vectors) and ``model`` with the centres and code words, published
by one rename. ``load`` opens it in another session.

``search`` looks into the ``probes`` nearest cells of each query, in two passes over blocks of cells that some query of a
task asks for. The first reads codes alone and finds where a query's best ``rerank`` estimates end; the second re-ranks just
those rows beside their codes and passes on the best k: products in single precision leave out rows that can't be among
them, the rest are scored exactly. So neither estimates nor the rows to re-rank are shuffled. Ties go to the smaller position.
Several settings of probes and rerank (``searches``) share both passes: a pair is estimated once a pass for all of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.functions.vectors import doubles
from vectrail.operators.blocks import NONE, Best, against, dots, hits, kind, room
from vectrail.operators.ranking import vectors
from vectrail.sources.shared import stored

#: Vectors to fit on; stretches of a vector; code words of a stretch; rows of a block of codes; queries of a block; cells at most.
SAMPLE, PARTS, CODES, BLOCK, QUERIES, MOST_CELLS = 50_000, 16, 256, 1 << 13, 1024, 16_384
#: Estimates that a task keeps, of as many queries as fit; pairs that are looked at one by one at once.
ESTIMATES, PAIRS = 1 << 26, 1 << 17
#: Blocks of queries per core from which on a task re-ranks over the whole index; fewer share it in pieces, to keep all cores at work.
ROUNDS = 4
#: Bits that queries, centres and code words are rounded to for estimates, so that sums of their products are exact in any order.
BITS = 25


class Model(NamedTuple):
    """Unit centres (cells x dims) and code words (parts x words x dims of a part)."""

    centres: np.ndarray
    words: np.ndarray


class Index(NamedTuple):
    """An opened index: its model, blocks of a cell's rows (cell, pos, code, v) with positions as an array, codes and vectors as bytes, the number of rows, and the kind of their numbers (f4 or f8)."""

    model: Model
    blocks: DataFrame
    rows: int
    number: str

    @property
    def codes(self) -> DataFrame:
        """(cell, pos, code) of every row."""
        width = len(self.model.words)
        at = F.posexplode("pos").alias("i", "pos")
        return self.blocks.select("cell", "code", at).select("cell", "pos", F.substring("code", F.col("i") * width + 1, F.lit(width)).alias("code"))


def cells_for(rows: int) -> int:
    """Cells of an index: the root of the rows, a power of two, at most MOST_CELLS so that centres stay small enough to broadcast."""
    return min(MOST_CELLS, 1 << max(0, round(math.log2(max(1, rows)) / 2)))


def _means(x: np.ndarray, k: int, rounds: int, unit: bool = False) -> np.ndarray:
    """k centres of x by Lloyd's rounds from rows spread over x; an empty one stays where it was."""
    centres = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(axis=1) - 2 * (x @ centres.T), axis=1)
        sums, n = np.zeros_like(centres), np.bincount(near, minlength=len(centres))
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if unit:
            centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return centres


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as (rows, parts, width), with zeros at the end where the parts don't divide the dimensions."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, width * parts - x.shape[1]))).reshape(len(x), parts, width)


def fit(rows: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = 10) -> Model:
    """The model of ``rows`` (pos, embedding), from at most ``sample`` of them."""
    some = rows.orderBy(F.xxhash64("pos"), "pos").limit(sample).select(doubles("embedding").alias("v")).toArrow()
    x = np.array(some.column(0).to_pylist(), float).reshape(len(some), -1)
    if not len(x):
        raise ValueError("an index needs rows")
    centres = _means(x, cells, rounds, unit=True)
    left = _cut(x - centres[np.argmax(x @ centres.T, axis=1)], PARTS)
    return Model(centres, np.stack([_pad_words(_means(left[:, p], CODES, rounds)) for p in range(PARTS)]))


def _pad_words(words: np.ndarray) -> np.ndarray:
    """CODES words; where there are fewer the last one stands for the rest."""
    return np.concatenate((words, np.repeat(words[-1:], CODES - len(words), axis=0)))


def encode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cell, codes) of rows."""
    cell = np.argmax(x @ model.centres.T, axis=1)
    left, codes = _cut(x - model.centres[cell], len(model.words)), np.empty((len(x), len(model.words)), np.uint8)
    for p, words in enumerate(model.words):
        codes[:, p] = np.argmin((words**2).sum(axis=1) - 2 * (left[:, p] @ words.T), axis=1)
    return cell.astype(np.int32), codes


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def build(rows: DataFrame, path: str, cells: int | None = None) -> Index:
    """Index ``rows`` (pos, embedding; unit vectors of one length) below ``path``, a folder that all tasks see; an existing one is refused."""
    spark, (fs, place) = rows.sparkSession, pa.fs.FileSystem.from_uri(path)
    if fs.get_file_info(place).type != pa.fs.FileType.NotFound:
        raise FileExistsError(path)
    d = rows.select("pos", "embedding")
    n = d.count()
    model = fit(d, cells or cells_for(n))
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell, codes = encode(sent.value, _matrix(batch.column(1)).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["cell", "pos", "code", "v"])

    given = vectors(d)
    codes = stored(given.mapInArrow(run, f"cell int, pos long, code binary, v {dict(given.dtypes)['v']}"), "codes")
    # a crowded cell is many blocks
    parts = codes.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = codes.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("pos"), "parts").cast("int")).drop("parts")

    def pack(table: pa.Table) -> pa.Table:
        t, v = table.combine_chunks(), _matrix(table.column("v").combine_chunks())
        code = b"".join(t.column("code").to_pylist())
        return pa.table({"cell": t.column("cell")[:1], "pos": pa.array([t.column("pos").to_numpy()]), "code": pa.array([code], pa.binary()), "v": pa.array([v.tobytes()], pa.binary())})

    dealt.groupBy("cell", "part").applyInArrow(pack, "cell int, pos array<long>, code binary, v binary").write.parquet(f"{path}.partial/blocks")
    about = [(n, kind(given), *(a for x in model for a in (list(x.shape), x.astype(float).ravel().tolist())))]
    spark.createDataFrame(about, "rows long, number string, c_shape array<int>, centres array<double>, w_shape array<int>, words array<double>").coalesce(1).write.parquet(f"{path}.partial/model")
    fs.move(f"{place}.partial", place)
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    """Open an index that ``build`` made."""
    about = spark.read.parquet(f"{path}/model").first()
    model = Model(np.array(about["centres"]).reshape(about["c_shape"]), np.array(about["words"]).reshape(about["w_shape"]))
    return Index(model, spark.read.schema("cell int, pos array<long>, code binary, v binary").parquet(f"{path}/blocks"), about["rows"], about["number"])


def _rounded(x: np.ndarray, length: np.ndarray) -> np.ndarray:
    """x in multiples of 2**-BITS of a power of two of at least ``length``."""
    unit = np.exp2(np.ceil(np.log2(np.where(length > 0, length, 1.0))) - BITS)
    return np.rint(x / unit) * unit


def _rounded_model(model: Model) -> Model:
    """The model that estimates and the order of cells are made with."""
    most = np.linalg.norm(model.centres, axis=1).max() + math.sqrt((np.linalg.norm(model.words, axis=2).max(axis=1) ** 2).sum())
    return Model(*(_rounded(x, most) for x in model))


def _rounded_queries(q: np.ndarray) -> np.ndarray:
    return _rounded(q, np.linalg.norm(q, axis=1, keepdims=True))


def _order(q: np.ndarray, model: Model) -> np.ndarray:
    """Cells of each query, nearest first; of both as they are rounded, so that every task has the same order."""
    return np.argsort(-(q @ model.centres.T), axis=1, kind="stable")


def _places(q: np.ndarray, model: Model) -> np.ndarray:
    """The place of each cell (column) in a query's (row's) order."""
    order = _order(q, model)
    out = np.empty(order.shape, np.int32)
    np.put_along_axis(out, order, np.arange(order.shape[1], dtype=np.int32)[None, :], 1)
    return out


def _decoded(model: Model, cell: int, code: pa.Scalar) -> np.ndarray:
    """A block's rows as their codes give them."""
    parts, words, width = model.words.shape
    at = np.frombuffer(code.as_buffer(), np.uint8).reshape(-1, parts) + np.arange(parts) * words
    return np.take(model.words.reshape(-1, width), at, axis=0).reshape(len(at), -1)[:, : model.centres.shape[1]] + model.centres[cell]


def _near(queries: DataFrame, index: Index, probes: int, also: tuple[int, ...] = ()) -> DataFrame:
    """(pos, v, near, compared, each) of queries (pos, embedding): the nearest cells, how many rows are in them, and in the first ``also`` of them."""
    sizes = np.zeros(len(index.model.centres), np.int64)
    for row in index.blocks.groupBy("cell").agg(F.sum(F.size("pos")).alias("n")).collect():  # MOST_CELLS rows at most
        sizes[row["cell"]] = row["n"]
    sent = queries.sparkSession.sparkContext.broadcast((_rounded_model(index.model), sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                model, sizes = sent.value
                near = _order(_rounded_queries(_matrix(batch.column(1)).astype(float)), model)[:, :probes].astype(np.int32)
                each = [sizes[near[:, :p]].sum(axis=1) for p in also]
                each = pa.array(list(np.stack(each, axis=1)) if each else [[]] * len(near), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(near), pa.list_(pa.int32())), pa.array(sizes[near].sum(axis=1)), each], names=["pos", "v", "near", "compared", "each"])

    given = vectors(queries)
    return given.mapInArrow(run, f"pos long, v {dict(given.dtypes)['v']}, near array<int>, compared long, each array<long>")


def _asked(index: Index, probes: int):
    """Condition of a block of queries and a block of the index: some query looks into its cell. None if all do."""
    return None if probes >= len(index.model.centres) else F.exists("q_near", lambda x: F.array_contains(x, F.col("cell")))


def _ends(near: DataFrame, index: Index, settings: list[tuple[int, int]]) -> DataFrame:
    """(qpos, least, last): ``cutoffs`` of each setting (probes, keep), as arrays."""
    sent, rows, n = near.sparkSession.sparkContext.broadcast(_rounded_model(index.model)), index.rows, len(settings)
    widest = max(p for p, _ in settings)
    # those of the same cells from the largest re-rank to the smallest, each of what the one before keeps
    ways = {p: sorted((s for s in range(n) if settings[s][0] == p), key=lambda s: -settings[s][1]) for p in {p for p, _ in settings}}

    def solve(left: list, rights: Iterator[list]) -> Iterator[list]:
        own, q, model = left[0], _rounded_queries(left[1].astype(float)), sent.value
        places = _places(q, model)
        e, pos, cells, edges = np.empty((len(own), rows), np.float32), np.empty(rows, np.int64), [], [0]
        for cell, p, code in rights:
            at, cell = edges[-1], cell.as_py()
            ask = np.flatnonzero(places[:, cell] < widest)
            if len(ask):
                span = slice(at, at + len(p))
                if len(ask) == len(own):
                    e[:, span] = q @ _decoded(model, cell, code).T
                else:
                    e[ask, span] = q[ask] @ _decoded(model, cell, code).T
                pos[span] = p
                cells.append(cell)
                edges.append(span.stop)
        at_block = places[:, np.array(cells, int)]
        block = np.repeat(np.arange(len(cells)), np.diff(edges))
        least, last = np.full((len(own), n), -np.inf), np.full((len(own), n), NONE)
        for i, line in enumerate(e):
            for probes, ways_of in ways.items():
                spans = np.flatnonzero(at_block[i] < probes)
                if len(spans) == len(cells):
                    top = line[: edges[-1]]
                else:
                    top = np.concatenate([line[edges[j] : edges[j + 1]] for j in spans.tolist()] or [line[:0]])
                there = len(top)
                for s in ways_of:
                    keep = settings[s][1]
                    if there > keep:
                        top = np.partition(top, len(top) - keep)[len(top) - keep :]
                        least[i, s] = top[0]
                        equal, more = line[: edges[-1]] == top[0], np.count_nonzero(top == top[0])
                        if np.count_nonzero(equal) > more:
                            ties = np.flatnonzero(equal)
                            ties = ties[at_block[i, block[ties]] < probes]
                            last[i, s] = np.sort(pos[ties])[more - 1]
        yield [own, list(least), list(last)]

    size = max(1, min(QUERIES, ESTIMATES // max(1, rows)))
    asks = near.select("pos", "v", *(["near"] if widest < len(index.model.centres) else []))
    return against(asks, index.blocks.select("cell", "pos", "code"), solve, "qpos long, least array<double>, last array<long>", size, whole=True, condition=_asked(index, widest), number=index.number)


def cutoffs(near: DataFrame, index: Index, probes: int, keep: int) -> DataFrame:
    """(qpos, least, last): a query's best ``keep`` rows by estimate are those over ``least``, and those equal to it up to position ``last``.

    A task reads the codes for a few queries and keeps one estimate a row: ``ESTIMATES`` in all, or one query's.
    """
    return _ends(near, index, [(probes, keep)]).select("qpos", F.col("least")[0].alias("least"), F.col("last")[0].alias("last"))


def searches(queries: DataFrame, index: Index, settings: list[tuple[int, int]], k: int = 10) -> DataFrame:
    """(setting, qpos, gpos, score, rank): for each setting (probes, rerank), by its place, the best k of the ``rerank`` best estimates by exact score, ties by position."""
    n, cells = len(settings), len(index.model.centres)
    settings = [(min(p, cells), max(r, k)) for p, r in settings]
    widest, limits = max(p for p, _ in settings), np.array([p for p, _ in settings])
    near = stored(_near(queries, index, widest).select("pos", "v", *(["near"] if widest < cells else [])), "near")
    ends = _ends(near, index, settings).withColumnRenamed("qpos", "pos")
    sent = queries.sparkSession.sparkContext.broadcast(_rounded_model(index.model))

    def solve(left: list, rights: Iterator[list]) -> Iterator[list[np.ndarray]]:
        own, q, model = left[0], left[1].astype(float), sent.value
        least, last = (x.values.flatten().to_numpy().reshape(len(own), n).T for x in left[-2:])
        rounded, single = _rounded_queries(q), q.astype(np.float32)
        places, best, floor = _places(rounded, model), [Best(len(own), k) for _ in settings], np.full((n, len(own)), -np.inf)
        for cell, pos, code, v in rights:
            cell = cell.as_py()
            asks = places[None, :, cell] < limits[:, None]
            ask = np.flatnonzero(asks.any(axis=0))
            if not len(ask):
                continue
            with np.errstate(all="ignore"):
                spare = room(q[ask], v)
                enter = np.where(asks[:, ask], floor[:, ask], np.inf).min(axis=0) - spare
                product = single[ask] @ v.astype(np.float32, copy=False).T
                a, b = hits((product >= np.nextafter(enter.astype(np.float32), np.float32(-np.inf))[:, None]) | ~np.isfinite(product))
            if not len(a):
                continue
            rows = _decoded(model, cell, code)
            # where many pairs enter, as in a query's first cell, all are estimated together
            dense = rounded[ask] @ rows.T if 16 * len(a) > len(ask) * len(pos) else None
            for at in range(0, len(a), PAIRS):
                i, j = ask[a[at : at + PAIRS]], b[at : at + PAIRS]
                e = (np.einsum("ij,ij->i", rounded[i], rows[j]) if dense is None else dense[a[at : at + PAIRS], j]).astype(np.float32)
                there = [asks[s, i] & ((e > least[s, i]) | ((e == least[s, i]) & (pos[j] <= last[s, i]))) for s in range(n)]
                some = np.flatnonzero(np.logical_or.reduce(there))
                i, j = i[some], j[some]
                score = dots(q, v, i, j)
                for s in range(n):
                    add = there[s][some] & ~(score < floor[s, i])
                    if add.any():
                        best[s].add(i[add], pos[j[add]], score[add])
                        floor[s] = best[s].least(slice(None))
        for s in range(n):
            found = best[s].rows(own)
            yield [np.full(len(found[0]), s, np.int32), *found]

    many = near.count()
    asked = near.join(ends, "pos")
    whole = many >= QUERIES * ROUNDS * queries.sparkSession.sparkContext.defaultParallelism
    found = against(asked, index.blocks, solve, "setting int, qpos long, gpos long, score double", QUERIES, whole, _asked(index, widest), index.number, many)
    rank = F.row_number().over(Window.partitionBy("setting", "qpos").orderBy(F.desc("score"), "gpos"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, index: Index, probes: int, rerank: int, k: int = 10) -> DataFrame:
    """(qpos, gpos, score, rank): the best k of the ``rerank`` best estimates, by exact score, ties by position."""
    return searches(queries, index, [(probes, rerank)], k).drop("setting")


def sweep(queries: DataFrame, index: Index, exact: DataFrame, settings: list[tuple[int, int]], k: int = 10) -> DataFrame:
    """(probes, rerank, n, recall, compared, scored) of each setting, all of which are searched together.

    n queries, the mean share of the rows of ``exact`` (qpos, gpos) that were found, and the shares of all pairs whose codes
    were compared and which were re-ranked.
    """
    q, total = queries.select("pos", "embedding"), F.lit(max(1, index.rows))
    want = stored(exact.select("qpos", "gpos"), "exact")
    hits = searches(q, index, settings, k).join(want, ["qpos", "gpos"]).groupBy("setting", "qpos").agg(F.count("*").alias("hits"))
    cost = _near(q, index, max(p for p, _ in settings), tuple(p for p, _ in settings)).select(F.col("pos").alias("qpos"), F.posexplode("each").alias("setting", "compared"))
    each = want.groupBy("qpos").agg(F.count("*").alias("wanted")).join(cost, "qpos").join(hits, ["setting", "qpos"], "left")
    most = F.element_at(F.array(*[F.lit(max(r, k)) for _, r in settings]), F.col("setting") + 1)
    each = each.groupBy("setting").agg(F.count("*").alias("n"), F.avg(F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"), (F.avg("compared") / total).alias("compared"), (F.avg(F.least("compared", most)) / total).alias("scored"))
    ways = queries.sparkSession.createDataFrame([(s, *x) for s, x in enumerate(settings)], "setting int, probes int, rerank int")
    return ways.join(each, "setting", "left").select("probes", "rerank", F.coalesce("n", F.lit(0)).alias("n"), "recall", "compared", "scored")

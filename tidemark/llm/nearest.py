"""Nearest neighbours by inner product, through stable projections and kd-trees.

Vectors are lengthened by one component so that all have the norm of the longest;
the largest inner product is then the smallest distance.  A Gaussian (2-stable)
projection to ``DIMS`` dimensions makes the squared projected distance over the
squared distance chi-square distributed with ``DIMS`` degrees of freedom.  A
query takes points by growing projected distance, verifies them on the original
vectors, and stops when the chi-square test says that a nearer point is unlikely
to lie behind: a point at the distance of the ``k``-th best found has a squared
projected distance above the bound with probability 1 - ``CONFIDENCE``.

The projected space is cut into cells of about ``PER_CELL`` points (at most
``CELLS``) by the upper levels of a kd-tree, fitted to a sample of at most
``SAMPLE`` vectors; every vector is put into its cell, where the lower levels are
built.  Where more than ``CELLS`` cells would be needed, each cell is split by a
hash into parts that are searched alike.  A query first searches its own cell,
and then, with the distance that it has found, all cells that the test can't rule
out.  Equal vectors are one point with its smallest ids, so no cell holds more
than its share.

Defined cases: vectors that are null, zero, or that hold null or non-finite
components take no part; vectors of different lengths have no inner product, so
each length is searched by itself; queries with fewer candidates than ``k`` get
all; ties go to the smaller id; a repeated id is one row for each different
vector; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm.common import materialise

DIMS = 24
CONFIDENCE = 0.87
CELLS, PER_CELL = 65_536, 4096
SAMPLE = 20_000
LEAF = 512
#: Queries whose projected distances to a cell are computed together.
ROWS = 512
#: Queries that meet a cell in one group.
QUERIES_AT_ONCE = 50_000
_VECTOR = np.dtype("<f8")


def chi_square_cdf(x, dims: int = DIMS):
    """The distribution function for an even number of degrees of freedom."""
    h = np.asarray(x, float) / 2
    term, total = np.ones_like(h), np.ones_like(h)
    for j in range(1, dims // 2):
        term = term * h / j
        total = total + term
    return 1 - np.exp(-h) * total


def chi_square_bound(p: float = CONFIDENCE, dims: int = DIMS) -> float:
    """Where the distribution function reaches ``p``."""
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square_cdf(mid, dims) < p else (lo, mid)
    return hi


def points_of(vectors: DataFrame, k: int, dim: int) -> DataFrame:
    """(v, ids): each different valid vector of length ``dim``, as bytes of doubles, and its ``k + 1`` smallest ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch["embedding"]
            flat = column.flatten()
            values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
            good = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
            ids = batch["vec_id"].to_numpy()
            kept: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(good).tolist():
                kept.setdefault((values[i] + 0.0).astype(_VECTOR).tobytes(), []).append(int(ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array([*kept], pa.binary()), pa.array([sorted(set(x))[: k + 1] for x in kept.values()], pa.list_(pa.int64()))], names=["v", "ids"])

    whole = vectors.filter((F.size("embedding") == dim) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    # a vector that very many rows have is first gathered in 64 groups
    some = whole.mapInArrow(run, "v binary, ids array<long>").groupBy("v", F.pmod(F.xxhash64("ids"), F.lit(64)).alias("deal")).agg(smallest.alias("ids"))
    return some.groupBy("v").agg(smallest.alias("ids"))


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), _VECTOR).reshape(len(values), -1) if values else np.empty((0, 0))


class Space:
    """The projection and the cells."""

    def __init__(self, dim: int, longest: float, seed: int):
        self.longest = longest
        self.matrix = np.random.default_rng(seed).standard_normal((dim + 1, DIMS))
        self.splits: list[tuple[int, float] | None] = []

    def project(self, v: np.ndarray, is_query: bool) -> np.ndarray:
        last = np.zeros(len(v)) if is_query else np.sqrt(np.maximum(self.longest - (v * v).sum(axis=1), 0))
        return v @ self.matrix[:-1] + last[:, None] * self.matrix[-1]

    def fit(self, points: np.ndarray, cells: int) -> None:
        """Split at medians of the widest dimension, level by level; a cell is a number of bits."""
        self.levels = max(0, math.ceil(math.log2(max(1, cells))))
        groups = [np.arange(len(points))]
        self.cuts: list[list[tuple[int, float]]] = []
        for _ in range(self.levels):
            row, after = [], []
            for g in groups:
                p = points[g]
                if len(g) < 2:
                    row.append((0, 0.0))
                    after += [g, g[:0]]
                    continue
                axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
                at = float(np.median(p[:, axis]))
                row.append((axis, at))
                after += [g[p[:, axis] <= at], g[p[:, axis] > at]]
            self.cuts.append(row)
            groups = after

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for row in self.cuts:
            axis, at = np.array([a for a, _ in row]), np.array([x for _, x in row])
            out = out * 2 + (points[np.arange(len(points)), axis[out]] > at[out])
        return out


def _tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A kd-tree's leaves: the order of the points, where leaves start, and their boxes."""
    order, starts, stack = [], [], [np.arange(len(points))]
    while stack:
        g = stack.pop()
        if len(g) <= LEAF:
            starts.append(sum(map(len, order)) if not starts else starts[-1] + len(order[-1]))
            order.append(g)
            continue
        p = points[g]
        axis = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
        g = g[np.argpartition(p[:, axis], len(g) // 2)]
        stack += [g[: len(g) // 2], g[len(g) // 2 :]]
    flat, starts = np.concatenate(order), np.array(starts)
    return flat, starts, np.minimum.reduceat(points[flat], starts), np.maximum.reduceat(points[flat], starts)


def _box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(axis=-1)


def _search(space: Space, v: np.ndarray, ids: list[list[int]], queries: np.ndarray, known: np.ndarray, k: int) -> list[tuple[int, list[tuple[int, float]]]]:
    """For each query the best ``k`` ids of a cell, better than the score ``known`` so far."""
    projected = space.project(v, False)
    flat, starts, low, high = _tree(projected)
    projected, v, ids = projected[flat], v[flat], [ids[i] for i in flat.tolist()]
    ends = np.append(starts[1:], len(flat))
    smallest = np.array([x[0] for x in ids])
    bound = chi_square_bound()
    square = (projected * projected).sum(axis=1)
    out = []
    for first in range(0, len(queries), ROWS):
        some = queries[first : first + ROWS]
        asked = space.project(some, True)
        gaps = square - 2 * (asked @ projected.T) + (asked * asked).sum(axis=1)[:, None]
        for q, p, gap, least in zip(some, asked, gaps, known[first : first + ROWS].tolist(), strict=True):
            far = space.longest + float(q @ q)
            near = _box_distance(p, low, high)
            leaves = np.argsort(near, kind="stable")
            scores, rows, done, step, kth = np.empty(0), np.empty(0, np.int64), 0, 1, least
            while done < len(leaves):
                reach = max(0.0, far - 2 * kth) * bound * (1 + 1e-9) if math.isfinite(kth) else math.inf
                part = leaves[done : done + step]
                part = part[near[part] <= reach]
                if not part.size:
                    break  # the chi-square test holds for all that is left
                cand = np.concatenate([np.arange(starts[i], ends[i]) for i in part.tolist()])
                cand = cand[gap[cand] <= reach]
                if len(cand) > 4 * k:  # the nearest ones first: they shorten the reach for the others
                    nearest_first = cand[np.argpartition(gap[cand], 2 * k)[: 2 * k]]
                    sure = np.sort(v[nearest_first] @ q)[-k]
                    cand = cand[gap[cand] <= max(0.0, far - 2 * max(kth, float(sure))) * bound * (1 + 1e-9)]
                rows = np.append(rows, cand)
                scores = np.append(scores, v[cand] @ q)
                if len(rows) > k:
                    best = np.lexsort((smallest[rows], -scores))[:k]
                    rows, scores = rows[best], scores[best]
                if len(rows) >= k:
                    kth = max(least, float(scores.min()))
                done, step = done + step, step * 2
            scores = (v[rows] * q).sum(axis=1)
            found = sorted(((-float(s), i) for s, r in zip(scores, rows.tolist(), strict=True) for i in ids[r]))[:k]
            out.append([(i, -s) for s, i in found])
    return out


def _searcher(space: Space, k: int):
    def run(key: tuple[pa.Scalar, ...], points: pa.Table, queries: pa.Table) -> pa.Table:
        qid, ids, scores = [], [], []
        if len(points) and len(queries):
            known = np.nan_to_num(queries["known"].to_numpy().astype(float), nan=-math.inf)
            found = _search(space, _matrix(points["v"]), points["ids"].to_pylist(), _matrix(queries["v"]), known, k)
            for q, best in zip(queries["qid"].to_pylist(), found, strict=True):
                qid += [q] * len(best)
                ids += [i for i, _ in best]
                scores += [s for _, s in best]
        return pa.table([pa.array(qid, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], names=["qid", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, is_query, *, k: int = 20, seed: int = 5, per_cell: int = PER_CELL, most_cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest other rows of each row with ``is_query``."""
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    asked = vectors.filter(is_query)
    # lengths that queries have: a handful in any table of embeddings
    lengths = [r["n"] for r in asked.filter("size(embedding) > 0").select(F.size("embedding").alias("n")).distinct().collect()]
    return functools.reduce(DataFrame.unionAll, [_nearest(vectors, asked, n, k, seed, per_cell, most_cells) for n in sorted(lengths)], empty)


def _nearest(vectors: DataFrame, queries: DataFrame, dim: int, k: int, seed: int, per_cell: int, most_cells: int) -> DataFrame:
    """The search among vectors of one length."""
    points = materialise(points_of(vectors, k, dim), "nearest-points")
    asked = materialise(points_of(queries, 0, dim).select("v", F.col("ids")[0].alias("qid")), "nearest-queries")
    every = queries.filter(F.size("embedding") == dim).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).distinct()
    n = points.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    norm = points.mapInArrow(_norms, "norm double").agg(F.max("norm")).first()[0]
    sample = points.select("v").orderBy(F.xxhash64("v")).limit(SAMPLE).toArrow()
    first = _matrix(sample["v"])
    space = Space(first.shape[1], norm, seed)
    wanted = -(-n // per_cell)
    space.fit(space.project(first, False), min(most_cells, wanted))
    chunks, parts = max(1, -(-asked.count() // QUERIES_AT_ONCE)), max(1, -(-wanted // most_cells))
    dealt = lambda column, into: F.pmod(F.xxhash64(column), F.lit(into))
    copies = lambda into: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(into - 1).cast("long")))

    placed = materialise(points.mapInArrow(_placer(space, False), "v binary, ids array<long>, cell long, p array<double>"), "nearest-cells")
    axes = [F.struct(F.min(F.col("p")[j]).alias("low"), F.max(F.col("p")[j]).alias("high")).alias(f"x{j}") for j in range(DIMS)]
    boxes = placed.groupBy("cell").agg(*axes).collect()  # at most most_cells rows
    cells = np.array([r["cell"] for r in boxes])
    low = np.array([[r[f"x{j}"]["low"] for j in range(DIMS)] for r in boxes])
    high = np.array([[r[f"x{j}"]["high"] for j in range(DIMS)] for r in boxes])
    spread = placed.select("v", "ids", "cell", dealt("v", parts).alias("part"), copies(chunks).alias("chunk"))

    def search(sent: DataFrame) -> DataFrame:
        sent = sent.select("qid", "v", "cell", "known", dealt("qid", chunks).alias("chunk"), copies(parts).alias("part"))
        return spread.groupBy("cell", "part", "chunk").cogroup(sent.groupBy("cell", "part", "chunk")).applyInArrow(_searcher(space, k + 1), "qid long, vec_id long, score double")

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = space.project(_matrix(batch["v"]), True)
            own = np.array([cells[np.argmin(_box_distance(x, low, high))] for x in p], np.int64)
            yield pa.RecordBatch.from_arrays([batch["qid"], batch["v"], pa.array(own), pa.nulls(len(batch), pa.float64())], names=["qid", "v", "cell", "known"])

    one = materialise(search(asked.mapInArrow(home, "qid long, v binary, cell long, known double")), "nearest-first")
    order = [F.desc("score"), F.asc("vec_id")]
    top = F.row_number().over(W.Window.partitionBy("qid").orderBy(*order))
    # the last of the k + 1 best of the own cell (a query itself may be one of them)
    reached = one.withColumn("r", top).filter(F.col("r") == k + 1).select("qid", F.col("score").alias("known"))
    again = asked.join(reached, "qid", "left")

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bound = chi_square_bound()
        for batch in batches:
            v = _matrix(batch["v"])
            known = batch["known"].to_numpy(zero_copy_only=False).astype(float)
            rows, where = [], []
            for i, p in enumerate(space.project(v, True)):
                gap = _box_distance(p, low, high)
                reach = math.inf if math.isnan(known[i]) else max(0.0, norm + float(v[i] @ v[i]) - 2 * known[i]) * bound
                hit = (gap <= reach) & (np.arange(len(cells)) != np.argmin(gap))
                where.append(cells[hit])
                rows.append(np.full(hit.sum(), i))
            take = pa.array(np.concatenate(rows) if rows else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch["qid"].take(take), batch["v"].take(take), pa.array(np.concatenate(where) if where else np.empty(0, np.int64)), batch["known"].take(take)], names=["qid", "v", "cell", "known"])

    two = search(again.select("qid", "v", "known").mapInArrow(others, "qid long, v binary, cell long, known double"))
    best = one.unionAll(two).withColumn("r", top).filter(F.col("r") <= k + 1).drop("r")
    named = every.mapInArrow(_pack, "query_id long, v binary").join(asked, "v").select("query_id", "qid")
    found = named.join(best, "qid").filter("query_id <> vec_id")
    rank = F.row_number().over(W.Window.partitionBy("query_id").orderBy(*order))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = _matrix(batch["v"])
        yield pa.RecordBatch.from_arrays([pa.array((v * v).sum(axis=1) if len(v) else np.empty(0))], names=["norm"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [(np.array(x, float) + 0.0).astype(_VECTOR).tobytes() if None not in x else b"" for x in batch["embedding"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["query_id"], pa.array(packed, pa.binary())], names=["query_id", "v"])


def _placer(space: Space, is_query: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            p = space.project(_matrix(batch["v"]), is_query)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(space.cell(p)), pa.array(list(p), pa.list_(pa.float64()))], names=[*batch.schema.names, "cell", "p"])

    return run

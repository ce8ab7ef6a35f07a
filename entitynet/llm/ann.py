"""Nearest vectors by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected on ``PROJECTED`` Gaussian directions. The squared projected distance
of two vectors over their squared distance follows a chi-square law, so once the projected
neighbours of a query have been verified out to radius r, a vector nearer than the k-th
best distance d so far has been seen with probability chi2_cdf(r^2 / d^2); the search ends
when that reaches ``SURE``.

The upper levels of the kd-tree are split at medians of a bounded sample; every vector is
filed in a leaf, and a leaf of more than ``CELL`` vectors in several cells. Each cell is
searched in one task, which builds the lower levels over its own vectors and takes the
queries one batch after another. A query first searches its own cell for a bound on d, and
then every cell whose box lies within the radius at which the test holds.

Copies of a vector are one entry with its k+1 smallest ids: no other copy can be in a result.

Defined cases: rows without an id, and vectors that are null, empty, zero or hold a null or
a non-finite number take no part, nor do vectors of another length than most; a repeated
row counts once; with fewer than k candidates all are returned; ties go to smaller ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from entitynet.session import cut

PROJECTED = 8
SURE = 0.97
#: Vectors of a cell, leaves of the shared tree at most, vectors of the sample, vectors of a leaf inside a cell.
CELL, LEAVES, SAMPLE, BUCKET = 20_000, 4_096, 8_192, 256


def radius_factor(sure: float = SURE, dims: int = PROJECTED) -> float:
    """x with chi2_cdf(x) = sure, for an even number of degrees of freedom, by bisection."""
    cdf = lambda x: 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(dims // 2))
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < sure else (low, middle)
    return high


def directions(length: int, seed: int = 11, dims: int = PROJECTED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((length, dims))


def split_planes(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each inner node of a complete tree, each split at the median of its widest axis."""
    axis, value = np.zeros(1 << depth, np.int64), np.zeros(1 << depth)
    parts = {1: points}
    for node in range(1, 1 << depth):
        part = parts.pop(node)
        if len(part):
            axis[node] = np.ptp(part, axis=0).argmax()
            value[node] = np.median(part[:, axis[node]])
        right = part[:, axis[node]] > value[node]
        parts[2 * node], parts[2 * node + 1] = part[~right], part[right]
    return axis, value


def leaf_of(points: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    node = np.ones(len(points), np.int64)
    while len(node) and node[0] < len(axis):
        node = 2 * node + (points[np.arange(len(points)), axis[node]] > value[node])
    return node - len(axis)


def buckets(points: np.ndarray, size: int = BUCKET) -> list[np.ndarray]:
    """Row numbers of the leaves of a kd-tree over ``points``."""
    todo, done = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        order = rows[np.argsort(points[rows, np.ptp(points[rows], axis=0).argmax()], kind="stable")]
        todo += [order[:len(order) // 2], order[len(order) // 2:]]
    return done


def box_distance(low: np.ndarray, high: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distance of a point from each box."""
    away = np.maximum(np.maximum(low - point, point - high), 0)
    return (away * away).sum(1)


class Cell:
    """The vectors of a cell under a kd-tree of their projections."""

    def __init__(self, ids: list[list[int]], vectors: np.ndarray, matrix: np.ndarray):
        projected = vectors @ matrix
        self.leaves = []
        for rows in buckets(projected):
            self.leaves.append((projected[rows], np.ascontiguousarray(vectors[rows].T), [ids[r] for r in rows]))
        self.low = np.array([p.min(0) for p, *_ in self.leaves])
        self.high = np.array([p.max(0) for p, *_ in self.leaves])

    def nearest(self, own: int, vector: np.ndarray, projected: np.ndarray, k: int, bound: float, factor: float) -> list[tuple[float, int]]:
        """The k best (distance, id) found, none beyond ``bound``."""
        best: list[tuple[float, int]] = []
        away = box_distance(self.low, self.high, projected)
        for i in np.argsort(away, kind="stable"):
            reach = best[-1][0] if len(best) == k else bound
            if away[i] > factor * reach * reach:
                break
            points, columns, ids = self.leaves[i]
            near = np.flatnonzero(((points - projected) ** 2).sum(1) <= factor * reach * reach)
            # Summed one coordinate after another: the same number on every machine.
            squares = (columns[:, near] - vector[:, None]) ** 2
            distance = np.sqrt(np.add.accumulate(squares, axis=0)[-1])
            close = np.flatnonzero(distance <= reach)
            if len(close):
                best = sorted([*best, *((float(distance[j]), x) for j in close for x in ids[near[j]] if x != own)])[:k]
        return best


def search_cells(matrix: np.ndarray, k: int, factor: float):
    """For rows sorted by (cell, kind), a cell's vectors first: (query_id, vec_id, score)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors, cell = None, [], [], None
        for batch in batches:
            out: list[tuple[int, int, float]] = []
            data = np.array(batch.column("vector").flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            for i, row in enumerate(batch.select(["cell", "kind", "id", "ids", "bound"]).to_pylist()):
                if row["cell"] != at:
                    at, ids, vectors, cell = row["cell"], [], [], None
                if row["kind"] == 0:
                    ids.append(row["ids"])
                    vectors.append(data[i])
                elif vectors:
                    cell = cell or Cell(ids, np.array(vectors), matrix)
                    found = cell.nearest(row["id"], data[i], data[i] @ matrix, k, row["bound"], factor)
                    out += [(row["id"], x, d) for d, x in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))],
                                                 ["query_id", "vec_id", "score"])

    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, each once."""
    good = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0))
    lengths = good.groupBy(F.size("vector").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    return good.where(F.size("vector") == (lengths.n if lengths else 0)).distinct()


def neighbours(embeddings: DataFrame, is_query, k: int = 10, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row for which ``is_query``, a condition on vec_id, holds."""
    schema, spark = "query_id bigint, vec_id bigint, score double", embeddings.sparkSession
    rows = cut(usable(embeddings))
    kind = rows.schema["vector"].dataType.simpleString()
    order = Window.partitionBy("vector").orderBy("vec_id")
    entries = cut(rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k + 1)
                  .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    queries = rows.where(is_query(F.col("vec_id"))).withColumnRenamed("vec_id", "id")
    count = entries.count()
    sample = [r.vector for r in entries.where(F.pmod(F.xxhash64("vector"), F.lit(max(count, 1))) < SAMPLE).select("vector").limit(2 * SAMPLE).collect()]
    matrix = directions(len(sample[0]) if sample else 1)
    leaves = min(LEAVES, max(1, -(-count // CELL)))
    axis, value = split_planes(np.array(sample, np.float64).reshape(len(sample), -1) @ matrix if sample else np.empty((0, PROJECTED)),
                               (leaves - 1).bit_length())
    factor = radius_factor(sure)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.array(batch.column("vector").flatten(), dtype=np.float64).reshape(batch.num_rows, -1) @ matrix
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf_of(points, axis, value)), pa.array(list(points), pa.list_(pa.float64()))],
                [*batch.schema.names, "leaf", "point"])

    filed = cut(entries.select("ids", "vector").mapInArrow(project, f"ids array<bigint>, vector {kind}, leaf bigint, point array<double>"))
    edges = lambda f: F.array(*[f(F.element_at("point", i + 1)) for i in range(PROJECTED)])
    boxes = filed.groupBy("leaf").agg(F.count("*").alias("n"), edges(F.min).alias("low"), edges(F.max).alias("high")).orderBy("leaf").collect()
    leaf, parts = np.array([b.leaf for b in boxes], np.int64), np.array([-(-b.n // CELL) for b in boxes], np.int64)
    low, high = (np.array([b[x] for b in boxes]).reshape(len(boxes), PROJECTED) for x in ("low", "high"))
    share = F.create_map(*[F.lit(int(x)) for pair in zip(leaf, parts) for x in pair]) if len(boxes) else F.lit(None).cast("map<bigint,int>")
    cell = F.col("leaf") * (1 << 32) + F.pmod(F.xxhash64("vector"), share[F.col("leaf")].cast("long"))
    points = filed.select(cell.alias("cell"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), "ids", "vector", F.lit(None).cast("double").alias("bound"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each query and cell that it must search: its own, or without ``first`` all within reach."""
        for batch in batches:
            projected = np.array(batch.column("vector").flatten(), dtype=np.float64).reshape(batch.num_rows, -1) @ matrix
            bounds = batch.column("bound").to_pylist()
            at, to = [], []
            for i, point in enumerate(projected):
                away = box_distance(low, high, point)
                if bounds[i] is None:
                    b = int(away.argmin())
                    visits = [(int(leaf[b]) << 32) + batch.column("id")[i].as_py() % int(parts[b])]
                else:
                    visits = [(int(leaf[b]) << 32) + c for b in np.flatnonzero(away <= factor * bounds[i] ** 2) for c in range(parts[b])]
                at += [i] * len(visits)
                to += visits
            got = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(to, pa.int64()), pa.array([1] * len(to), pa.int32()), got.column("id"), pa.array([None] * len(to), pa.list_(pa.int64())),
                 got.column("vector"), pa.array([float("inf") if x is None else x for x in got.column("bound").to_pylist()], pa.float64())],
                ["cell", "kind", "id", "ids", "vector", "bound"])

    def search(asked: DataFrame) -> DataFrame:
        routed = asked.mapInArrow(route, f"cell bigint, kind int, id bigint, ids array<bigint>, vector {kind}, bound double")
        return points.unionByName(routed).repartition("cell").sortWithinPartitions("cell", "kind", "id").mapInArrow(search_cells(matrix, k, factor), schema)

    if not boxes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    first = cut(search(queries.withColumn("bound", F.lit(None).cast("double"))))
    bound = first.groupBy(F.col("query_id").alias("id")).agg(F.max("score").alias("d"), F.count("*").alias("n"))
    bounded = queries.join(bound, "id", "left").withColumn("bound", F.when(F.col("n") == k, F.col("d")).otherwise(F.lit(float("inf"))))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    found = search(bounded.select("id", "vector", "bound")).unionByName(first).distinct()
    return found.withColumn("rank", ranked).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Approximate nearest neighbours by a few stable projections in kd-trees.

Vectors are projected on ``M`` random Gaussian directions (2-stable), so a squared projected distance over the
squared true one follows chi-square with M degrees of freedom. A split tree over the projected space, fitted on at
most ``SAMPLE`` vectors, deals all vectors into cells; each cell is a kd-tree of its own. A query takes projected
neighbours in order of distance, verifies each on the original vector, and stops once the chi-square test says that
anything still closer than its present k-th would have been projected nearer with probability ``CONFIDENCE``.

Two rounds: first each query searches its own cell, which gives a k-th distance; then it goes to exactly those cells
whose projected box could still pass the test at that distance. So queries aren't sent to all cells.
Equal vectors are one point with its k + 1 smallest ids (more can never be among k neighbours), counted in two
steps, so a vector that a third of all rows have neither fills a cell nor meets in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelwatch.llm.blocks import written

M, K, CONFIDENCE, SEED = 8, 10, 0.98, 11
SAMPLE = 50_000
CELL_ROWS = 5_000
LEAF = 32


def chi_square_bound(m: int, confidence: float) -> float:
    """Quantile of chi-square with m (even) degrees of freedom, by bisection of its closed form."""
    lo, hi = 0.0, 1000.0
    for _ in range(80):
        x = (lo + hi) / 2
        below = 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(m // 2))
        lo, hi = (x, hi) if below < confidence else (lo, x)
    return hi


class Tree:
    """kd-tree over projected points: median splits on the widest axis, boxes of all nodes."""

    def __init__(self, points: np.ndarray, leaf: int) -> None:
        self.left, self.right, self.axis, self.cut, self.rows, self.low, self.high = [], [], [], [], [], [], []
        self._grow(points, np.arange(len(points)), leaf)

    def _grow(self, points: np.ndarray, rows: np.ndarray, leaf: int) -> int:
        node, own = len(self.left), points[rows]
        for part, x in zip((self.left, self.right, self.axis, self.cut, self.rows, self.low, self.high),
                           (-1, -1, 0, 0.0, rows, own.min(0), own.max(0))):
            part.append(x)
        axis = int(np.argmax(self.high[node] - self.low[node]))
        values = own[:, axis]
        cut = float(np.median(values))
        below = values <= cut
        if len(rows) > leaf and not below.all():
            self.axis[node], self.cut[node], self.rows[node] = axis, cut, None
            self.left[node] = self._grow(points, rows[below], leaf)
            self.right[node] = self._grow(points, rows[~below], leaf)
        return node

    def cells(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            if self.left[node] < 0:
                out[rows] = node
                continue
            below = points[rows, self.axis[node]] <= self.cut[node]
            todo += [(self.left[node], rows[below]), (self.right[node], rows[~below])]
        return out


def _box_distance(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(-1)


def search(vectors: np.ndarray, points: np.ndarray, tree: Tree, q: np.ndarray, at: np.ndarray, k: int, bound: float,
           worst: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and squared distances of the k nearest found; worst: a squared k-th distance known already.

    Leaves open in order of their box's projected distance; the test stops the search when the nearest leaf
    left fails it.
    """
    heap_rows, heap_d = np.zeros(0, np.int64), np.zeros(0)
    leaves = [i for i in range(len(tree.left)) if tree.left[i] < 0]
    near = _box_distance(np.array([tree.low[i] for i in leaves]), np.array([tree.high[i] for i in leaves]), at)
    for j in np.argsort(near, kind="stable"):
        kth = min(worst, heap_d[k - 1] if len(heap_d) >= k else np.inf)
        if near[j] > bound * kth:
            break
        rows = tree.rows[leaves[j]]
        gap = points[rows] - at
        rows = rows[(gap * gap).sum(1) <= bound * kth]
        diff = vectors[rows] - q
        heap_rows = np.concatenate([heap_rows, rows])
        heap_d = np.concatenate([heap_d, (diff * diff).sum(1)])
        order = np.argsort(heap_d, kind="stable")
        # all rows tied with the k-th stay: ids decide later
        keep = order[: max(k, int(np.searchsorted(heap_d[order], heap_d[order[k - 1]], "right")))] if len(order) > k else order
        heap_rows, heap_d = heap_rows[keep], heap_d[keep]
    return heap_rows, heap_d


def _projector(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, M))


def neighbours(vectors: DataFrame, every: int = 100, k: int = K, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row whose vec_id is divisible by ``every``.

    vectors: vec_id (distinct), embedding array of float or double; other columns are not read. score: Euclidean
    distance in double precision; ties go to the smaller vec_id. Vectors that are null, zero, of another length than
    most, or hold null or non-finite components take no part. With k candidates or fewer all are returned. Every
    vector is indexed; only the split tree is fitted on a bounded sample. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    bound = chi_square_bound(M, confidence)
    ok = ("embedding is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) "
          "and exists(embedding, x -> x != 0)")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(ok)
    dims = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if dims is None:
        return spark.createDataFrame([], schema)
    dim = dims.d
    rows = rows.filter(F.size("embedding") == dim)
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    one = Window.partitionBy("embedding", "_salt").orderBy("vec_id")
    two = Window.partitionBy("embedding").orderBy("vec_id")
    fewest = (rows.withColumn("_salt", salt).withColumn("_n", F.row_number().over(one)).filter(F.col("_n") <= k + 1)
              .withColumn("_n", F.row_number().over(two)).filter(F.col("_n") <= k + 1))
    points = fewest.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    matrix = _projector(dim)

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["point"] = list(np.stack(b.embedding.to_numpy()) @ matrix)
                yield b

    points = written(points.mapInPandas(project, "embedding array<double>, ids array<long>, point array<double>"))
    n = points.count()
    sample = np.array([r.point for r in points.select("point").orderBy(F.xxhash64("point"), "point").limit(SAMPLE).collect()])
    tree = Tree(sample, max(1, int(len(sample) / max(1.0, n / CELL_ROWS))))
    # cells by the tree's own cuts, with boxes of all their points, sampled or not

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["cell"] = tree.cells(np.stack(b.point.to_numpy()))
                yield b

    celled = written(points.mapInPandas(deal, "embedding array<double>, ids array<long>, point array<double>, cell long"))
    ends = [x for i in range(M) for x in (F.min(F.col("point")[i]).alias(f"l{i}"), F.max(F.col("point")[i]).alias(f"h{i}"))]
    boxes = celled.groupBy("cell").agg(*ends).orderBy("cell").collect()
    cells = np.array([b.cell for b in boxes])
    low = np.array([[b[f"l{i}"] for i in range(M)] for b in boxes])
    high = np.array([[b[f"h{i}"] for i in range(M)] for b in boxes])

    def queries_here(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["cell"] = tree.cells(np.stack(b["point"].to_numpy()))
                b["worst"] = np.inf
                yield b

    layout = "query_id long, q array<double>, point array<double>, cell long, worst double"
    asked = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))

    def project_query(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["point"] = list(np.stack(b.q.to_numpy()) @ matrix)
                yield b

    first = asked.mapInPandas(project_query, "query_id long, q array<double>, point array<double>").mapInPandas(queries_here, layout)

    def in_cell(_: tuple, part: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(part) and len(queries):
            own, at, ids = np.stack(part.embedding.to_numpy()), np.stack(part.point.to_numpy()), part.ids.tolist()
            local = Tree(at, LEAF)
            for query, q, p, worst in zip(queries.query_id, queries.q, queries.point, queries.worst):
                # one more than k: the query's own vector is among them
                found, d = search(own, at, local, q, p, k + 1, bound, worst)
                hits = sorted((x, i) for r, x in zip(found, d) for i in ids[r] if i != query)[:k]
                out += [(query, i, math.sqrt(x)) for x, i in hits]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    result = "query_id long, vec_id long, score double"
    near = written(celled.groupBy("cell").cogroup(first.groupBy("cell")).applyInPandas(in_cell, result))
    kth = near.groupBy("query_id").agg(F.get(F.sort_array(F.collect_list("score")), F.lit(k - 1)).alias("kth"))

    def queries_there(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for query, q, p, home, kth_d in zip(b.query_id, b.q, b.point, b.cell, b.kth):
                worst = kth_d * kth_d * (1 + 1e-9) if kth_d is not None and not math.isnan(kth_d) else np.inf
                for c in cells[_box_distance(low, high, p) <= bound * worst]:
                    if c != home:
                        out.append((query, q, p, c, worst))
            yield pd.DataFrame(out, columns=["query_id", "q", "point", "cell", "worst"])

    second = first.drop("worst").join(kth, "query_id", "left").mapInPandas(queries_there, layout)
    far = celled.groupBy("cell").cogroup(second.groupBy("cell")).applyInPandas(in_cell, result)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (near.union(far).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))

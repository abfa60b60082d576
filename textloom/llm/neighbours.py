"""Approximate nearest neighbours by low-dimensional stable projections indexed by kd-trees.

Largest inner product becomes smallest distance by one more coordinate that gives all vectors the same norm. Vectors
are projected on M random normal directions; a projected squared distance is the true one times a chi-square variable
of M degrees. Projected neighbours are verified in growing order until the next one lies beyond the chi-square quantile
times the k-th best true distance: a closer vector is then missed with probability below 1 - SURE.

The upper levels of the kd-tree are fitted on a bounded sample and deal all vectors into cells, as many as BLOCK rows each
and the sample allow; the rows of a cell are dealt to blocks of about BLOCK rows (rows of equal vectors or ids to any of
them), and each block has a kd-tree of its own. A query first looks at a block of its own cell, and then at the blocks of
all cells that the stopping test doesn't exclude. Only those go to the block: a block is copied once for every QUERIES
queries that look at it, not for every group of all queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import bounded, discard, small_batches, table, written

M, SURE = 8, 0.985
BLOCK, QUERIES, LEAF = 4096, 4096, 64
#: Vectors, about, that the upper levels are fitted on, and of these in a cell at least; all vectors are indexed.
SAMPLE, IN_CELL = 1 << 18, 16


def chi_square_quantile(p: float = SURE, degrees: int = M) -> float:
    """Wilson-Hilferty approximation."""
    from statistics import NormalDist

    a = 2 / (9 * degrees)
    return degrees * (1 - a + NormalDist().inv_cdf(p) * a**0.5) ** 3


class Projection:
    def __init__(self, dims: int, norm2: float, seed: int = 5):
        self.norm2 = norm2
        self.axes = np.random.default_rng(seed).normal(size=(dims + 1, M))

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Indexed vectors, brought to the common norm."""
        rest = np.sqrt(np.maximum(0.0, self.norm2 - (x * x).sum(1)))
        return x @ self.axes[:-1] + rest[:, None] * self.axes[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.axes[:-1]


class Cells:
    """Upper levels of a kd-tree over projected points: medians of a sample, widest coordinate first."""

    def __init__(self, sample: np.ndarray, levels: int):
        self.axis, self.cut = np.zeros(1 << levels, int), np.zeros(1 << levels)
        self.levels = levels

        def split(node: int, points: np.ndarray) -> None:
            if node >= 1 << levels:
                return
            if len(points):
                self.axis[node] = int(np.argmax(points.max(0) - points.min(0)))
                self.cut[node] = float(np.median(points[:, self.axis[node]]))
            low = points[:, self.axis[node]] < self.cut[node]
            split(2 * node, points[low])
            split(2 * node + 1, points[~low])

        split(1, sample)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        for _ in range(self.levels):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.levels)

    def reached(self, points: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) pairs of the cells whose squared distance from a point is within its limit; walks only where some point goes."""
        who, where = [], []

        def walk(node: int, at: np.ndarray, gaps: np.ndarray) -> None:
            if not len(at):
                return
            if node >= 1 << self.levels:
                who.append(at)
                where.append(np.full(len(at), node - (1 << self.levels)))
                return
            axis = self.axis[node]
            over = points[at, axis] - self.cut[node]  # at or above zero: the point lies on the high side
            for child, gap in ((2 * node, np.maximum(over, 0)), (2 * node + 1, np.maximum(-over, 0))):
                there = gaps.copy()
                there[:, axis] = np.maximum(there[:, axis], gap)
                stay = (there * there).sum(1) <= limits[at]
                walk(child, at[stay], there[stay])

        walk(1, np.arange(len(points)), np.zeros(points.shape))
        return (np.concatenate(who), np.concatenate(where)) if who else (np.zeros(0, int), np.zeros(0, int))


class Block:
    """A kd-tree over the projections of a block's vectors."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projection: Projection):
        points = projection.rows(x)
        parts = [np.arange(len(x))]
        while parts and len(parts[0]) > LEAF:
            halves = []
            for p in parts:
                axis = int(np.argmax(np.ptp(points[p], 0)))
                order = p[np.argsort(points[p, axis], kind="stable")]
                halves += [order[: len(p) // 2], order[len(p) // 2 :]]
            parts = halves
        order = np.concatenate(parts)
        self.ids, self.x, self.points, self.norm2 = ids[order], np.ascontiguousarray(x[order]), points[order], projection.norm2
        self.ends = np.cumsum([len(p) for p in parts])
        self.low = np.array([points[p].min(0) for p in parts])
        self.high = np.array([points[p].max(0) for p in parts])

    def search(self, own: np.ndarray, q: np.ndarray, p: np.ndarray, k: int, bound: np.ndarray, beyond: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query ids and inner products of the nearest rows found; bound: squared distance within which results matter.

        Each query verifies leaves in growing order of their projected distance, in rounds of growing size, and stops
        when the next leaf lies beyond its bound, which falls to the k-th best true distance after each round. The
        queries that look at a leaf in one round share a product with its vectors.
        """
        gap = np.maximum(0, np.maximum(self.low[None] - p[:, None], p[:, None] - self.high[None]))
        near = (gap * gap).sum(2)
        place = near.argsort(1, kind="stable").argsort(1, kind="stable")
        scores = np.full((len(q), len(self.x)), -np.inf)
        shift, bound = self.norm2 + (q * q).sum(1), bound.copy()
        starts = np.concatenate([[0], self.ends[:-1]])
        first, last = 0, 4
        while first < near.shape[1]:
            due = (place >= first) & (place < last) & (near <= beyond * bound[:, None])
            for leaf in np.flatnonzero(due.any(0)):
                who, rows = np.flatnonzero(due[:, leaf]), slice(starts[leaf], self.ends[leaf])
                d = (p[who] ** 2).sum(1)[:, None] - 2 * p[who] @ self.points[rows].T + (self.points[rows] ** 2).sum(1)
                near_enough = (d <= beyond * bound[who, None] + 1e-9) & (self.ids[rows][None] != own[who, None])
                scores[who, rows] = np.where(near_enough, q[who] @ self.x[rows].T, -np.inf)
            if len(self.x) >= k and due.any():
                kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                bound = np.minimum(bound, np.maximum(0.0, shift - 2 * kth) + 1e-9)  # infinite with fewer than k found
            first, last = last, 4 * last
        out = []
        for i in range(len(q)):
            s = scores[i]
            kth = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -np.inf
            rows = np.flatnonzero((s >= kth - 1e-9) & (s > -np.inf))  # those that rounding may have put behind come along
            exact = (self.x[rows] * q[i]).sum(1)
            best = rows_order(self.ids[rows], exact)[:k]
            out.append((self.ids[rows][best], exact[best]))
        return out


def rows_order(ids: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Largest score first, then smallest id."""
    return np.lexsort((ids, -scores))


def usable(vectors: DataFrame, dims: int | None = None) -> DataFrame:
    """(vec_id, v) as doubles: rows with an id and a vector that isn't null, empty or zero and has only finite components."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return rows if dims is None else rows.where(F.size("v") == dims)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k rows of largest inner product found, itself left out.

    vectors, queries: (vec_id, embedding). Vectors that are null, empty, zero or hold null or non-finite components
    take no part, nor do those of another length than most. Ties go to the smaller vec_id; a query's own row is every
    row of its vec_id; of queries with one vec_id one is taken; repeated rows may repeat in a result; fewer than k
    candidates are all given; without any, the result is empty. Other columns are left out.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    every = every_ = written(usable(vectors), "ann-vectors")
    shape = every.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).orderBy(F.desc("n"), F.desc("dims")).limit(1).collect()
    if not shape:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims, n, norm2 = shape[0]
    every = every.where(F.size("v") == dims)
    projection = Projection(dims, norm2)

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy().reshape(-1, dims)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(projection.rows(matrix(b.column(0)))), pa.list_(pa.float64()))], names=["p"])

    drawn = every.where(F.rand(11) < SAMPLE / n).select("v")
    sample = np.array([r["p"] for r in drawn.mapInArrow(projected, "p array<double>").collect()]).reshape(-1, M)  # 64 bytes each
    sample = sample[np.lexsort(sample.T)]
    levels = max(0, min(int(np.ceil(np.log2(n / BLOCK))), int(np.log2(max(1, len(sample) / IN_CELL)))))
    cells = Cells(sample, levels)
    beyond = chi_square_quantile()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = cells.of(projection.rows(matrix(b.column(1)))) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32))], names=["vec_id", "v", "cell"])

    dealt = written(every.mapInArrow(deal, "vec_id long, v array<double>, cell int").withColumn("salt", F.floor(F.rand(7) * (1 << 30)).cast("int")), "ann-cells")
    parts = {r["cell"]: -(-r["count"] // BLOCK) for r in dealt.groupBy("cell").count().collect()}  # at most 2 * SAMPLE / IN_CELL rows
    blocks = spark.createDataFrame(sorted(parts.items()), "cell int, parts long")
    index = dealt.join(F.broadcast(blocks), "cell").withColumn("part", F.pmod("salt", F.col("parts")).cast("int")).drop("parts", "salt")
    discard(every_)

    asked = written(usable(queries, dims).dropDuplicates(["vec_id"]).withColumnRenamed("vec_id", "query_id"), "ann-queries")
    found = "query_id long, vec_id long, score double"

    def visit(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = projection.queries(matrix(b.column(1)))
                bound = np.full(len(p), np.inf) if first else b.column(2).to_numpy(zero_copy_only=False)
                who, cell = (np.arange(len(p)), cells.of(p)) if first else cells.reached(p, beyond * bound)
                many = np.ones(len(cell), int) if first else np.array([parts.get(c, 0) for c in cell.tolist()], int)
                pick = np.repeat(np.arange(len(cell)), many)
                part = np.arange(len(pick)) - np.repeat(np.cumsum(many) - many, many)
                ids = b.column(0).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids[who[pick]]), pa.array(bound[who[pick]]), pa.array(cell[pick].astype(np.int32)), pa.array(part.astype(np.int32))], names=["query_id", "bound", "cell", "part"])

        return run

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            block = Block(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), projection)
            q = np.stack(right["v"].to_numpy())
            ids, bounds = right["query_id"].to_numpy(), right["bound"].to_numpy(dtype=float)
            for at in range(0, len(q), 256):
                part = slice(at, at + 256)
                got = block.search(ids[part], q[part], projection.queries(q[part]), k, bounds[part], beyond)
                counts = [len(a) for a, _ in got]
                out.append(pd.DataFrame({"query_id": np.repeat(ids[part], counts), "vec_id": np.concatenate([a for a, _ in got]), "score": np.concatenate([b for _, b in got])}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})

    keys = ["cell", "part", "grp"]

    def searched(rows: DataFrame, first: bool) -> DataFrame:
        plan = written(rows.mapInArrow(visit(first), "query_id long, bound double, cell int, part int"), "ann-plan")
        groups = bounded(written(plan.groupBy("cell", "part").agg(F.ceil(F.count("*") / QUERIES).alias("groups")), "ann-groups"))  # a row a block
        planned = plan.join(groups, ["cell", "part"]).withColumn("grp", F.pmod(F.xxhash64("query_id"), F.col("groups"))).drop("groups")
        planned = planned.join(asked.select("query_id", "v"), "query_id")
        copied = index.join(groups, ["cell", "part"]).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
        return copied.groupBy(*keys).cogroup(planned.groupBy(*keys)).applyInPandas(answer, found)

    # each query's own cell first: the k-th distance there bounds the search of the others
    homes = searched(asked.select("query_id", "v"), True)
    bounds = homes.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    length2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    limited = asked.join(bounds, "query_id", "left").select("query_id", "v", F.when(F.col("least").isNull(), F.lit(float("inf"))).otherwise(F.greatest(F.lit(0.0), F.lit(norm2) + length2 - 2 * F.col("least")) + 1e-9).alias("bound"))
    second = searched(written(limited, "ann-bounds"), False)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return second.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)

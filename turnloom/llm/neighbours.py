"""Nearest neighbours by low-dimensional stable projections, a kd-tree and a chi-square stopping test.

Vectors are projected to ``dims`` Gaussian sums.  The squared ratio of projected to true distance follows a chi-square law with ``dims`` degrees of
freedom, so once the next projected distance r satisfies r^2 > q d_k^2 (q: the quantile of ``sure``, d_k: the k-th best true distance so far), a
neighbour that is still unseen has at most the chance 1 - ``sure``: the search stops.

The tree's upper levels are fitted on a bounded sample (``sample_rows``) and cut the projected space into cells; every row is indexed, and a cell with
more rows than ``cell_rows`` (a very common vector) is split into chunks by a hash, each with a tree of its own.  A query visits its own cell
first, which bounds d_k, and then the cells that the test does not rule out; within a chunk, leaves are taken in the order of their projected
distance and verified in full precision until the test holds.  Queries of a cell are dealt into blocks, so neither side of a task is unbounded.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than the most
frequent; rows that repeat an id are candidates each, but never for a query of their own id, and a query that repeats id and vector counts once; fewer
candidates than k give all; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.common import staged, table


@dataclass(frozen=True)
class SearchSettings:
    k: int = 10
    dims: int = 8
    sure: float = 0.98
    seed: int = 11
    cell_rows: int = 4096
    max_cells: int = 4096
    sample_rows: int = 50_000
    leaf_rows: int = 64
    block_queries: int = 1024


def chi_square_quantile(p: float, dims: int) -> float:
    """For an even number of degrees of freedom, by bisection of the closed form."""
    if dims % 2:
        raise ValueError("an even number of dimensions")

    def cdf(x: float) -> float:
        term, total = 1.0, 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def projection(width: int, cfg: SearchSettings) -> np.ndarray:
    return np.random.default_rng(cfg.seed).standard_normal((width, cfg.dims))


def split_cells(points: np.ndarray, cells: int) -> list[tuple]:
    """An implicit tree of (dimension, cut, left, right) nodes; a leaf is (cell,).  Medians of the widest dimension."""
    nodes: list[tuple] = []
    count = 0

    def grow(p: np.ndarray, want: int) -> int:
        nonlocal count
        at = len(nodes)
        nodes.append(())
        if want > 1 and len(p) > 1:
            wide = int(np.argmax(p.max(0) - p.min(0)))
            cut = float(np.median(p[:, wide]))
            left = p[:, wide] <= cut
            if 0 < left.sum() < len(p):
                a = grow(p[left], want // 2)
                nodes[at] = (wide, cut, a, grow(p[~left], want - want // 2))
                return at
        nodes[at] = (count,)
        count += 1
        return at

    grow(points, cells)
    return nodes


def cells_of(points: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    todo = [(0, np.arange(len(points)))]
    while todo:
        n, rows = todo.pop()
        if len(nodes[n]) == 1:
            out[rows] = nodes[n][0]
        else:
            wide, cut, a, b = nodes[n]
            left = points[rows, wide] <= cut
            todo += [(a, rows[left]), (b, rows[~left])]
    return out


class Leaves:
    """A kd-tree kept as its leaves: rows in leaf order, and the box of each leaf."""

    def __init__(self, points: np.ndarray, leaf_rows: int):
        order, todo, ends = [], [np.arange(len(points))], []
        while todo:
            rows = todo.pop()
            if len(rows) > leaf_rows:
                wide = int(np.argmax(np.ptp(points[rows], axis=0)))
                rows = rows[np.argpartition(points[rows, wide], len(rows) // 2)]
                todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
            else:
                order.append(rows)
                ends.append(len(rows))
        self.order = np.concatenate(order)
        self.ends = np.cumsum(ends)
        starts = np.concatenate([[0], self.ends[:-1]])
        p = points[self.order]
        self.low, self.high = np.minimum.reduceat(p, starts), np.maximum.reduceat(p, starts)
        self.starts = starts

    def distances(self, q: np.ndarray) -> np.ndarray:
        """Squared projected distance to each leaf's box."""
        gap = np.maximum(0, np.maximum(self.low - q, q - self.high))
        return (gap * gap).sum(1)


def search(q: np.ndarray, qp: np.ndarray, own: int, ids: np.ndarray, vecs: np.ndarray, tree: Leaves, k: int, quantile: float, bound: float):
    """The best k (distance, id) of one chunk, closest first; ``vecs`` and ``ids`` in leaf order; ``bound``: k-th distance known so far."""
    far = tree.distances(qp)
    by = np.argsort(far, kind="stable")
    best_d, best_i = np.empty(0), np.empty(0, np.int64)
    for leaf in by:
        if far[leaf] > quantile * bound * bound:
            break
        a, b = tree.starts[leaf], tree.ends[leaf]
        diff = vecs[a:b] - q
        dist = np.sqrt((diff * diff).sum(1))
        near = (dist <= bound) & (ids[a:b] != own)
        if near.any():
            best_d, best_i = np.concatenate([best_d, dist[near]]), np.concatenate([best_i, ids[a:b][near]])
            keep = np.lexsort((best_i, best_d))[:k]
            best_d, best_i = best_d[keep], best_i[keep]
            if len(best_d) == k:
                bound = min(bound, best_d[-1])
    return best_d, best_i


def usable(v: Column) -> Column:
    """Neither null nor zero, all components finite."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _floats(col: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", cfg: SearchSettings = SearchSettings()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``is_query`` holds, against all rows."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    v = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    v = v.where(usable(F.col("v")) & F.col("vec_id").isNotNull())
    widths = v.groupBy(F.size("v").alias("width")).count().orderBy(F.desc("count"), "width").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], result)
    width, rows = widths[0]
    v = v.where(F.size("v") == width)
    r, dims = projection(width, cfg), cfg.dims

    # the upper tree, from a bounded sample chosen by a hash
    share = min(1.0, cfg.sample_rows / rows)
    picked = v.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").limit(cfg.sample_rows * 2)
    sample = np.array([x[0] for x in picked.collect()], np.float64).reshape(-1, width) @ r
    nodes = split_cells(sample, min(cfg.max_cells, max(1, math.ceil(rows / cfg.cell_rows)))) if len(sample) else [(0,)]

    def place(batches):
        for b in batches:
            x = np.asarray(b.column("v").flatten(), np.float64).reshape(-1, width)
            p = x @ r
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("query"), pa.array(cells_of(p, nodes)), pa.array([a.tobytes() for a in x], pa.binary()), pa.array([a.tobytes() for a in p], pa.binary())],
                ["vec_id", "query", "cell", "v", "p"],
            )

    placed = staged(v.mapInArrow(place, "vec_id long, query boolean, cell int, v binary, p binary"), "neighbours-index")

    def boxes(batches):
        for b in batches:
            t = b.to_pandas()
            for cell, g in t.groupby("cell"):
                p = _floats(g["p"], dims)
                yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([len(g)], pa.int64()), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()])], ["cell", "n", "low", "high"])

    # at most max_cells rows: the box and size of each cell
    part = placed.select("cell", "p").mapInArrow(boxes, "cell int, n long, low array<double>, high array<double>")
    each = [F.min(F.col("low")[i]).alias(f"l{i}") for i in range(dims)] + [F.max(F.col("high")[i]).alias(f"h{i}") for i in range(dims)]
    info = part.groupBy("cell").agg(F.sum("n").alias("n"), *each).collect()
    names = np.array([x["cell"] for x in info])
    low, high = (np.array([[x[f"{s}{i}"] for i in range(dims)] for x in info]) for s in "lh")
    chunks = {x["cell"]: math.ceil(x["n"] / (2 * cfg.cell_rows)) for x in info}
    chunk_map = F.create_map(*[y for c, n in chunks.items() if n > 1 for y in (F.lit(c), F.lit(n))]) if max(chunks.values()) > 1 else None
    n_chunks = F.coalesce(F.try_element_at(chunk_map, F.col("cell")), F.lit(1)) if chunk_map is not None else F.lit(1)
    data = placed.select("cell", F.pmod(F.xxhash64("vec_id"), n_chunks).cast("int").alias("chunk"), "vec_id", "v", "p")
    quantile, k, leaf_rows = chi_square_quantile(cfg.sure, dims), cfg.k, cfg.leaf_rows

    def visit(key, points: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(asked):
            return pd.DataFrame({"query_id": [], "tag": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "tag": "int64", "vec_id": "int64", "score": float})
        tree = Leaves(_floats(points["p"], dims), leaf_rows)
        ids, vecs = points["vec_id"].to_numpy(np.int64)[tree.order], _floats(points["v"], width)[tree.order]
        out = []
        for qid, tag, q, qp, bound in zip(asked["query_id"], asked["tag"], _floats(asked["v"], width), _floats(asked["p"], dims), asked["bound"]):
            d, i = search(q, qp, qid, ids, vecs, tree, k, quantile, bound)
            out.append(pd.DataFrame({"query_id": qid, "tag": tag, "vec_id": i, "score": d}))
        return pd.concat(out)

    def visits(asked: DataFrame) -> DataFrame:
        """asked: query_id, tag, v, p, bound, cell.  The best k of each chunk asked."""
        counts = {x["cell"]: x["count"] for x in asked.groupBy("cell").count().collect()}  # at most max_cells rows
        more = {c: math.ceil(n / cfg.block_queries) for c, n in counts.items()}
        more_map = F.create_map(*[y for c, n in more.items() if n > 1 for y in (F.lit(c), F.lit(n))]) if max(more.values(), default=1) > 1 else None
        blocks = F.coalesce(F.try_element_at(more_map, F.col("cell")), F.lit(1)) if more_map is not None else F.lit(1)
        a = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0), n_chunks - 1))).withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int"))
        d = data.where(F.col("cell").isin([int(c) for c in counts])).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
        by = ["cell", "chunk", "block"]
        return d.groupBy(*by).cogroup(a.groupBy(*by)).applyInPandas(visit, "query_id long, tag long, vec_id long, score double")

    queries = placed.where("query").select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("tag"), "v", "p", "cell").dropDuplicates(["query_id", "tag"])
    first = staged(visits(queries.withColumn("bound", F.lit(float("inf")))), "neighbours-first")

    def reach(batches):
        """The cells that the test does not rule out, but for the query's own."""
        for b in batches:
            t = b.to_pandas()
            rows = []
            for qid, tag, qv, qp, own, bound in zip(t["query_id"], t["tag"], t["v"], t["p"], t["cell"], t["bound"]):
                p = np.frombuffer(qp)
                gap = np.maximum(0, np.maximum(low - p, p - high))
                todo = names[((gap * gap).sum(1) <= quantile * bound * bound) & (names != own)]
                rows += [(qid, tag, qv, qp, bound, int(c)) for c in todo]
            yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["query_id", "tag", "v", "p", "bound", "cell"]).astype({"query_id": "int64", "tag": "int64", "bound": float, "cell": "int32"}),
                                             pa.schema([("query_id", pa.int64()), ("tag", pa.int64()), ("v", pa.binary()), ("p", pa.binary()), ("bound", pa.float64()), ("cell", pa.int32())]), preserve_index=False)

    kth = first.groupBy("query_id", "tag").agg(F.sort_array(F.collect_list("score")).alias("s"))  # k values for each of a cell's chunks
    bounds = kth.select("query_id", "tag", F.when(F.size("s") >= k, F.element_at("s", F.least(F.lit(k), F.size("s")))).otherwise(float("inf")).alias("bound"))
    asked = queries.join(bounds, ["query_id", "tag"], "left").na.fill(float("inf"), ["bound"])
    asked = staged(asked.select("query_id", "tag", "v", "p", "cell", "bound").mapInArrow(reach, "query_id long, tag long, v binary, p binary, bound double, cell int"), "neighbours-asked")
    best = first.unionByName(visits(asked)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "tag").orderBy("score", "vec_id")))
    return best.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_neighbours(spark, d) -> DataFrame:
    return nearest(table(spark, d, "embeddings"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)

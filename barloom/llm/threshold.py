"""Exact top-k by inner product with Fagin's threshold algorithm.

Vectors are dealt into blocks. A block keeps, for every dimension, its rows in the order of that component. Many queries read
the lists in step, from the top where a component is positive and from the bottom where it is negative; rows met for the first
time are scored in full, for all queries that still read, by one matrix product. What the lists still hold cannot score more than
a query with the components last read, so it ends once that bound is below its k-th score so far. Blocks of queries meet blocks
of rows; the best of all blocks are merged. The k-th score of the block that a query belongs to is found first and goes with it,
so that other blocks stop early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.store import cut
from barloom.llm.vectors import dealt, dense, same_width, usable

#: rows and queries of a block
ROWS, QUERIES = 4096, 2048
#: queries that read the lists together
TOGETHER = 256
#: the least value: no bound known
_NONE = -(2**62)


class SortedLists:
    """A block of integer vectors with its rows in order per dimension."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[by_id], rows[by_id]
        self.order = np.argsort(self.rows, axis=0, kind="stable")
        self.peak = int(np.abs(self.rows).max()) if self.rows.size else 0

    def tops(self, query_ids: np.ndarray, points: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(query's place, row number, score) of the k best rows of each query but its own, equals by smaller id, and the depth to
        which each query read; rows below a query's floor may be left out."""
        floors = np.full(len(points), _NONE) if floors is None else floors
        parts = [self._read(query_ids[lo : lo + TOGETHER], points[lo : lo + TOGETHER], k, floors[lo : lo + TOGETHER]) for lo in range(0, len(points), TOGETHER)]
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        places = [q + i * TOGETHER for i, (q, *_) in enumerate(parts)]
        return np.concatenate(places), *(np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))

    def _read(self, query_ids: np.ndarray, points: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(self.ids)
        # doubles hold these products exactly, and multiply faster
        exact = self.peak * int(np.abs(points).max(initial=0)) * points.shape[1] < 2**53
        kind = np.float64 if exact else np.int64
        sheet, points, kth = self.rows.astype(kind), points.astype(kind), floors.astype(kind)
        nothing = -np.inf if exact else np.iinfo(np.int64).min
        met, depths, reading = np.zeros(n, bool), np.full(len(points), n), np.arange(len(points))
        which, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, kind)
        depth, step = 0, 8
        while depth < n and len(reading):
            to, asked = min(n, depth + step), points[reading]
            down, up = (asked > 0).any(axis=0), (asked < 0).any(axis=0)
            if not (down.any() or up.any()):  # every row scores 0
                to, down = n, ~down
            seen = np.unique(np.concatenate([self.order[n - to : n - depth, down].ravel(), self.order[depth:to, up].ravel()]))
            new = seen[~met[seen]]
            met[new] = True
            if len(new):
                own = asked @ sheet[new].T
                own[self.ids[new][None, :] == query_ids[reading][:, None]] = nothing
                bar = kth[reading]
                if len(new) >= k:
                    bar = np.maximum(bar, np.partition(own, len(new) - k, axis=1)[:, len(new) - k])
                a, c = np.nonzero((own >= bar[:, None]) & (own > nothing))
                which, at, score = np.concatenate([which, reading[a]]), np.concatenate([at, new[c]]), np.concatenate([score, own[a, c]])
                order = np.lexsort((at, -score, which))
                which, at, score = which[order], at[order], score[order]
                rank = np.arange(len(which)) - np.searchsorted(which, which)
                last = rank == k - 1
                kth[which[last]] = np.maximum(kth[which[last]], score[last])
                which, at, score = (x[rank < k] for x in (which, at, score))
            depth, step = to, step * 2
            high, low = (self.rows[self.order[i], np.arange(self.rows.shape[1])].astype(kind) for i in (n - depth, depth - 1))
            bound = np.maximum(asked, 0) @ high + np.minimum(asked, 0) @ low
            # an unmet row may score the bound itself and have a smaller id
            done = bound < kth[reading]
            depths[reading[done]] = depth
            reading = reading[~done]
        return which, at, score.astype(np.int64), depths


def quantised(table: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vec: floor(scale * component) as integers. Rows without an id or with a null or non-finite component are left out."""
    vec = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale))
    return table.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), id, score for integer vectors (`id`, `vec`): the k greatest inner products with every row but the
    query's own, all if there are fewer; equals by smaller id. `depth`: how far the lists of the best row's block were read.

    Vectors of different lengths compare as if filled up with zeros. Rows that repeat an id are rows of their own. Scores must
    fit 64 bits. Memory of a task: a block of ROWS rows and QUERIES queries; the work is rows x queries at worst, in blocks.
    """
    rows, queries = cut(rows, "rows"), cut(queries, "queries")
    n_rows, n_queries = rows.count(), queries.count()
    parts, asking = max(1, -(-n_rows // ROWS)), max(1, -(-n_queries // QUERIES))
    schema = "query_id long, id long, score long, depth int"

    def search(group: pa.Table, asked: pa.Table) -> pa.Table:
        names, found, score, depths = (np.zeros(0, np.int64) for _ in range(4))
        if group.num_rows and asked.num_rows:
            block, points = same_width(dense(group["vec"], np.int64), dense(asked["vec"], np.int64))
            lists = SortedLists(group["id"].to_numpy(), block)
            ids = asked["query_id"].to_numpy()
            which, at, score, depths = lists.tops(ids, points, k, asked["floor"].to_numpy() if "floor" in asked.column_names else None)
            names, found, depths = ids[which], lists.ids[at], depths[which]
        return pa.table({"query_id": pa.array(names, pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(score, pa.int64()), "depth": pa.array(depths, pa.int32())})

    asked = queries.select(F.col("id").alias("query_id"), "vec")
    at_home = dealt(rows, "block", parts)
    # one block for each query; the k-th score there is a bound for all others
    first = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int"))
    near = cut(at_home.groupBy("block").cogroup(first.groupBy("block")).applyInArrow(search, schema), "near")
    floors = near.groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "floor")
    bounded = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(_NONE)))
    home = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    blocks = bounded.withColumn("group", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(asking)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(F.col("block") != home)
    everywhere = dealt(rows, "block", parts, ("group", asking))
    far = everywhere.groupBy("block", "group").cogroup(blocks.groupBy("block", "group")).applyInArrow(search, schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.unionAll(far).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score", "depth")

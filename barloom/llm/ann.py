"""Approximate nearest neighbours with learned partitions.

A bounded sample of the vectors gives a neighbour graph; it is cut in halves again and again along the second eigenvector, at
the median, so that parts are equal in size and few edges cross. A small softmax classifier learns the parts of the sample.
Every row is indexed in its most probable part; a query looks into its several most probable parts, as many as rows
of the sample that it did not learn from need for the wanted recall, and reranks all rows there by the exact measure.

Parts that hold more than PART rows are split again in the same way, each by a sample and a classifier of its own, level by
level: the number of parts grows with the table, and a query descends into the probable parts of each part that it visits.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.store import cut, drop
from barloom.llm.vectors import dense, same_width, usable

#: bound of the sample that a classifier is fitted on, one for the table and one for each part that is split again
SAMPLE = 4096
#: what all levels together should find at least, however many there are
WHOLE = 0.91
NEIGHBOURS = 10
#: rows and questions of a block; a larger part, and what asks a part more often, is dealt into several
ROWS = QUESTIONS = 8192
#: rows of a part above which it is split again
PART = 8192


class Router:
    """Partition probabilities of a vector: one hidden layer, softmax."""

    def __init__(self, layers: list[np.ndarray], probes: int):
        self.layers, self.probes = layers, probes

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        x = x[:, : len(w1)] if x.shape[1] >= len(w1) else np.pad(x, ((0, 0), (0, len(w1) - x.shape[1])))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
        z = np.maximum(x @ w1 + b1, 0) @ w2 + b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k rows of the largest inner product with each row."""
    k = min(k, len(x) - 1)
    out = np.zeros((len(x), max(k, 0)), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, max(k - 1, 0), axis=1)[:, :k]
    return out


def balanced_parts(near: np.ndarray, depth: int, rng: np.random.Generator) -> np.ndarray:
    """2 ** depth parts of equal size (to one row) by halving the graph at the median of the Fiedler vector."""
    part = np.zeros(len(near), np.int64)
    a = np.repeat(np.arange(len(near)), near.shape[1])
    b = near.ravel()
    for _ in range(depth):
        new = part * 2
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            place = np.full(len(near), -1)
            place[rows] = np.arange(len(rows))
            inner = (place[a] >= 0) & (place[b] >= 0)
            u, v = place[a[inner]], place[b[inner]]
            u, v = np.concatenate([u, v]), np.concatenate([v, u])
            degree = np.bincount(u, minlength=len(rows)) + 1.0
            scale = 1 / np.sqrt(degree)
            trivial = np.sqrt(degree) / np.linalg.norm(np.sqrt(degree))
            y = rng.standard_normal(len(rows))
            for _ in range(80):  # power iteration on the normalised adjacency, the trivial vector taken out
                y -= trivial * (trivial @ y)
                y = y + scale * (np.bincount(u, (scale * y)[v], len(rows)) + scale * y)
                y /= max(np.linalg.norm(y), 1e-30)
            order = np.argsort(scale * y, kind="stable")
            new[rows[order[len(rows) // 2 :]]] += 1
        part = new
    return part


def train(x: np.ndarray, part: np.ndarray, parts: int, rng: np.random.Generator, hidden: int = 96, epochs: int = 40) -> list[np.ndarray]:
    """Softmax classifier by Adam on unit vectors."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    layers = [rng.standard_normal((x.shape[1], hidden)) * np.sqrt(2 / x.shape[1]) * 4, np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            own = order[lo : lo + 128]
            w1, b1, w2, b2 = layers
            h = np.maximum(x[own] @ w1 + b1, 0)
            z = h @ w2 + b2
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z /= z.sum(axis=1, keepdims=True)
            z[np.arange(len(own)), part[own]] -= 1
            z /= len(own)
            back = (z @ w2.T) * (h > 0)
            t += 1
            for w, g, a, b in zip(layers, (x[own].T @ back, back.sum(0), h.T @ z, z.sum(0)), m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= 0.003 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return layers


def fit(sample: np.ndarray, depth: int = 5, recall: float = 0.97, k: int = 20, seed: int = 5) -> Router:
    """A router whose probes reach `recall` of the k nearest rows among a quarter of the sample that it was not trained on."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(sample))
    held, sample = sample[order[: len(sample) // 4]], sample[order[len(sample) // 4 :]]
    depth = max(0, min(depth, int(np.log2(max(1, len(sample) // 64)))))
    near = neighbour_graph(sample, NEIGHBOURS)
    part = balanced_parts(near, depth, rng) if depth else np.zeros(len(sample), np.int64)
    router = Router(train(sample, part, 2**depth, rng), 2**depth)
    chance = router.probabilities(held)
    home, wanted = chance.argmax(axis=1), neighbour_graph(held, k)
    rank_of = np.argsort(np.argsort(-chance, axis=1, kind="stable"), axis=1, kind="stable")
    needed = np.take_along_axis(rank_of, home[wanted], axis=1)
    for probes in range(1, 2**depth + 1):
        if not needed.size or (needed < probes).mean() >= recall:
            router.probes = probes
            break
    return router


def _top(block: np.ndarray, ids: np.ndarray, query_id: int, point: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    rough = np.where(ids == query_id, -np.inf, rough)
    n = min(k, int(np.isfinite(rough).sum()))
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    kth = -np.partition(-rough, n - 1)[n - 1]
    # a matrix product may round equal rows differently: take all that come near and score them one by one in the same order
    close = np.flatnonzero(rough >= kth - 1e-9 * (1 + abs(kth)))
    exact = (block[close] * point).sum(axis=1)
    order = np.lexsort((ids[close], -exact))[:n]
    return close[order], exact[order]


def _meetings(indexed: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, block, group, id, vec) and (path, block, group, query_id, point) of rows and questions (path, name, vec, turn): every
    block of a part's rows meets every group of the questions that probe the part. Dealt by `turn`, so that equal ids and equal
    vectors spread too."""
    # one row for each part, written, so that its size is known; parts that hold nothing or that nothing probes drop out
    sizes = indexed.groupBy("path").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")).join(asked.groupBy("path").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("groups")), "path")
    sizes = cut(sizes, "sizes")
    own = lambda n: F.pmod(F.xxhash64("turn", F.lit(n)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = indexed.join(sizes, "path").select("path", own("blocks").alias("block"), each("groups").alias("group"), F.col("name").alias("id"), "vec")
    questions = asked.join(sizes, "path").select("path", each("blocks").alias("block"), own("groups").alias("group"), F.col("name").alias("query_id"), F.col("vec").alias("point"))
    return members, questions


def _ranked(router: Router, vec: pa.ChunkedArray, n: int) -> np.ndarray:
    """The n most probable parts of each vector, the most probable first."""
    return np.argsort(-router.probabilities(dense(vec, np.float64)), axis=1, kind="stable")[:, :n]


def _learn(points: DataFrame, large: DataFrame, depth: int, recall: float, k: int) -> DataFrame:
    """path, probes, model: a router for each part in `large` (path, n), fitted on about SAMPLE of its rows."""
    chosen = points.join(large, "path").where(F.pmod(F.xxhash64("turn", F.lit(3)), "n") < SAMPLE).select("path", "turn", "vec")

    def learn(group: pa.Table) -> pa.Table:
        router = fit(dense(group.sort_by("turn")["vec"], np.float64), depth, recall, k)
        held = io.BytesIO()
        np.savez(held, *router.layers)
        return pa.table({"path": group["path"].slice(0, 1), "probes": pa.array([router.probes], pa.int32()), "model": pa.array([held.getvalue()], pa.binary())})

    return chosen.groupBy("path").applyInArrow(learn, "path long, probes int, model binary")


def _descend(points: DataFrame, models: DataFrame, width: int, all_probes: bool) -> DataFrame:
    """Points (path, name, vec, turn) of the parts that `models` split move on to the most probable part below, or with
    `all_probes` to as many as the part's router probes. They meet the router in blocks."""
    sizes = cut(points.groupBy("path").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("blocks")).join(models.select("path"), "path"), "sizes")
    placed = points.join(sizes, "path").withColumn("block", F.pmod(F.xxhash64("turn", F.lit("level")), "blocks").cast("int")).drop("blocks")
    routers = models.join(sizes, "path").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    columns = points.columns

    def move(rows: pa.Table, router: pa.Table) -> pa.Table:
        rows = rows.select(columns)
        if not rows.num_rows:
            return rows
        with np.load(io.BytesIO(router["model"][0].as_py())) as held:
            layers = [held[f"arr_{i}"] for i in range(4)]
        probes = router["probes"][0].as_py()
        below = _ranked(Router(layers, probes), rows["vec"], probes if all_probes else 1)
        node = rows["path"].to_numpy()[:, None] * width + 1 + below
        rows = rows.take(pa.array(np.repeat(np.arange(len(below)), below.shape[1])))
        return rows.set_column(columns.index("path"), "path", pa.array(node.ravel(), pa.int64()))

    moved = placed.groupBy("path", "block").cogroup(routers.groupBy("path", "block")).applyInArrow(move, points.schema)
    return points.join(models.select("path"), "path", "left_anti").select(*columns).unionAll(moved)


def search(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", depth: int = 5, recall: float = 0.97) -> DataFrame:
    """query_id, rank (from 1), id, score: for each query row the k found rows of the largest inner product in double precision,
    its own row left out, equals by smaller id; all found rows if there are fewer.

    Vectors null, empty, zero or with a null or non-finite component, and rows without an id, take no part. Vectors of different
    lengths compare as if filled up with zeros. Fitted on SAMPLE rows at most (least hashes), and on about as many of each part
    above PART rows, which is split again; every row is indexed. Equal vectors stay in one part, which is read in blocks.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = table.where(F.col(id_col).isNotNull() & usable(F.col(vec_col)) & F.exists(F.col(vec_col), lambda x: x != 0))
    rows = cut(rows.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), is_query.alias("asks")), "vectors")
    sample = rows.select("id", "vec").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType())), T.StructField("asks", T.BooleanType()), T.StructField("turn", T.LongType()), T.StructField("parts", T.ArrayType(T.IntegerType()))])
    found = "query_id long, id long, score double"
    if not sample.num_rows:
        return rows.limit(0).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), "id", F.lit(0.0).alias("score"))
    width = 2**depth
    # levels that parts of PART rows take, if parts are about equal
    levels = 1 + max(0, math.ceil(math.log(max(1.0, rows.count() / PART), max(2, min(width, sample.num_rows // 128)))))
    recall = max(recall, WHOLE ** (1 / levels))
    router = fit(dense(sample["vec"], np.float64), depth, recall, k)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        turn = TaskContext.get().partitionId() << 36
        for batch in batches:
            order = _ranked(router, batch.column("vec"), router.probes).astype(np.int32)
            turns = pa.array(range(turn, turn + batch.num_rows), pa.int64())
            turn += batch.num_rows
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "vec", "asks")], turns, pa.array(list(order), pa.list_(pa.int32()))], names=schema.names)

    routed = cut(rows.mapInArrow(route, schema), "routed")
    drop(rows)
    indexed = routed.select((F.col("parts")[0] + 1).cast("long").alias("path"), F.col("id").alias("name"), "vec", "turn")
    asked = routed.where("asks").select(F.explode("parts").alias("part"), "id", "vec", "turn").select((F.col("part") + 1).cast("long").alias("path"), F.col("id").alias("name"), "vec", "turn")
    for _ in range(levels):
        large = cut(indexed.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > PART), "large")
        if large.isEmpty():
            break
        models = cut(_learn(indexed, large, depth, recall, k), "models")
        above, indexed, asked = (indexed, asked), cut(_descend(indexed, models, width, False), "indexed"), cut(_descend(asked, models, width, True), "asked")
        drop(routed, large, models, *above)
    members, asked = _meetings(indexed, asked)

    def rerank(group: pa.Table, questions: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if group.num_rows and questions.num_rows:
            block, points = same_width(dense(group["vec"], np.float64), dense(questions["point"], np.float64))
            ids, names = group["id"].to_numpy(), questions["query_id"].to_numpy()
            for lo in range(0, len(points), 256):
                rough = points[lo : lo + 256] @ block.T
                for i, own in enumerate(rough, lo):
                    at, score = _top(block, ids, int(names[i]), points[i], own, k)
                    out.append((np.full(len(at), names[i]), ids[at], score))
        return pa.table({n: pa.array(np.concatenate([o[i] for o in out]), t) for i, (n, t) in enumerate((("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())))})

    near = members.groupBy("path", "block", "group").cogroup(asked.groupBy("path", "block", "group")).applyInArrow(rerank, found)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

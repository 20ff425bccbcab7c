"""Hard negatives by an inverted multi-index, exactly.

A vector is cut in halves, and each half goes to the nearest of the codewords of its half; a pair of codewords is a cell. The
score of an anchor with a row is the sum of two half scores, and a half score is at most that of the codeword plus the anchor's
half norm times the radius of what the codeword holds. Cells are visited from the greatest sum of both bounds downwards: the
bounds of each half are sorted, and a heap walks the pairs in the order of their sums. What is not visited scores at most what
the heap offers next, so a window of scores is certified once that falls below the least score that still counts.

Cells are dealt to blocks of rows. An anchor asks the block of its own cell first; the scores found there tell which other blocks
can matter by the bounds of their cells, and go along. Anchors that share vector and label ask once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.store import cut
from barloom.llm.vectors import dense, same_width, usable

#: bound of the sample that the codebooks are fitted on, and the most codewords of a half
SAMPLE, MOST_WORDS = 8192, 256
#: rows and questions that meet in a task, and rows scored at once
ROWS, QUESTIONS, STRIDE = 8192, 2048, 256
#: the least score: nothing known
_NONE = -(2**62)


def codewords(x: np.ndarray, words: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's centres; a centre that nothing goes to moves to the row farthest from its own."""
    x = x.astype(np.float64)
    centres = x[np.linspace(0, len(x) - 1, words).astype(np.int64)].copy()
    for _ in range(rounds):
        home, far = nearest_word(x, centres)
        counts = np.bincount(home, minlength=words)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = x[np.argsort(-far, kind="stable")[: len(empty)]]
    return centres


def nearest_word(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, and its distance."""
    rough = (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    home = rough.argmin(axis=1) if len(x) else np.zeros(0, np.int64)
    return home, np.sqrt(((x - centres[home]) ** 2).sum(axis=1))


class Codebooks:
    """Codewords of both halves. Components beyond the sample's width belong to the second half, where codewords are 0."""

    def __init__(self, sample: np.ndarray, words: int):
        self.split = sample.shape[1] // 2
        self.words = min(words, len(sample))
        self.first, self.second = codewords(sample[:, : self.split], self.words), codewords(sample[:, self.split :], self.words)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both halves as doubles, and the second codewords in their width."""
        x = x.astype(np.float64)
        if x.shape[1] < self.split:
            x = np.pad(x, ((0, 0), (0, self.split - x.shape[1])))
        second, words = same_width(x[:, self.split :], self.second)
        return x[:, : self.split], second, words

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cell and the distances from both codewords of each row."""
        a, b, words = self.halves(x)
        (u, d1), (v, d2) = nearest_word(a, self.first), nearest_word(b, words)
        return u * self.words + v, d1, d2

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Half scores with all codewords, and half norms, of each row."""
        a, b, words = self.halves(x)
        return a @ self.first.T, b @ words.T, np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)


class Layout:
    """Cells dealt to blocks of about ROWS rows, in their order; a larger cell has several blocks."""

    def __init__(self, cell: np.ndarray, count: np.ndarray, r1: np.ndarray, r2: np.ndarray, books: Codebooks):
        order = np.argsort(cell)
        self.cell, count, self.r1, self.r2, self.books = cell[order], count[order], r1[order], r2[order], books
        self.lo, self.shards, self.starts, self.members = np.zeros(len(cell), np.int64), np.ones(len(cell), np.int64), [], []
        blocks = held = 0
        for i, n in enumerate(count.tolist()):
            if n > ROWS or held + n > ROWS or not blocks:  # a block of its own, or a new one
                shards = max(1, -(-n // ROWS))
                self.lo[i], self.shards[i] = blocks, shards
                for _ in range(shards):
                    self.starts.append(len(self.members))
                    self.members.append(i)
                blocks, held = blocks + shards, n if shards == 1 else ROWS
            else:
                self.lo[i], held = blocks - 1, held + n
                self.members.append(i)
        self.blocks, self.starts = blocks, np.array(self.starts, np.int64)

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The most and the least that a row of each block can score with each point."""
        s1, s2, n1, n2 = self.books.scores(x)
        centre = s1[:, self.cell // self.books.words] + s2[:, self.cell % self.books.words]
        reach = n1[:, None] * self.r1 + n2[:, None] * self.r2
        slack = 1e-9 * (1 + np.abs(centre) + reach)
        most, least = (centre + reach + slack)[:, self.members], (centre - reach - slack)[:, self.members]
        return np.maximum.reduceat(most, self.starts, axis=1), np.minimum.reduceat(least, self.starts, axis=1)

    def home(self, x: np.ndarray) -> np.ndarray:
        """A block of the cell that a vector of the table falls into; of any block where the cell is unknown."""
        at = np.minimum(np.searchsorted(self.cell, self.books.cells(x)[0]), len(self.cell) - 1)
        return self.lo[at]


class Block:
    """Rows of one block by cell, with radii of its own."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray, books: Codebooks):
        by_id = np.argsort(ids, kind="stable")
        cell, d1, d2 = books.cells(rows)
        order = by_id[np.argsort(cell[by_id], kind="stable")]
        self.ids, self.labels, self.rows, self.books = ids[order], labels[order], rows[order], books
        cell, d1, d2 = cell[order], d1[order], d2[order]
        self.u, first = np.unique(cell // books.words, return_inverse=True)
        self.v, second = np.unique(cell % books.words, return_inverse=True)
        self.r1, self.r2 = np.zeros(len(self.u)), np.zeros(len(self.v))
        np.maximum.at(self.r1, first, d1)
        np.maximum.at(self.r2, second, d2)
        starts = np.flatnonzero(np.diff(cell, prepend=-1))
        ends = np.append(starts[1:], len(cell))
        #: rows of the pair (place of the first codeword, place of the second)
        self.at = dict(zip(zip(first[starts].tolist(), second[starts].tolist(), strict=True), zip(starts.tolist(), ends.tolist(), strict=True), strict=True))
        # doubles hold these products exactly, and multiply faster
        self._peak = float(np.abs(rows).max()) if rows.size else 0.0
        self._fast = self.rows.astype(np.float64) if self._peak < 2**31 else None

    def score(self, at: np.ndarray, point: np.ndarray) -> np.ndarray:
        if self._fast is not None and self._peak * float(np.abs(point).max()) * len(point) < 2**53:
            return (self._fast[at] @ point.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ point

    def visit(self, point: np.ndarray, ceiling: float = math.inf) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(row numbers, scores, bound): cells by the sum of their half bounds, about STRIDE rows at a time, and what all later rows
        score at most. Cells in which every row scores more than `ceiling` are passed over."""
        s1, s2, n1, n2 = (x[0] for x in self.books.scores(point[None, :]))
        s1, s2 = s1[self.u], s2[self.v]
        low1, low2 = s1 - n1 * self.r1, s2 - n2 * self.r2
        top1, top2 = s1 + n1 * self.r1, s2 + n2 * self.r2
        slack = 1e-9 * (1 + float(np.abs(top1).max() + np.abs(top2).max()))
        by1, by2 = np.argsort(-top1, kind="stable").tolist(), np.argsort(-top2, kind="stable").tolist()
        most1, most2 = (top1[by1] + slack).tolist(), top2[by2].tolist()
        heap = [(-(most1[0] + most2[0]), 0, 0)]
        left = len(self.at)
        held: list[tuple[int, int]] = []
        size = 0
        while heap and left:
            _, i, j = heapq.heappop(heap)
            # every pair has one predecessor with no smaller a sum
            if j + 1 < len(by2):
                heapq.heappush(heap, (-(most1[i] + most2[j + 1]), i, j + 1))
            if not j and i + 1 < len(by1):
                heapq.heappush(heap, (-(most1[i + 1] + most2[0]), i + 1, 0))
            u, v = by1[i], by2[j]
            rows = self.at.get((u, v))
            if rows is None:
                continue
            left -= 1
            if low1[u] + low2[v] - slack <= ceiling:
                held.append(rows)
                size += rows[1] - rows[0]
            if size >= STRIDE or held and not left:
                at = np.concatenate([np.arange(a, b) for a, b in held])
                yield at, self.score(at, point), -heap[0][0] if heap and left else -math.inf
                held, size = [], 0
            elif heap and not held:  # nothing new, but a lower bound
                yield np.zeros(0, np.int64), np.zeros(0, np.int64), -heap[0][0]
        if held:
            at = np.concatenate([np.arange(a, b) for a, b in held])
            yield at, self.score(at, point), -math.inf

    def _best(self, at: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(at) > k:  # only what ties the k-th or beats it needs sorting
            kth = np.partition(score, len(score) - k)[len(score) - k]
            at, score = at[score >= kth], score[score >= kth]
        order = np.lexsort((self.ids[at], -score))[:k]
        return at[order], score[order]

    def nearest(self, point: np.ndarray, label: int, k: int, floor: int = _NONE) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and scores of the k best rows of the label, equals by smaller id; rows below `floor` may be left out."""
        best, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at, score, bound in self.visit(point):
            own = self.labels[at] == label
            if len(best) == k:
                own &= score >= scores[-1]
            if own.any():
                best, scores = self._best(np.concatenate([best, at[own]]), np.concatenate([scores, score[own]]), k)
            if bound < max(floor, int(scores[-1]) if len(best) == k else _NONE):
                break
        return best, scores

    def windows(self, point: np.ndarray, label: int, windows: list[tuple[int, int, int]], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For every window (least and greatest score, and what the k-th scores at least) the k best rows of other labels in it."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        for at, score, bound in self.visit(point, max((hi for _, hi, _ in windows), default=0)):
            other = self.labels[at] != label
            at, score = at[other], score[other]
            certified = True
            for w, (lo, hi, floor) in enumerate(windows):
                least = max(lo, floor, int(found[w][1][-1]) if len(found[w][0]) == k else _NONE)
                inside = (score >= least) & (score <= hi)
                if inside.any():
                    found[w] = self._best(np.concatenate([found[w][0], at[inside]]), np.concatenate([found[w][1], score[inside]]), k)
                    least = max(least, int(found[w][1][-1]) if len(found[w][0]) == k else _NONE)
                certified &= bound < least
            if certified:
                break
        yield from found


def _deal(members: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and questions of the same block by (block, group): at most about QUESTIONS questions meet a block at once."""
    groups = asked.groupBy("block").agg(F.ceil(F.count("*") / QUESTIONS).cast("int").alias("groups"))
    own = F.pmod(F.xxhash64("qid", F.lit(7)), F.col("groups")).cast("int").alias("group")
    everywhere = F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group")
    questions = asked.join(groups, "block").select(*asked.columns, own)
    return members.join(groups, "block").select("block", "id", "label", "vec", everywhere), questions


def mine(table: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Components become floor(scale * component); a score is the integer inner product with the anchor; higher scores come first,
    equals by smaller id. An anchor's positives are its first `positives` other rows of the same label. For each of them the first
    `negatives` rows of other labels follow whose score is from `low` to `high` percent of the positive's; fewer where there are
    fewer, none where the positive's score is negative.

    Rows without an id or a label, and vectors null, empty or with a null or non-finite component take no part. Vectors of
    different lengths compare as if filled up with zeros. Rows that repeat an id are rows of their own, but no row of an anchor's
    id is its positive; its repeats give equal results once. A hundred scores must stay below 2 ** 53. An empty table gives none.

    The codebooks are fitted on SAMPLE rows at most (least hashes) and grow with the square root of the table, up to MOST_WORDS
    words a half; every row is indexed, and the result does not depend on them. Of rows with equal vector and label only as many
    can count as an anchor takes, so that a vector that a third of all rows share is a few rows. The driver sees the sample and
    one line for each cell.
    """
    vec = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * scale))
    given = table.where(F.col(id_col).isNotNull() & usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), vec.alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    given = cut(given.where(F.col("label").isNotNull()), "vectors")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    # one more than the positives: a row is not its own
    most = max(positives + 1, negatives)
    same = Window.partitionBy("label", "vec").orderBy("id")
    rows = cut(given.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= most).select("id", "label", "vec"), "distinct")
    n = rows.count()
    if not n:
        return table.sparkSession.createDataFrame([], out)
    sample = rows.select("vec").orderBy(F.xxhash64("id", "vec"), "id", "vec").limit(SAMPLE).toArrow()
    words = 1 << max(2, min(MOST_WORDS.bit_length() - 1, round(math.log2(math.sqrt(n / 32) + 1))))
    books = Codebooks(dense(sample["vec"], np.float64), words)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, d1, d2 = books.cells(dense(batch.column("vec"), np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64()), pa.array(d1), pa.array(d2)], names=[*batch.schema.names, "cell", "d1", "d2"])

    indexed = cut(rows.mapInArrow(index, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType()), T.StructField("d1", T.DoubleType()), T.StructField("d2", T.DoubleType())])), "cells")
    # one line for each cell: MOST_WORDS ** 2 at most
    cells = indexed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("r1"), F.max("d2").alias("r2")).toArrow()
    layout = Layout(*[cells[c].to_numpy() for c in ("cell", "n", "r1", "r2")], books)
    spark = table.sparkSession
    places = spark.createDataFrame(list(zip(layout.cell.tolist(), layout.lo.tolist(), layout.shards.tolist(), strict=True)), "cell long, lo long, shards long")
    shard = F.col("lo") + F.pmod(F.xxhash64("id", "vec"), F.col("shards"))
    members = cut(indexed.join(F.broadcast(places), "cell").select(shard.cast("int").alias("block"), "id", "label", "vec"), "blocks")

    # anchors that share label and vector ask once
    name = F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("vec").cast("array<string>")))
    anchors = cut(given.where("asks").select(F.col("id").alias("anchor_id"), name.alias("qid"), "label", "vec"), "anchors")
    questions = anchors.groupBy("qid").agg(F.any_value("label").alias("label"), F.any_value("vec").alias("vec"))

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(layout.home(dense(batch.column("vec"), np.int64)), pa.int32())], names=[*batch.schema.names, "block"])

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every other block that can hold a score from `need` to `ceiling`."""
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                points = dense(some.column("vec"), np.int64)
                upper, lower = layout.bounds(points)
                asks = (upper >= some.column("need").to_numpy()[:, None]) & (lower <= some.column("ceiling").to_numpy()[:, None])
                asks[np.arange(len(points)), some.column("home").to_numpy()] = False
                who, block = np.nonzero(asks)
                kept = some.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(block, pa.int32())], names=[*some.schema.names, "block"])

    def with_block(df: DataFrame) -> T.StructType:
        return T.StructType([*df.schema.fields, T.StructField("block", T.IntegerType())])

    def meet(asked: DataFrame, answer, schema: str) -> DataFrame:
        held, questions = _deal(members, asked)
        names = [f.split()[0] for f in schema.split(", ")]

        def search(group: pa.Table, asks: pa.Table) -> pa.Table:
            found: list[list[np.ndarray]] = []
            if group.num_rows and asks.num_rows:
                vectors, points = same_width(dense(group["vec"], np.int64), dense(asks["vec"], np.int64))
                block = Block(group["id"].to_numpy(), group["label"].to_numpy(), vectors, books)
                for point, row in zip(points, asks.drop_columns(["vec"]).to_pylist(), strict=True):
                    found += answer(block, point, row)
            flat = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*[f[1:] for f in found], strict=True)] if found else [pa.array([], pa.int64())] * (len(names) - 1)
            qids = pa.array([f[0] for f in found for _ in range(len(f[1]))], pa.string())
            return pa.table([qids, *flat], names=names)

        return held.groupBy("block", "group").cogroup(questions.groupBy("block", "group")).applyInArrow(search, schema)

    def first(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def nearest(block: Block, point: np.ndarray, row: dict) -> list:
        at, score = block.nearest(point, row["label"], positives + 1, row.get("need", _NONE))
        return [(row["qid"], block.ids[at], score)]

    home = cut(questions.mapInArrow(at_home, with_block(questions)), "homes")
    found = "qid string, id long, score long"
    near = cut(meet(home, nearest, found), "near")
    floors = near.groupBy("qid").agg(F.min("score").alias("_least"), F.count("*").alias("_n")).where(F.col("_n") > positives).select("qid", F.col("_least").alias("need"))
    asking = home.withColumnRenamed("block", "home").join(floors, "qid", "left").withColumn("need", F.coalesce("need", F.lit(_NONE))).withColumn("ceiling", F.lit(2**62))
    far = meet(asking.mapInArrow(elsewhere, with_block(asking)), nearest, found)
    # the questions' positives: one row each
    ranked = first(near.unionAll(far), ["qid"], positives + 1)
    chosen = cut(ranked.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("positives")), "positives")

    # whole percentages of whole scores: integers throughout
    least = lambda p: ((p * low + 99) - F.pmod(p * low + 99, F.lit(100))) / 100
    greatest = lambda p: (p * high - F.pmod(p * high, F.lit(100))) / 100
    scores = F.array_distinct(F.transform("positives", lambda p: p["score"]))
    scores = F.filter(scores, lambda s: s >= 0)
    windows = F.transform(scores, lambda s: F.struct(s.alias("of"), least(s).cast("long").alias("lo"), greatest(s).cast("long").alias("hi")))
    windows = F.filter(windows, lambda w: w["lo"] <= w["hi"])
    wanted = cut(home.join(chosen, "qid").select("qid", "label", "vec", "block", windows.alias("windows")).where(F.size("windows") > 0), "windows")

    def hardest(block: Block, point: np.ndarray, row: dict) -> list:
        floors = row.get("floors") or {}
        asked = [(w["lo"], w["hi"], dict(floors).get(w["of"], _NONE)) for w in row["windows"]]
        return [(row["qid"], np.full(len(at), w["of"]), block.ids[at], score) for w, (at, score) in zip(row["windows"], block.windows(point, row["label"], asked, negatives), strict=True)]

    found = "qid string, of long, id long, score long"
    near = cut(meet(wanted, hardest, found), "hard")
    floors = near.groupBy("qid", "of").agg(F.min("score").alias("_least"), F.count("*").alias("_n")).where(F.col("_n") >= negatives)
    floors = floors.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("of", "_least"))).alias("floors"))
    asking = wanted.withColumnRenamed("block", "home").join(floors, "qid", "left")
    floor_of = lambda w: F.greatest(w["lo"], F.coalesce(F.element_at("floors", w["of"]), F.lit(_NONE)))
    asking = asking.withColumn("need", F.array_min(F.transform("windows", floor_of))).withColumn("ceiling", F.array_max(F.transform("windows", lambda w: w["hi"])))
    far = meet(asking.mapInArrow(elsewhere, with_block(asking)), hardest, found)
    hard = first(near.unionAll(far), ["qid", "of"], negatives)
    hard = hard.groupBy("qid", "of").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("hard"))
    hard = hard.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("of", "hard"))).alias("hard"))

    own = F.slice(F.filter("positives", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
    asked = anchors.select("anchor_id", "qid").distinct().join(chosen.join(hard, "qid"), "qid")
    pairs = asked.select("anchor_id", F.explode(own).alias("p"), "hard")
    last = pairs.select("anchor_id", F.col("p")["id"].alias("positive_id"), F.col("p")["score"].alias("positive_score"), F.explode(F.element_at("hard", F.col("p")["score"])).alias("n"))
    return last.select("anchor_id", "positive_id", F.col("n")["rank"].cast("int").alias("rank"), F.col("n")["id"].alias("negative_id"), "positive_score", F.col("n")["score"].alias("negative_score"))

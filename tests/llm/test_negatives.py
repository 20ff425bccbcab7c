"""Hard negatives against brute force, and their query against SQL."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import negatives, queries


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, anchors, k=5, m=3, low=50, high=95, scale=256):
    """rows: (id, label, vector); the expected result of `mine` with the anchors' ids."""
    wide = max((len(v) for _, _, v in rows if usable(v)), default=0)
    kept = [(i, la, [math.floor(scale * x) for x in v] + [0] * (wide - len(v))) for i, la, v in rows if i is not None and la is not None and usable(v)]
    out = set()
    if not kept:
        return out
    matrix = np.array([v for _, _, v in kept], np.int64)
    for n, (i, la, v) in enumerate(kept):
        if i not in anchors:
            continue
        score = (matrix @ matrix[n]).tolist()
        others = sorted(((-s, j, lb) for (j, lb, _), s in zip(kept, score) if j != i))
        for ps, j, _ in [o for o in others if o[2] == la][:k]:
            hard = [(-s, x) for s, x, lb in others if lb != la and low * -ps <= 100 * -s <= high * -ps][:m]
            out |= {(i, j, r, x, -ps, s) for r, (s, x) in enumerate(hard, 1)}
    return out


def mined(spark, rows, anchors, **options):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({n: F.lit("x") for n in ("qid", "block", "cell", "asks", "score")})
    return {tuple(r) for r in negatives.mine(df, F.col("vec_id").isin(list(anchors)), F.col("label"), **options).collect()}


def clusters(rnd, n, width=16, around=8, noise=0.3):
    centres = rnd.standard_normal((around, width))
    return centres[rnd.integers(0, around, n)] + noise * rnd.standard_normal((n, width))


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force_across_blocks(spark, monkeypatch, seed):
    """Blocks of a few rows: cells are split and merged, and bounds decide which blocks are asked."""
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "QUESTIONS", 8)
    monkeypatch.setattr(negatives, "STRIDE", 8)
    rnd = np.random.default_rng(seed)
    x = clusters(rnd, 600) if seed else rnd.standard_normal((600, 16))
    x[100:250] = x[100]  # one vector of a quarter of the rows, with several labels
    rows = [(i, int(rnd.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]
    anchors = set(range(0, 600, 13)) | {101, 102, 103}
    assert mined(spark, rows, anchors) == brute(rows, anchors)


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 1.0]), (1, 1, [1.0, 1.0]), (1, 1, [0.9, 1.0]), (2, 2, [0.8, 0.8]), (3, 2, [0.8, 0.8]), (4, None, [0.8, 0.8]), (None, 2, [0.8, 0.8]), (5, 2, None), (6, 2, [float("nan"), 1.0]), (7, 2, [None, 1.0]), (8, 2, []), (9, 2, [0.7]), (10, 3, [0.6, 0.6, 5.0]), (11, 2, [float("inf"), 0.0]), (12, 5, [0.0, 0.0]), (13, 5, [0.0, 0.0]), (14, 6, [-1.0, -1.0]), (15, 6, [1.0, 1.0])]
    every = set(range(16))
    assert mined(spark, rows, every) == brute(rows, every)
    assert mined(spark, rows, every, positives=1, negatives=5, low=10, high=100) == brute(rows, every, 1, 5, 10, 100)
    assert mined(spark, rows, set()) == set()
    assert mined(spark, rows[4:9], every) == set()
    assert mined(spark, [], every) == set()


def test_window_is_left_once_certified():
    """On clusters the heap is not emptied."""
    rnd = np.random.default_rng(1)
    x = np.floor(256 * clusters(rnd, 4000, noise=0.05)).astype(np.int64)
    books = negatives.Codebooks(x[:1000].astype(np.float64), 16)
    block = negatives.Block(np.arange(4000), rnd.integers(0, 3, 4000), x, books)
    read = sum(len(at) for at, _, _ in block.visit(x[5]))
    assert read == 4000
    seen = 0
    for at, score, bound in block.visit(x[5]):
        seen += len(at)
        if bound < np.sort(score)[-6:].min():
            break
    assert seen < 2500
    at, score = block.nearest(x[5], int(block.labels[0]), 6)
    every = x[np.argsort(block.ids[np.argsort(block.ids)])] @ x[5]
    own = [(-every[block.ids[i]], block.ids[i]) for i in range(4000) if block.labels[i] == block.labels[0]]
    assert [(-s, block.ids[a]) for a, s in zip(at, score)] == sorted(own)[:6]


def test_query(spark, sf_dir, tmp_path):
    for folder, path in ((sf_dir, f"{sf_dir}/embeddings.parquet"), (str(tmp_path), f"{tmp_path}/embeddings.parquet/*.parquet")):
        if folder != sf_dir:
            rnd = random.Random(6)
            spoiled = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
            rows = [(r.vec_id, rnd.choice([r.label, r.label, None]), None if rnd.random() < 0.05 else r.embedding) for r in spoiled]
            spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}')")
        want = con.execute(queries.ORACLES["op11_inverted_multi_index"]).fetchall()
        assert {tuple(r) for r in queries.op11(spark, folder).collect()} == set(want) and want

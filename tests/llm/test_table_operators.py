"""Near duplicates, mixtures, vector searches and archives against brute force on small tables."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import ann, fixity, mixing, neardup, threshold

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_components(texts, size, percent=80):
    sets = []
    for t in texts:
        w = (t or "").encode().translate(LOWER).split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def near_texts(seed):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(25):
        base = rnd.choices(words, k=rnd.choice([3, 5, 6, 8, 12, 30, 60]))
        for _ in range(rnd.choice([1, 2, 3, 20])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(copy) // 8))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(" ".join(w.upper() if rnd.random() < 0.1 else w for w in copy))
    return [*texts, None, "", " \n", "a", "A", "b a", "B  A", "long " * 3000]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, size):
    texts = near_texts(size)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("node", F.lit("x")).withColumn("n", F.lit(1))
    out = neardup.components(docs, size).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in out] == brute_components(texts, size)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_rest_of_buckets_is_compared(spark, monkeypatch):
    """Without further hubs, and with blocks of a few nodes, the comparison inside buckets finds the same links."""
    monkeypatch.setattr(neardup, "HUBS", 0)
    monkeypatch.setattr(neardup, "SIDE", 4)
    texts = near_texts(7)[:90]
    out = neardup.components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2).orderBy("doc_id").collect()
    assert [(r.n_shingles, r.component_id) for r in out] == brute_components(texts, 2)


def test_near_duplicates_of_odd_tables(spark):
    same = "one two three four five six seven"
    docs = spark.createDataFrame([(None, same), (4, same), (4, same), (9, same), (None, "quite another text of some words"), (7, None), (8, "")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.components(docs).collect()), key=str)
    assert out == sorted([(None, 4, False), (4, 4, True), (4, 4, True), (9, 4, False), (None, None, True), (7, 7, True), (8, 8, True)], key=str)
    assert neardup.components(docs.limit(0)).count() == 0
    assert neardup.components(docs.where("doc_id > 6 AND doc_id < 9")).count() == 2


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(3)
    pool = rnd.integers(0, 2**63, 1200, dtype=np.uint64)
    for size in (6, 60, 900):
        a, b = np.unique(pool[:size]), np.unique(pool[size // 6 : size + size // 6])
        same = (neardup.signatures([a])[0] == neardup.signatures([b])[0]).mean()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(same - true) < 0.3


def fill(sizes, share=1.5, most=2):
    names = sorted((n for n in sizes if n is not None), key=str.encode) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    left, goal, open_ = share * sum(sizes.values()), dict.fromkeys(names, 0.0), set(names)
    while open_:
        level = left / sum(weight[n] for n in open_)
        over = {n for n in open_ if level * weight[n] > most * sizes[n]}
        if not over:
            goal.update({n: level * weight[n] for n in open_})
            break
        for n in over:
            goal[n] = most * sizes[n]
            left -= goal[n]
        open_ -= over
    return goal


@pytest.mark.parametrize("seed", range(3))
def test_mixture(spark, seed):
    rnd = random.Random(seed)
    data = [(rnd.choice([None, i]), " ".join(["w"] * rnd.choice([0, 1, 5, 40])), rnd.choice(["a", "a", "a", "a", "b", "c", "é", "z", None])) for i in range(200)]
    data += [(1, None, "b"), (1, "x y", "b"), (1, "x y", "b"), (3, "long " * 2000, "c")]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(0))
    out = mixing.mix(docs, carry=("text",)).toPandas()
    assert len(out) == len(data)
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    goal = fill(sizes)
    for name, own in out.groupby("source", dropna=False):
        name = name if isinstance(name, str) else None
        assert (own.source_size == sizes[name]).all() and np.allclose(own.target, goal[name])
        assert abs(own.taken.sum() - goal[name]) <= 1
    assert (out.taken <= 2 * out["size"]).all()
    # whole epochs before the fraction: any two documents of a source differ by one epoch at most
    for _, own in out[out["size"] > 0].groupby("source", dropna=False):
        epochs = own.taken / own["size"]
        assert epochs.max() - epochs.min() <= 1
    again = mixing.mix(docs.repartition(7), carry=("text",)).toPandas()
    key = lambda df: Counter(map(str, df[["doc_id", "size", "source", "taken"]].values.tolist()))
    assert key(out) == key(again)
    written = mixing.copies(mixing.mix(docs, carry=("text",))).toPandas()
    assert written.text.map(lambda t: len(t.split())).sum() == out.taken.sum()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") % 8 == 0, "b").otherwise("a").alias("source"))
    weight = F.when(F.col("doc_id") % 2 == 0, 1.0).otherwise(0.2)
    out = mixing.mix(docs, share=0.3, weight=weight).where("source = 'a'").groupBy(F.col("doc_id") % 2 == 0).agg(F.avg(F.col("taken") / F.col("size"))).collect()
    chance = {r[0]: r[1] for r in out}
    assert chance[True] > 1.8 * chance[False]


def test_word_counts(spark):
    texts = ["a b", " a\x0bb\x0c\r\n c ", "", None, "\xa0x y", " x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r[0] for r in docs.select(mixing.word_count(F.col("text"))).collect()]
    assert got == [len((t or "").encode().split()) for t in texts]


VECTORS = "vec_id long, embedding array<float>, id string, vec int"


def vectors(spark, seed, n=400, wide=9):
    rnd = np.random.default_rng(seed)
    x = np.round(rnd.standard_normal((n, wide)), 1).astype(np.float32)  # many ties
    x[5], x[6], x[7] = x[4], x[4], 0
    data = [(i, [float(v) for v in row], "a", 1) for i, row in enumerate(x)]
    odd = [(1000, None, "a", 1), (1001, [], "a", 1), (1100, [1.0, None, *[0.0] * (wide - 2)], "a", 1), (1200, [float("nan")] * wide, "a", 1), (1300, [float("inf")] * wide, "a", 1), (None, [1.0] * wide, "a", 1)]
    return x.astype(float), spark.createDataFrame(data + odd, VECTORS)


@pytest.mark.parametrize("block", [4096, 64])
def test_exact_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(threshold, "ROWS", block)
    monkeypatch.setattr(threshold, "QUERIES", 3)
    x, table = vectors(spark, block)
    rows = threshold.quantised(table)
    out = threshold.top_k(rows, rows.where("id % 50 = 0"), 10)
    whole = np.floor(1024 * x).astype(np.int64)
    want = []
    for q in range(0, 400, 50):
        score = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:10]
        want += [(q, r + 1, int(i), int(score[i])) for r, i in enumerate(order)]
    assert sorted(map(tuple, out.select("query_id", "rank", "id", "score").collect())) == sorted(want)
    few = rows.where("id < 4")
    assert threshold.top_k(few, few.where("id = 0"), 10).count() == 3
    assert threshold.top_k(rows.limit(0), rows.limit(0), 10).count() == 0


def test_lists_are_not_read_to_the_end():
    rnd = np.random.default_rng(1)
    rows = np.zeros((3000, 4), np.int64)
    rows[:, 0] = rnd.permutation(3000)
    lists = threshold.SortedLists(np.arange(3000), rows)
    which, at, score, depth = lists.tops(np.array([-1]), np.array([[3, 0, 0, 0]]), 5)
    assert score.tolist() == [3 * v for v in range(2999, 2994, -1)] and depth[0] < 100 and not which.any()
    huge = threshold.SortedLists(np.arange(3), np.array([[2**40], [2**40 + 1], [-(2**40)]]))
    assert huge.tops(np.array([-1]), np.array([[2**20 + 1]]), 2)[2].tolist() == [(2**40 + 1) * (2**20 + 1), 2**40 * (2**20 + 1)]


@pytest.mark.parametrize("spread,k", [(2, 4), (2, 60), (1000, 3), (2**31, 3)])
def test_queries_that_read_together_find_what_each_would(monkeypatch, spread, k):
    """Many ties, queries of zeros, repeated ids, floors, more asked for than there is, products beyond 2 ** 53."""
    monkeypatch.setattr(threshold, "TOGETHER", 7)
    rnd = np.random.default_rng(spread)
    rows, ids = rnd.integers(-spread, spread + 1, (50, 5)), rnd.permutation(50) // 2
    points = np.concatenate([rnd.integers(-spread // 32 - 1, spread // 32 + 2, (20, 5)), np.zeros((2, 5), np.int64)])
    names = rnd.integers(0, 30, len(points))
    lists = threshold.SortedLists(ids, rows)
    floors = np.array([threshold._NONE if i % 2 else 0 for i in range(len(points))])
    which, at, score, depth = lists.tops(names, points, k, floors)
    assert depth.max() <= 50
    for q, point in enumerate(points):
        want = sorted(((-int(r @ point), int(i)) for r, i in zip(rows, ids) if i != names[q]))[:k]
        got = list(zip((-score[which == q]).tolist(), lists.ids[at[which == q]].tolist()))
        if q % 2:
            assert got == want
        else:  # what is below the floor may be missing
            assert [w for w in want if w[0] <= 0] == [g for g in got if g[0] <= 0]


def test_neighbours(spark):
    x, table = vectors(spark, 2, 3000, 16)
    out = ann.search(table, F.col("vec_id") % 20 == 0, 20).toPandas()
    asked = [q for q in range(0, 3000, 20) if x[q].any()]
    assert sorted(out.query_id.unique()) == asked and set(out.groupby("query_id").size()) == {20}
    hit = 0
    for q, own in out.groupby("query_id"):
        score = x @ x[q]
        assert q not in set(own.id) and np.allclose(own.score, score[own.id])
        order = own.sort_values("rank")
        assert list(zip(-order.score, order.id)) == sorted(zip(-order.score, order.id))
        score[[q, 7]] = -np.inf
        kth = np.sort(score)[-20]
        hit += (score[own.id] >= kth - 1e-12).sum()
    assert hit / len(out) >= 0.9
    few = table.where("vec_id < 5")
    assert ann.search(few, F.col("vec_id") == 0, 20).count() == 4
    assert ann.search(table.limit(0), F.col("vec_id") == 0, 20).count() == 0


def test_questions_meet_rows_in_blocks(spark, monkeypatch):
    """Half of all rows ask one part, many under one id: no group grows with them, every row meets every question once."""
    monkeypatch.setattr(ann, "ROWS", 64)
    monkeypatch.setattr(ann, "QUESTIONS", 64, raising=False)
    points = spark.range(2000).select(F.lit(3).cast("long").alias("path"), F.when(F.col("id") < 500, 7).otherwise(F.col("id")).alias("name"), F.array(F.lit(1.0)).alias("vec"), F.col("id").alias("turn"))
    asks = points.where("turn % 2 = 0")
    members, asked = ann._meetings(points, asks.unionAll(asks.withColumn("path", F.col("turn") % 4)))
    keys = ["path", "block", "group"]
    assert members.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 128 and asked.groupBy(*keys).count().agg(F.max("count")).first()[0] <= 128
    met = members.where("path = 3").groupBy(*keys).agg(F.count("*").alias("m")).join(asked.groupBy(*keys).agg(F.count("*").alias("q")), keys)
    assert met.agg(F.sum(F.col("m") * F.col("q"))).first()[0] == 2000 * 1000


def test_blocks_of_questions_do_not_change_the_result(spark, monkeypatch):
    _, table = vectors(spark, 6, 1500, 16)
    found = lambda: sorted(map(tuple, ann.search(table, F.col("vec_id") % 2 == 0, 5).collect()))
    whole = found()
    monkeypatch.setattr(ann, "ROWS", 32)
    monkeypatch.setattr(ann, "QUESTIONS", 32, raising=False)
    assert found() == whole


def test_large_parts_are_split_again(spark, monkeypatch):
    """Parts stay small however many rows there are, clusters and equal vectors included, and recall holds over all levels."""
    monkeypatch.setattr(ann, "SAMPLE", 512)
    monkeypatch.setattr(ann, "PART", 400)
    made = []
    monkeypatch.setattr(ann, "_meetings", lambda rows, asked, meet=ann._meetings: made.append((rows, asked)) or meet(rows, asked))
    rnd = np.random.default_rng(12)
    x = rnd.standard_normal((60, 16))[rnd.integers(0, 60, 9000)] + 0.4 * rnd.standard_normal((9000, 16))
    x[:1000] = x[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    table = spark.createDataFrame([(i, v.tolist(), None, 1) for i, v in enumerate(x)], VECTORS).repartition(6)
    out = ann.search(table, F.col("vec_id") % 50 == 0, 20).toPandas()
    asked = np.arange(0, 9000, 50)
    assert sorted(out.query_id.unique()) == asked.tolist() and set(out.groupby("query_id").size()) == {20}
    hit = 0
    for q, own in out.groupby("query_id"):
        score = x @ x[q]
        assert q not in set(own.id) and np.allclose(own.score, score[own.id])
        score[q] = -np.inf
        hit += (score[own.id] >= np.sort(score)[-20] - 1e-12).sum()
    assert hit / len(out) >= 0.9
    rows, questions = made[0]
    assert rows.count() == 9000 and rows.select("name").distinct().count() == 9000
    sizes = sorted(r["count"] for r in rows.groupBy("path").count().collect())
    assert sizes[-1] < 2000 and sizes[-2] <= 400  # equal vectors stay together
    assert questions.groupBy("path", "name").count().agg(F.max("count")).first()[0] == 1


def test_neighbours_of_rows_beyond_the_sample(spark):
    rnd = np.random.default_rng(8)
    x = rnd.standard_normal((12_000, 24))
    table = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    hit, asked = 0, range(0, 12_000, 40)
    own = ann.search(table, F.col("vec_id") % 40 == 0, 20).toPandas().groupby("query_id").id.agg(set)
    for q in asked:
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(own[q] & set(np.argsort(-score)[:20].tolist()))
    print("recall", hit / (20 * len(asked)))
    assert hit / (20 * len(asked)) >= 0.95


def test_probes_come_from_rows_held_back(monkeypatch):
    seen = []
    monkeypatch.setattr(ann, "train", lambda x, *a, f=ann.train: seen.append(x) or f(x, *a))
    monkeypatch.setattr(ann.Router, "probabilities", lambda self, x, f=ann.Router.probabilities: seen.append(x) or f(self, x))
    ann.fit(np.random.default_rng(3).standard_normal((600, 8)))
    learnt, asked = ({r.tobytes() for r in x} for x in seen)
    assert len(learnt) == 450 and len(asked) == 150 and not learnt & asked


def test_parts_are_balanced():
    rnd = np.random.default_rng(4)
    near = ann.neighbour_graph(rnd.standard_normal((1000, 8)), 10)
    sizes = np.bincount(ann.balanced_parts(near, 4, rnd))
    assert len(sizes) == 16 and sizes.max() - sizes.min() <= 1


def pages(spark, n=300):
    data = [(i if i % 50 else None, f"http://x/{i}" if i % 9 else None, f"<p>{'y' * (i * 37 % 4000)}" if i % 11 else None) for i in range(n)]
    return spark.createDataFrame([*data, data[3], data[3], data[50], data[50], (9000, "u", "z" * 300_000)], "page_id long, url string, html string").withColumn("offset", F.lit("x")).withColumn("stamp", F.lit(1))


def test_records_fill_their_archives(spark):
    out = fixity.pack(pages(spark).withColumns({c: F.lit("x") for c in ("offset", "_a", "_k", "record", "archive", "_content")})).select("archive", "offset", F.octet_length("record").alias("n")).toPandas()
    assert len(out) == 305
    for _, own in out.groupby("archive"):
        own = own.sort_values(["offset", "n"])
        assert own.offset.tolist() == [0, *np.cumsum(own.n)[:-1].tolist()]


def test_audit_finds_what_differs(spark):
    packed = fixity.pack(pages(spark).withColumns({c: F.lit("x") for c in ("offset", "_a", "_k", "record", "archive", "_content")})).cache()
    assert fixity.audit(packed, packed).count() == 0
    assert fixity.audit(packed.limit(0), packed.limit(0)).count() == 0
    all_ = packed.count()
    assert fixity.audit(packed, packed.limit(0)).where("status = 'missing'").count() == all_
    bad = packed.where("page_id % 40 <> 7 OR page_id IS NULL").withColumn("record", F.when(F.col("page_id") % 30 == 4, F.reverse("record")).when(F.col("page_id") % 30 == 6, F.lit(None)).otherwise(F.col("record")))
    extra = packed.where("page_id = 101").select(*[F.lit("other.warc").alias(c) if c == "archive" else F.col(c) for c in packed.columns])
    found = Counter(r.status for r in fixity.audit(packed, bad.unionByName(extra)).collect())
    at = "page_id % 40 <> 7 AND (page_id % 30 = 4 OR page_id % 30 = 6)"
    assert found == Counter(altered=packed.where(at).count(), missing=packed.where("page_id % 40 = 7").count(), extra=1)


def test_ranges_of_keys_are_small_for_small_weights(spark):
    keys = spark.range(50_000).select(mixing.order_key(11, F.when(F.col("id") % 10 == 0, 1.0).otherwise(0.05), F.col("id")).alias("key"))
    found = keys.select("key", mixing._range(F.col("key"), 0).alias("a"), mixing._range(F.col("key"), 1).alias("b")).toPandas().sort_values("key")
    assert found.groupby(["a", "b"]).size().max() <= 10
    places = list(zip(found.a, found.b))
    assert places == sorted(places) and found.a.between(0, mixing.RANGES - 1).all()

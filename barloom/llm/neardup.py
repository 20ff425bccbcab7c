"""Near-duplicate texts: one-permutation MinHash, banded buckets, star-shaped candidate edges, exact confirmation.

Texts with the same shingle set are one node from the start. A node's set is cut into K bins by the high bits of the shingle
names; the least name of each bin is its signature, and an empty bin borrows from the bin that a fixed sequence of probes
meets first (optimal densification). R bins in a row make a band; nodes with the same band share a bucket. With K = 128 and
R = 4, sets of similarity 0.8 miss each other in all 32 bands with a chance of 5e-8.

A bucket of m nodes gives m - 1 edges, all to one hub. Edges are confirmed on the full sets. A star alone would lose a link
between two nodes that are both unlike the hub, so buckets whose nodes are not yet all connected get another hub, and what is
then left is compared by full sets inside the bucket, in blocks of bounded size that return only links which connect something
new. Nodes already connected are never paired again, which keeps large groups of copies linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.store import cut, drop
from barloom.llm.words import Words, blocks, combine, mix
from barloom.llm.workers import released, released_groups

U64 = np.uint64
K, R = 128, 4
BLOCK_BYTES = 2 << 20
#: hubs that a bucket may get before its rest is compared in blocks
HUBS = 2
#: nodes of one side of a block
SIDE = 1024


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted 64-bit names of each text's distinct `size`-word shingles; a text with fewer words is one shingle."""
    words = Words(texts, lower=True)
    name, first = words.names(), words.first
    runs = name
    for k in range(1, size):
        runs = combine(runs[: max(0, len(name) - k)], name[k:])
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            whole = name[a : a + 1]
            for k in range(a + 1, b):
                whole = combine(whole, name[k : k + 1])
            out.append(mix(whole + U64(b - a)))
        else:
            out.append(name[:0])
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of K values per non-empty set."""
    width = U64(2**64 // K)
    edges = np.arange(K, dtype=U64) * width
    sig, empty = np.zeros((len(sets), K), U64), np.ones((len(sets), K), bool)
    for i, own in enumerate(sets):
        at = np.searchsorted(own, edges)
        there = np.flatnonzero(at < len(own))
        there = there[own[at[there]] // width == there.astype(U64)]
        sig[i, there], empty[i, there] = own[at[there]], False
    row, bin_ = np.nonzero(empty)
    tried = 0
    while len(row):
        tried += 1
        probe = (mix(bin_.astype(U64) * U64(1_000_003) + U64(tried)) % U64(K)).astype(np.int64)
        met = ~empty[row, probe]
        # the value is tied to the borrowing bin, so that two bins are not equal by sharing a lender
        sig[row[met], bin_[met]] = sig[row[met], probe[met]]
        row, bin_ = row[~met], bin_[~met]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    out = np.empty((len(sig), K // R), U64)
    for b in range(K // R):
        key = np.full(len(sig), mix(np.array([b + 1], U64))[0])
        for c in range(R):
            key = combine(key, sig[:, b * R + c])
        out[:, b] = key
    return out.view(np.int64)


def _node(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        return np.array([mix(own + U64(1)).sum(dtype=U64) + U64(len(own)), mix(own * U64(3) + U64(2)).sum(dtype=U64)], U64).tobytes()


def _sketch(slim: DataFrame, size: int, least: int) -> DataFrame:
    """id, text keys, n and, for sets of `least` shingles or more, bands."""
    schema = T.StructType(
        [*[slim.schema[c] for c in ("id", "t1", "t2")]]
        + [T.StructField("n", T.LongType()), T.StructField("node", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "text", BLOCK_BYTES):
            sets = shingle_sets(batch.column("text"), size)
            wide = [i for i, s in enumerate(sets) if len(s) >= least]
            band = bands(signatures([sets[i] for i in wide]))
            at = {i: k for k, i in enumerate(wide)}
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("id", "t1", "t2")],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_node(s) if len(s) else None for s in sets], pa.binary()),
                    pa.array([band[at[i]] if i in at else None for i in range(len(sets))], pa.list_(pa.int64())),
                ],
                names=schema.names,
            )

    return slim.mapInArrow(released(run), schema)


def _packed(slim: DataFrame) -> DataFrame:
    """The texts, small enough to shuffle."""
    schema = T.StructType([*[slim.schema[c] for c in ("id", "t1", "t2")], T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            packed = [None if t is None else squeeze(t.encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "t1", "t2")], pa.array(packed, pa.binary())], names=schema.names)

    return slim.mapInArrow(released(run), schema)


def _confirm(edges: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The edges (a, b) whose full sets are alike enough."""
    a_side = texts.select(F.col("node").alias("a"), F.col("packed").alias("of_a"))
    b_side = texts.select(F.col("node").alias("b"), F.col("packed").alias("of_b"))
    schema = edges.select("a", "b").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                packed = dict(zip(a + b, part.column("of_a").to_pylist() + part.column("of_b").to_pylist(), strict=True))
                sets = dict(zip(packed, shingle_sets(pa.array([open_(p).decode() for p in packed.values()], pa.large_string()), size), strict=True))
                linked = []
                for x, y in zip(a, b, strict=True):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    linked.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
                yield part.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return edges.select("a", "b").join(b_side, "b").join(a_side, "a").select("a", "b", "of_a", "of_b").mapInArrow(released(run), schema)


def _components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): the least node of each component, by large and small stars in turns until nothing moves.

    Every step keeps components as they are and only shortens paths to their least node."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = cut(edges, "edges")
    print_ = [F.count("*"), F.bit_xor(F.xxhash64("u", "v"))]
    before = edges.agg(*print_).first()
    for _ in range(most):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small = cut(small, "small")
        drop(edges)
        edges, after = small, small.agg(*print_).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _sizes_allow(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _overlaps(sets: list[np.ndarray], own: np.ndarray, others: np.ndarray):
    """For each set in `own`: its number and how many shingles it shares with each set in `others`."""
    flat = np.concatenate([sets[j] for j in others.tolist()])
    owner = np.repeat(np.arange(len(others)), [len(sets[j]) for j in others.tolist()])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for i in own.tolist():
        lo, hi = np.searchsorted(flat, sets[i], side="left"), np.searchsorted(flat, sets[i], side="right")
        size = hi - lo
        at = np.arange(size.sum()) + np.repeat(lo - np.cumsum(size) + size, size)
        yield i, np.bincount(owner[at], minlength=len(others))


def _rest(members: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between unconnected nodes of one bucket, by their full sets; of several that join the same two components one.

    `members`: key, node, label, packed. A large bucket is dealt into blocks of SIDE nodes against SIDE nodes, so what a task
    holds is bounded, and what it returns is less than the nodes it has seen."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / SIDE).cast("int").alias("parts"), F.bit_xor(F.xxhash64("node")).alias("x"), F.count("*").alias("m"))
    # the same nodes often meet in several bands
    parts = sizes.groupBy("x", "m", "parts").agg(F.min("key").alias("key")).select("key", "parts")
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = members.join(parts, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "label", "packed")
    schema = "a binary, b binary"

    def links(group: pa.Table) -> pa.Table:
        p, q, own = group["p"][0].as_py(), group["q"][0].as_py(), group["own"].to_numpy()
        node, open_ = group["node"].to_pylist(), zstandard.ZstdDecompressor().decompress
        sets = shingle_sets(pa.array([open_(x).decode() for x in group["packed"].to_pylist()], pa.large_string()), size)
        n, label = np.array([len(s) for s in sets]), np.unique(np.array([x.hex() for x in group["label"].to_pylist()]), return_inverse=True)[1]
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        out_a, out_b = [], []
        if len(left) and len(right):
            for i, shared in _overlaps(sets, left[(np.bincount(label[right], minlength=label.max() + 1)[label[left]] < len(right))], right):
                alike = right[100 * shared >= percent * (n[i] + n[right] - shared)]
                for to in np.unique(label[alike[label[alike] != label[i]]]).tolist():
                    j = int(alike[label[alike] == to][0])
                    out_a.append(min(node[i], node[j]))
                    out_b.append(max(node[i], node[j]))
                    label[label == to] = label[i]
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary())})

    return dealt.groupBy("key", "p", "q").applyInArrow(released_groups(links), schema)


def components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id (the least id reachable over links, itself included), kept (id = component_id).

    A-Z count as lower case; words are runs of `[^\\x20\\x09-\\x0D]`. Links: 100 * intersection >= percent * union of the sets.
    A text with fewer than `size` words is one shingle; null and empty texts have none and are linked with nothing. Rows that
    repeat an id are nodes of their own and share what they reach. Rows without an id take part in linking, but name no
    component: their component is the least id they reach; where there is none it is null and they are kept. Other columns are
    left out.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(7)).alias("t2"), text.alias("text"))
    # a different set needs at least one more or one other shingle: below this size no two sets are alike enough
    least = -(-percent // max(1, 100 - percent))
    sketch = cut(_sketch(slim, size, least), "sketch")
    some = sketch.where("n > 0")
    nodes = cut(some.groupBy("node").agg(F.first("n").alias("n"), F.min("id").alias("least_id"), F.min(F.struct("id", "t1", "t2")).alias("of"), F.first("bands").alias("bands")), "nodes")
    in_bucket = nodes.where("bands IS NOT NULL").select("node", F.explode("bands").alias("key"))
    shared = in_bucket.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    buckets = cut(in_bucket.join(shared, "key"), "buckets")
    asked = buckets.select("node").distinct().join(nodes.select("node", F.col("of.id").alias("i"), F.col("of.t1").alias("u1"), F.col("of.t2").alias("u2")), "node")
    packed = _packed(slim)
    texts = cut(packed.join(asked, (packed.t1 == asked.u1) & (packed.t2 == asked.u2) & packed.id.eqNullSafe(asked.i)).select("node", "packed").dropDuplicates(["node"]), "texts")
    about = cut(nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("node", "n"), "about")

    links, labels = None, about.select("node", F.col("node").alias("label"))
    for round_ in range(HUBS + 1):
        state = cut(buckets.join(labels, "node"), "state")
        labelled = state.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", F.lit(round_)).alias("h"), "node", "label")).alias("hub"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        open_ = cut(labelled.where("lo != hi").select("key", F.col("hub.node").alias("hub"), F.col("hub.label").alias("hub_label")), "open")
        if not open_.limit(1).count():
            break
        if round_ < HUBS:
            star = state.join(open_, "key").where("label != hub_label").select("hub", "node").distinct()
            a, b = about.select(F.col("node").alias("hub"), F.col("n").alias("n_a")), about.select("node", F.col("n").alias("n_b"))
            edges = star.join(a, "hub").join(b, "node").where(_sizes_allow(F.col("n_a"), F.col("n_b"), percent)).select(F.col("hub").alias("a"), F.col("node").alias("b"))
        else:
            edges = _rest(state.join(open_.select("key"), "key").join(texts, "node"), size, percent)
        edges = cut(edges, "star")
        found = cut(_confirm(edges, texts, size, percent), "links") if round_ < HUBS else edges
        if found.limit(1).count():
            links = found if links is None else links.unionAll(found)
            known = cut(_components(links), "known")
            labels = cut(about.select("node").join(known, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
        drop(state, open_, edges)
    drop(buckets, texts)

    of_node = nodes.select("node", "least_id").join(labels, "node", "left").select("node", "least_id", F.coalesce("label", "node").alias("label"))
    least_of = of_node.groupBy("label").agg(F.min("least_id").alias("component_id"))
    placed = cut(of_node.join(least_of, "label").select("node", "component_id"), "placed")
    out = sketch.select("id", "n", "node").join(placed, "node", "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"))

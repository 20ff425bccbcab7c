"""The manifest against plain hashing, and its query against SQL."""

import glob
import hashlib
import os
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from barloom.llm import manifest, queries


def H(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """The root, and each leaf's siblings by level."""
    at, found = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for leaf, place in enumerate(at):
            run = runs[place // 8]
            found[leaf].append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        nodes, at = [H("".join(r)) for r in runs], [p // 8 for p in at]
    return nodes[0], found


def brute(rows):
    """(id, part, leaf) -> sorted rows with their subroot, root and path."""
    parts = sorted({p for _, p, _ in rows}, key=lambda p: (p is not None, (p or "").encode()))
    out, roots, held = [], [], []
    for part in parts:
        own = sorted((r for r in rows if r[1] == part), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
        root, paths = climb([r[2] for r in own])
        roots.append(root)
        held.append(list(zip(own, range(len(own)), paths)))
    root, above = climb(roots)
    for sub, rows_, up in zip(roots, held, above):
        out += [(*r, place, sub, root, path + up) for r, place, path in rows_]
    return out


def of(df):
    key = lambda r: (str(r[1]), r[3])
    return sorted([(r.doc, r.part, r.leaf, r.place, r.subroot, r.root, [(s.before, s.after) for s in r.path]) for r in df.collect()], key=key)


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 1}, {"a": 9, "": 65, "é": 64, "z": 2, None: 513}, {"a": 4200, "b": 1}])
def test_proofs(spark, sizes):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, i, i, i]), part, H(f"{part}{i}")) for part, n in sizes.items() for i in range(n)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc long, part string, leaf string").withColumn("at", F.lit("x")).withColumn("_part", F.lit(1)).withColumn("path", F.lit(2))
    found = manifest.manifest(df, "doc", "part")
    key = lambda r: (str(r[1]), r[3])
    assert of(found) == sorted(brute(rows), key=key)
    assert found.where(manifest.fold(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0


def test_repeated_rows_take_a_place_each(spark):
    rows = [(7, "a", H("x"))] * 5000 + [(None, None, H("y"))] * 9 + [(8, "a", H("z"))]
    found = manifest.manifest(spark.createDataFrame(rows, "doc long, part string, leaf string"), "doc", "part")
    key = lambda r: (str(r[1]), r[3])
    assert of(found) == sorted(brute(rows), key=key)


def test_fields_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, None, ""), (None, "é", "ab" * 50000)], "a long, b string, c string")
    out = df.select(manifest.leaf_of([F.col(c) for c in df.columns])).collect()
    assert [r[0] for r in out] == [H("1:1-0:"), H("-2:é100000:" + "ab" * 50000)]
    empty = spark.createDataFrame([], "doc long, part string, leaf string")
    assert manifest.manifest(empty, "doc", "part").count() == 0


def documents(spark, folder):
    rnd = random.Random(2)
    rows = [(rnd.choice([i, i, i, None]), rnd.choice([None, "", "One TWO thrée É", "x" * 999]), rnd.choice(["en", "en", None, "de", "É"]), rnd.choice([None, "s"]), rnd.choice([None, 5])) for i in range(300)]
    rows += rows[:20]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    return rows


def test_query(spark, tmp_path):
    rows = documents(spark, str(tmp_path))
    out = queries.op13(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(queries.ORACLES["op13_merkle_manifest"])
    names = [d[0] for d in cur.description]
    want = sorted((tuple(r[names.index(c)] for c in out[0].asDict()) for r in cur.fetchall()), key=str)
    assert sorted((tuple(r) for r in out), key=str) == want
    # tampering shows where it changes a text, and nowhere else
    spoiled = {field(i) + field(s) + field(la) + field(n) + field(t) for i, t, la, s, n in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and t and any("A" <= c <= "Z" for c in t)}
    assert {r.leaf for r in out if not r.verified} == {H(x) for x in spoiled} and spoiled


def test_given_documents(spark, sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/documents.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(queries.ORACLES["op13_merkle_manifest"] + " ORDER BY doc_id").fetchall()
    got = queries.op13(spark, sf_dir).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want

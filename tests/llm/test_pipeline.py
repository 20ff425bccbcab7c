"""The pipeline stage by stage against brute force, and the contract of its queries."""

import os
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from test_table_operators import brute_components, fill  # noqa: E402
from test_text_operators import plain  # noqa: E402

from barloom.llm import bpe, store  # noqa: E402
from barloom.llm.queries import ORACLES, QUERIES  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """(name, input, output) of each stage, with odd rows among the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(None, "mail me@example.com or call +1 (456) 555-2186 now", None, None, None), (7, None, "en", "src1", 0), (8, "", None, None, 0), (9, "12 34 !!", "en", "src2", 8), (9, "der die das", "de", None, 11), (9, "der die das", "de", None, 11)]
    docs = store.cut(docs.select(*corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(odd, SCHEMA)), "docs")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        given = docs.toPandas()
        docs = store.cut(stage(spark, docs, sf_dir), name)
        out[name] = given, docs.toPandas()
    return out


def test_stages_are_named_functions():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "privacy", "mixture", "tokens"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_keeps_what_has_a_language(stages):
    given, kept = stages["language"]
    spoken = given[given.text.map(lambda t: any(c.isalpha() for c in t or ""))]
    assert Counter(kept.text) == Counter(spoken.text) and list(kept.columns) == list(corpus_pipeline.COLUMNS)
    known = given.dropna(subset=["lang", "doc_id"]).drop_duplicates("doc_id", keep=False).set_index("doc_id").lang
    own = kept.dropna(subset=["doc_id"]).drop_duplicates("doc_id", keep=False).set_index("doc_id").lang
    both = own.index.intersection(known.index)
    assert (own[both] == known[both]).mean() > 0.95


def test_one_document_of_each_group_stays(stages):
    given, kept = stages["near_duplicates"]
    groups = brute_components(list(given.text), 5)
    assert len(kept) == len({g for _, g in groups})
    of_text = {t: g for t, (_, g) in zip(given.text, groups, strict=True)}
    assert len({of_text[t] for t in kept.text}) == len(kept)


def test_numbers_outlast_other_splits(spark, tmp_path, monkeypatch):
    """Files are split otherwise between the jobs of a stage, as where executors come or go."""
    texts = [f"{'same words in every copy of this text' if i % 2 else ' '.join(f'w{i}x{k}' for k in range(9))}" for i in range(200)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(8).write.parquet(f"{tmp_path}/d")
    key, found = "spark.sql.files.maxPartitionBytes", corpus_pipeline.neardup.components

    def elsewhere(*args, **named):
        out = store.cut(found(*args, **named), "found")
        spark.conf.set(key, "1k")
        return out

    monkeypatch.setattr(corpus_pipeline.neardup, "components", elsewhere)
    before = spark.conf.get(key)
    try:
        kept = corpus_pipeline.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/d"), "").toPandas()
    finally:
        spark.conf.set(key, before)
    assert sorted(kept.text) == sorted(set(texts))


def test_no_personal_data_is_left(stages):
    given, clean = stages["privacy"]
    assert len(given) == len(clean) and any(plain(t) for t in given.text)
    assert not any(plain(t) for t in clean.text)
    untouched = Counter(t for t in given.text if not plain(t))
    assert not untouched - Counter(clean.text)
    assert (clean.n_chars == clean.text.str.len()).all()


def test_sources_meet_their_targets(stages):
    given, mixed = stages["mixture"]
    size = lambda df: Counter({s if isinstance(s, str) else None: int(n) for s, n in df.assign(n=df.text.map(lambda t: len(t.encode().split()))).groupby("source", dropna=False).n.sum().items()})
    goal, taken = fill(size(given)), size(mixed)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)


def test_tokens_are_the_library_s(stages):
    import public_tokenizers
    import tiktoken

    given, coded = stages["tokens"]
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path(corpus_pipeline.RANKS)), special_tokens={})
    want = Counter(np.array(coder.encode_ordinary(t), "<u4").tobytes() for t in given.text)
    assert Counter(bytes(x) for x in coded.ids) == want


def test_empty_documents_pass_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_of_the_contract(spark, sf_dir):
    assert [f"op{n}" for n in range(1, 14)] == sorted({q.split("_")[0] for q in QUERIES}, key=lambda q: int(q[2:]))
    assert set(ORACLES) <= set(QUERIES)
    first = {
        "op1": "doc_id n_email n_ip n_card n_phone base_sha256 spans", "op2": "query_id rank vec_id score", "op3": "doc_id n_words n_removed kept_sha256", "op4": "doc_id size source_size target taken",
        "op5": "doc_id n_bytes n_tokens over_limit", "op6": "doc_id held_out lang_pred score", "op8": "doc_id n_tokens ids_sha256 decoded_sha256", "op9": "query_id rank vec_id score", "op10": "doc_id n_shingles component_id kept",
        "op11": "anchor_id positive_id rank negative_id positive_score negative_score", "op12": "doc_id piece start length ids_crc32 sequence_id offset",
        "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
    }
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "embeddings")}
    for name, build in QUERIES.items():
        op = name.split("_")[0]
        if op in first:
            out = build(spark, sf_dir)
            columns = first[op].split()
            assert out.columns[: len(columns)] == columns, name
            if op not in ("op2", "op9", "op11", "op12"):
                assert out.agg(F.count("*")).first()[0] == rows["documents"], name


def test_sql_agrees(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    for name, sql in ORACLES.items():
        out = QUERIES[name](spark, sf_dir)
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(out.columns)
        assert sorted(map(str, found.fetchall())) == sorted(str(tuple(r)) for r in out.select(*columns).collect())


def test_entry_works_without_the_subpackage():
    import subprocess

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op1_') for k in q) and len(q) > 400"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, timeout=120).returncode == 0

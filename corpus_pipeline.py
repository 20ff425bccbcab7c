"""From documents to token ids: language, near duplicates, personal data, source mixture, byte-level BPE.

Every stage takes the documents that the stage before it kept, as a Parquet table, and all but the last return the columns of
documents. Rows are told apart by their place in that table, so null and repeated ids do no harm. An empty table passes through
all stages as an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, language, mixing, neardup, privacy, store

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
RANKS = "byte_bpe_multi_50k.tiktoken"
#: rows of an Arrow batch: whole texts, in the JVM and in Python at once
BATCH_ROWS = 500
#: bytes of text whose words are made distinct together: smaller than the operator's own, beside the memory of other stages
BLOCK_BYTES = 3 << 20

#: tables of the stages of the run that goes on
_made: list[str] = []


def _stage(first: bool = False):
    """Deletes what earlier stages of the run left, as their results have been written, unless the documents still read it."""

    def wrap(build: Callable[[SparkSession, DataFrame, str], DataFrame]):
        @functools.wraps(build)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
            if not first:
                read = docs.inputFiles()
                store.drop_paths(spark, [p for p in _made if not any(p.split(":")[-1].lstrip("/") in f for f in read)])
            _made.clear()
            before = set(store.WRITTEN)
            out = build(spark, docs, sf_dir)
            _made.extend(p for p in store.WRITTEN if p not in before)
            return out

        return run_stage

    return wrap


@_stage(first=True)
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`lang` becomes the language recognised; texts in which none is (null, without letters) go."""
    found = language.identify(docs.select(*COLUMNS), language.samples(docs))
    return found.where(F.col("lang_pred") != language.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


@_stage()
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at a similarity of 0.8 or more stays."""
    # written with their numbers: computed anew, they would follow the splits of each job
    docs = store.cut(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    found = neardup.components(docs, size=5, percent=80, id_col="_row")
    gone = store.cut(found.where("NOT kept").select("_row"), "copies")
    return docs.join(gone, "_row", "left_anti").select(*COLUMNS)


@_stage()
def protect_privacy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced in the texts."""
    found = privacy.apply_spans(privacy.sanitise(docs.select(*COLUMNS)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage()
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are repeated for complete epochs, and sampled for the rest."""
    mixed = mixing.copies(mixing.mix(docs.select(*COLUMNS), carry=("text", "lang")))
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


@_stage()
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text (unsigned 32-bit little-endian), and digests of them and of the bytes that they decode to."""
    ranks = public_tokenizers.path(RANKS)
    found = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, block_bytes=BLOCK_BYTES), ranks)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("privacy", protect_privacy),
    ("mixture", mix_sources),
    ("tokens", tokenize),
]

#: no SQL for suffix automata, MinHash components or BPE; tests compare each stage with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = store.cut(docs, name)
            if i:
                store.drop(given)
            given = docs
    return docs

"""The registered queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import ann, bpe, fixity, language, manifest, mixing, neardup, negatives, packing, privacy, substrings, threshold, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_disclosing_terms")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = privacy.sanitise(table(spark, sf_dir, "documents"), keep=("doc_id",))
    base = F.filter("spans", lambda s: s.kind != privacy.TERM)
    counts = [privacy.of_kind("spans", kind).alias(f"n_{kind}") for kind in (*privacy.KINDS, privacy.TERM)]
    removed = F.size(F.filter("spans", lambda s: s.how == "remove")).cast("long").alias("n_term_removed")
    return found.select("doc_id", *counts[:-1], F.sha2(privacy.written(base), 256).alias("base_sha256"), privacy.written(F.col("spans")).alias("spans"), counts[-1], removed)


TOP_K_SQL = """
WITH kept AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM kept q JOIN kept c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10"""


@query("op2_threshold_top_k", TOP_K_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = threshold.quantised(table(spark, sf_dir, "embeddings"))
    return threshold.top_k(rows, rows.where("id % 100 = 0"), k=10).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op3_recompression")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_source_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_prefix_token_counts")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limits=(4096,))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 4096).alias("over_limit"), "fit_4096")


@query("op6_cross_parsing_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", "text"), language.samples(docs))
    return found.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score")


FIXITY_SQL = """
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, 'pages-' || lpad(CAST(page_id // 1024 AS VARCHAR), 9, '0') || '.warc' AS archive FROM pages),
r AS (SELECT *, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) AS head, chr(13) || chr(10) || chr(13) || chr(10) AS foot FROM p),
o AS (SELECT *, CAST(coalesce(sum(strlen(head || html || foot)) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM r)
SELECT archive, "offset", CAST(strlen(head || html || foot) AS BIGINT) AS length_a, CASE WHEN page_id % 97 = 1 THEN NULL ELSE CAST(strlen(head || '#' || substr(html, 2) || foot) AS BIGINT) END AS length_b,
  sha256(head || html || foot) AS digest_a, CASE WHEN page_id % 97 = 1 THEN NULL ELSE sha256(head || '#' || substr(html, 2) || foot) END AS digest_b, CASE WHEN page_id % 97 = 1 THEN 'missing' ELSE 'altered' END AS status
FROM o WHERE page_id % 97 = 1 OR page_id % 89 = 0 AND NOT starts_with(html, '#')"""


@query("op7_merkle_fixity", FIXITY_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives against a replica in which some records are overwritten at their first byte and some are lost."""
    packed = fixity.pack(table(spark, sf_dir, "pages")).select("page_id", "archive", "offset", "record")
    start = F.locate("\r\n\r\n", "record") + 4
    spoiled = F.concat(F.substring("record", 1, start - 1), F.lit("#"), F.substring("record", start + 1, F.length("record")))
    replica = packed.where("page_id % 97 <> 1").withColumn("record", F.when(F.col("page_id") % 89 == 0, spoiled).otherwise(F.col("record")))
    return fixity.audit(packed, replica)


@query("op8_byte_level_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_learned_partitions")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query("op10_minhash_components")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components(table(spark, sf_dir, "documents"), size=2, percent=80)


NEGATIVES_SQL = """
WITH kept AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, CAST(list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM kept q JOIN kept c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
positive AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS turn FROM scored WHERE same),
negative AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, n.vec_id AS negative_id, n.score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
  FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score WHERE p.turn <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 3"""


@query("op11_inverted_multi_index", NEGATIVES_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


@query("op12_best_fit_packing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), size=4096, end_id=1)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _up(tree: str, seed: str) -> str:
    """Recursive SQL: the levels of the trees whose leaves `seed` gives as (part, pos, stamp)."""
    return f"""{tree} AS (SELECT part, 0 AS level, pos, stamp, count(*) OVER (PARTITION BY part) AS n FROM ({seed})
  UNION ALL SELECT part, level + 1, pos // 8, sha256(string_agg(stamp, '' ORDER BY pos)), (n + 7) // 8 FROM {tree} WHERE n > 1 GROUP BY part, level, pos // 8, n)"""


def _steps(tree: str) -> str:
    """For every node but a tree's root the hashes before and after it among its siblings."""
    own = "PARTITION BY part, level, pos // 8 ORDER BY pos ROWS BETWEEN"
    return f"SELECT part, level, pos, coalesce(string_agg(stamp, '') OVER ({own} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b, coalesce(string_agg(stamp, '') OVER ({own} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {tree} WHERE n > 1"


#: crc32 is not among the engine's functions: the bitwise rule over the digits of the id
CRC32_SQL = "xor(list_reduce(list_prepend(4294967295, flatten([[ord(d), 0, 0, 0, 0, 0, 0, 0] for d in string_split(CAST(doc_id AS VARCHAR), '')])), lambda c, v: xor(xor(c, v) >> 1, 3988292384 * (xor(c, v) & 1))), 4294967295)"
_FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
MANIFEST_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS part, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {CRC32_SQL} % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS spoiled FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
{_up("low", "SELECT part, pos, leaf AS stamp FROM r")},
subs AS (SELECT part, stamp FROM low WHERE n = 1),
{_up("high", "SELECT 0 AS part, part AS pos, stamp FROM subs")},
top AS (SELECT stamp AS root FROM high WHERE n = 1),
steps AS (SELECT part, level, pos, b, a FROM ({_steps("low")}) UNION ALL SELECT -1, level, pos, b, a FROM ({_steps("high")})),
walk AS (SELECT row_number() OVER () AS i, doc_id, leaf, part, part AS name, pos, 0 AS level, '' AS proof, coalesce(spoiled, leaf) AS acc FROM r
  UNION ALL
  SELECT w.i, w.doc_id, w.leaf, CASE WHEN s.b IS NULL THEN -1 ELSE w.part END, w.name, CASE WHEN s.b IS NULL THEN w.name ELSE w.pos // 8 END, CASE WHEN s.b IS NULL THEN 0 ELSE w.level + 1 END,
    w.proof || coalesce(s.b || s.a, ''), CASE WHEN s.b IS NULL THEN w.acc ELSE sha256(s.b || w.acc || s.a) END
  FROM walk w LEFT JOIN steps s ON s.part = w.part AND s.level = w.level AND s.pos = w.pos WHERE s.b IS NOT NULL OR w.part >= 0)
SELECT doc_id, leaf, subs.stamp AS subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM walk JOIN subs ON subs.part = walk.name CROSS JOIN top
WHERE walk.part = -1 AND NOT EXISTS (SELECT 1 FROM steps s WHERE s.part = -1 AND s.level = walk.level AND s.pos = walk.pos)"""


@query("op13_merkle_manifest", MANIFEST_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, and what a copy in which some texts are lower-cased folds to."""
    docs = table(spark, sf_dir, "documents")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    spoiled = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, manifest.leaf_of([*head, lower]))
    rows = docs.select("doc_id", "lang", manifest.leaf_of([*head, F.col("text")]).alias("leaf"), spoiled.alias("spoiled"))
    found = manifest.manifest(rows, "doc_id", "lang", carry=("spoiled",))
    proof = manifest.digest(manifest.siblings(F.col("path"))).alias("proof_sha256")
    folded = manifest.fold(F.coalesce("spoiled", "leaf"), F.col("path")).alias("folded_root")
    return found.select("doc_id", "leaf", "subroot", "root", proof, folded).withColumn("verified", F.col("folded_root") == F.col("root"))

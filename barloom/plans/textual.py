"""Plans: text, transcripts, embeddings, strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.columns import cosine_distance
from barloom.functions.windows import Roll
from barloom.operators import text as op
from barloom.plans import duck as q
from barloom.plans.registry import plan

POS, NEG, RISK = ["tion", "the ", "and "], ["un", "er ", "nicht"], ["ing", "ent", "que"]
CL = {"a": ["THE", "AND"], "b": ["LE ", "QUE"], "c": ["UND", "NICHT"]}


def docs(t):
    return t.raw("documents").select("doc_id", "text", "lang", "source")


def has(x, w):
    return f"contains(lower({x}), '{w}')"


def cnt(x, ws):
    return "(" + " + ".join(f"{has(x, w)}::INT" for w in ws) + ")"


_ws = "len(list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '), lambda w__: w__ <> ''))"
q.cte("dw", f"SELECT doc_id, text, {_ws} AS n_words FROM documents")


@plan("text_cleaning", 374, "doc_id:i n_raw:i n_clean:i cleaned:s", "SELECT doc_id, length(text) AS n_raw, length(c) AS n_clean, c AS cleaned FROM (SELECT doc_id, text, regexp_replace(trim(regexp_replace(regexp_replace(text, 'http[^ \\t\\n\\x0B\\f\\r]+|www[^ \\t\\n\\x0B\\f\\r]+', '', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), '[^\\p{L}\\p{N}_ $%\\-+.]', ' ', 'g') AS c FROM documents)")
def _(t):
    d = docs(t).withColumn("cleaned", op.clean("text"))
    return d.withColumns({"n_raw": F.length("text"), "n_clean": F.length("cleaned")})


q.cte("lx", f"SELECT d.doc_id, {cnt('d.text', POS)} AS n_positive, {cnt('d.text', NEG)} AS n_negative, {cnt('d.text', RISK)} AS nr, n_words FROM documents d JOIN dw USING (doc_id)")


@plan(
    "lexicon_scores",
    377,
    "doc_id:i n_positive:i n_negative:i sentiment confidence risk_density",
    "SELECT *, CASE WHEN n_positive + n_negative > 0 THEN (n_positive - n_negative) / (n_positive + n_negative)::DOUBLE ELSE 0 END AS sentiment, least(1, (n_positive + n_negative) / 10.0) AS confidence, CASE WHEN n_words > 0 THEN least(1, nr / (n_words / 100.0)) ELSE 0 END AS risk_density FROM lx",
)
def _(t):
    return op.lexicon_scores(docs(t), "text", POS, NEG, RISK)


TERMS = ["tion", "ment", "the", "der", "que", "ing", "zzzz"]


@plan("keyword_extraction", 379, "doc_id:i found:s", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {has('text', w)} THEN '{w}' END" for w in TERMS) + "], lambda v__: v__ IS NOT NULL), ',') AS found FROM documents")
def _(t):
    return docs(t).withColumn("found", F.array_join(op.keywords("text", TERMS), ","))


@plan("keyword_counts", 94, "keyword:s n:i", " UNION ALL ".join(f"SELECT '{w}' AS keyword, count(*) AS n FROM documents WHERE {has('text', w)} HAVING count(*) > 0" for w in TERMS))
def _(t):
    return op.keyword_counts(docs(t), "text", TERMS)


_flag = lambda ws: "(" + " OR ".join(f"contains(upper(text), '{w}')" for w in ws) + ")::INT"


@plan("cluster_flags", 380, "doc_id:i cluster_a cluster_b cluster_c", "SELECT doc_id, " + ", ".join(f"{_flag(ws)} AS cluster_{k}" for k, ws in CL.items()) + " FROM documents")
def _(t):
    return op.cluster_flags(docs(t), "text", CL)


q.cte("nw", "SELECT doc_id, text, lang, source, TIMESTAMP '2024-01-01' + doc_id * INTERVAL 1 MINUTE AS ts, string_split(text, '.')[1] AS title FROM documents")


def news(t):
    return docs(t).withColumns({"ts": F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000), "title": F.split("text", "\\.")[0]})


@plan("article_dedupe", 350, "title_key:s copies:i doc_id:i", "SELECT lower(trim(title, ' ')) AS title_key, count(*) AS copies, min(doc_id) AS doc_id FROM nw GROUP BY 1")
def _(t):
    return op.dedupe_titles(news(t).select("doc_id", "title"), "title", F.col("doc_id"))


@plan(
    "news_ranking",
    338,
    "source:s doc_id:i rank:i",
    f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY date_trunc('minute', ts) DESC, abs({cnt('text', POS)} - {cnt('text', NEG)}) DESC, doc_id) AS rank FROM nw WHERE trim(title, ' ') <> ''",
)
def _(t):
    from pyspark.sql import Window

    d = news(t).where(F.trim("title") != "").withColumn("s", F.abs(op.mentions("text", POS) - op.mentions("text", NEG)))
    # one partition per (source, minute); positions inside it are offset by the counts of later minutes
    h = d.withColumn("slot", F.date_trunc("minute", "ts"))
    later = h.groupBy("source", "slot").agg(F.count("*").alias("n"))
    w = Window.partitionBy("source").orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)
    later = later.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    inside = Window.partitionBy("source", "slot").orderBy(F.desc("s"), "doc_id")
    return h.withColumn("k", F.row_number().over(inside)).join(later, ["source", "slot"]).withColumn("rank", F.col("base") + F.col("k"))


@plan(
    "headlines_per_day",
    78,
    "source:s day:d part:i n:i headlines:s",
    "SELECT source, day, part, count(*) AS n, string_agg(trim(title, ' '), ' | ' ORDER BY pos) AS headlines FROM (SELECT *, pos // 100 AS part FROM (SELECT source, ts::DATE AS day, title, row_number() OVER (PARTITION BY source, ts::DATE ORDER BY ts, doc_id) - 1 AS pos FROM nw WHERE trim(title, ' ') <> '')) GROUP BY 1, 2, 3",
)
def _(t):
    d = news(t).withColumns({"day": F.to_date("ts"), "id": F.col("doc_id")})
    return op.headlines_per_day(d, "title", "day", ("source",), 100)


@plan("tone_summary", 95, "lang:s source:s n:i mean_tone", f"SELECT lang, source, count(*) AS n, avg({cnt('text', POS)} - {cnt('text', NEG)}) AS mean_tone FROM documents GROUP BY GROUPING SETS ((lang), (source), (lang, source))")
def _(t):
    d = docs(t).withColumn("tone", op.mentions("text", POS) - op.mentions("text", NEG))
    return d.groupingSets([["lang"], ["source"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("n"), F.avg("tone").alias("mean_tone"))


q.cte("ck0", "SELECT doc_id, list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), ' '), lambda w__: w__ <> '') AS ws FROM documents")
q.cte("ck1", "SELECT doc_id, ws, unnest(generate_series(0, greatest(0, ceil((len(ws) - 64) / 48.0) * 48)::INT, 48)) AS s FROM ck0 WHERE len(ws) > 0")


@plan("token_chunks", 381, "doc_id:i chunk:i n_tokens:i digest:s", "SELECT doc_id, (s // 48) AS chunk, len(ws[s + 1:s + 64]) AS n_tokens, md5(array_to_string(ws[s + 1:s + 64], ' ')) AS digest FROM ck1")
def _(t):
    d = op.chunks(docs(t).select("doc_id", "text"), "text", 64, 16)
    return d.withColumns({"n_tokens": F.size(F.split("chunk_text", " ")), "digest": F.md5("chunk_text")})


# ---- transcripts ----------------------------------------------------------------------------------------------------
q.cte("turns", "SELECT conv_id * 1000 + turn AS id, role, CASE role WHEN 'user' THEN 'Anna Analyst, question: ' ELSE 'Bob CFO: ' END || replace(text, ':', ' ') AS text FROM conversations")


def turns(t):
    c = t.raw("conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", F.concat(F.when(F.col("role") == "user", "Anna Analyst, question: ").otherwise("Bob CFO: "), F.replace("text", F.lit(":"), F.lit(" "))).alias("text"))


q.cte("seg0", "SELECT id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM turns")
q.cte("seg1", "SELECT id, trim(line, ' ') AS line, pos FROM seg0 WHERE trim(line, ' ') <> ''")
q.cte("seg2", "SELECT *, contains(line, ':') AND (contains(lower(line), 'cfo') OR contains(lower(line), 'analyst')) AS sp FROM seg1")
q.cte("seg3", "SELECT *, sum(sp::INT) OVER (PARTITION BY id ORDER BY pos) AS segment FROM seg2")
q.cte("seg4", "SELECT id, segment, max(CASE WHEN sp THEN trim(string_split(line, ':')[1], ' ') END) AS speaker, trim(string_agg(CASE WHEN sp THEN trim(substr(line, strpos(line, ':') + 1), ' ') ELSE line END, ' ' ORDER BY pos), ' ') AS content FROM seg3 WHERE segment > 0 GROUP BY 1, 2")


@plan("transcript_segments", 375, "id:i segment:i speaker:s content:s", "SELECT * FROM seg4 WHERE content <> ''")
def _(t):
    return op.speaker_segments(turns(t), "text", "id", ["cfo", "ceo", "analyst", "question"])


q.cte("sec0", "SELECT conv_id * 1000 + turn AS id, text || CASE WHEN turn % 2 = 1 THEN ' Operator: and now the first question ' || role ELSE '' END AS text FROM conversations")
q.cte("sec1", "SELECT id, text, list_min(list_filter([" + ", ".join(f"strpos(lower(text), '{m}')" for m in ("question-and-answer", "question and answer", "q&a session", "operator:", "first question", "questions and answers", "qa session", "now open for questions")) + "], lambda p__: p__ > 0)) AS cut_at FROM sec0")


@plan("transcript_sections", 376, "id:i prepared:s qa:s", "SELECT id, trim(CASE WHEN cut_at IS NULL THEN text ELSE substr(text, 1, cut_at - 1) END, ' ') AS prepared, trim(CASE WHEN cut_at IS NULL THEN '' ELSE substr(text, cut_at) END, ' ') AS qa FROM sec1")
def _(t):
    c = t.raw("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat("text", F.when(F.col("turn") % 2 == 1, F.concat(F.lit(" Operator: and now the first question "), F.col("role"))).otherwise("")).alias("text"))
    return op.split_sections(c, "text")


q.cte("gd", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'we see ' || (o_custkey % 9) || '-' || (o_custkey % 9 + 2) || '% growth' WHEN 1 THEN 'Between ' || (o_custkey % 7) || '.5% and ' || (o_custkey % 7 + 1) || '% next year' WHEN 2 THEN 'about ' || (o_custkey % 30) || '% of sales' ELSE 'no number' END AS text FROM orders")


@plan(
    "numeric_guidance",
    378,
    "id:i low high",
    "SELECT id, coalesce(try_cast(regexp_extract(text, '(\\d+(?:\\.\\d+)?)-(\\d+(?:\\.\\d+)?)%', 1) AS DOUBLE), try_cast(regexp_extract(text, '(?i)between (\\d+(?:\\.\\d+)?)% and (\\d+(?:\\.\\d+)?)%', 1) AS DOUBLE), try_cast(regexp_extract(text, '(\\d+(?:\\.\\d+)?)%', 1) AS DOUBLE)) AS low, "
    "coalesce(try_cast(regexp_extract(text, '(\\d+(?:\\.\\d+)?)-(\\d+(?:\\.\\d+)?)%', 2) AS DOUBLE), try_cast(regexp_extract(text, '(?i)between (\\d+(?:\\.\\d+)?)% and (\\d+(?:\\.\\d+)?)%', 2) AS DOUBLE), try_cast(regexp_extract(text, '(\\d+(?:\\.\\d+)?)%', 1) AS DOUBLE)) AS high FROM gd",
)
def _(t):
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    s = lambda x: x.cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("we see "), s(c % 9), F.lit("-"), s(c % 9 + 2), F.lit("% growth")))
        .when(k == 1, F.concat(F.lit("Between "), s(c % 7), F.lit(".5% and "), s(c % 7 + 1), F.lit("% next year")))
        .when(k == 2, F.concat(F.lit("about "), s(c % 30), F.lit("% of sales")))
        .otherwise("no number")
    )
    return op.numeric_guidance(t.raw("orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), "text")


# ---- strings ----------------------------------------------------------------------------------------------------------
@plan("split_ratio_parse", 370, "partkey:i ratio", "SELECT p_partkey AS partkey, CASE p_partkey % 5 WHEN 0 THEN p_size / 2.0::DOUBLE WHEN 1 THEN p_size / 3.0::DOUBLE WHEN 2 THEN p_size / 4.0::DOUBLE WHEN 3 THEN p_size + 0.5::DOUBLE END AS ratio FROM part")
def _(t):
    k, s = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    raw = F.when(k == 0, F.concat(s, F.lit("/2"))).when(k == 1, F.concat(s, F.lit(" : 3"))).when(k == 2, F.concat(s, F.lit(" FOR 4"))).when(k == 3, F.concat(s, F.lit(".5"))).otherwise("none")
    return t.raw("part").select(F.col("p_partkey").alias("partkey"), op.split_ratio(raw).alias("ratio"))


@plan("quarter_labels", 385, "orderkey:i start:d", "SELECT o_orderkey AS orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE date_trunc('quarter', o_orderdate)::DATE END AS start FROM orders")
def _(t):
    d = F.col("o_orderdate").cast("date")
    y, n = F.year(d).cast("string"), F.quarter(d).cast("string")
    label = F.when(F.col("o_custkey") % 5 == 0, "FY").when(F.col("o_custkey") % 2 == 0, F.concat(F.lit(" q"), n, F.lit(" "), y)).otherwise(F.concat(y, F.lit("-Q"), n))
    return t.raw("orders").select(F.col("o_orderkey").alias("orderkey"), op.quarter_start(label).alias("start"))


@plan("jurisdiction_normalisation", 382, "suppkey:i jurisdiction:s", "SELECT s_suppkey AS suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'United States' WHEN 1 THEN 'US-New York' WHEN 2 THEN 'Nation_' || s_nationkey WHEN 3 THEN 'Cayman Islands' ELSE 'Guinea-Bissau (O''X/' || s_nationkey || 'Th)' END AS jurisdiction FROM supplier")
def _(t):
    k = F.col("s_suppkey") % 5
    raw = F.when(k == 0, " usa").when(k == 1, "NEW YORK ").when(k == 2, F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"))).when(k == 3, "cayman islands").otherwise(F.concat(F.lit("GUINEA-bissau (o'x/"), F.col("s_nationkey").cast("string"), F.lit("th)")))
    return t.raw("supplier").select(F.col("s_suppkey").alias("suppkey"), op.jurisdiction(raw).alias("jurisdiction"))


@plan("symbol_normalisation", 383, "raw_key:i symbol", "SELECT s_suppkey AS raw_key, upper(trim(' ' || s_name || ' ')) AS symbol FROM supplier")
def _(t):
    return t.raw("supplier").select(F.col("s_suppkey").alias("raw_key"), F.upper(F.trim(F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")))).alias("symbol"))


@plan("event_text_build", 394, "event_id:i text:s", "SELECT event_id, concat_ws(' ', CASE WHEN user_id % 3 > 0 THEN 'user' || user_id END, event_type, props) AS text FROM events")
def _(t):
    e = t.raw("events").withColumn("who", F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("user"), F.col("user_id"))).otherwise(" "))
    return e.select("event_id", op.event_text(["who", "event_type", "props"]).alias("text"))


# ---- embeddings ---------------------------------------------------------------------------------------------------------
q.cte("ev", "SELECT vec_id, embedding, label, DATE '2020-01-01' + (vec_id // 5)::INT AS date, 1 + vec_id % 4 AS w FROM embeddings")
q.cte("ev_long", "SELECT vec_id, label, date, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS pos FROM ev")
q.cte("cent", "SELECT pos, avg(v) AS c FROM ev_long GROUP BY 1")
q.cte("cent_c", "SELECT label, pos, avg(v) AS c FROM ev_long GROUP BY 1, 2")


def vectors(t):
    e = t.raw("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), "label")
    return e.withColumns({"date": F.date_add(F.lit("2020-01-01").cast("date"), F.floor(F.col("vec_id") / 5).cast("int")), "w": 1 + F.col("vec_id") % 4, "one": F.lit(0)})


@plan("baseline_centroid", 120, "label:i pos:i c", "SELECT label, pos, c FROM cent_c")
def _(t):
    c = op.centroids(vectors(t), "embedding", "label")
    return c.select("label", F.posexplode("centroid").alias("p", "c")).withColumn("pos", F.col("p") + 1)


q.cte("dist", "SELECT e.vec_id, 1 - sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) AS d FROM ev_long e JOIN cent USING (pos) GROUP BY 1")
q.cte("nov0", "SELECT date, sum(d * w) / (sum(w) + 1e-9) AS novelty, count(*) AS num_events FROM ev JOIN dist USING (vec_id) GROUP BY date")


@plan(
    "cosine_distance",
    393,
    "vec_id:i distance",
    "SELECT vec_id, d AS distance FROM dist",
)
def _(t):
    v = vectors(t)
    base = op.centroids(v, "embedding", None)
    return v.join(F.broadcast(base)).withColumn("distance", cosine_distance(F.col("embedding"), F.col("centroid")))


@plan("novelty", 121, "date novelty num_events:i novelty_7d novelty_30d", "SELECT *, avg(novelty) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS novelty_7d, avg(novelty) OVER (ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS novelty_30d FROM nov0")
def _(t):
    v = vectors(t)
    return op.novelty(v, "embedding", "w", op.centroids(v, "embedding", None), Roll("one", "date"))


@plan("cluster_novelty", 121, "date label:i novelty n:i", "SELECT date, label, avg(d) AS novelty, count(*) AS n FROM (SELECT e.vec_id, e.label, e.date, 1 - sum(v * c) / (sqrt(sum(v * v)) * sqrt(sum(c * c))) AS d FROM ev_long e JOIN cent_c USING (label, pos) GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(t):
    v = vectors(t)
    return op.cluster_novelty(v, "embedding", "label", op.centroids(v, "embedding", "label"))


@plan("symbol_relevance", 122, "day:d relevance n:i", f"SELECT ts::DATE AS day, avg(0.4 * ({cnt('text', ['tion', 'que'])} > 0)::INT + 0.15 + 0.2 * {_flag(CL['a'])}) AS relevance, count(*) AS n FROM nw GROUP BY 1")
def _(t):
    d = op.cluster_flags(news(t), "text", CL).withColumn("day", F.to_date("ts"))
    return op.relevance(d, "text", ["tion", "que"], "cluster_a", keys=("day",))


@plan(
    "stratified_sample",
    119,
    "month:d label:i vec_id:i",
    "SELECT month, label, vec_id FROM (SELECT date_trunc('month', date)::DATE AS month, label, vec_id, row_number() OVER (PARTITION BY date_trunc('month', date), label ORDER BY md5(vec_id || '|s'), vec_id) AS k FROM ev) WHERE k <= 5",
)
def _(t):
    v = vectors(t).select("vec_id", "label", F.trunc("date", "month").alias("month"))
    return op.stratified_sample(v, ["month", "label"], "vec_id", 5)

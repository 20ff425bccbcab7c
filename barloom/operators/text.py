"""Text and embedding operators. Whole texts only; per-row work stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import col, cosine_distance, flag
from barloom.functions.windows import Roll


def clean(x) -> Column:
    """Links removed, white space collapsed, symbols other than $ % - + . blanked."""
    t = F.regexp_replace(col(x), r"http\S+|www\S+", "")
    t = F.trim(F.regexp_replace(t, r"\s+", " "))
    return F.regexp_replace(t, r"[^\p{L}\p{N}_\s$%\-+.]", " ")


def words(x) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(F.trim(F.regexp_replace(col(x), r"\s+", " ")), " "), lambda w: w != "")


def mentions(x, terms: list[str]) -> Column:
    """How many of the terms occur in the lower-cased text."""
    low = F.lower(col(x))
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0))


def density_per_100(x, terms: list[str]) -> Column:
    """Term mentions per hundred words, capped at one."""
    n = F.size(words(x))
    return F.when(n > 0, F.least(F.lit(1.0), mentions(x, terms) / (n / 100.0))).otherwise(0.0)


def lexicon_scores(df: DataFrame, x: str, positive: list[str], negative: list[str], risk: list[str]) -> DataFrame:
    """Balance of positive and negative terms, confidence by number of hits, risk density."""
    p, n = mentions(x, positive), mentions(x, negative)
    d = df.withColumns({"n_positive": p, "n_negative": n, "risk_density": density_per_100(x, risk)})
    hits = F.col("n_positive") + F.col("n_negative")
    return d.withColumns(
        {"sentiment": F.when(hits > 0, (F.col("n_positive") - F.col("n_negative")) / hits).otherwise(0.0), "confidence": F.least(F.lit(1.0), hits / 10.0)}
    )


def keywords(x, terms: list[str]) -> Column:
    """The terms that occur in the text, in term order."""
    low = F.lower(col(x))
    return F.filter(F.array(*[F.when(low.contains(t), F.lit(t)) for t in terms]), lambda v: v.isNotNull())


def cluster_flags(df: DataFrame, x: str, clusters: dict[str, list[str]]) -> DataFrame:
    up = F.upper(col(x))
    out = {}
    for name, terms in clusters.items():
        hit = F.lit(False)
        for t in terms:
            hit = hit | up.contains(t.upper())
        out[f"cluster_{name}"] = flag(hit)
    return df.withColumns(out)


# fixed values: phrases that open the question section of a call
QA_MARKERS = ("question-and-answer", "question and answer", "q&a session", "operator\n", "operator:", "first question", "our first question", "questions and answers", "qa session", "now open for questions")


def split_sections(df: DataFrame, x: str, markers=QA_MARKERS) -> DataFrame:
    """Prepared remarks and questions, cut at the earliest marker; without one everything is prepared."""
    low = F.lower(col(x))
    at = F.array_min(F.filter(F.array(*[F.locate(m, low) for m in markers]), lambda p: p > 0))
    d = df.withColumn("__at", at)
    return d.withColumns(
        {
            "prepared": F.trim(F.when(F.col("__at").isNull(), col(x)).otherwise(F.expr(f"substring({x}, 1, __at - 1)"))),
            "qa": F.trim(F.when(F.col("__at").isNull(), "").otherwise(F.expr(f"substring({x}, __at)"))),
        }
    ).drop("__at")


def speaker_segments(df: DataFrame, x: str, key: str, titles: list[str]) -> DataFrame:
    """Segments of a transcript by speaker line ("Name, title: words"); lines before the first speaker are dropped.

    A window partition holds the lines of one transcript, which arrived as a single row.
    """
    lines = F.filter(F.transform(F.split(x, "\n"), lambda v: F.trim(v)), lambda v: v != "")
    hit = lambda v: v.contains(":") & F.exists(F.array(*[F.lit(t) for t in titles]), lambda t: F.lower(v).contains(t))
    d = df.select(key, F.posexplode(lines).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("is_speaker", hit(F.col("line"))).withColumn("segment", F.sum(F.col("is_speaker").cast("int")).over(w)).where(F.col("segment") > 0)
    body = F.when(F.col("is_speaker"), F.trim(F.expr("substring(line, locate(':', line) + 1)"))).otherwise(F.col("line"))
    g = d.groupBy(key, "segment").agg(
        F.max(F.when(F.col("is_speaker"), F.trim(F.substring_index("line", ":", 1)))).alias("speaker"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", body.alias("t")))), lambda s: s["t"]), " ").alias("content"),
    )
    return g.withColumn("content", F.trim("content")).where(F.col("content") != "")


def numeric_guidance(df: DataFrame, x: str) -> DataFrame:
    """First percentage range ("3-5%", "between 3% and 5%"), else the first single percentage as both ends."""
    a = r"(\d+(?:\.\d+)?)[-–](\d+(?:\.\d+)?)%"
    b = r"(?i)between (\d+(?:\.\d+)?)% and (\d+(?:\.\d+)?)%"
    one = r"(\d+(?:\.\d+)?)%"
    num = lambda pat, i: F.regexp_extract(x, pat, i).try_cast("double")
    return df.withColumns({"low": F.coalesce(num(a, 1), num(b, 1), num(one, 1)), "high": F.coalesce(num(a, 2), num(b, 2), num(one, 1))})


def chunks(df: DataFrame, x: str, size: int, overlap: int) -> DataFrame:
    """Overlapping token windows over the whole text; the last window may be shorter, none starts past the end."""
    step = size - overlap
    d = df.withColumn("__w", words(x))
    n = F.size("__w")
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))) * step).cast("int")
    d = d.where(n > 0).withColumn("__s", F.sequence(F.lit(0), last, F.lit(step)))
    d = d.withColumn("__c", F.transform("__s", lambda s: F.array_join(F.slice(F.col("__w"), s + 1, F.lit(size)), " ")))
    keep = [c for c in df.columns if c != x]
    # an inner explode would add a filter that splits the text anew for every window; the outer one adds none
    return d.select(*keep, F.posexplode_outer("__c").alias("chunk", "chunk_text")).where(F.col("chunk_text").isNotNull())


def headlines_per_day(df: DataFrame, title: str, date: str, keys=("symbol",), per_bucket: int = 256) -> DataFrame:
    """Headlines of a day as ordered text parts of at most `per_bucket` headlines.

    A day may hold a third of all news, so it is never one string: rows are placed second by second, and a day becomes
    as many parts as it needs, each in order.
    """
    d = df.where(F.trim(title) != "").withColumn("__b", F.unix_timestamp("ts"))
    n = d.groupBy(*keys, date, "__b").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys, date).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    n = n.withColumn("__base", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, date, "__b").orderBy("ts", "id")
    d = d.withColumn("__i", F.row_number().over(inside)).join(n, [*keys, date, "__b"])
    d = d.withColumn("pos", F.col("__base") + F.col("__i") - 1).withColumn("part", F.floor(F.col("pos") / per_bucket))
    g = d.groupBy(*keys, date, "part").agg(F.sort_array(F.collect_list(F.struct("pos", F.trim(title).alias("t")))).alias("__x"), F.count("*").alias("n"))
    return g.withColumn("headlines", F.array_join(F.transform("__x", lambda s: s["t"]), " | ")).drop("__x")


def keyword_counts(df: DataFrame, x: str, terms: list[str]) -> DataFrame:
    """Number of texts each term occurs in; texts are reduced to their matched terms before the shuffle."""
    return df.select(F.explode(keywords(x, terms)).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def dedupe_titles(df: DataFrame, title: str, order) -> DataFrame:
    """First row per lower-trimmed title, combined map-side (a title copied a million times is one row per task)."""
    rest = [c for c in df.columns]
    d = df.withColumn("title_key", F.lower(F.trim(title)))
    return d.groupBy("title_key").agg(F.min_by(F.struct(*rest), order).alias("__r"), F.count("*").alias("copies")).select("title_key", "copies", "__r.*")


def event_text(columns: list[str], sep: str = " ") -> Column:
    """Text built from the non-empty columns in order."""
    return F.concat_ws(sep, *[F.when(F.trim(F.col(c).cast("string")) != "", F.trim(F.col(c).cast("string"))) for c in columns])


# ---- embeddings -----------------------------------------------------------------------------------------------------
def stratified_sample(df: DataFrame, strata: list[str], key: str, k: int) -> DataFrame:
    """Up to k rows per stratum by hash order, repeatable and independent of task order.

    Rows are first thinned to those whose hash can be among the k smallest of their task group, so a stratum with a third
    of the data sends at most 64k rows to the ranking.
    """
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit("s")))
    d = df.withColumn("__h", h).withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(64)))
    pre = d.withColumn("__r", F.row_number().over(Window.partitionBy(*strata, "__salt").orderBy("__h", key))).where(F.col("__r") <= k)
    w = Window.partitionBy(*strata).orderBy("__h", key)
    return pre.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__h", "__salt", "__r")


def centroids(df: DataFrame, vector: str, cluster: str | None) -> DataFrame:
    """Mean vector, globally or per cluster: partial averages per position, then one short array per cluster."""
    keys = [cluster] if cluster else []
    d = df.select(*keys, F.posexplode(vector).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return d.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("centroid"))


def novelty(df: DataFrame, vector: str, weight: str, base: DataFrame, r: Roll) -> DataFrame:
    """Weighted mean cosine distance to the baseline centroid per date, with 7- and 30-row means."""
    d = df.join(F.broadcast(base)).withColumn("__d", cosine_distance(F.col(vector), F.col("centroid")))  # the baseline is one row
    g = d.groupBy(*r.keys, "date").agg((F.sum(F.col("__d") * F.col(weight)) / (F.sum(weight) + 1e-9)).alias("novelty"), F.count("*").alias("num_events"))
    return g.withColumns({"novelty_7d": r.mean("novelty", 7, 1), "novelty_30d": r.mean("novelty", 30, 1)})


def cluster_novelty(df: DataFrame, vector: str, cluster: str, base: DataFrame) -> DataFrame:
    """Mean distance to the cluster's own centroid per (date, cluster)."""
    d = df.join(base, cluster).withColumn("__d", cosine_distance(F.col(vector), F.col("centroid")))
    return d.groupBy("date", cluster).agg(F.avg("__d").alias("novelty"), F.count("*").alias("n"))


def relevance(df: DataFrame, x: str, themes: list[str], sector_flag: str, country_match: float = 0.5, semantic: float = 0.0, keys=("date",)) -> DataFrame:
    """Mean of 0.4 theme + 0.3 country + 0.2 sector + 0.1 semantic match per date."""
    theme = flag(mentions(x, [t.lower() for t in themes]) > 0)
    score = 0.4 * theme + 0.3 * country_match + 0.2 * F.col(sector_flag) + 0.1 * semantic
    return df.groupBy(*keys).agg(F.avg(score).alias("relevance"), F.count("*").alias("n"))


# fixed values: jurisdiction aliases
JURISDICTIONS = {
    "Delaware": "US-Delaware", "California": "US-California", "New York": "US-New York", "Nevada": "US-Nevada", "United States": "United States", "Usa": "United States",
    "Us": "United States", "Cayman Islands": "Cayman Islands", "British Virgin Islands": "British Virgin Islands", "Ireland": "Ireland", "Luxembourg": "Luxembourg",
}


def jurisdiction(x, aliases=JURISDICTIONS) -> Column:
    """Title case (a capital after every character that is no letter), then the alias."""
    runs = F.regexp_extract_all(F.trim(col(x)), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    t = F.array_join(F.transform(runs, F.initcap), "")
    table = F.create_map(*[v for k, a in aliases.items() for v in (F.lit(k), F.lit(a))])
    return F.coalesce(F.element_at(table, t), t)


def split_ratio(x) -> Column:
    """"4/1", "2:1", "3 for 2" or a plain number as new shares per old share."""
    t = F.lower(F.trim(col(x)))
    a = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*(?:/|:|for)\s*(\d+(?:\.\d+)?)$", 1).try_cast("double")
    b = F.regexp_extract(t, r"^(\d+(?:\.\d+)?)\s*(?:/|:|for)\s*(\d+(?:\.\d+)?)$", 2).try_cast("double")
    plain = t.try_cast("double")
    return F.coalesce(F.when(b > 0, a / b), F.when(plain > 0, plain))


def quarter_start(label) -> Column:
    """"2024Q3", "Q3 2024" or "2024-Q3" as the first day of the quarter."""
    t = F.upper(F.trim(col(label)))
    y = F.coalesce(F.regexp_extract(t, r"(\d{4})", 1).try_cast("int"))
    n = F.regexp_extract(t, r"Q([1-4])", 1).try_cast("int")
    return F.when(y.isNotNull() & n.isNotNull(), F.make_date(y, (n - 1) * 3 + 1, F.lit(1)))

"""Mixing sources to target weights by weighted sampling without replacement.

Each source has a budget of words. As many complete epochs as fit are taken whole; the rest of the budget is a sample in the
order of exponential keys -ln(u) / w (u: a hash of the document, w: its quality), prefix-summed to the budget. The document in
which the budget ends is taken in part, its first words, so a source meets its budget to a word.

No source is sorted as a whole, as one may hold a third of all rows: keys fall into ranges, sizes are summed by range, and only
the range in which the budget ends is looked at again, in finer ranges, and at last row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.store import cut

#: fixed values: weights of the sources in the order of their names, repeating
CYCLE = (5, 2, 1)
#: ranges of keys at each level, even in ln(key): whatever the weights, the last one holds at most about a 1.4-billionth of a source
RANGES, LEVELS = 4096, 3
#: separators of words
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs of `[^\\x20\\x09-\\x0D]`; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def quality(text: Column) -> Column:
    """A weight from 0.05 to 1: the share of letters and blanks in the text's characters, less for very short texts."""
    clean = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    share = clean / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), share * F.least(F.lit(1.0), F.length(text) / 200)), F.lit(0.05))


def order_key(seed: int, weight: Column, *identity: Column) -> Column:
    """-ln(u) / w with u in (0, 1) from a hash, so that reruns and retried tasks agree."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *identity), 11)
    return -F.log((bits + 0.5) / float(1 << 53)) / weight


def targets(sizes: DataFrame, share: float = 1.5, most_epochs: int = 2) -> DataFrame:
    """source, source_size -> also target: `share` of all words dealt by weight, at most `most_epochs` times a source's size,
    what is above dealt again by weight among the others. That ends where target = min(cap, level * weight) for one level, the
    same for all, found from running sums over the sources in the order of cap / weight. One row per source."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy(F.lit(0))
    cycle = F.array(*[F.lit(float(w)) for w in CYCLE])
    weighed = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(CYCLE) + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most_epochs))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    # the first source whose cap is above the level its remaining fellows would get; all later ones get that level too
    levelled = weighed.withColumn("level", F.when(F.col("cap") >= level * F.col("weight"), level))
    common = F.first("level", ignorenulls=True).over(by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levelled.select("source", "source_size", F.least("cap", F.coalesce(common * F.col("weight"), F.col("cap"))).alias("target"))


def _range(key: Column, level: int) -> Column:
    """Number of the range of a key at a level, counted within the range above; grows with the key."""
    # in [0, 1), in the keys' order; a key of 0 has no logarithm and is first
    place = F.least(F.lit(1 - 2.0**-53), F.greatest(F.lit(0.0), (F.log(key) + 64) / 128))
    for _ in range(level):
        place = place * RANGES - F.floor(place * RANGES)
    return F.floor(place * RANGES).cast("int")


def mix(docs: DataFrame, share: float = 1.5, most_epochs: int = 2, seed: int = 11, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", weight: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """id, size, source, source_size, target, taken (words, repeats counted), epochs, part (words of the fractional epoch), and
    the columns named in `carry`, for every row of `docs`.

    A null text has size 0 and is taken 0 times over; a null source is a source of its own, last in order. Rows that repeat
    are rows of their own. Rows with the same key are ordered by id and text hash; rows equal in that too are interchangeable.
    Equal input gives equal output. An empty table gives an empty result.
    """
    text = F.col(text_col).cast("string")
    if weight is None:
        weight = quality(text)
    key = order_key(seed, weight, F.col(id_col), text)
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), word_count(text).alias("_size"), key.alias("_key"), F.xxhash64(text).alias("_tie"), *[F.col(c).alias(f"_c_{c}") for c in carry])
    slim = cut(slim, "sizes")
    goals = targets(slim.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size")), share, most_epochs)
    whole = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(most_epochs)).cast("long")
    goals = goals.withColumn("epochs", whole).withColumn("budget", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    goals = cut(goals, "goals")

    # where each source's budget ends: a range, then a range in that, with the words before it
    ends = goals.select("source", F.lit(0).cast("long").alias("before"), "budget")
    inside = slim.where("_size > 0")
    for level in range(LEVELS):
        name = f"at_{level}"
        kept = ["source", *[f"at_{k}" for k in range(level)]]
        rows = inside.join(ends.select(F.col("source").alias("s"), *[F.col(c).alias(f"w_{c}") for c in kept[1:]]), F.col("_source").eqNullSafe(F.col("s")))
        for k in range(level):
            rows = rows.where(_range(F.col("_key"), k) == F.col(f"w_at_{k}"))
        sums = rows.groupBy(F.col("_source").alias("s"), _range(F.col("_key"), level).alias(name)).agg(F.sum("_size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("s").orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow))
        sums = sums.withColumn("upto", run).withColumn("b", F.col("upto") - F.col("words"))
        joined = ends.join(sums.select("s", name, "b", "upto"), F.col("source").eqNullSafe(F.col("s")))
        hit = joined.where((F.col("before") + F.col("b") <= F.col("budget")) & (F.col("before") + F.col("upto") > F.col("budget")))
        ends = cut(hit.select("source", *kept[1:], name, (F.col("before") + F.col("b")).alias("before"), "budget"), "ends")

    placed = slim.join(goals.select(F.col("source").alias("s"), "source_size", "target", "epochs", "budget"), F.col("_source").eqNullSafe(F.col("s"))).drop("s")
    placed = placed.join(ends.select(F.col("source").alias("s"), *[f"at_{k}" for k in range(LEVELS)], "before"), F.col("_source").eqNullSafe(F.col("s")), "left").drop("s")
    mine = F.struct(*[_range(F.col("_key"), k).alias(f"r{k}") for k in range(LEVELS)])
    end = F.struct(*[F.col(f"at_{k}").alias(f"r{k}") for k in range(LEVELS)])
    placed = placed.withColumn("_mine", mine).withColumn("_end", end)
    at_end = (F.col("_size") > 0) & F.col("at_0").isNotNull() & (F.col("_mine") == F.col("_end"))
    # without an end the budget is 0 or takes everything
    all_ = F.when(F.col("at_0").isNull(), F.when(F.col("budget") > 0, F.col("_size")).otherwise(F.lit(0).cast("long"))).when(F.col("_mine") < F.col("_end"), F.col("_size")).otherwise(F.lit(0).cast("long"))
    far = placed.where(~F.coalesce(at_end, F.lit(False))).withColumn("part", all_)
    near = placed.where(F.coalesce(at_end, F.lit(False)))
    order = Window.partitionBy("_source").orderBy("_key", F.col("_id").asc_nulls_last(), "_tie")
    upto = F.col("before") + F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    near = near.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("_size", F.col("budget") - upto)))
    out = far.unionByName(near)
    taken = F.col("epochs") * F.col("_size") + F.col("part")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source").alias(source_col), "source_size", "target", taken.alias("taken"), "epochs", "part", *[F.col(f"_c_{c}").alias(c) for c in carry if c not in (id_col, source_col)])


def copies(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The mix itself: a row for each complete epoch and one, cut after its last word taken, for the fractional one. Documents
    that are not taken go; a text without words goes too."""
    words = F.filter(F.split(F.col(text_col), SPACE), lambda w: w != "")
    share = F.when(F.col("part") >= F.col("size"), F.col(text_col)).otherwise(F.array_join(F.slice(words, 1, F.col("part").cast("int")), " "))
    whole = F.transform(F.sequence(F.lit(1), F.col("epochs").cast("int")), lambda _: F.col(text_col))
    texts = F.concat(F.when(F.col("epochs") > 0, whole).otherwise(F.array().cast("array<string>")), F.when(F.col("part") > 0, F.array(share)).otherwise(F.array().cast("array<string>")))
    return mixed.where("size > 0").withColumn("_texts", texts).withColumn(text_col, F.explode("_texts")).drop("_texts")

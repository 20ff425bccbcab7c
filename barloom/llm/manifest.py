"""A Merkle manifest of a dataset: a hash per row, a tree per part, a root over the parts, and a proof for every row.

Rows of a part stand in the order of their ids. The place of a row in octal digits says where it hangs: the last digit is its
place in a run of FANOUT siblings, the one before the place of that run, and so on. Rolling up groups the digits away one by one,
and every node keeps its children as nested structs, so that a block of FANOUT ** DEPTH rows becomes one row that holds its whole
subtree. The roots of blocks are the rows of the next round. On the way down a block is opened by `transform`, which gives each
child the hashes before and after it, and `explode`; a block meets its own path in a grouping, and no join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.llm.store import cut, drop

#: children of a node, and levels that one block holds: 4,096 rows
FANOUT, DEPTH = 8, 4
_STEP = "struct<before:string,after:string>"


def digest(text: Column) -> Column:
    """H of the contract: lowercase hex sha256 of UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, `:`, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf leads to by its path."""
    return F.aggregate(path, leaf, lambda acc, s: digest(F.concat(s["before"], acc, s["after"])))


def siblings(path: Column) -> Column:
    """All sibling hashes of a path, from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _placed(rows: DataFrame, order: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """`rows` with at (place in the part, from 0), times and n (rows of the part). Equal rows are one row with their number.

    Spark sorts by ranges; a row's place is its place in the range plus what earlier ranges hold of the part. The ranges are
    written, so every later reader sees the same ones.
    """
    keys = ["_part", *order, *[c for c in carry if c not in order]]
    slim = cut(rows.groupBy(*keys).agg(F.count("*").alias("times")), "leaves")
    ranged = slim.repartitionByRange("_part", *order).sortWithinPartitions("_part", *order)
    # the place of a row in its range: what the range holds before it
    placed = cut(ranged.withColumn("_turn", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_turn", 33)), "ranges")
    drop(slim)
    of_part = Window.partitionBy("_part")
    ends = placed.groupBy("_range", "_part").agg(F.sum("times").alias("_held"))
    before = F.coalesce(F.sum("_held").over(of_part.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.select("_range", "_part", before.alias("_before"), F.sum("_held").over(of_part).alias("n"))
    inside = Window.partitionBy("_range", "_part").orderBy("_turn").rowsBetween(Window.unboundedPreceding, -1)
    own = placed.withColumn("_own", F.coalesce(F.sum("times").over(inside), F.lit(0)))
    return own.join(ends, ["_range", "_part"]).withColumn("at", F.col("_before") + F.col("_own")).drop("_range", "_turn", "_own", "_before")


def _blocks(nodes: DataFrame, carry: Sequence[str]) -> DataFrame:
    """_part, block, n, stamp, kids: the subtrees of FANOUT ** DEPTH nodes (`at`, `times`, `stamp`) as nested structs."""
    size = FANOUT**DEPTH
    block = lambda at: F.floor(at / size).cast("long")
    first, last = F.col("at"), F.col("at") + F.col("times") - 1
    # equal rows first go to their blocks and are spread there
    apart = nodes.withColumn("block", F.explode(F.sequence(block(first), block(last)))).repartition("_part", "block")
    lo, hi = F.greatest(first, F.col("block") * size), F.least(last, F.col("block") * size + size - 1)
    tree = apart.withColumn("at", F.explode(F.sequence(lo, hi)))
    digits = {f"d{i}": F.pmod(F.shiftright("at", 3 * i), F.lit(FANOUT)).cast("int") for i in range(DEPTH)}
    tree = tree.withColumns(digits).select("_part", "block", "n", *digits, "stamp", *carry)
    for i in range(DEPTH):
        above = [f"d{j}" for j in range(DEPTH - 1, i, -1)]
        inner = ["stamp", *(carry if i == 0 else ["kids"])]
        tree = tree.groupBy("_part", "block", "n", *above).agg(F.sort_array(F.collect_list(F.struct(f"d{i}", *inner))).alias("kids"))
        joined = digest(F.array_join(F.transform("kids", lambda k: k["stamp"]), ""))
        # a part with one node left on this level has reached its root
        tree = tree.withColumn("stamp", F.when(F.col("n") > FANOUT**i, joined).otherwise(F.col("kids")[0]["stamp"]))
    return tree


def _opened(blocks: DataFrame, paths: DataFrame, carry: Sequence[str]) -> DataFrame:
    """The nodes of `blocks` (with `carry`) and their paths to the root, subroot and root, given those of the blocks."""
    tops = ["path", "subroot", "root"]
    held, told = ["n", "kids"], paths.select("_part", "block", *tops)
    both = blocks.select("_part", "block", *held).unionByName(told, allowMissingColumns=True)
    found = both.groupBy("_part", "block").agg(*[F.any_value(c, F.lit(True)).alias(c) for c in (*held, *tops)])
    found = found.withColumn("at", F.col("block"))
    for i in range(DEPTH - 1, -1, -1):
        stamps = F.transform("kids", lambda k: k["stamp"])

        def child(k: Column, place: Column) -> Column:
            step = F.struct(F.array_join(F.slice("_stamps", F.lit(1), place), "").alias("before"), F.array_join(F.slice("_stamps", place + 2, F.lit(FANOUT)), "").alias("after"))
            return F.struct(k.alias("node"), step.alias("step"))

        opened = found.withColumn("_stamps", stamps).withColumn("_child", F.explode(F.transform("kids", child)))
        node, step = F.col("_child")["node"], F.col("_child")["step"]
        path = F.when(F.col("n") > FANOUT**i, F.concat(F.array(step), F.col("path"))).otherwise(F.col("path"))
        inner = [node[c].alias(c) for c in (carry if i == 0 else ["kids"])]
        found = opened.select("_part", "n", (F.col("at") * FANOUT + node[f"d{i}"]).alias("at"), node["stamp"].alias("stamp"), *inner, path.alias("path"), "subroot", "root")
    return found.drop("n")


def _rolled(nodes: DataFrame, carry: Sequence[str]) -> list[DataFrame]:
    """Rounds of blocks, leaves first, until every part is one block."""
    rounds = [cut(_blocks(nodes, carry), "blocks")]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > FANOUT**DEPTH:
        up = rounds[-1].select("_part", F.col("block").alias("at"), F.lit(1).cast("long").alias("times"), F.ceil(F.col("n") / FANOUT**DEPTH).cast("long").alias("n"), "stamp")
        rounds.append(cut(_blocks(up, ()), "blocks"))
    return rounds


def manifest(rows: DataFrame, id_col: str, part_col: str, leaf_col: str = "leaf", carry: Sequence[str] = ()) -> DataFrame:
    """The given columns of every row, place (in its part, from 0), subroot, root and path: (before, after) sibling hashes by
    level, from the leaf through the part's root to the root.

    Rows of a part ascend by id, null ids first, equal ids by their leaf, then by the columns carried; rows equal in all of them
    are interchangeable and each has its place. A null part is a part of its own and comes first, others follow in the order of
    their bytes. A null leaf takes no part. A lone row is its part's root, a lone part is the root, an empty table gives no rows.
    Every part, however large, is dealt into blocks of FANOUT ** DEPTH rows.
    """
    names = [f"_c{i}" for i in range(len(carry))]
    part = F.coalesce(F.concat(F.lit("="), F.col(part_col).cast("string")), F.lit(""))
    given = rows.where(F.col(leaf_col).isNotNull()).select(part.alias("_part"), F.col(id_col).alias("_id"), F.col(leaf_col).alias("stamp"), *[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)])
    own = ["_id", *names]
    rounds = _rolled(_placed(given, ["_id", "stamp", *names], own), own)
    # the parts' roots in their order are the leaves of one more tree
    parts = rounds[-1].select(F.lit("").alias("_part"), F.col("_part").alias("_name"), "stamp")
    tops = _rolled(_placed(parts, ["_name"], ["stamp"]), ["_name"])
    at_root = tops[-1].select("_part", "block", F.array().cast(f"array<{_STEP}>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("stamp").alias("root"))
    for i in range(len(tops) - 1, -1, -1):
        below = _opened(tops[i], at_root, ["_name"] if i == 0 else ())
        at_root = below.withColumnRenamed("at", "block")
    at_root = at_root.select(F.col("_name").alias("_part"), F.lit(0).cast("long").alias("block"), "path", F.col("stamp").alias("subroot"), "root")
    for i in range(len(rounds) - 1, -1, -1):
        at_root = _opened(rounds[i], at_root, own if i == 0 else ()).withColumnRenamed("at", "block")
    out = [F.col(n).alias(c) for c, n in zip(carry, names, strict=True)]
    name = F.when(F.col("_part") != "", F.substring("_part", 2, 2**31 - 1))
    fixed = {id_col: F.col("_id"), part_col: name.cast(rows.schema[part_col].dataType), leaf_col: F.col("stamp")}
    return at_root.select(*[c.alias(n) for n, c in fixed.items() if n not in carry], *out, F.col("block").alias("place"), "subroot", "root", "path")

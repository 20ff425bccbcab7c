"""Fixity of web archives: hash trees over records and ordered offset ranges, compared from the roots down.

A replica is a table of records (archive, offset, record). Record hashes, in the order of their offsets, make the hash of a
range of RANGE bytes; FANOUT ranges in a row make the next level, up to an archive's root; archives meet in a tree by a hash of
their name, up to the replica's root. Two replicas are compared root first, and only children of nodes that differ are read.
Every level is an aggregation with a bounded number of children, so no task holds an archive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.store import cut, drop

#: bytes of an archive in one leaf range, and children of a node
RANGE, FANOUT = 1 << 16, 16
#: pages of one archive
PER_ARCHIVE = 1024


def record(url: Column, page: Column, payload: Column) -> Column:
    """A WARC resource record; null parts count as empty."""
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def pack(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages as records with their place: page_id, archive, offset, record, and the other columns of `pages`. Columns of `pages`
    that have the names archive, offset or record, or those used on the way (_a, _i, _c, _k, _content), are left out.

    Archives take PER_ARCHIVE ids in a row. Pages without an id are spread over archives of their own by content. Offsets come
    from the lengths alone, a slim table, and are then joined to the pages; rows that repeat are records of their own, told
    apart by url and content, and equal rows are interchangeable.
    """
    pages = pages.drop(*[c for c in ("archive", "offset", "record", "_a", "_i", "_c", "_k", "_content") if c not in (id_col, url_col, html_col)])
    text = record(F.col(url_col), F.col(id_col), F.col(html_col))
    loose = F.concat(F.lit("loose-"), F.hex(F.xxhash64(url_col, html_col)).substr(1, 3))
    name = F.coalesce(F.concat(F.lit("pages-"), F.lpad(F.floor(F.col(id_col) / PER_ARCHIVE).cast("string"), 9, "0")), loose)
    placed = pages.withColumns({"archive": F.concat(name, F.lit(".warc")), "record": text})
    order = Window.partitionBy("archive").orderBy(id_col, "_content")
    slim = placed.select("archive", id_col, F.xxhash64(url_col, html_col).alias("_content"), F.octet_length("record").cast("long").alias("_n"))
    # equal rows stand in one row with their number
    slim = slim.groupBy("archive", id_col, "_content", "_n").agg(F.count("*").alias("_times"))
    first = F.coalesce(F.sum(F.col("_n") * F.col("_times")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    offsets = slim.withColumn("_first", first).select(F.col("archive").alias("_a"), F.col(id_col).alias("_i"), F.col("_content").alias("_c"), "_first", "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)).alias("_k"))
    offsets = offsets.select("_a", "_i", "_c", "_k", (F.col("_first") + F.col("_k") * F.col("_n")).alias("offset"))
    same = Window.partitionBy("archive", id_col, "_content").orderBy(F.lit(0))
    several = placed.withColumn("_content", F.xxhash64(url_col, html_col)).withColumn("_k", F.row_number().over(same).cast("long") - 1)
    joined = several.join(offsets, (F.col("archive") == F.col("_a")) & F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_content") == F.col("_c")) & (several["_k"] == offsets["_k"]))
    return joined.drop("_a", "_i", "_c", "_k", "_content")


def leaves(replica: DataFrame, archive_col: str = "archive", offset_col: str = "offset", record_col: str = "record") -> DataFrame:
    """archive, offset, length, digest, stamp: one row for each place. Rows that share a place, which a sound replica does not
    have, are summed up without keeping them: the stamp tells their number and content, digest and length are the least."""
    digest = F.coalesce(F.sha2(F.col(record_col), 256), F.lit("null"))
    rows = replica.select(F.coalesce(F.col(archive_col).cast("string"), F.lit("")).alias("archive"), F.coalesce(F.col(offset_col).cast("long"), F.lit(-1).cast("long")).alias("offset"), F.octet_length(F.col(record_col)).cast("long").alias("length"), digest.alias("digest"))
    summed = rows.groupBy("archive", "offset").agg(F.min("length").alias("length"), F.min("digest").alias("digest"), F.max("digest").alias("_hi"), F.count("*").alias("_n"), F.bit_xor(F.xxhash64("digest", "length")).alias("_x"))
    stamp = F.sha2(F.concat_ws(":", "offset", "length", "digest", "_hi", "_n", F.col("_x").cast("string")), 256)
    return summed.select("archive", "offset", "length", "digest", stamp.alias("stamp"))


def _parent(nodes: DataFrame, keys: list[str], order: str) -> DataFrame:
    children = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("stamp").alias("s"))))
    return nodes.groupBy(*keys).agg(F.sha2(F.concat_ws(",", F.transform(children, lambda c: F.concat_ws(":", c.o.cast("string"), c.s))), 256).alias("stamp"))


class Tree:
    """Levels of one replica, leaves first: ranges of an archive ("r", r0, r1, ...), then groups of archives ("g", ...)."""

    def __init__(self, replica: DataFrame, ranges: int | None = None, groups: int | None = None, **columns):
        self.leaves = cut(leaves(replica, **columns), "leaves")
        self.ranges, self.groups = ranges, groups

    def size(self) -> tuple[int, int]:
        """Levels that the archives and the number of archives need."""
        most, count = self.leaves.agg(F.coalesce(F.max("offset"), F.lit(0)), F.count_distinct("archive")).first()
        return 1 + max(0, math.ceil(math.log(most // RANGE + 1, FANOUT))), max(0, math.ceil(math.log(max(1, count), FANOUT)))

    def build(self, ranges: int, groups: int) -> None:
        at = self.leaves.withColumn("node", F.floor(F.col("offset") / RANGE))
        self.levels = [cut(_parent(at, ["archive", "node"], "offset"), "level")]
        for _ in range(ranges):
            up = self.levels[-1].withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FANOUT))
            self.levels.append(cut(_parent(up, ["archive", "node"], "child"), "level"))
        # above, an archive's nodes are one (two where rows have no offset)
        up = _parent(self.levels[-1].withColumn("child", F.col("node")), ["archive"], "child")
        self.roots = cut(up.withColumn("node", F.pmod(F.xxhash64("archive"), F.lit(FANOUT**groups))), "roots")
        self.above = [cut(_parent(self.roots, ["node"], "archive"), "group")]
        for _ in range(groups):
            up = self.above[-1].withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FANOUT))
            self.above.append(cut(_parent(up, ["node"], "child"), "group"))

    def drop(self) -> None:
        drop(*self.levels, self.roots, *self.above)


def _differing(a: DataFrame, b: DataFrame, keys: list[str], under: DataFrame | None, parent: dict[str, Column]) -> DataFrame:
    """Nodes below `under` whose stamps differ or that one side lacks."""
    if under is not None:
        a, b = (x.withColumns({f"_{k}": c for k, c in parent.items()}).join(under.select(*[F.col(k).alias(f"_{k}") for k in parent]), [f"_{k}" for k in parent], "left_semi") for x in (a, b))
    both = a.select(*keys, F.col("stamp").alias("s_a")).join(b.select(*keys, F.col("stamp").alias("s_b")), keys, "full_outer")
    return both.where(~F.col("s_a").eqNullSafe(F.col("s_b"))).select(*keys)


def audit(replica_a: DataFrame, replica_b: DataFrame, **columns) -> DataFrame:
    """Records in which two replicas differ: archive, offset, length_a, length_b, digest_a, digest_b, status (altered, missing:
    not in b, extra: not in a). Equal replicas, empty ones too, give an empty result.

    Null archives count as one archive without a name, null offsets as -1, a null record as a digest of its own. Other columns
    are not looked at.
    """
    a, b = Tree(replica_a, **columns), Tree(replica_b, **columns)
    depth = [max(x) for x in zip(a.size(), b.size(), strict=True)]
    a.build(*depth)
    b.build(*depth)
    open_: DataFrame | None = None
    for x, y in zip(reversed(a.above), reversed(b.above), strict=True):
        open_ = cut(_differing(x, y, ["node"], open_, {"node": F.floor(F.col("node") / FANOUT)}), "open")
    open_ = cut(_differing(a.roots, b.roots, ["archive"], open_, {"node": F.col("node")}), "open")
    parent = {"archive": F.col("archive")}
    for x, y in zip(reversed(a.levels), reversed(b.levels), strict=True):
        open_ = cut(_differing(x, y, ["archive", "node"], open_, parent), "open")
        parent = {"archive": F.col("archive"), "node": F.floor(F.col("node") / FANOUT)}
    a.drop()
    b.drop()
    found = []
    for tree, side in ((a, "a"), (b, "b")):
        at = tree.leaves.withColumn("node", F.floor(F.col("offset") / RANGE)).join(open_, ["archive", "node"], "left_semi")
        found.append(at.select("archive", "offset", F.col("length").alias(f"length_{side}"), F.col("digest").alias(f"digest_{side}"), F.col("stamp").alias(f"stamp_{side}")))
    both = found[0].join(found[1], ["archive", "offset"], "full_outer").where(~F.col("stamp_a").eqNullSafe(F.col("stamp_b")))
    status = F.when(F.col("stamp_b").isNull(), "missing").when(F.col("stamp_a").isNull(), "extra").otherwise("altered")
    return both.select("archive", "offset", "length_a", "length_b", "digest_a", "digest_b", status.alias("status"))

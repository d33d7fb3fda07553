"""Merkle manifest of a dataset: a hash tree per group of rows, and one over the groups' roots.

Levels are strings. A block is an aligned run of ``2 ** bits`` nodes of a group, and each of its levels is one
string of 64 hexadecimal digits a node; the parents of a level are the hashes of its substrings of 128, and the
64 digits beside a node's own are its sibling. The topmost nodes of the blocks are the leaves of the next tier, in blocks
again, until each group has one node, its root; the roots of the groups, in order, go through the same.

1. ``leaves`` hashes every row where it is read; only digests and ids go on.
2. A range partitioning by (group, id) with the row counts of its partitions gives every leaf its place.
3. Blocks of a tier are grouped by (group, place >> bits): at most ``2 ** bits`` rows each, however large a group is.
   Every tier is a table in the shared folder: together they are the manifest.
4. ``proofs`` joins the tiers from the top down: a leaf's path is that inside its block, then that of its block.

A node that is last without a sibling is hashed alone. A path has one entry for each hash on the way up: ``L`` or ``R``
and the sibling to the left or right, or ``N`` where there is none.

Defined cases: a null group is a group of its own, before all others; null ids come first, and rows that share an id follow
in the order of their leaves (equal ones may be exchanged). Null fields are written ``-``, which no value is. A repeated
row is a leaf of its own. An empty table has no rows and no root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aspectra.llm.common import stash

BITS = 8
HEX = 64  # hexadecimal digits of a digest
ALL = "all"


def written(value: Column) -> Column:
    """A value as it is hashed: its length in UTF-8 bytes, a colon and itself; ``-`` if null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[written(f) for f in fields]), 256)


def group_value(key: Column) -> Column:
    """The value that ``written`` wrote."""
    return F.when(key != "-", F.substr(key, F.instr(key, ":") + 1))


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: as a variable, not as an expression in each place."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _parents(level: Column) -> Column:
    n = ((F.length(level) + (2 * HEX - 1)) / (2 * HEX)).cast("int")
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.sha2(F.substring(level, (i - 1) * (2 * HEX) + 1, F.lit(2 * HEX)), 256))
    return F.array_join(each, "")


def _levels(level: Column, total: Column, bits: int, held: tuple[Column, ...] = ()) -> Column:
    """All levels of a block, the lowest first; where the group has one node left, a level is that below it."""
    if len(held) == bits:
        return F.array(*held, level)
    above = lambda x: F.when(total > (1 << len(held)), _parents(x)).otherwise(x)
    return _bind(above(level), lambda up: _levels(up, total, bits, (*held, level)))


def _path(place: Column, levels: Column, total: Column, bits: int) -> Column:
    """Entries of a node's way up inside its block."""
    entries = []
    for k in range(bits):
        at = F.shiftright(place.bitwiseAND((1 << bits) - 1), k)
        odd = at % 2
        beside = F.substring(levels[k], ((at + 1 - 2 * odd) * HEX + 1).cast("int"), F.lit(HEX))
        step = F.when(odd == 1, F.concat(F.lit("L"), beside)).when(beside != "", F.concat(F.lit("R"), beside)).otherwise(F.lit("N"))
        entries.append(F.when(total > (1 << k), step))
    return F.array_compact(F.array(*entries))


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the entries of a path give."""

    def step(node, entry):
        side, beside = F.substring(entry, 1, 1), F.substring(entry, 2, HEX)
        return F.sha2(F.when(side == "L", F.concat(beside, node)).otherwise(F.concat(node, beside)), 256)

    return F.aggregate(path, start, step)


def siblings(path: Column) -> Column:
    """The siblings of a path, from the leaf to the root, in one string."""
    return F.array_join(F.transform(path, lambda entry: F.substring(entry, 2, HEX)), "")


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows (``group``, ...) with ``place`` in their group by ``order``, and ``total``, the group's rows."""
    # Rows that agree in all of it are told apart by where they were read, so they can lie in several partitions.
    keys = ["group", *order, "_tie"]
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_rows = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    ranged, _ = stash(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "merkle-order")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    # A row for each group and task that has some of it.
    sizes = ranged.groupBy("group", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy("group")
    before = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets, _ = stash(sizes.select("group", "_part", "_first", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total")), "merkle-offsets")
    out = ranged.join(offsets, ["group", "_part"]).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
    return out.drop("_at", "_part", "_first", "_before")


@dataclass
class Tree:
    """Tables (group, block, total, members, levels) from the leaves up; ``total``: the group's nodes in this tier."""

    tiers: list[DataFrame]
    bits: int

    def roots(self) -> DataFrame:
        """(group, root), one row per group."""
        return self.tiers[-1].select("group", F.col("levels")[self.bits].alias("root"))

    def paths(self, tier: int = 0) -> DataFrame:
        """The members of a tier with ``path``, their way to the root, and ``root``."""
        blocks, bits = self.tiers[tier], self.bits
        if tier + 1 == len(self.tiers):
            blocks = blocks.select("*", F.array().cast("array<string>").alias("_up"), F.col("levels")[bits].alias("root"))
        else:
            up = self.paths(tier + 1).select("group", F.col("place").alias("block"), F.col("path").alias("_up"), "root")
            blocks = blocks.join(up, ["group", "block"])
        fields = blocks.schema["members"].dataType.elementType.fieldNames()
        own = lambda m: F.struct(*[m[f].alias(f) for f in fields], _path(m["place"], F.col("levels"), F.col("total"), bits).alias("_own"))
        each = blocks.select("group", "_up", "root", F.inline(F.transform("members", own)))
        return each.select("group", *fields, F.concat("_own", "_up").alias("path"), "root")


def grow(nodes: DataFrame, bits: int = BITS) -> Tree:
    """The tree over nodes (group, place, total, digest, ...); further columns stay with the leaves."""
    tiers = []
    while True:
        carry = [c for c in nodes.columns if c not in ("group", "place", "total")]
        found = nodes.groupBy("group", F.shiftright("place", bits).alias("block")).agg(
            F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("place", *carry))).alias("members")
        )
        lowest = F.array_join(F.transform("members", lambda m: m["digest"]), "")
        levels = _bind(lowest, lambda level: _levels(level, F.col("total"), bits))
        tiers.append(stash(found.select("*", levels.alias("levels")), "merkle-tier")[0])
        widest = tiers[-1].agg(F.max("total")).first()[0] or 0
        if widest <= 1 << bits:
            return Tree(tiers, bits)
        nodes = tiers[-1].select(
            "group", F.col("block").alias("place"), F.ceil(F.col("total") / (1 << bits)).alias("total"), F.col("levels")[bits].alias("digest")
        )


@dataclass
class Manifest:
    rows: Tree  # of each group's rows
    groups: Tree  # of the groups' roots

    def proofs(self) -> DataFrame:
        """(id, the carried columns, leaf, group, subroot, root, path), one row per row of the dataset."""
        top = self.groups.paths().select(F.col("key").alias("group"), F.col("digest").alias("subroot"), F.col("path").alias("_above"), F.col("root"))
        below = self.rows.paths().withColumnRenamed("root", "subroot").withColumnRenamed("digest", "leaf").drop("place")
        out = below.join(top, ["group", "subroot"])
        return out.withColumn("path", F.concat("path", "_above")).drop("_above").withColumn("group", group_value(F.col("group")))


def manifest(docs: DataFrame, id_col: str, group_col: str, fields: Sequence[str], carry: Mapping[str, Column] | None = None, bits: int = BITS) -> Manifest:
    """The manifest of all rows: a leaf per row, hashed from ``fields``, in the tree of its group, by id."""
    carry = {name: c.alias(name) for name, c in (carry or {}).items()}
    digest = leaf([F.col(f) for f in fields])
    rows, _ = stash(docs.select(written(F.col(group_col)).alias("group"), F.col(id_col).alias("id"), digest.alias("digest"), *carry.values()), "merkle-leaves")
    trees = grow(placed(rows, ["id", "digest"]), bits)
    roots = trees.roots().select(F.lit(ALL).alias("group"), F.col("group").alias("key"), F.col("root").alias("digest"), group_value(F.col("group")).alias("value"))
    return Manifest(trees, grow(placed(roots, ["value"]), bits))

"""A Merkle manifest of a table: one tree of digests for each value of a column, one tree above them, and every row's path to the root.

Rows become leaves by the SHA-256 of their fields; texts are hashed where they are read, and only digests move. Leaves are numbered within their tree
in one range shuffle. Each level is a slot pivot: conditional aggregates spread the children of a parent into ``fanout`` columns, so
the digest of the parent is that of the columns in a row, and the siblings of a child are all columns but its own. Leaves that stand
together are mostly in one partition, so the pivot combines them before its shuffle; each level has an eighth of the rows of the one before.

The way down joins each pivot with the paths of its parents, on keys that are unique, and spreads the columns into rows again. No list of digests is
ever gathered: not on the driver, which learns the number of levels and the root alone, and not in a task.

Trees of unequal heights: a tree that has only one node left is passed on unhashed through the levels that higher trees need.

Results: null fields are hashed as ``-``. Rows are ordered by the order column (null first), then by leaf; rows equal in both are alike and take
places next to each other. Trees are ordered by their value, null first, text by its UTF-8 bytes. A tree of one row has its leaf as
subroot and no siblings; an empty table has an empty manifest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.llm.common import stored
from tablecheck.plans.ordering import Key, with_row_index

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 8
_PATH = "array<struct<left:string,right:string>>"


def leaf(*values: Column) -> Column:
    """SHA-256, as lowercase hex, of fields in a row: each its number of UTF-8 bytes, a colon and itself, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t), F.lit(":"), t)) for t in texts]), 256)


def proof(path: Column) -> Column:
    """SHA-256 of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path lead to."""
    return F.aggregate(path, start, lambda digest, x: F.sha2(F.concat(x["left"], digest, x["right"]), 256))


@dataclass(frozen=True)
class _Level:
    """(tree, parent, n, s0 ... ): a row for each parent; n is the number of nodes that the tree has on this level."""

    slots: DataFrame
    fanout: int

    def _side(self, slots: range) -> str:
        return ", ".join(["''", *[f"s{k}.digest" for k in slots]])

    def parents(self) -> DataFrame:
        """(tree, at, n, item): the nodes of the next level."""
        hashed = f"CASE WHEN n = 1 THEN s0.digest ELSE sha2(concat_ws({self._side(range(self.fanout))}), 256) END"
        return self.slots.selectExpr("tree", "parent AS at", f"(n + {self.fanout - 1}) DIV {self.fanout} AS n", f"struct({hashed} AS digest) AS item")

    def children(self, above: DataFrame) -> DataFrame:
        """(tree, at, item, path, subroot): the nodes of this level, below the (tree, at, path, subroot) of their parents."""
        sides = [f"struct(concat_ws({self._side(range(k))}) AS left, concat_ws({self._side(range(k + 1, self.fanout))}) AS right)" for k in range(self.fanout)]
        spread = ", ".join(f"struct({k} AS slot, s{k} AS item, {side} AS sides)" for k, side in enumerate(sides))
        joined = self.slots.join(above.selectExpr("tree AS t", "at AS p", "path", "subroot"), F.expr("tree = t AND parent = p"))
        rows = joined.selectExpr("tree", "parent", "n", "path", "subroot", f"explode(array({spread})) AS c").filter("c.item IS NOT NULL")
        path = "CASE WHEN n = 1 THEN path ELSE concat(array(c.sides), path) END AS path"
        return rows.selectExpr("tree", f"parent * {self.fanout} + c.slot AS at", "c.item", path, "subroot")


def _pivot(nodes: DataFrame, fanout: int) -> _Level:
    """The nodes (tree, at, n, item) with the children of a parent as columns."""
    columns = [F.expr(f"max(CASE WHEN at % {fanout} = {k} THEN item END) AS s{k}") for k in range(fanout)]
    return _Level(stored(nodes.groupBy("tree", F.expr(f"at DIV {fanout} AS parent")).agg(F.max("n").alias("n"), *columns)), fanout)


def _grown(nodes: DataFrame, fanout: int) -> tuple[list[_Level], DataFrame]:
    """All levels over the nodes, lowest first, and the one node that each tree ends in."""
    left = nodes.agg(F.max("n")).first()[0] or 1
    levels = []
    while True:
        levels.append(_pivot(nodes, fanout))
        nodes = levels[-1].parents()
        left = -(-left // fanout)
        if left == 1:
            return levels, nodes


def _paths(levels: list[_Level], above: DataFrame) -> DataFrame:
    """The lowest nodes with their paths."""
    for level in reversed(levels):
        above = level.children(above)
    return above


def manifest(rows: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id", carried: tuple[str, ...] = (), fanout: int = FANOUT) -> DataFrame:
    """(order, tree, *carried, position, leaf, subroot, root, path) of every row.

    ``path`` has the siblings (left, right) of each level from the leaf to the root; ``carried`` names short columns that stay with their row.
    """
    if fanout < 2:
        raise ValueError("A parent has at least two children.")
    kept = [F.col(order).alias("k0"), F.col(tree).alias("k1"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(carried, 2)]]
    # Of rows that are equal in tree and order the leaf decides: ties are broken by all columns in turn.
    leaves = stored(rows.select(kept[1], kept[0], leaf(*[F.col(c) for c in fields]).alias("digest"), *kept[2:]))
    placed = with_row_index(leaves, [Key(F.col("k1"), nulls_first=True), Key(F.col("k0"), nulls_first=True)], "place")
    # A row for each tree; stored, so that its size is known where the leaves are joined with it.
    trees = stored(placed.groupBy("k1").agg(F.min("place").alias("tree"), F.count("*").alias("n")).withColumnRenamed("k1", "t1"))
    item = F.struct("digest", *[f"k{i}" for i in range(len(kept))])
    nodes = placed.join(trees, F.col("k1").eqNullSafe(F.col("t1"))).select("tree", (F.col("place") - F.col("tree")).alias("at"), "n", item.alias("item"))
    levels, roots = _grown(nodes, fanout)

    # The tree above: its leaves are the subroots, in the order of the places where their trees begin.
    subroots = with_row_index(roots.select("tree", "item.digest"), [Key(F.col("tree"))], "at")
    count = subroots.count()
    upper = subroots.select(F.lit(0).cast("long").alias("tree"), "at", F.lit(count).cast("long").alias("n"), F.struct("digest", "tree").alias("item"))
    tops, root = _grown(upper, fanout)
    top = root.select("tree", "at", F.array().cast(_PATH).alias("path"), F.lit(None).cast("string").alias("subroot"))
    first = root.select("item.digest").first()
    below = _paths(tops, top).select(F.col("item.tree").alias("tree"), F.lit(0).cast("long").alias("at"), "path", F.col("item.digest").alias("subroot"))
    found = _paths(levels, below)
    named = [F.col(f"item.k{i}").alias(name) for i, name in enumerate((order, tree, *carried))]
    return found.select(*named, F.col("at").alias("position"), F.col("item.digest").alias("leaf"), "subroot", F.lit(first and first[0]).cast("string").alias("root"), "path")

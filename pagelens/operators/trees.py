"""Box trees as tables of nodes: counts, style rows and pseudo-markup.

nodes: tree, node, parent (null for a root), place (among its siblings), tag, x, y, w, h.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.sources.checkpoints import cut


def levels(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """Adds depth and index, the places on the way from the root (empty for a root, then 0, 0-1 and so on).

    One join a level, of the nodes found in the level before. Nodes below most_depth raise an error.
    """
    level = nodes.where("parent is null").select("*", F.lit(0).alias("depth"), F.lit("").alias("index"))
    found = level
    for depth in range(1, most_depth + 2):
        up = level.select("tree", F.col("node").alias("parent"), F.col("index").alias("__up"))
        below = nodes.join(up, ["tree", "parent"]).withColumn("depth", F.lit(depth)).withColumn("index", F.concat(F.col("__up"), F.when(F.col("__up") == "", "").otherwise("-"), F.col("place").cast("string")))
        level = cut(below.drop("__up"))
        if not level.limit(1).count():
            return found
        found = found.unionByName(level)
    raise ValueError(f"a tree is deeper than {most_depth}")


def tree_summary(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per tree: nodes, leaves, the largest depth, and tags with their counts, the most frequent first. found: of levels."""
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct().withColumn("__inner", F.lit(True))
    totals = found.join(inner, ["tree", "node"], "left").groupBy("tree").agg(F.count("*").alias("node_count"), F.count_if(F.col("__inner").isNull()).alias("leaf_count"), F.max("depth").alias("max_depth"))
    tags = found.groupBy("tree", F.coalesce("tag", F.lit("unknown")).alias("tag")).agg(F.count("*").alias("n"))
    listed = tags.groupBy("tree").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "tag"))).alias("t"))
    return totals.join(listed.select("tree", F.transform("t", lambda x: F.concat(x["tag"], F.lit(":"), (-x["n"]).cast("string"))).alias("tags")), "tree")


def style_rows(found: DataFrame, skip_leaves: bool = True) -> DataFrame:
    """A row for each node with its index and the tags of its children in order; without leaves unless they are wanted."""
    children = found.where("parent is not null").groupBy("tree", F.col("parent").alias("node")).agg(F.array_sort(F.collect_list(F.struct("place", "tag"))).alias("c"))
    rows = found.join(children, ["tree", "node"], "inner" if skip_leaves else "left")
    return rows.select("tree", "node", "index", "tag", "x", "y", "w", "h", F.coalesce(F.transform("c", lambda x: x["tag"]), F.array().cast("array<string>")).alias("children"))


def pseudo_markup(found: DataFrame, width: float = 1.0, height: float = 1.0, precision: int = 3) -> DataFrame:
    """(tree, html): each tree as nested tags with its boxes relative to a size, built from the deepest level up."""
    box = F.format_string("[%s, %s, %s, %s]", *(F.round(F.col(c) / size, precision).cast("string") for c, size in (("x", width), ("y", height), ("w", width), ("h", height))))
    rows = found.select("tree", "node", "parent", "place", "depth", "tag", F.concat(F.lit("<"), F.col("tag"), F.lit(" bbox="), box, F.lit(">")).alias("open"))
    deepest = rows.agg(F.max("depth").alias("d")).first()["d"]
    inner = None
    for depth in range(deepest or 0, -1, -1):
        level = rows.where(F.col("depth") == depth)
        level = level.withColumn("inside", F.lit("")) if inner is None else level.join(inner, ["tree", "node"], "left")
        level = level.withColumn("html", F.concat("open", F.coalesce("inside", F.lit("")), F.lit("</"), F.col("tag"), F.lit(">")))
        if depth == 0:
            return level.select("tree", "html")
        inner = level.groupBy("tree", F.col("parent").alias("node")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "html"))), lambda x: x["html"]), "").alias("inside"))
    raise AssertionError

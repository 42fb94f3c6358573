"""Connected components of an edge table, by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.scratch import Scratch


#: The smallest neighbours of so many nodes are sent to the tasks; of more they are joined by shuffle.
SEND_NODES = 200_000


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge to another.

    edges: columns a and b, any order, repeats and loops allowed; read several times, so a written table. Alternates large-star and
    small-star rounds, each a grouped minimum and a join, until every node stands alone below
    one smaller node or is itself a smallest: about the logarithm of the longest path. Minima are
    combined before the shuffle, and joins on a much-linked node are left to adaptive skew handling.
    """
    now, written = edges.where("a != b"), []
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smaller = F.when(F.col("b") < F.col("a"), F.col("b"))
        nodes = scratch.table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.coalesce((F.min(smaller) < F.max(smaller)) | ((F.min(smaller) < F.col("a")) & F.bool_or(F.col("b") > F.col("a"))), F.lit(False)).alias("open")), "nodes")
        many, to_do = nodes.agg(F.count("*"), F.count_if("open")).first()
        if not to_do:
            return nodes.select(F.col("a").alias("node"), F.col("m").alias("component"))
        sent = F.broadcast if many <= SEND_NODES else lambda df: df
        large = both.where("b > a").join(sent(nodes.select("a", "m")), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(sent(least), "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = scratch.table(small.select("e.a", "e.b").where("a != b").distinct(), "edges")
        scratch.drop(nodes, *written)
        written = [now]

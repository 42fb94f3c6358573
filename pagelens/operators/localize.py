"""Which elements a changed region of a page belongs to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelens.functions.geometry import Box, coverage, intersection, iou

# Weights of the region's coverage, of the overlap and of the element's coverage.
RANK = (0.55, 0.30, 0.15)
ROOTS = ("html", "body")


def localize(clusters: DataFrame, elements: DataFrame, key: str, *, keep: int = 5, cell: float = 256.0) -> DataFrame:
    """For each cluster the best elements it overlaps, roots only where nothing else does.

    clusters: key, cluster, cx cy cw ch; elements: key, node, tag, ex ey ew eh. Boxes meet in
    the cells of a grid, so only neighbours are compared; a large element stands in all its cells.
    """

    def cells(rows: DataFrame, p: str) -> DataFrame:
        place = lambda c, size: F.sequence(F.floor(F.col(p + c) / cell), F.floor((F.col(p + c) + F.greatest(F.col(p + size), F.lit(0.0))) / cell))
        return rows.withColumn("gx", F.explode(place("x", "w"))).withColumn("gy", F.explode(place("y", "h")))

    c, e = Box.of("c"), Box.of("e")
    met = cells(clusters, "c").join(cells(elements, "e"), [key, "gx", "gy"]).drop("gx", "gy").dropDuplicates([key, "cluster", "node"]).where(intersection(c, e) > 0)
    rank = RANK[0] * coverage(c, e) + RANK[1] * iou(c, e) + RANK[2] * coverage(e, c)
    w = Window.partitionBy(key, "cluster")
    inner = met.withColumns({"score": rank, "__root": F.col("tag").isin(*ROOTS)}).withColumn("__other", F.min("__root").over(w)).where(~F.col("__root") | F.col("__other"))
    return inner.withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "node"))).where(F.col("rank") <= keep).select(key, "cluster", "node", "tag", "score", "rank")

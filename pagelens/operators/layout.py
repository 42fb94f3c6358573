"""How much of a page is one blank area: the largest rectangle of one shade, by runs in columns over pixel tables.

A pixel's run is the number of pixels of its shade straight above it, itself included: a
window over each column. The largest rectangle that ends in a line follows from that line's
runs alone, so lines are dealt out in strips and only each strip's best goes on.

Defined cases: a pixel without a row ends the runs and rectangles beside it; among equal
areas the darker shade, then the higher, the more left and the taller rectangle counts; an
empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.operators.tiles import picture_sizes

#: Lines of a picture that one task takes at a time.
STRIP = 64
# Weights of red, green and blue in a shade (of 2 ** 16), and from which share a blank area is large.
SHADE = (("r", 19595), ("g", 38470), ("b", 7471))
LARGE_BLANK = 25.0


def shade() -> Column:
    """Brightness in whole values from 0 to 255."""
    total = F.lit(1 << 15)
    for c, w in SHADE:
        total = total + F.col(c) * w
    return F.shiftright(total, 16)


def _shrunk_lines(rows: DataFrame, image: list[str], along: str, size_in: str, size_out: str) -> DataFrame:
    """Values averaged over the stretch of a line that becomes one pixel; parts of pixels count in part."""
    other = "y" if along == "x" else "x"
    scale = F.col(size_in) / F.col(size_out)
    first, last = F.floor(F.col(along) / scale), F.ceil((F.col(along) + 1) / scale) - 1
    to = F.explode(F.sequence(first, F.least(last, F.col(size_out) - 1)))
    sizes = ["width", "height", "new_width", "new_height"]
    dealt = rows.withColumn("to", to).withColumn("w", F.least(F.col(along) + 1, (F.col("to") + 1) * scale) - F.greatest(F.col(along), F.col("to") * scale))
    return dealt.where("w > 1e-9").groupBy(*image, *sizes, F.col("to").alias(along), other).agg((F.sum(F.col("shade") * F.col("w")) / F.sum("w")).alias("shade"))


def shrink(shades: DataFrame, image: list[str], most: int) -> DataFrame:
    """Pictures (image, x, y, shade) with a side over most, made smaller by averaging areas; adds the size before, width and height."""
    sizes = picture_sizes(shades, image)
    factor = F.least(F.lit(1.0), most / F.greatest("width", "height").cast("double"))
    sizes = sizes.withColumns({"new_width": F.floor(F.col("width") * factor).cast("long"), "new_height": F.floor(F.col("height") * factor).cast("long")})
    rows = shades.select(*image, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("shade").cast("double").alias("shade")).join(sizes.hint("shuffle_hash"), image)  # else the pixels may be broadcast
    large = rows.where(F.greatest("width", "height") > most)
    large = _shrunk_lines(_shrunk_lines(large, image, "x", "width", "new_width"), image, "y", "height", "new_height")
    names = [*image, "x", "y", F.rint("shade").cast("int").alias("shade"), "width", "height", "new_width", "new_height"]
    return rows.where(F.greatest("width", "height") <= most).select(*names).unionByName(large.select(*names))


def line_rectangle(x: list[int], run: list[int], band: list[int]) -> tuple[int, int, int, int, int]:
    """(area, band, left, right, height) of the best rectangle that ends in a line; x ascending, right exclusive."""
    best = (0, 0, 0, 0, 0)
    stack: list[tuple[int, int]] = []  # left edge and height of the rectangles still open
    before, shade_ = None, None
    for at, height, own in zip([*x, None], [*run, 0], [*band, None], strict=True):
        ends = at is None or own != shade_ or at != before + 1
        start = at
        while stack and (ends or stack[-1][1] > height):
            left, tall = stack.pop()
            area = tall * (before + 1 - left)
            if (area, -shade_) > (best[0], -best[1]) or not best[0]:
                best = (area, shade_, left, before + 1, tall)
            if not ends:
                start = left
        if at is None:
            break
        if not stack or stack[-1][1] < height:
            stack.append((start, height))
        before, shade_ = at, own
    return best


def largest_rectangles(bands: DataFrame, image: list[str]) -> DataFrame:
    """Per picture the largest rectangle of one band: band, x, y, w, h, area. bands: image, x, y, band."""
    column = Window.partitionBy(*image, "x").orderBy("y")
    same = (F.lag("band").over(column) == F.col("band")) & (F.lag("y").over(column) == F.col("y") - 1)
    runs = bands.withColumn("start", F.when(~F.coalesce(same, F.lit(False)), F.col("y"))).withColumn("run", F.col("y") - F.last("start", ignorenulls=True).over(column) + 1)
    whole = lambda c: F.col(c).cast("long").alias(c)
    runs = runs.select(*image, *map(whole, ("x", "y", "run", "band")), F.floor(F.col("y") / STRIP).alias("__strip"))
    names = ["area", "band", "left", "right", "tall", "bottom"]
    schema = T.StructType([*(bands.schema[k] for k in image), *(T.StructField(c, T.LongType()) for c in names)])

    def best(table: pa.Table) -> pa.Table:
        table = table.sort_by([("y", "ascending"), ("x", "ascending")])
        y = table.column("y").to_numpy()
        cuts = [0, *((y[1:] != y[:-1]).nonzero()[0] + 1).tolist(), len(y)]
        x, run, band = (table.column(c).to_pylist() for c in ("x", "run", "band"))
        found = [(*line_rectangle(x[a:b], run[a:b], band[a:b]), int(y[a])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        top = max(found, key=lambda r: (r[0], -r[1], -r[5], -r[3], r[4]))
        keys = [table.column(k).slice(0, 1) for k in image]
        return pa.Table.from_arrays([*keys, *(pa.chunked_array([pa.array([v], pa.int64())]) for v in top)], names=schema.names)

    strips = runs.groupBy(*image, "__strip").applyInArrow(best, schema)
    order = F.struct("area", -F.col("band"), -F.col("bottom"), -F.col("right"), "tall")
    top = strips.groupBy(*image).agg(F.max_by(F.struct(*names), order).alias("t"))
    return top.select(*image, "t.band", F.col("t.left").alias("x"), (F.col("t.bottom") - F.col("t.tall") + 1).alias("y"), (F.col("t.right") - F.col("t.left")).alias("w"), F.col("t.tall").alias("h"), "t.area")


def layout_sparsity(pixels: DataFrame, image: list[str], *, tolerance: int = 80, most: int = 1200) -> DataFrame:
    """Per picture: the largest blank rectangle in its own pixels, sparsity_rate in percent, score and tags."""
    shades = shrink(pixels.select(*image, "x", "y", shade().alias("shade")), image, most)
    sizes = shades.groupBy(*image).agg(*(F.max(c).alias(c) for c in ("width", "height", "new_width", "new_height")))
    bands = shades.select(*image, "x", "y", F.floor((F.col("shade") + tolerance / 2) / tolerance).alias("band"))
    rows = largest_rectangles(bands, image).join(sizes, image)
    factor = F.least(F.lit(1.0), most / F.greatest("width", "height").cast("double"))
    rate = F.col("area") / (F.col("new_width") * F.col("new_height")) * 100
    rows = rows.withColumns({"rate": rate, "back": 1 / factor})
    score = F.least(F.lit(100.0), F.sqrt(F.greatest(F.lit(0.0), 100 - F.col("rate"))) * 10)
    own = lambda c, power=1: F.rint(F.col(c) * F.pow("back", F.lit(power))).cast("long").alias(c)
    tags = F.when(F.col("rate") >= LARGE_BLANK, F.array(F.lit("large_blank_region"))).otherwise(F.array().cast("array<string>"))
    return rows.select(*image, *map(own, "xywh"), own("area", 2), F.col("rate").alias("sparsity_rate"), score.alias("score"), tags.alias("tags"))

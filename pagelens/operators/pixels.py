"""Pictures as tables of pixels: image keys, x, y, r, g, b from 0 to 255. All sums are grouped and combine before a shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = ("r", "g", "b")
# Luma weights, the limits of white and black, and what each part of the sanity score needs and weighs.
LUMA = (0.2126, 0.7152, 0.0722)
WHITE, BLACK, LEAST_SIDE = 250, 8, 16
FULL_STD, FULL_CONTENT, FULL_ENTROPY, FULL_NOT_BLACK, FULL_TEXT = 36.0, 0.08, 4.0, 0.95, 120.0
SANITY_WEIGHTS = {"size": 0.20, "variation": 0.25, "content": 0.25, "entropy": 0.20, "not_black": 0.10}
TEXT_WEIGHT, SANE = 0.15, 0.65
# By how much a second rendering moves each channel of a text, and how far from that it may be.
SHIFT, TOLERANCE = 50, 8


def grey() -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(RGB, LUMA, strict=True)])


def _any(test) -> Column:
    return reduce(lambda a, b: a | b, [test(F.col(c)) for c in RGB]).cast("int")


def render_sanity(pixels: DataFrame, image: list[str], text_chars: DataFrame | None = None) -> DataFrame:
    """How far each picture is from blank: entropy, spread, shares of pixels and a score. text_chars: image, n of a page's visible text."""
    rows = pixels.withColumn("grey", grey())
    levels = rows.groupBy(*image, F.floor("grey").alias("level")).agg(F.count("*").alias("n"))
    total = levels.groupBy(*image).agg(F.sum("n").alias("total"))
    share = F.col("n") / F.col("total")
    entropy = levels.join(total, image).groupBy(*image).agg((-F.sum(share * F.log2(share))).alias("entropy"))
    colours = rows.groupBy(*image, *RGB).agg(F.count("*").alias("n")).groupBy(*image).agg((F.count("*") / F.sum("n")).alias("unique_colours"))
    parts = rows.groupBy(*image).agg(
        F.stddev_pop("grey").alias("grey_std"), F.avg(_any(lambda c: c < WHITE)).alias("non_white"), F.avg(_any(lambda c: c > BLACK)).alias("non_black"),
        (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"),
    )
    full = lambda c, at: F.least(F.col(c) / at, F.lit(1.0))
    reached = {
        "size": F.when((F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE), 1.0).otherwise(0.0), "variation": full("grey_std", FULL_STD),
        "content": full("non_white", FULL_CONTENT), "entropy": full("entropy", FULL_ENTROPY), "not_black": full("non_black", FULL_NOT_BLACK),
    }
    out = parts.join(entropy, image).join(colours, image)
    score = reduce(lambda a, b: a + b, [reached[k] * w for k, w in SANITY_WEIGHTS.items()])
    if text_chars is not None:
        out = out.join(text_chars, image, "left")
        text = F.least(F.coalesce(F.col("n"), F.lit(0)) / FULL_TEXT, F.lit(1.0))
        score = score * (1 - TEXT_WEIGHT) + text * TEXT_WEIGHT
    return out.withColumn("score", score).withColumn("passed", F.col("score") >= SANE)


def _both(a: DataFrame, b: DataFrame, image: list[str]) -> DataFrame:
    return a.select(*image, "x", "y", *RGB).join(b.select(*image, "x", "y", *(F.col(c).alias(f"{c}2") for c in RGB)), [*image, "x", "y"])


def errors(a: DataFrame, b: DataFrame, image: list[str]) -> DataFrame:
    """Mean absolute and mean squared error over the channels of the pixels of both pictures."""
    off = [F.col(c) - F.col(f"{c}2") for c in RGB]
    mean = lambda f: F.avg(reduce(lambda x, y: x + y, [f(d) for d in off]) / len(RGB))
    return _both(a, b, image).groupBy(*image).agg(mean(F.abs).alias("mae"), mean(lambda d: d * d).alias("mse"))


def recoloured(a: DataFrame, b: DataFrame, image: list[str]) -> DataFrame:
    """Pixels that a second rendering moved by the fixed shift in every channel; the shifted value goes round the end of the scale, its distance to the second does not."""
    moved = reduce(lambda x, y: x & y, [F.abs(F.pmod(F.col(c) + SHIFT, F.lit(256)) - F.col(f"{c}2")) <= TOLERANCE for c in RGB])
    return _both(a, b, image).where(moved).select(*image, "x", "y")

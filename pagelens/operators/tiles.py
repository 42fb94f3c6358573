"""Comparing pictures as tables of pixels: resizing, pixel match without smoothed edges, and clusters of differences.

Pictures are dense tables of pixels: image keys, x, y, r, g, b from 0 to 255, and a where
they have transparency. No step holds a picture: resizing takes strips of lines, the
stencil runs over tiles with a halo, and clusters are labelled in tiles and then joined
over the tiles' borders.

Defined cases: a picture that only one side has is left out; a pixel without a row is not
there, for its neighbours too; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelens.operators import raster
from pagelens.sources.checkpoints import cut

RGB = ("r", "g", "b")
TILE = 256
#: A stencil looks at the neighbours of a pixel's neighbours.
HALO = 2
# Least area of a cluster, and from which share of differing pixels on a difference is large.
CLUSTER_AREA, LARGE_SHARE = 64, 0.05


def _opaque(pixels: DataFrame) -> DataFrame:
    return pixels if "a" in pixels.columns else pixels.withColumn("a", F.lit(255))


def picture_sizes(pixels: DataFrame, image: list[str]) -> DataFrame:
    """image, width, height."""
    return pixels.groupBy(*image).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))


# --- resizing -----------------------------------------------------------------------------------------------

#: Lines of a picture that one task takes at a time.
STRIP = 64


@cache
def _taps(size_in: int, size_out: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return raster.resize_taps(size_in, size_out, kind)


def _resized_lines(rows: DataFrame, image: list[str], along: str, channels: list[str], kind: str) -> DataFrame:
    """Pixels, with the sizes before and after, resized along one axis: strips of lines, each a numpy array."""
    other, size_in, size_out = ("y", "width_in", "width") if along == "x" else ("x", "height_in", "height")

    def strip(table: pa.Table) -> pa.Table:
        at, line = table.column(along).to_numpy(), table.column(other).to_numpy()
        before, after = (int(table.column(c)[0].as_py()) for c in (size_in, size_out))
        if before == after:
            return table.drop_columns("__strip")
        top = int(line.min())
        values = np.zeros((before, int(line.max()) - top + 1, len(channels) + 1), dtype=np.int64)
        np.add.at(values, (at, line - top), np.stack([*(table.column(c).to_numpy() for c in channels), np.ones(len(at), np.int64)], axis=1))
        first, count, weights = _taps(before, after, kind)
        out = np.zeros((after, *values.shape[1:]), dtype=np.int64)
        for step in range(weights.shape[1]):
            by = np.where(step < count, weights[:, step], 0)[:, None]
            taken = values[np.minimum(first + step, before - 1)]
            out[..., :-1] += by[..., None] * taken[..., :-1]
            out[..., -1] += np.where((step < count)[:, None], taken[..., -1], 0)
        to, lines = np.nonzero(out[..., -1])  # where any pixel was
        found = np.clip((out[to, lines, :-1] + (1 << (raster.PRECISION - 1))) >> raster.PRECISION, 0, 255)
        new = {along: to, other: lines + top} | {c: found[:, i] for i, c in enumerate(channels)}
        rest = table.slice(0, 1).take(pa.array(np.zeros(len(to), np.int64)))
        return pa.table([pa.array(new[f.name]).cast(f.type) if f.name in new else rest.column(f.name) for f in schema_of(table)], names=[f.name for f in schema_of(table)])

    schema_of = lambda table: [f for f in table.schema if f.name != "__strip"]
    return rows.withColumn("__strip", F.floor(F.col(other) / STRIP)).groupBy(*image, "__strip").applyInArrow(strip, rows.schema)


def _sized(pixels: DataFrame, image: list[str], sizes: DataFrame, kind: str, own: DataFrame | None = None) -> DataFrame:
    """The pictures in the sizes of a table, and these as width and height. own: their sizes before, if known.

    Spark judges a table of pixels by the one it was made from, which can be far smaller: hints keep
    pixels from being sent whole to the driver and to each executor.
    """
    channels = [*RGB, "a"] if "a" in pixels.columns else list(RGB)
    own = (picture_sizes(pixels, image) if own is None else own).withColumnsRenamed({"width": "width_in", "height": "height_in"})
    both = own.join(sizes.select(*image, "width", "height"), image)
    rows = pixels.select(*image, "x", "y", *channels).join(both.hint("shuffle_hash"), image)
    change = (F.col("width_in") != F.col("width")) | (F.col("height_in") != F.col("height"))
    moved = rows.where(change)
    if "a" in channels:
        product = lambda c: F.col(c) * F.col("a") + 128
        moved = moved.withColumns({c: F.shiftright(F.shiftright(product(c), 8) + product(c), 8) for c in RGB})
    for along in "xy":
        moved = _resized_lines(moved, image, along, channels, kind)
    if "a" in channels:
        moved = moved.withColumns({c: F.when(F.col("a").isin(0, 255), F.col(c)).otherwise(F.least(F.lit(255), F.floor(255 * F.col(c) / F.col("a")))).cast("int") for c in RGB})
    names = [*image, "x", "y", *channels, "width", "height"]
    return rows.where(~change).select(*names).unionByName(moved.select(*names))


def resize(pixels: DataFrame, image: list[str], sizes: DataFrame, kind: str = "lanczos") -> DataFrame:
    """The pictures in the sizes of a table (image, width, height): by lanczos, bicubic, bilinear or box (area) weights.

    Lines first, then columns, each rounded to whole values. Transparent pixels weigh in by
    their opacity.
    """
    return _sized(pixels, image, sizes, kind).drop("width", "height")


def same_size(a: DataFrame, b: DataFrame, image: list[str], kind: str = "lanczos") -> DataFrame:
    """b in the sizes of a."""
    return resize(b, image, picture_sizes(a, image), kind)


# --- differences --------------------------------------------------------------------------------------------


def _alike(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both with opacity, if either has it."""
    return (_opaque(a), _opaque(b)) if "a" in a.columns or "a" in b.columns else (a, b)


def _with_size(a: DataFrame, b: DataFrame, image: list[str]) -> DataFrame:
    """b with width and height, the size of a's picture."""
    return b.join(picture_sizes(a, image).hint("shuffle_hash"), image)


def _difference(checkerboard: bool, clear: bool) -> Column:
    """Perceived difference of a pair of pixels, as in raster.pixel_difference; a transparent pixel shows a background. clear: there are such pixels."""
    at = (F.col("y") * F.col("width") + F.col("x")) * 4
    off = []
    for c, by in zip(RGB, raster.BACKGROUND, strict=True):
        plain = (F.col(c) - F.col(f"{c}2")).cast("double")
        if not clear:
            off.append(plain)
            continue
        behind = raster.BACK_DARK + raster.BACK_STEP * F.pmod(F.floor(at / by), F.lit(2)) if checkerboard else F.lit(255.0)
        seen = (F.col(c) * F.col("a") - F.col(f"{c}2") * F.col("a2") - behind * (F.col("a") - F.col("a2"))) / 255.0
        off.append(F.when((F.col("a") < 255) | (F.col("a2") < 255), seen).otherwise(plain))
    parts = [reduce(lambda s, v: s + v, [d * float(w) for d, w in zip(off, row, strict=True)]) for row in raster.YIQ]
    return reduce(lambda s, v: s + v, [p * p * float(w) for p, w in zip(parts, raster.YIQ_WEIGHT, strict=True)])


def _differing(a: DataFrame, b: DataFrame, image: list[str], threshold: float, checkerboard: bool) -> DataFrame:
    """image, x, y of differing pixels; b with width and height."""
    names = [*RGB, "a"] if "a" in a.columns else list(RGB)
    other = b.select(*image, "x", "y", "width", *(F.col(c).alias(f"{c}2") for c in names))
    pairs = a.select(*image, "x", "y", *names).join(other.hint("merge"), [*image, "x", "y"])
    return pairs.where(_difference(checkerboard, "a" in names) > raster.MOST * threshold * threshold).select(*image, "x", "y")


def differing_pixels(a: DataFrame, b: DataFrame, image: list[str], *, threshold: float = 0.1, checkerboard: bool = True) -> DataFrame:
    """image, x, y of the pixels whose perceived difference is over the threshold."""
    a, b = _alike(a, b)
    return _differing(a, _with_size(a, b, image), image, threshold, checkerboard)


def _difference_of(p: np.ndarray, q: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, checkerboard: bool) -> np.ndarray:
    """_difference of arrays of pixels (r, g, b, a), by the same steps."""
    clear = (p[..., 3] < 255) | (q[..., 3] < 255)
    off = [(p[..., c] - q[..., c]).astype(float) for c in range(3)]
    if clear.any():
        place = (y * width + x) * 4
        for c, by in enumerate(raster.BACKGROUND):
            behind = raster.BACK_DARK + raster.BACK_STEP * (np.floor(place / by) % 2) if checkerboard else 255.0
            off[c] = np.where(clear, (p[..., c] * p[..., 3] - q[..., c] * q[..., 3] - behind * (p[..., 3] - q[..., 3])) / 255.0, off[c])
    parts = [off[0] * row[0] + off[1] * row[1] + off[2] * row[2] for row in raster.YIQ]
    return reduce(lambda s, v: s + v, [v * v * w for v, w in zip(parts, raster.YIQ_WEIGHT, strict=True)])


def _marked(a: DataFrame, b: DataFrame, image: list[str], threshold: float, checkerboard: bool, tile: int) -> DataFrame:
    """image, x, y and aa of differing pixels; b with width and height. The pixels of both sides go once to their tiles, colours as one number."""
    names = [*RGB, "a"] if "a" in a.columns else list(RGB)
    colour = reduce(lambda s, c: s * 256 + F.col(c), names[1:], F.col(names[0]).cast("long"))
    whole = [F.col(c).cast("long").alias(f"__{c}") for c in "xy"]
    none = F.lit(0).cast("long")  # the width that marks a's pixels
    rows = a.select(*image, *whole, colour.alias("__c"), none.alias("__w"), none.alias("__h"))
    rows = rows.unionByName(b.select(*image, *whole, colour.alias("__c"), F.col("width").cast("long").alias("__w"), F.col("height").cast("long").alias("__h")))
    near = lambda c: F.array_distinct(F.array(*(F.floor((F.col(c) + by) / tile) for by in (-HALO, 0, HALO))))
    rows = rows.withColumn("__tx", F.explode(near("__x"))).withColumn("__ty", F.explode(near("__y")))
    schema = T.StructType([*(a.schema[k] for k in [*image, "x", "y"]), T.StructField("aa", T.BooleanType())])
    most = raster.MOST * threshold * threshold

    def stencil(table: pa.Table) -> pa.Table:
        x, y, c, w, h, tx, ty = (table.column(f"__{k}").to_numpy() for k in ("x", "y", "c", "w", "h", "tx", "ty"))
        second = w > 0
        left, top = x.min(), y.min()
        shape = (int(y.max() - top) + 1, int(x.max() - left) + 1)
        there, both = np.ones(shape, dtype=bool), []
        for own in (~second, second):
            at = (y[own] - top, x[own] - left)
            mine = np.zeros(shape, dtype=bool)
            mine[at] = True
            there &= mine
            picture = np.full((*shape, 4), 255, dtype=np.int64)
            for i, by in enumerate(range(8 * (len(names) - 1), -1, -8)):
                picture[..., i][at] = (c[own] >> by) & 255
            both.append(picture)
        size = (int(w.max()), int(h.max()))
        ys, xs = (np.arange(shape[0]) + top)[:, None], (np.arange(shape[1]) + left)[None, :]
        differs = there & (xs // tile == tx[0]) & (ys // tile == ty[0])
        if differs.any():
            differs &= _difference_of(*both, xs, ys, size[0], checkerboard) > most
        rows_, columns = np.nonzero(differs)
        smooth = raster.smoothed(*both, there, (int(left), int(top)), size, checkerboard)[rows_, columns] if len(rows_) else np.zeros(0, dtype=bool)
        keys = [table.column(k).slice(0, 1).take(pa.array(np.zeros(len(rows_), np.int64))) for k in image]
        return pa.table([*keys, pa.array(columns + left), pa.array(rows_ + top), pa.array(smooth)], names=[*image, "x", "y", "aa"])

    longs = T.StructType([f if f.name not in ("x", "y") else T.StructField(f.name, T.LongType()) for f in schema])
    found = rows.groupBy(*image, "__tx", "__ty").applyInArrow(stencil, longs)
    return found.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))


def marked_differences(a: DataFrame, b: DataFrame, image: list[str], *, threshold: float = 0.1, checkerboard: bool = True, tile: int = TILE) -> DataFrame:
    """differing_pixels with aa: whether the pixel belongs to a smoothed edge of either picture.

    Tiles are numpy arrays of at most (tile + 2 * HALO) ** 2 pixels.
    """
    a, b = _alike(a, b)
    return _marked(a, _with_size(a, b, image), image, threshold, checkerboard, tile)


def pixelmatch(a: DataFrame, b: DataFrame, image: list[str], *, threshold: float = 0.1, include_aa: bool = False, checkerboard: bool = True, tile: int = TILE) -> DataFrame:
    """Per picture of both: total_pixels, diff_pixels, aa_pixels, diff_ratio, score. b is resized to a; smoothed edges do not count unless include_aa."""
    a, b = _alike(a, b)
    own, sizes = picture_sizes(b, image), picture_sizes(a, image)
    b = _sized(b, image, sizes, "lanczos", own)
    marked = _differing(a, b, image, threshold, checkerboard).withColumn("aa", F.lit(False)) if include_aa else _marked(a, b, image, threshold, checkerboard, tile)
    counts = marked.groupBy(*image).agg(F.count_if(~F.col("aa")).alias("diff_pixels"), F.count_if("aa").alias("aa_pixels"))
    total = (F.col("width").cast("long") * F.col("height")).alias("total_pixels")
    out = sizes.join(own.select(*image), image, "left_semi").select(*image, total).join(counts, image, "left").fillna(0, ["diff_pixels", "aa_pixels"])
    return out.withColumn("diff_ratio", F.col("diff_pixels") / F.col("total_pixels")).withColumn("score", 1 - F.col("diff_ratio"))


# --- clusters -----------------------------------------------------------------------------------------------

_NEAR = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def _label_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first pixel of each pixel's region, by position in the arrays; x and y sorted by (y, x)."""
    width = int(x.max()) + 3 if len(x) else 3
    code = y * width + x + 1
    edges = []
    for dx, dy in ((1, 0), (-1, 1), (0, 1), (1, 1)):
        wanted = code + dy * width + dx
        at = np.minimum(np.searchsorted(code, wanted), len(code) - 1)
        hit = np.flatnonzero(code[at] == wanted)
        edges.append(np.stack([hit, at[hit]]))
    a, b = np.concatenate(edges, axis=1)
    label = np.arange(len(x))
    while len(a):
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _merged(edges: DataFrame, image: list[str]) -> DataFrame:
    """(image, region, root): the smallest region that each region of an edge hangs together with.

    Every region hooks itself to its smallest neighbour; chains of hooks are halved to their
    ends; the edges are carried over to the ends. Regions that stay open become fewer by more
    than half a round.
    """
    edges = cut(edges.select(*image, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    found = None
    while not edges.isEmpty():
        hooks = cut(edges.groupBy(*image, F.col("b").alias("region")).agg(F.min("a").alias("root")))
        while True:
            onward = hooks.select(*image, F.col("region").alias("root"), F.col("root").alias("next"))
            step = cut(hooks.join(onward, [*image, "root"], "left").select(*image, "region", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            hooks = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        if found is None:
            found = hooks
        else:
            later = hooks.select(*image, F.col("region").alias("root"), F.col("root").alias("next"))
            found = cut(found.join(later, [*image, "root"], "left").select(*image, "region", F.coalesce("next", "root").alias("root")).unionByName(hooks))
        ends = lambda side, h=hooks: h.select(*image, F.col("region").alias(side), F.col("root").alias(f"{side}_root"))
        moved = edges.join(ends("a"), [*image, "a"], "left").join(ends("b"), [*image, "b"], "left").select(*image, F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
        edges = cut(moved.select(*image, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    return found if found is not None else edges.select(*image, F.col("a").alias("region"), F.col("b").alias("root"))


def regions(marked: DataFrame, image: list[str], *, tile: int = TILE) -> DataFrame:
    """Connected regions (also over corners) of the pixels image, x, y: region, x, y, w, h, area. region is the code of its first pixel.

    Tiles are labelled one by one; of each only its regions and the pixels on its border go on.
    """
    keys = [*image, "__tx", "__ty"]
    rows = marked.select(*image, F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    rows = rows.withColumns({"__tx": F.floor(F.col("x") / tile), "__ty": F.floor(F.col("y") / tile)})
    numbers = ["region", "x0", "y0", "x1", "y1", "area"]
    schema = T.StructType([*(marked.schema[k] for k in image), *(T.StructField(c, T.LongType()) for c in numbers)])

    def label(table: pa.Table) -> pa.Table:
        x, y = (table.column(c).to_numpy() for c in ("x", "y"))
        order = np.lexsort((x, y))
        x, y = x[order], y[order]
        own = _label_of(x - x.min(), y - y.min())
        first, index, area = np.unique(own, return_inverse=True, return_counts=True)
        region = (y[first] << 32) | x[first]
        box = [np.full(len(first), v) for v in (1 << 40, 1 << 40, -1, -1)]
        for i, (values, least) in enumerate(((x, True), (y, True), (x, False), (y, False))):
            (np.minimum if least else np.maximum).at(box[i], index, values)
        # pixels on the tile's border follow as boxes of their own, with no area
        edge = np.flatnonzero((x % tile == 0) | (x % tile == tile - 1) | (y % tile == 0) | (y % tile == tile - 1))
        columns = [np.concatenate([region, region[index[edge]]]), *(np.concatenate([b, v[edge]]) for b, v in zip(box, (x, y, x, y), strict=True)), np.concatenate([area, np.zeros(len(edge), np.int64)])]
        keys_out = [table.column(k).slice(0, 1).take(pa.array(np.zeros(len(columns[0]), np.int64))) for k in image]
        return pa.Table.from_arrays([*keys_out, *map(pa.array, columns)], names=[*image, *numbers])

    parts = cut(rows.groupBy(*keys).applyInArrow(label, schema))
    border = parts.where("area = 0").select(*image, F.col("region").alias("a"), F.col("x0").alias("x"), F.col("y0").alias("y"))
    around = F.explode(F.array(*(F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in _NEAR)))
    beside = border.select(*image, F.col("a").alias("b"), around.alias("at")).select(*image, "b", "at.x", "at.y")
    roots = _merged(border.join(beside, [*image, "x", "y"]).where("a != b"), image)
    whole = parts.where("area > 0").join(roots, [*image, "region"], "left").withColumn("region", F.coalesce("root", "region"))
    boxes = whole.groupBy(*image, "region").agg(F.min("x0").alias("x"), F.min("y0").alias("y"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("area").alias("area"))
    return boxes.select(*image, "region", "x", "y", (F.col("x1") - F.col("x") + 1).alias("w"), (F.col("y1") - F.col("y") + 1).alias("h"), "area")


def _difference_regions(a: DataFrame, b: DataFrame, image: list[str], threshold: float, tile: int) -> DataFrame:
    plain = lambda d: d.select(*image, "x", "y", *RGB)
    a, b = plain(a), plain(b)
    return regions(_differing(a, _sized(b, image, picture_sizes(a, image), "lanczos"), image, threshold, True), image, tile=tile)


def difference_clusters(a: DataFrame, b: DataFrame, image: list[str], *, threshold: float = 0.1, least_area: int = CLUSTER_AREA, tile: int = TILE) -> DataFrame:
    """Clusters of differing pixels from least_area on: their box, area, share of the picture, and rank by area. b is resized to a."""
    found = _difference_regions(a, b, image, threshold, tile).where(F.col("area") >= least_area)
    total = picture_sizes(a, image).select(*image, (F.col("width").cast("long") * F.col("height")).alias("total"))
    rank = F.row_number().over(Window.partitionBy(*image).orderBy(F.col("area").desc(), "region"))
    return found.join(total, image).select(*image, rank.alias("rank"), "x", "y", "w", "h", "area", (F.col("area") / F.col("total")).alias("area_ratio"))


def tagged_differences(a: DataFrame, b: DataFrame, image: list[str], *, threshold: float = 0.1, least_area: int = CLUSTER_AREA, tile: int = TILE) -> DataFrame:
    """difference_tags of two pictures without opacity; their pixels meet once, as the regions of all differing pixels also tell their number."""
    found = _difference_regions(a, b, image, threshold, tile)
    sums = found.groupBy(*image).agg(F.sum("area").alias("diff_pixels"))
    total = (F.col("width").cast("long") * F.col("height")).alias("total_pixels")
    both = picture_sizes(a, image).join(b.select(*image).distinct(), image, "left_semi").select(*image, total)
    return difference_tags(both.join(sums, image, "left").fillna(0, ["diff_pixels"]), found.where(F.col("area") >= least_area), image)


def difference_tags(pictures: DataFrame, clusters: DataFrame, image: list[str]) -> DataFrame:
    """Per picture: diff_pixels, diff_ratio, cluster_count and tags. pictures: image, diff_pixels, total_pixels (pixelmatch with include_aa)."""
    counts = clusters.groupBy(*image).agg(F.count("*").alias("cluster_count"))
    rows = pictures.join(counts, image, "left").fillna(0, ["cluster_count"]).withColumn("diff_ratio", F.col("diff_pixels") / F.col("total_pixels"))
    tags = F.array_compact(F.array(F.when(F.col("diff_pixels") > 0, "visual_diff"), F.when(F.col("cluster_count") > 0, "visual_diff_cluster"), F.when(F.col("diff_ratio") >= LARGE_SHARE, "large_visual_diff")))
    return rows.select(*image, "diff_pixels", "diff_ratio", "cluster_count", tags.alias("tags"))

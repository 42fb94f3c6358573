"""Pixel kernels over decoded images, one pair a row, in Arrow batches.

An image is a binary column of RGB bytes, row by row, with its width and height; decoding
stands outside. Kernels are numpy inside a pandas function; Spark deals out the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights of red, green and blue in Y, I and Q, and of their squares in the difference.
YIQ = np.array([[0.29889531, 0.58662247, 0.11448223], [0.59597799, -0.27417610, -0.32180189], [0.21147017, -0.52261711, 0.31114694]])
YIQ_WEIGHT = np.array([0.5053, 0.299, 0.1957])
MOST = 35215.0
# The two shades of the checkerboard behind transparent pixels, and what a byte's place is divided by for red, green and blue.
BACK_DARK, BACK_STEP = 48.0, 159.0
BACKGROUND = (1.0, 1.618033988749895, 2.618033988749895)
# How far the resizing filters reach, and the bits of their weights.
SUPPORT = {"box": 0.5, "bilinear": 1.0, "bicubic": 2.0, "lanczos": 3.0}
PRECISION = 22


def _image(data: bytes, width: int, height: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8).reshape(height, width, 3)


def resize_taps(size_in: int, size_out: int, kind: str = "lanczos") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of size_out pixels the first that adds to it, how many do, and their whole-number weights in units of 2 ** -PRECISION, zeros behind."""
    scale = max(size_in / size_out, 1.0)
    center = (np.arange(size_out) + 0.5) * (size_in / size_out)
    reach = SUPPORT[kind] * scale
    first = np.maximum(0, np.trunc(center - reach + 0.5)).astype(np.int64)
    count = np.minimum(size_in, np.trunc(center + reach + 0.5)).astype(np.int64) - first
    step = np.arange(max(1, int(count.max())))[None, :]
    x = (first[:, None] + step - center[:, None] + 0.5) * (1 / scale)
    if kind == "box":
        w = ((x > -0.5) & (x <= 0.5)).astype(float)
    elif kind == "bilinear":
        w = np.maximum(0.0, 1 - np.abs(x))
    elif kind == "bicubic":
        v = np.abs(x)
        w = np.where(v < 1, (1.5 * v - 2.5) * v * v + 1, np.where(v < 2, (((v - 5) * v + 8) * v - 4) * -0.5, 0.0))
    else:
        w = np.where((x >= -3) & (x < 3), np.sinc(x) * np.sinc(x / 3), 0.0)
    w = np.where(step < count[:, None], w, 0.0)
    w = w / w.sum(axis=1, keepdims=True) * (1 << PRECISION)
    return first, count, np.where(w < 0, np.ceil(w - 0.5), np.floor(w + 0.5)).astype(np.int64)


def resize_matrix(size_in: int, size_out: int, kind: str = "lanczos") -> np.ndarray:
    """Whole-number weights, size_out x size_in, in units of 2 ** -PRECISION."""
    first, count, weights = resize_taps(size_in, size_out, kind)
    out = np.zeros((size_out, size_in), dtype=np.int64)
    to, step = np.nonzero(np.arange(weights.shape[1])[None, :] < count[:, None])
    out[to, first[to] + step] = weights[to, step]
    return out


def resized(a: np.ndarray, height: int, width: int, kind: str = "lanczos") -> np.ndarray:
    """A picture in another size: lines, then columns, each rounded to whole values."""
    half = 1 << (PRECISION - 1)
    out = a.astype(np.int64)
    if a.shape[1] != width:
        out = np.clip((np.einsum("oi,hic->hoc", resize_matrix(a.shape[1], width, kind), out) + half) >> PRECISION, 0, 255)
    if a.shape[0] != height:
        out = np.clip((np.einsum("oi,iwc->owc", resize_matrix(a.shape[0], height, kind), out) + half) >> PRECISION, 0, 255)
    return out.astype(np.uint8)


_AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def _neighbours(a: np.ndarray) -> np.ndarray:
    """For each place, along a new first axis, what stands around it; zeros beyond the edge."""
    h, w = a.shape[:2]
    wide = np.zeros((h + 2, w + 2, *a.shape[2:]), dtype=a.dtype)
    wide[1:-1, 1:-1] = a
    return np.stack([wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dx, dy in _AROUND])


def smoothed(a: np.ndarray, b: np.ndarray, there: np.ndarray, origin: tuple[int, int], size: tuple[int, int], checkerboard: bool = True) -> np.ndarray:
    """Which pixels of a part of two pictures (r, g, b, a) lie on a smoothed edge of either.

    A pixel does if at most two neighbours are as bright as it, one is darker and one brighter,
    and its darkest or its brightest neighbour has more than two equal neighbours in both
    pictures. The picture's own edge counts as one equal neighbour. there: the pixels that
    exist; origin: the part's first column and row; size: the picture's width and height.
    """
    h, w = there.shape
    x, y = np.arange(w)[None, :] + origin[0], np.arange(h)[:, None] + origin[1]
    edge = ((x == 0) | (x == size[0] - 1) | (y == 0) | (y == size[1] - 1)).astype(int)
    beside = _neighbours(there)
    place = (y * size[0] + x) * 4
    around = [_neighbours(p) for p in (a, b)]

    def has_equals(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return edge + (beside & (n == p).all(axis=3)).sum(axis=0) > 2

    equals = _neighbours(has_equals(a, around[0]) & has_equals(b, around[1]))

    def on_edge(p: np.ndarray, n: np.ndarray) -> np.ndarray:
        off = [(p[..., c] - n[..., c]).astype(float) for c in range(3)]
        clear = (p[..., 3] < 255) | (n[..., 3] < 255)
        if clear.any():
            clear &= (p != n).any(axis=3)
            back = [BACK_DARK + BACK_STEP * (np.floor(place / by) % 2) if checkerboard else np.full((h, w), 255.0) for by in BACKGROUND]
            off = [np.where(clear, (p[..., c] * p[..., 3] - n[..., c] * n[..., 3] - back[c] * (p[..., 3] - n[..., 3])) / 255.0, off[c]) for c in range(3)]
        delta = np.where(beside, off[0] * YIQ[0, 0] + off[1] * YIQ[0, 1] + off[2] * YIQ[0, 2], 0.0)
        zeroes = edge + (beside & (delta == 0)).sum(axis=0)
        at = lambda place: np.take_along_axis(equals, place[None], axis=0)[0]
        return (zeroes <= 2) & (delta.min(axis=0) < 0) & (delta.max(axis=0) > 0) & (at(delta.argmin(axis=0)) | at(delta.argmax(axis=0)))

    return on_edge(a, around[0]) | on_edge(b, around[1])


def pixel_difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Perceived difference of each pixel."""
    return ((a.astype(np.float64) - b.astype(np.float64)) @ YIQ.T) ** 2 @ YIQ_WEIGHT


def ssim(a: np.ndarray, b: np.ndarray, sigma: float = 1.5) -> float:
    """Mean structural similarity of two grey images under a gaussian window."""
    radius = int(3.5 * sigma + 0.5)
    kernel = np.exp(-(np.arange(-radius, radius + 1) ** 2) / (2 * sigma**2))
    kernel /= kernel.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            x = np.apply_along_axis(lambda v: np.convolve(np.pad(v, radius, mode="symmetric"), kernel, "valid"), axis, x)
        return x

    a, b = a.astype(np.float64), b.astype(np.float64)
    ma, mb = blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    c1, c2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma**2 + mb**2 + c1) * (va + vb + c2))).mean())


def largest_uniform_rectangle(mask: np.ndarray) -> int:
    """Area of the largest rectangle of true cells."""
    best, heights = 0, np.zeros(mask.shape[1], dtype=int)
    for row in mask:
        heights = np.where(row, heights + 1, 0)
        stack: list[tuple[int, int]] = []
        for i, h in enumerate([*heights.tolist(), 0]):
            start = i
            while stack and stack[-1][1] >= h:
                start, height = stack.pop()
                best = max(best, height * (i - start))
            stack.append((start, h))
    return best


def image_scores(pairs: DataFrame, key: str, threshold: float = 0.1) -> DataFrame:
    """key, pixelmatch, mse, ssim and size_match of pairs (a, aw, ah, b, bw, bh): b is resized to a; pixels on smoothed edges do not count as different."""

    def score(frames):
        for pdf in frames:
            out = []
            for r in pdf.itertuples(index=False):
                a, b = _image(r.a, r.aw, r.ah), _image(r.b, r.bw, r.bh)
                b = resized(b, r.ah, r.aw)
                differs = pixel_difference(a, b) > MOST * threshold**2
                if differs.any():
                    opaque = [np.concatenate([p.astype(np.int64), np.full((*p.shape[:2], 1), 255)], axis=2) for p in (a, b)]
                    differs &= ~smoothed(*opaque, np.ones(differs.shape, dtype=bool), (0, 0), (r.aw, r.ah))
                grey = np.array([0.299, 0.587, 0.114])
                out.append((1 - differs.mean(), ((a.astype(float) - b) ** 2).mean(), ssim(a @ grey, b @ grey), min(r.aw, r.bw) / max(r.aw, r.bw) * min(r.ah, r.bh) / max(r.ah, r.bh)))
            yield pd.concat([pdf[[key]].reset_index(drop=True), pd.DataFrame(out, columns=["pixelmatch", "mse", "ssim", "size_match"], dtype="float64")], axis=1)

    return pairs.select(key, "a", "aw", "ah", "b", "bw", "bh").mapInPandas(score, f"{key} {dict(pairs.dtypes)[key]}, pixelmatch double, mse double, ssim double, size_match double")


def colour_blocks(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Box and mean colour of each marked colour's pixels: pixels (keys, colour, x, y, r, g, b)."""
    return pixels.groupBy(*keys, "colour").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"),
        *[F.floor(F.avg(c)).cast("int").alias(c) for c in "rgb"], F.count("*").alias("pixels"),
    )


def delta_score(frames: DataFrame, keys: list[str], order: str) -> DataFrame:
    """1 less the error of the candidate's change since the first frame relative to the reference's, by channel sums.

    frames: keys, order, reference and candidate channel sums as arrays.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    based = frames.withColumns({"r0": F.first("reference").over(w), "c0": F.first("candidate").over(w)})
    change = lambda x, y: F.zip_with(x, y, lambda a, b: F.abs(a - b))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    dr, dc = change("reference", "r0"), change("candidate", "c0")
    scored = based.withColumns({"size": total(dr), "error": total(F.zip_with(dr, dc, lambda a, b: F.abs(a - b)))}).where("size > 0")
    return scored.groupBy(*keys).agg(F.avg(F.greatest(F.lit(0.0), 1 - F.col("error") / F.col("size"))).alias("delta_score"))

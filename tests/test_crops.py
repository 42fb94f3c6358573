"""Crops by boxes against slices of whole arrays."""

import numpy as np
import pytest

from pagelens.operators import crops, raster


def table(spark, pictures):
    rows = [(k, x, y, *map(int, p[y, x])) for k, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    return spark.createDataFrame(rows, "page string, x int, y int, r int, g int, b int").repartition(4)


def match(r, c):
    opaque = lambda p: np.concatenate([p.astype(np.int64), np.full((*p.shape[:2], 1), 255)], axis=2)
    c = raster.resized(c, *r.shape[:2])
    off = raster.pixel_difference(r, c) > raster.MOST * 0.01
    return 1 - (off & ~raster.smoothed(opaque(r), opaque(c), np.ones(off.shape, dtype=bool), (0, 0), (r.shape[1], r.shape[0]))).mean()


def test_block_scores(spark):
    rng = np.random.default_rng(2)
    ref = {p: rng.integers(0, 256, (20, 30, 3)) for p in ("a", "b", "only")}
    cand = {p: np.where(rng.random((20, 30, 1)) < 0.7, ref[p], rng.integers(0, 256, (20, 30, 3))) for p in ("a", "b")}
    boxes = [("a", 0, 0.1, 0.1, 0.4, 0.5, 0.1, 0.1, 0.4, 0.5), ("a", 1, 0.0, 0.0, 1.0, 1.0, 0.2, 0.3, 0.5, 0.5), ("a", 2, 0.9, 0.9, 0.5, 0.5, 0.5, 0.5, 0.25, 0.4), ("a", 3, 0.2, 0.2, 0.0, 0.3, 0.2, 0.2, 0.1, 0.3), ("a", 4, 1.2, 0.0, 0.3, 0.3, 0.0, 0.0, 0.3, 0.3)]
    boxes += [("b", 0, 0.5, 0.5, 0.001, 0.001, 0.5, 0.5, 0.001, 0.001), ("only", 0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 1.0, 1.0)]
    pairs = spark.createDataFrame([(*b, 0.5) for b in boxes], "page string, block int, rx double, ry double, rw double, rh double, cx double, cy double, cw double, ch double, covered double")

    def part(p, x, y, w, h):
        edge = lambda s, n: max(0, min(n, int(np.rint(s * n))))
        return p[edge(y, 20) : edge(y + h, 20), edge(x, 30) : edge(x + w, 30)]

    want = {}
    for page, block, *v in boxes:
        r, c = part(ref[page], *v[:4]), part(cand[page], *v[4:]) if page in cand else np.zeros((0, 0, 3))
        want[page, block] = match(r, c) if r.size and c.size else None
    a, b = table(spark, ref), table(spark, cand)
    got = {(r["page"], r["block"]): r["pixelmatch"] for r in crops.pair_pixelmatch(pairs, a, b, ["page"], "block", tile=7).collect()}
    assert got == pytest.approx(want) and sum(v is None for v in want.values()) == 4
    pages = {r["page"]: r for r in crops.block_scores(pairs, a, b, ["page"], "block").collect()}
    area = {b[1]: b[4] * b[5] for b in boxes if b[0] == "a"}
    mean = sum(want["a", i] * area[i] for i in range(3)) / sum(area[i] for i in range(3))
    assert pages["a"]["matched_pixelmatch"] == pytest.approx(mean) and pages["a"]["pixelmatch_score"] == pytest.approx(mean / 2)
    assert (pages["a"]["pair_count"], pages["a"]["scored_pair_count"]) == (5, 3) and pages["b"]["matched_pixelmatch"] == 0 and pages["only"]["scored_pair_count"] == 0
    assert crops.block_scores(pairs.limit(0), a, b, ["page"], "block").count() == 0

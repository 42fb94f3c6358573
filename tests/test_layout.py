"""The largest blank rectangle against trying every rectangle."""

import numpy as np
import pytest

from pagelens.operators import layout, raster


def every_rectangle(band):
    best = None
    h, w = band.shape
    for bottom in range(h):
        for top in range(bottom + 1):
            for left in range(w):
                for right in range(left + 1, w + 1):
                    part = band[top : bottom + 1, left:right]
                    if (part == part[0, 0]).all():
                        key = (part.size, -part[0, 0], -bottom, -right, bottom + 1 - top)
                        best = max(best or key, key)
    area, shade, bottom, right, tall = best
    return (-shade, -right - area // tall, -bottom - tall + 1, area // tall, tall, area)


def table(spark, pictures):
    return spark.createDataFrame([(k, x, y, int(p[y, x])) for k, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])], "image string, x int, y int, band int").repartition(4)


def test_largest_rectangles(spark, monkeypatch):
    monkeypatch.setattr(layout, "STRIP", 3)
    rng = np.random.default_rng(12)
    pictures = {f"p{i}": rng.integers(0, 1 + i % 4, (rng.integers(1, 9), rng.integers(1, 9))) for i in range(30)} | {"stairs": np.tri(7, 9, dtype=int), "line": np.zeros((1, 8), int)}
    got = {r["image"]: tuple(r)[1:] for r in layout.largest_rectangles(table(spark, pictures), ["image"]).collect()}
    assert got == {k: every_rectangle(p) for k, p in pictures.items()}
    for p in pictures.values():
        assert max(raster.largest_uniform_rectangle(p == v) for v in np.unique(p)) == every_rectangle(p)[-1]
    hole = spark.createDataFrame([("h", x, y, 0) for x in range(5) for y in range(5) if (x, y) != (2, 2)], "image string, x int, y int, band int")
    assert layout.largest_rectangles(hole, ["image"]).first()["area"] == 10
    assert layout.largest_rectangles(hole.limit(0), ["image"]).count() == 0


def test_sparsity(spark):
    rows = [("white", x, y, 255, 255, 255) for x in range(10) for y in range(10)] + [("half", x, y, *([0] * 3 if y < 5 else [255] * 3)) for x in range(10) for y in range(10)]
    rows += [("mixed", x, y, *([255 * ((x + y) % 2)] * 3)) for x in range(10) for y in range(10)]
    pixels = spark.createDataFrame(rows, "image string, x int, y int, r int, g int, b int")
    got = {r["image"]: r for r in layout.layout_sparsity(pixels, ["image"]).collect()}
    assert got["white"]["score"] == 0 and got["white"]["tags"] == ["large_blank_region"]
    assert got["half"]["score"] == pytest.approx(50**0.5 * 10) and (got["half"]["x"], got["half"]["y"], got["half"]["w"], got["half"]["h"]) == (0, 0, 10, 5)
    assert got["mixed"]["sparsity_rate"] == 1 and got["mixed"]["tags"] == []


def test_shrink(spark):
    values = np.arange(7 * 11).reshape(7, 11) * 3 % 251
    shades = spark.createDataFrame([("a", x, y, int(values[y, x])) for x in range(11) for y in range(7)] + [("b", x, 0, 9) for x in range(4)], "image string, x int, y int, shade int")
    out = layout.shrink(shades, ["image"], 4).collect()
    fine = np.repeat(np.repeat(values, 2, axis=0), 4, axis=1).reshape(2, 7, 4, 11).mean(axis=(1, 3))  # 11 x 7 in 4 x 2, by quarters and halves of pixels
    got = {(r["x"], r["y"]): r["shade"] for r in out if r["image"] == "a"}
    assert got == {(x, y): int(np.rint(fine[y, x])) for y in range(2) for x in range(4)}
    assert {(r["width"], r["new_width"]) for r in out} == {(11, 4), (4, 4)}

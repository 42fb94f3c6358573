"""Pixel tables against plain loops over whole pictures, with tiles far smaller than the pictures."""

import math
from collections import deque

import numpy as np
import pytest

from pagelens.operators import raster, tiles


def picture(rng, height, width, alpha=False):
    """Flat areas, smooth edges and some noise, so that every branch of the edge rule is met."""
    y, x = np.mgrid[0:height, 0:width]
    cover = np.clip(rng.uniform(3, 7) - np.hypot(x - rng.uniform(0, width), y - rng.uniform(0, height)) + 0.5, 0, 1)[..., None]
    out = np.floor(240 + (np.array([20, 60, 10]) - 240) * cover + 0.5).astype(int)
    noisy = rng.random((height, width)) < 0.1
    out[noisy] = rng.choice([0, 80, 255], (noisy.sum(), 3))
    a = rng.choice([0, 120, 255], (height, width, 1), p=[0.1, 0.1, 0.8]) if alpha else np.full((height, width, 1), 255)
    return np.concatenate([out, a], axis=2)


def table(spark, pictures, alpha=True):
    rows = [(name, x, y, *map(int, p[y, x])) for name, p in pictures.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    out = spark.createDataFrame(rows, "image string, x int, y int, r int, g int, b int, a int").repartition(5)
    return out if alpha else out.drop("a")


def back(place, on):
    return [48.0 + 159.0 * (int(place / by) % 2) if on else 255.0 for by in (1, 1.618033988749895, 2.618033988749895)]


def seen(p, q, place, on):
    if (p == q).all():
        return [0.0] * 3
    if p[3] < 255 or q[3] < 255:
        return [(int(p[c]) * int(p[3]) - int(q[c]) * int(q[3]) - back(place, on)[c] * (int(p[3]) - int(q[3]))) / 255 for c in range(3)]
    return [float(p[c] - q[c]) for c in range(3)]


def plain_match(a, b, on=True):
    """Differing and smoothed pixels, one pixel at a time."""
    h, w = a.shape[:2]
    near = lambda x, y: [(i, j) for i in range(max(0, x - 1), min(w, x + 2)) for j in range(max(0, y - 1), min(h, y + 2)) if (i, j) != (x, y)]
    rim = lambda x, y: int(x in (0, w - 1) or y in (0, h - 1))
    siblings = lambda p, x, y: rim(x, y) + sum((p[j, i] == p[y, x]).all() for i, j in near(x, y)) > 2

    def smooth(p, q, x, y):
        deltas = [(sum(d * k for d, k in zip(seen(p[y, x], p[j, i], (y * w + x) * 4, on), raster.YIQ[0], strict=True)), i, j) for i, j in near(x, y)]
        if rim(x, y) + sum(d == 0 for d, _, _ in deltas) > 2:
            return False
        low, high = min(deltas, key=lambda t: t[0]), max(deltas, key=lambda t: t[0])
        return low[0] < 0 < high[0] and any(siblings(p, i, j) and siblings(q, i, j) for _, i, j in (low, high))

    differ, marked = set(), set()
    for y in range(h):
        for x in range(w):
            yiq = raster.YIQ @ np.array(seen(a[y, x], b[y, x], (y * w + x) * 4, on))
            if (yiq**2 * raster.YIQ_WEIGHT).sum() > 35215 * 0.01:
                differ.add((x, y))
                if smooth(a, b, x, y) or smooth(b, a, x, y):
                    marked.add((x, y))
    return differ, marked


@pytest.mark.parametrize("alpha", [False, True])
def test_pixelmatch_ignores_smoothed_edges(spark, alpha):
    rng = np.random.default_rng(11 + alpha)
    first = {f"p{i}": picture(rng, 14 + i, 19 - i, alpha) for i in range(4)}
    second = {k: np.where(rng.random(p.shape[:2])[..., None] < 0.5, p, picture(rng, *p.shape[:2], alpha)) for k, p in first.items()}
    first["equal"] = second["equal"] = first["p0"]
    first["alone"] = first["p1"]
    a, b = table(spark, first, alpha), table(spark, second, alpha)
    seen_both = [0, 0]
    for on in (True, False):
        want = {k: plain_match(first[k], second[k], on) for k in second}
        got = {k: (set(), set()) for k in second}
        for r in tiles.marked_differences(a, b, ["image"], checkerboard=on, tile=5).collect():
            got[r["image"]][0].add((r["x"], r["y"]))
            if r["aa"]:
                got[r["image"]][1].add((r["x"], r["y"]))
        assert got == want
        scores = {r["image"]: r for r in tiles.pixelmatch(a, b, ["image"], checkerboard=on, tile=7).collect()}
        assert set(scores) == set(second)
        for k, (differ, marked) in want.items():
            r = scores[k]
            assert (r["diff_pixels"], r["aa_pixels"], r["total_pixels"]) == (len(differ - marked), len(marked), first[k].shape[0] * first[k].shape[1])
            assert r["score"] == pytest.approx(1 - len(differ - marked) / r["total_pixels"])
            seen_both = [seen_both[0] + len(marked), seen_both[1] + len(differ - marked)]
    assert min(seen_both) > 50
    assert scores["equal"]["score"] == 1
    assert tiles.pixelmatch(a.limit(0), b, ["image"]).count() == 0


@pytest.mark.parametrize("kind", ["lanczos", "box", "bilinear", "bicubic"])
def test_resize(spark, kind):
    rng = np.random.default_rng(5)
    sizes = {"down": (17, 23, 6, 9), "up": (7, 5, 16, 21), "wider": (8, 6, 8, 13), "lower": (11, 6, 4, 6), "same": (5, 4, 5, 4), "one": (9, 9, 1, 1)}
    pictures = {k: rng.integers(0, 256, (h, w, 4)) for k, (h, w, _, _) in sizes.items()}
    target = spark.createDataFrame([(k, w, h) for k, (_, _, h, w) in sizes.items()], "image string, width int, height int")
    out = tiles.resize(table(spark, pictures, alpha=False), ["image"], target, kind).collect()
    got = {k: np.full((h, w, 3), -1) for k, (_, _, h, w) in sizes.items()}
    for r in out:
        got[r["image"]][r["y"], r["x"]] = r["r"], r["g"], r["b"]
    assert len(out) == sum(h * w for _, _, h, w in sizes.values())
    for k, (_, _, h, w) in sizes.items():
        assert (got[k] == raster.resized(pictures[k][..., :3], h, w, kind)).all(), k
    flat = raster.resized(np.full((9, 9, 3), 77), 4, 14, kind)
    assert (flat == 77).all()


def test_resize_by_hand(spark):
    row = np.array([[[0], [100], [200], [40]]]).repeat(3, axis=2)
    assert raster.resized(row, 1, 2, "box")[0, :, 0].tolist() == [50, 120]
    assert raster.resized(row[:, :2], 1, 4, "bilinear")[0, :, 0].tolist() == [0, 25, 75, 100]
    # a transparent pixel's colour does not bleed into its neighbour
    pair = np.array([[[200, 100, 50, 255], [0, 255, 0, 0]]])
    target = spark.createDataFrame([("p", 1, 1)], "image string, width int, height int")
    assert [tuple(r)[3:] for r in tiles.resize(table(spark, {"p": pair}), ["image"], target, "box").collect()] == [(199, 99, 49, 128)]


def test_pixelmatch_resizes(spark):
    rng = np.random.default_rng(3)
    a, b = picture(rng, 18, 15), picture(rng, 9, 21)
    want = plain_match(a, np.concatenate([raster.resized(b[..., :3], 18, 15), np.full((18, 15, 1), 255)], axis=2))
    r = tiles.pixelmatch(table(spark, {"p": a}, False), table(spark, {"p": b}, False), ["image"], tile=6).first()
    assert (r["diff_pixels"], r["aa_pixels"]) == (len(want[0] - want[1]), len(want[1]))
    both = tiles.pixelmatch(table(spark, {"p": a}, False), table(spark, {"p": b}, False), ["image"], include_aa=True).first()
    assert (both["diff_pixels"], both["aa_pixels"]) == (len(want[0]), 0)
    rows = spark.createDataFrame([(1, bytearray(a[..., :3].astype(np.uint8).tobytes()), 15, 18, bytearray(b[..., :3].astype(np.uint8).tobytes()), 21, 9)], "id int, a binary, aw int, ah int, b binary, bw int, bh int")
    assert raster.image_scores(rows, "id").first()["pixelmatch"] == pytest.approx(r["score"])


def flood(points):
    left, out = set(points), []
    while left:
        queue, part = deque([left.pop()]), []
        while queue:
            x, y = queue.popleft()
            part.append((x, y))
            for n in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    queue.append(n)
        xs, ys = [p[0] for p in part], [p[1] for p in part]
        fy, fx = min((p[1], p[0]) for p in part)
        out.append(((fy << 32) | fx, min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, len(part)))
    return sorted(out)


def test_regions_over_tile_borders(spark):
    rng = np.random.default_rng(9)
    spiral = {(round(r * math.cos(r)) + 40, round(r * math.sin(r)) + 40) for r in np.arange(0, 38, 0.01)}
    pictures = {"noise": {(int(x), int(y)) for x, y in rng.integers(0, 40, (500, 2))}, "spiral": spiral, "diagonal": {(i, i) for i in range(30)}, "line": {(i, 3) for i in range(64)}, "far": {(100_000, 5), (100_001, 6), (3, 70_000)}, "dots": {(4 * i, 4 * j) for i in range(5) for j in range(5)}}
    rows = [(k, x, y) for k, p in pictures.items() for x, y in p] + [("line", 3, 3)]
    marked = spark.createDataFrame(rows, "image string, x int, y int").repartition(3)
    for tile in (4, 256):
        got = {k: [] for k in pictures}
        for r in tiles.regions(marked, ["image"], tile=tile).collect():
            got[r["image"]].append(tuple(r)[1:])
        assert {k: sorted(v) for k, v in got.items()} == {k: flood(p) for k, p in pictures.items()}
    assert tiles.regions(marked.limit(0), ["image"]).count() == 0


def test_difference_clusters(spark):
    a = {k: np.full((20, 30, 4), 255) for k in ("blocks", "none", "few")}
    b = {k: p.copy() for k, p in a.items()}
    b["blocks"][2:12, 2:10] = 0, 0, 0, 255
    b["blocks"][3:18, 15:29] = 200, 0, 0, 255
    b["blocks"][19, 0] = b["few"][4, 4] = 0
    a, b = table(spark, a, False), table(spark, b, False)
    clusters = tiles.difference_clusters(a, b, ["image"], tile=8)
    assert sorted(tuple(r)[1:7] for r in clusters.collect()) == [(1, 15, 3, 14, 15, 210), (2, 2, 2, 8, 10, 80)]
    tags = {r["image"]: r for r in tiles.difference_tags(tiles.pixelmatch(a, b, ["image"], include_aa=True), clusters, ["image"]).collect()}
    assert tags["blocks"]["tags"] == ["visual_diff", "visual_diff_cluster", "large_visual_diff"] and tags["blocks"]["diff_pixels"] == 291
    assert tags["none"]["tags"] == [] and tags["few"]["tags"] == ["visual_diff"] and tags["few"]["cluster_count"] == 0

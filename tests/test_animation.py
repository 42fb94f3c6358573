"""Animation pairs against plain loops over both timelines."""

import math

import numpy as np
import pytest

from pagelens.operators import animation, raster

FRAME = "id string, side string, target int, frame int, name string, channels array<string>, x double, y double, w double, h double, style map<string,string>, top double, right double, bottom double, left double"


def frame(id_, side, target, n, x=0.0, y=0.0, channels=("motion", "color"), style=None, w=100.0, h=100.0, border=1.0):
    return (id_, side, target, n, f"t{target}", list(channels), None if x is None else float(x), float(y), w, h, style or {}, border, border, border, border)


def rgb(*v):
    return f"rgb({v[0]}, {v[1]}, {v[2]})"


def test_known_timelines(spark):
    move = lambda id_, r, c: [frame(id_, s, 0, 10 * n, *at, channels=["motion"]) for s, way in (("reference", r), ("candidate", c)) for n, at in enumerate(way)]
    rows = move("same", [(0, 0), (100, 0)], [(10, 10), (110, 10)]) + move("turned", [(0, 0), (100, 0)], [(0, 0), (0, 100)])
    rows += move("stays", [(0, 0), (0, 0)], [(0, 0), (40, 0)]) + move("still", [(0, 0), (0, 0)], [(10, 10), (10, 10)]) + move("short", [(0, 0), (100, 0), (500, 0)], [(0, 0), (100, 0)])
    rows += [frame("alone", "reference", 0, 0), frame("half", "reference", 0, 0), frame("half", "candidate", 0, 0), frame("half", "reference", 1, 0)]
    paint = lambda id_, r, c, prop="color", **how: [frame(id_, s, 0, n, channels=["color"], style={prop: v}, **how) for s, way in (("reference", r), ("candidate", c)) for n, v in enumerate(way)]
    rows += paint("bases", [rgb(0, 0, 0), rgb(10, 0, 0)], [rgb(50, 0, 0), rgb(60, 0, 0)]) + paint("unchanged", [rgb(0, 0, 0), rgb(10, 0, 0)], [rgb(0, 0, 0), rgb(0, 0, 0)])
    rows += paint("exact", ["scale(1)", "scale(2)"], ["scale(1)", "scale(3)"], prop="transform")
    for n, (a, b) in enumerate([((0, 0, 0), (0, 0, 0)), ((200, 0, 0), (0, 200, 0))]):  # only the border follows
        for side, fill in (("reference", a), ("candidate", b)):
            rows.append(frame("border", side, 0, n, channels=["color"], style={"background-color": rgb(*fill), "border-color": rgb(*a)}))
    table = spark.createDataFrame(rows, FRAME).repartition(3)
    got = {r["id"]: r for r in animation.animation_pairs(table, ["id"]).collect()}
    assert {k: got[k]["motion_delta"] for k in ("same", "turned", "stays", "still", "short")} == {"same": 1, "turned": 0, "stays": 0, "still": 1, "short": 1}
    assert (got["alone"]["status"], got["alone"]["reason"], got["alone"]["score"]) == ("unsupported", "animation_timeline_missing", 0)
    assert got["bases"]["color_delta"] == 1 and got["unchanged"]["color_delta"] == 0 and got["exact"]["color_delta"] == 0.5
    assert got["border"]["color_delta"] == pytest.approx(0.0396)
    targets = {(r["id"], r["target"]): r for r in animation.animation_targets(table, ["id"]).collect()}
    assert targets["half", 1]["channels"] == [] and targets["half", 1]["motion_delta"] is None and targets["half", 0]["channels"] == ["color", "motion"]
    assert animation.animation_pairs(table.limit(0), ["id"]).count() == 0


def test_frames_without_a_box(spark):
    rows = [frame("a", s, 0, n, x=5.0 * n, channels=["motion"]) for s in animation.SIDES for n in range(4)]
    rows[1] = frame("a", "reference", 0, 1, x=None, channels=["motion"])
    r = animation.animation_targets(spark.createDataFrame(rows, FRAME), ["id"]).first()
    assert r["bbox_iou"] == pytest.approx(3 / 4) and r["motion_delta"] == 1
    rows[1], rows[6] = frame("a", "reference", 0, 1, x=5.0, channels=["motion"]), frame("a", "candidate", 0, 2, x=None, channels=["motion"])
    assert animation.animation_targets(spark.createDataFrame(rows, FRAME), ["id"]).first()["motion_delta"] == 1


def test_crops(spark):
    rng = np.random.default_rng(4)
    shapes = {"reference": [(10, 12), (10, 12), (9, 12)], "candidate": [(7, 8), (10, 12), (10, 12)]}
    crops = {s: [rng.integers(0, 256, (*hw, 3)) if n != 1 else np.full((*hw, 3), 90) for n, hw in enumerate(v)] for s, v in shapes.items()}
    crops["candidate"][2][:6] = crops["reference"][2][:6]
    frames = spark.createDataFrame([frame("a", s, 0, 7 * n, channels=["color"]) for s in animation.SIDES for n in range(3)], FRAME)
    pixels = [("a", s, 0, 7 * n, x, y, *map(int, p[y, x])) for s, v in crops.items() for n, p in enumerate(v) for y in range(p.shape[0]) for x in range(p.shape[1])]
    table = spark.createDataFrame(pixels, "id string, side string, target int, frame int, x int, y int, r int, g int, b int")
    got = animation.animation_targets(frames, ["id"], crops=table).first()

    opaque = lambda p: np.concatenate([p.astype(np.int64), np.full((*p.shape[:2], 1), 255)], axis=2)
    match, delta = [], []
    for r, c in zip(crops["reference"], crops["candidate"], strict=True):
        even = raster.resized(c, *r.shape[:2])
        off = raster.pixel_difference(r, even) > raster.MOST * 0.01
        off &= ~raster.smoothed(opaque(r), opaque(even), np.ones(off.shape, dtype=bool), (0, 0), (r.shape[1], r.shape[0]))
        match.append(1 - off.mean())
        base = [raster.resized(crops[s][0], 10, 12, "bicubic").astype(int) for s in animation.SIDES]
        dr, dc = (np.abs(raster.resized(p, 10, 12, "bicubic").astype(int) - b) for p, b in zip((r, c), base, strict=True))
        if dr.sum() > 1:
            delta.append(max(0.0, 1 - np.abs(dr - dc).sum() / dr.sum()))
    assert len(delta) == 2 and math.isclose(got["target_box_pixelmatch"], np.mean(match)) and math.isclose(got["target_box_delta_pixelmatch"], np.mean(delta))

"""Routes, answers, animations, merged blocks, trees and reports on small cases."""

import json
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.functions import paths, style
from pagelens.operators import manifest, matching, pixels, summary, trees, validate


def test_paths(spark):
    base = "https://h.example/a/b/c.html?q=1#f"
    cases = {
        "d.html": "/a/b/d.html", "./d": "/a/b/d", "../d": "/a/d", "../../../d": "/d", "/x/./y/../z": "/x/z", "?p=2": "/a/b/c.html?p=2", "#g": "/a/b/c.html?q=1", "": None, "tel:1": None,
        "//h.example/k": "/k", "//o.example/k": None, "https://h.example": "/", "ftp://h.example/k": None, "..": "/a/", None: None,
    }
    rows = spark.createDataFrame(list(cases.items()), "href string, want string")
    out = rows.select("href", "want", paths.discovered_path(F.lit(base), F.col("href")).alias("path")).collect()
    assert [(r["href"], r["path"]) for r in out] == [(r["href"], r["want"]) for r in out]
    names = spark.createDataFrame([("/a/index.html", "home"), ("/", "home"), ("/x.tar.gz", "x.tar"), ("/work?x=1.2", "work")], "p string, want string")
    assert all(r["n"] == r["want"] for r in names.select("want", paths.page_name(F.col("p")).alias("n")).collect())


def test_json_answers(spark):
    cases = [('so {"a": "}"} it is {', '{"a": "}"}'), ('```JSON\n{"b": 1}\n```', '{"b": 1}'), ('{"a": {"b": 2}} {"c": 3}', '{"a": {"b": 2}} {"c": 3}'), ("none", None), ('x {"a": 1', None), (None, None), ('y {"q": "\\"{"} z', '{"q": "\\"{"}')]
    rows = spark.createDataFrame(cases, "said string, want string")
    out = rows.select("want", paths.json_payload("said").alias("got"), paths.sorted_json(paths.json_payload("said")).alias("sorted")).collect()
    assert all(r["got"] == r["want"] for r in out)
    assert out[0]["sorted"] == json.dumps({"a": "}"}) and out[2]["sorted"] is None


def test_animations(spark):
    rows = [(1, 0, "x", "/p", "click", "#a", 0, [5, 5]), (1, 1, "x", "/p", "wait", None, 90, [0, 30]), (1, 2, "y", "/q", "click", "#a", 0, None), (1, 3, "", "p", "drag", "#a", 0, None), (1, 4, "z", "/p", "hover", "#no", 0, None), (1, 5, "z", "/p", "hover", None, 0, None), (1, 6, "t", "/p", "wait", None, 0, None)]
    animations = spark.createDataFrame(rows, "site int, pos int, id string, path string, trigger string, trigger_selector string, duration long, samples array<long>")
    targets = spark.createDataFrame([(1, i, 0, None, "#a", ["color", "odd"], None) for i in range(6)] + [(1, 6, 0, "n", "#a", ["odd"], ["left"]), (1, 0, 1, "n", "#no", ["motion"], None)], "site int, pos int, place int, name string, selector string, channels array<string>, track array<string>")
    found = (spark.createDataFrame([("/p",)], "path string"), spark.createDataFrame([("/p", "#a", 1)], "path string, selector string, count long"))
    kept, diagnostics = manifest.sanitize_animations(animations, targets, *found)
    out = {r["pos"]: r for r in kept.collect()}
    assert {i: r["id"] for i, r in out.items()} == {0: "x", 1: "x-2", 3: "p.animation.3"}
    assert (out[0]["samples"], out[0]["duration"]) == ([0, 200, 400, 600], 600) and (out[1]["samples"], out[1]["duration"]) == ([0, 30], 90)
    assert out[3]["trigger"] == "click" and out[0]["targets"][0]["track"] == list(manifest.COLOUR_TRACK) and out[0]["targets"][0]["channels"] == ["color"] and len(out[0]["targets"]) == 1
    assert {r["pos"]: r["reason"] for r in diagnostics.collect()} == {0: None, 1: None, 2: "path_not_found", 3: None, 4: "trigger_selector_invalid", 5: "trigger_selector_missing", 6: "no_valid_targets"}


def test_context_and_gain():
    cost = -np.array([[0.9, 0.1, 0.2], [0.3, 0.8, 0.4], [0.2, 0.1, 0.7]])
    out = matching.with_context(cost, 0.5, 1)
    # the two cheapest other cells around each likely pair
    assert out[0, 0] == pytest.approx(-0.9 + 0.5 * (-0.8 - 0.3)) and out[1, 1] == pytest.approx(-0.8 + 0.5 * (-0.9 - 0.7)) and out[0, 1] == cost[0, 1]
    assert matching.gain([-0.5, -0.2], [-0.5, -0.9]) == pytest.approx(0.7) and matching.gain([-0.3], [-0.3]) == 0
    assert matching.gain([-0.1, -0.9], [-0.8, -0.8]) == 0.0 and matching.gain([-0.9], [-0.1]) == pytest.approx(-0.8)


def test_merged_blocks(spark):
    assert matching.merged_sides(["Hello big", "wide world", "other text"], ["Hello big wide world", "other text"])[0] == [[0, 1], [2]]
    rows = [(1, "reference", 0, "Hello big"), (1, "reference", 1, "wide world"), (1, "reference", 2, "other text"), (1, "candidate", 0, "Hello big wide world"), (1, "candidate", 1, "other text"), (2, "reference", 0, None)]
    out = matching.match_merged_blocks(spark.createDataFrame(rows, "g int, side string, pos int, text string"), group="g").collect()
    assert sorted((tuple(r["reference_pos"]), tuple(r["candidate_pos"]), r["similarity"]) for r in out) == [((0, 1), (0,), 1.0), ((2,), (1,), 1.0)]


def plain_merges(a, b, least=0.05):
    """Every trial from the beginning: joined texts, the whole table of ratios, the whole assignment."""

    def costs(a, b):
        table = -np.array([[SequenceMatcher(None, x, y).ratio() for y in b] for x in a])
        return [float(table[i, j]) for i, j in matching.assign(table)]

    def one_side(own, now, cost):
        gains = [(matching.gain(now, cost([*own[:i], f"{own[i]} {own[i + 1]}", *own[i + 2 :]])), i) for i in range(len(own) - 1)]
        out, gone = list(own), set()
        for g, i in sorted((x for x in gains if x[0] > least), key=lambda x: (-x[0], x[1])):
            if not {i, i + 1} & gone:
                gone |= {i, i + 1}
                out[i], out[i + 1] = f"{own[i]} {own[i + 1]}", None
        return [x for x in out if x is not None]

    while True:
        before = len(a), len(b)
        a = one_side(a, costs(a, b), lambda x, b=b: costs(x, b))
        b = one_side(b, costs(a, b), lambda x, a=a: costs(a, x))
        if before == (len(a), len(b)):
            return a, b


def test_sides_take_turns():
    rng = np.random.default_rng(5)
    words = ["alpha", "beta", "gamma", "delta", "omega", "kappa", "sigma", "zeta", "theta", "iota"]
    merged = 0
    for n in range(1, 13):
        line = [words[i] + words[j] for i, j in rng.integers(0, 10, (3 * n, 2))]
        sides = []
        for _ in range(2):
            cuts = sorted({0, len(line), *rng.integers(0, len(line), n).tolist()})
            sides.append([" ".join(line[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)])
        left, right, sim = matching.merged_sides(*sides)
        got = tuple([" ".join(side[i] for i in g) for g in groups] for side, groups in zip(sides, (left, right), strict=True))
        assert got == tuple(plain_merges(*sides))
        assert sim.tolist() == [[SequenceMatcher(None, x, y).ratio() for y in got[1]] for x in got[0]]
        merged += len(left) + len(right) < sum(map(len, sides))
    assert merged > 5
    assert matching.merged_sides([], ["x"])[:2] == ([], [[0]])


def test_ordered_resolution(spark):
    box = (0.1, 0.1, 0.2, 0.1)
    items = spark.createDataFrame([(1, 0, "alpha", *box), (1, 1, "alpha", *box), (1, 2, "zzz", *box), (2, 0, "alone", *box)], "g int, pos int, text string, x double, y double, w double, h double")
    elements = spark.createDataFrame([(1, 0, "alpha", *box), (1, 1, "", *box), (1, 2, "alphas", *box)], "g int, node int, text string, x double, y double, w double, h double")
    out = {(r["g"], r["pos"]): (r["node"], r["score"]) for r in matching.resolve_in_order(items, elements, group="g").collect()}
    likeness = SequenceMatcher(None, "alpha", "alphas").ratio()
    assert out[1, 0] == (0, pytest.approx(1.0)) and out[1, 1] == (2, pytest.approx(0.75 * likeness + 0.25)) and out[1, 2] == (None, None) and out[2, 0] == (None, None)


def test_trees(spark):
    nodes = spark.createDataFrame([(1, 0, None, 0, "body"), (1, 1, 0, 1, "p"), (1, 2, 0, 0, "h1"), (1, 3, 2, 0, "a"), (2, 0, None, 0, "x")], "tree int, node int, parent int, place int, tag string")
    nodes = nodes.withColumns({"x": F.lit(5.0), "y": F.lit(0.0), "w": F.lit(10.0), "h": F.lit(4.0)})
    found = trees.levels(nodes)
    assert {(r["tree"], r["node"]): r["index"] for r in found.collect()} == {(1, 0): "", (1, 1): "1", (1, 2): "0", (1, 3): "0-0", (2, 0): ""}
    one = trees.tree_summary(found, nodes).where("tree = 1").first()
    assert (one["node_count"], one["leaf_count"], one["max_depth"], one["tags"]) == (4, 2, 2, ["a:1", "body:1", "h1:1", "p:1"])
    assert {r["tree"]: r["html"] for r in trees.pseudo_markup(found, 10.0, 10.0).collect()}[1] == "<body bbox=[0.5, 0.0, 1.0, 0.4]><h1 bbox=[0.5, 0.0, 1.0, 0.4]><a bbox=[0.5, 0.0, 1.0, 0.4]></a></h1><p bbox=[0.5, 0.0, 1.0, 0.4]></p></body>"
    assert {r["index"] for r in trees.style_rows(found).collect()} == {"", "0"} and trees.style_rows(found, False).count() == 5
    assert trees.pseudo_markup(trees.levels(nodes.limit(0))).collect() == []
    with pytest.raises(ValueError):
        trees.levels(nodes, 1)


def test_styles(spark):
    cases = [("color", "red", "red", 1.0), ("color", "rgb(0,0,0)", "rgb(0,0,0)", 1.0), ("opacity", "0.5", "1", 0.5), ("font-family", "Arial", "Arialx", SequenceMatcher(None, "arial", "arialx").ratio()), ("width", "auto", "auto", 1.0), ("width", "10px", "5px", 0.5), ("width", None, "5px", None), ("text-align", " ", "", None), ("opacity", "x", "x", None)]
    rows = spark.createDataFrame(cases, "p string, a string, b string, want double")
    for r in rows.select("p", "want", style.property_similarity(F.col("p"), F.col("a"), F.col("b")).alias("got")).collect():
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"])), r


def test_summaries(spark):
    pairs = spark.createDataFrame([(1, 0.8, None)], "run int, pixelmatch double, ssim double").withColumns({m: F.lit(None).cast("double") for m in ("clip", "dreamsim", "vlm", "visual_block", "element_block_pixelmatch", "bbox_geometry", "cssom_block_style")})
    pages = spark.createDataFrame([(1, 0.4, None, None)], "run int, bleu_1 double, rouge_1_recall double, f1 double")
    out = {r["run"]: r for r in summary.final_summary(pairs, pages, spark.createDataFrame([(1, 2), (2, 3), (3, 0)], "run int, expected int"), ["run"]).collect()}
    assert out[1]["score"] == pytest.approx((0.35 * 0.8 + 0.15 * 0.4) / 0.5 * 0.5) and out[2]["score"] == 0 and out[3]["coverage"] == 0
    lines = summary.reward_markdown(spark.createDataFrame([(2, None), (1, "a|b")], "n int, v string"), "n").collect()
    assert [r["line"] for r in lines] == ["| 1 | a\\|b |", "| 2 | n/a |"]


def test_rules(spark):
    rows = spark.createDataFrame([(1, 2, ["a"]), (2, 1, ["a"]), (3, None, None)], "k int, dataset_size int, site_seeds array<string>")
    assert Counter(r["k"] for r in validate.broken(rows, "k", validate.plan_rules()).collect()) == {1: 1, 3: 3}


def test_pixels(spark):
    white = spark.createDataFrame([(x, y, 255, 255, 255) for x in range(4) for y in range(4)], "x int, y int, r int, g int, b int").withColumn("image", F.lit(1))
    one = pixels.render_sanity(white, ["image"]).first()
    assert one["entropy"] == 0 and one["non_white"] == 0 and not one["passed"]
    moved = white.withColumns({c: F.lit(49) for c in "rgb"})
    assert pixels.recoloured(white.withColumn("r", F.lit(206)), white, ["image"]).count() == 0  # the distance does not go round
    assert pixels.recoloured(white, moved, ["image"]).count() == 16 and pixels.errors(white, moved, ["image"]).first()["mae"] == 206

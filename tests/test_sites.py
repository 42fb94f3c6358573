import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pagelens import registry
from pagelens.functions.text import ROUTE_STOPWORDS
from pagelens.operators import blocks, localize, replay, sites


def test_replay(spark):
    schema = "id int, pos int, type string, ref_scroll double, cand_scroll double, ref_active string, cand_active string, ref_texts_before array<string>, ref_texts_after array<string>, cand_text string, confidence double, status string, failure string"
    rows = spark.createDataFrame(
        [
            (1, 0, "scroll", 100.0, 3.0, None, None, None, None, "", 1.0, "completed", None),
            (2, 0, "scroll", 5.0, 0.0, None, None, None, None, "", 1.0, "completed", None),
            (3, 0, "click", 0.0, 0.0, "text", "text", None, None, "", 0.5, "completed", None),
            (4, 0, "click", 0.0, 0.0, None, None, None, None, "", 1.0, "failed", "gone"),
            (5, 0, "hover", 0.0, 0.0, None, None, ["Old one"], ["old ONE", "New menu", "Other", "ab"], "the new MENU is here", 1.0, "completed", None),
            (6, 0, "hover", 0.0, 0.0, None, None, [], [], "", 1.0, "completed", None),
        ],
        schema,
    )
    out = replay.contributions(replay.post_state(rows))
    assert {r["id"]: r["contribution"] for r in out.collect()} == {1: 0, 2: 1, 3: 0.5, 4: 0, 5: 0.5, 6: 1}
    assert {r["id"]: r["failure"] for r in replay.first_failure(out, "id").collect()} == {1: "completed", 4: "gone"}
    assert replay.contributions(out, mapped=True).where("id = 4").first()["contribution"] == 0


def test_localize(spark):
    clusters = spark.createDataFrame([("a", 1, 10.0, 10.0, 20.0, 20.0), ("a", 2, 900.0, 900.0, 5.0, 5.0)], "k string, cluster int, cx double, cy double, cw double, ch double")
    elements = spark.createDataFrame([("a", 1, "body", 0.0, 0.0, 1000.0, 1000.0), ("a", 2, "p", 10.0, 10.0, 20.0, 20.0), ("a", 3, "div", 0.0, 0.0, 100.0, 100.0), ("a", 4, "p", 400.0, 0.0, 9.0, 9.0)], "k string, node int, tag string, ex double, ey double, ew double, eh double")
    found = {(r["cluster"], r["node"]): r["rank"] for r in localize.localize(clusters, elements, "k").collect()}
    assert found == {(1, 2): 1, (1, 3): 2, (2, 1): 1}


def test_blocks(spark):
    rows = spark.createDataFrame([(1, 2, "c", 0.0, 0.0, 1.0, 1.0, [40.0, 0.0, 0.0]), (1, 0, "a", 0.0, 0.0, 1.0, 1.0, [0.0, 0.0, 0.0]), (1, 1, "b", 0.0, 0.0, 1.0, 1.0, [20.0, 0.0, 0.0]), (1, 3, "d", 1.0, 0.0, 1.0, 1.0, [1.0, 1.0, 1.0])], "g int, pos int, text string, x double, y double, w double, h double, colour array<double>")
    out = {r["pos"]: (r["text"], r["colour"][0]) for r in blocks.merge_by_box(rows, ["g"]).collect()}
    assert out == {0: ("a b c", 25.0), 3: ("d", 1.0)}
    pairs = spark.createDataFrame([(1, *[0.0, 0.0, 1.0, 1.0] * 2, 0.5), (1, 0.0, 0.0, 1.0, 3.0, 5.0, 5.0, 0.0, 0.0, 0.5)], "g int, rx double, ry double, rw double, rh double, cx double, cy double, cw double, ch double, covered double")
    assert blocks.box_geometry(pairs, ["g"]).first()["iou"] == pytest.approx(0.25)
    styles = spark.range(1).select(F.lit(1).alias("g"), F.create_map(F.lit("a"), F.lit(2.0), F.lit("b"), F.lit(1.0)).alias("ref"), F.create_map(F.lit("a"), F.lit(1.0)).alias("cand"))
    row = blocks.style_scores(styles, ["g"]).first()
    assert (row["score"], row["properties"]) == (0.5, 1)


def test_paths_and_pages(spark):
    paths = spark.createDataFrame([("a/b.html",), ("/a.html",), ("../a.html",), ("a.exe",), (" ",), ("a\\b.css",)], "p string")
    assert [r[0] for r in paths.select(sites.path_problem(F.col("p"))).collect()] == [None, "absolute", "parent_part", "unsupported_type", "empty", None]
    pages = spark.createDataFrame([(1, "/about"), (1, "home.html"), (1, "docs"), (1, "none")], "site int, page string")
    files = spark.createDataFrame([(1, "/about.html"), (1, "/home.html"), (1, "/docs/index.html")], "site int, path string")
    assert {r["page"]: r["found"] for r in sites.page_presence(pages, files).collect()} == {"/about": "about.html", "home.html": "home.html", "docs": "docs/index.html", "none": None}


def test_reachable(spark):
    links = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "x", "y"), (2, "a", "z")], "site int, src string, dst string")
    starts = spark.createDataFrame([(1, "a")], "site int, path string")
    assert {(r["path"], r["steps"]) for r in sites.reachable(starts, links).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_semantic_routes(spark):
    captures = spark.createDataFrame([(1, 1, "/pricing-plans.html", "pricing", "see plans"), (2, 1, "/unknown.html", None, None)], "capture int, site int, path string, page string, intent string")
    routes = spark.createDataFrame([(1, "/plans.html", "Pricing plans", "all the plans"), (1, "/team.html", "Team", "people")], "site int, path string, title string, body string")
    out = sites.semantic_routes(captures, routes).collect()
    assert [(r["capture"], r["route"], r["confidence"]) for r in out] == [(1, "/plans.html", 1.0)]


def test_semantic_routes_against_all_pairs(spark):
    rng, letters = random.Random(3), "abcdefg"
    name = lambda: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 8)))
    captures = [(i, i % 2, f"/{name()}.html", rng.choice([None, name()]), rng.choice([None, "", "alpha beta", "beta gamma delta"])) for i in range(80)]
    routes = sorted({(i % 2, f"/{name()}.html"): (rng.choice(["", "Alpha"]), rng.choice(["", "gamma"]), rng.choice(["", "beta delta words"])) for i in range(60)}.items())
    tokens = lambda x: {w for w in re.findall("[a-z0-9]+", x.lower()) if len(w) > 1 and w not in ROUTE_STOPWORDS}
    bare = lambda x: re.sub("[^a-z0-9]+", "", x.lower())
    want = {}
    for key, site, path, page, intent in captures:
        q, i, best = tokens(f"{path[1:-5]} {page or ''}"), tokens(intent or ""), (0, None)
        for (at, route), (title, headings, body) in routes:
            t = tokens(f"{route} {route[1:-5]} {title} {headings}")
            b = t | tokens(body)
            if at == site and t and q | i:
                shared = len(q & t) / max(1, min(len(q), len(t)))
                slug = SequenceMatcher(None, bare(f"{path[1:-5]}{page or ''}"), bare(f"{route} {route[1:-5]}")).ratio()
                score = max(shared, len(i & t) / max(1, min(3, len(i))), slug * 0.7, shared * 0.7 + len(i & b) / max(1, min(len(i), len(b))) * 0.3)
                best = (score, route) if score > best[0] else best
        if best[0] >= 0.45:
            want[key] = best[1], pytest.approx(best[0])
    c = spark.createDataFrame(captures, "capture int, site int, path string, page string, intent string")
    r = spark.createDataFrame([(*k, *v) for k, v in routes], "site int, path string, title string, headings string, body string")
    assert {x["capture"]: (x["route"], x["score"]) for x in sites.semantic_routes(c, r).collect()} == want


def test_semantic_route_reads_visible_text(spark, tmp_path):
    html = f"<html><head><title>Alpha Beta Gamma</title><script>{'var x = 1; ' * 400}</script></head><body><h2>Prices of boats</h2></body></html>"
    rows = [(2, "http://a.example/x/boats.html", "<title>prices</title>"), (7, "http://a.example/x/y.html", html), (17, "http://a.example/x/z.html", "<prices><boats>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [(r["capture"], r["route"], r["score"]) for r in registry.semantic_route(spark, str(tmp_path)).collect()] == [(2, "/x/y.html", 1.0)]


def test_findings(spark):
    pages = spark.createDataFrame([(1, "p", "Lorem ipsum dolor"), (1, "q", "We care")], "site int, page string, text string")
    required = spark.createDataFrame([(1, "We care"), (1, "Contact us")], "site int, text string")
    assert {r["finding"] for r in sites.text_findings(pages, required, "page").collect()} == {"placeholder_text", "missing: Contact us"}

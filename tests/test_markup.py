"""Markup readers against small cases and round trips."""

import random

from pyspark.sql import functions as F

from pagelens.operators import markup, trees


def test_box_nodes():
    text = " <html bbox=[0, 0, 1, 1]> <s><div bbox=[0.1, 0.2, 0.5, 0.25]><p bbox=[0,0,0.5,0.5]></p></div><s> <p bbox=[1, 1, 1, 1]></div></p></html><p bbox=[0,0,1,1]>"
    assert [r[1:] for r in markup.box_nodes(text, 100, 200)] == [(None, 0, "html", 0, 0, 100, 200), (0, 0, "div", 10, 40, 50, 50), (1, 0, "p", 0, 0, 50, 100), (0, 1, "p", 100, 200, 100, 200), (0, 2, "p", 0, 0, 100, 200)]
    assert markup.box_nodes(None) == markup.box_nodes("") == markup.box_nodes("text <p>") == []
    assert len(markup.box_nodes("<a bbox=[0,0,1,1]><b bbox=[0,0,1,1]>words<c bbox=[0,0,1,1]>")) == 2
    assert len(markup.box_nodes("<a bbox=[0,0,1,1]><b>")) == 1


def test_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for tree in range(12):
        places: dict = {}
        for node in range(rng.randrange(1, 30)):
            parent = rng.randrange(node) if node else None
            place = places.get(parent, 0)
            places[parent] = place + 1
            rows.append((tree, node, parent, place, rng.choice(["div", "p", "h1"]), *(float(rng.randrange(1000)) for _ in range(4))))
    nodes = spark.createDataFrame(rows, "tree int, node int, parent int, place int, tag string, x double, y double, w double, h double")
    found = trees.levels(nodes)
    text = trees.pseudo_markup(found, 1000.0, 1000.0)
    again = trees.levels(markup.markup_nodes(text, ["tree"], width=1000.5, height=1000.5))
    key = lambda rows: sorted((r["tree"], r["index"], r["tag"], *(int(r[c]) for c in "xywh")) for r in rows.collect())
    assert key(again) == key(found)
    assert markup.markup_nodes(spark.createDataFrame([(1, None)], "tree int, html string"), ["tree"]).count() == 0


def test_text_colours(spark):
    html = """<html><head><title style="color:red">no</title></head><body style="color: #123456 !important"> a <b style="background-color: rgb(1,2,3)">b<i style="color:rgb(255, 0, 16)"> c</i></b>
      <!-- no --><br>d <p style="color: navy; color: nosuch">e</p><p style="COLOR: Teal">f</b></p> g &amp; h</body> after</html>"""
    assert [r[1:] for r in markup.coloured_texts(html)] == [("a", "#123456"), ("b", "#123456"), ("c", "#ff0010"), ("d", "#123456"), ("e", "#123456"), ("f", "#123456"), ("g & h", "#123456")]
    rows = markup.text_colours(spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "<body>x")], "page_id int, html string"), ["page_id"]).collect()
    assert [(r["page_id"], r["place"]) for r in rows] == [*((1, i) for i in range(7)), (4, 0)] and rows[-1]["colour"] == "#000000"


def test_pool(spark):
    rows = spark.range(-1, 4098).select("id", markup.pool_colour(F.col("id")).alias("c")).collect()
    colours = [r["c"] for r in rows if r["c"] is not None]
    assert len(colours) == len(set(colours)) == 4096 and colours[0] == "FAFAFA" and colours[1] == "FAFAEA" and colours[-1] == "0A0A0A"

"""Pixels made from a small table stay on the executors, whatever Spark takes their table's size for."""

import pytest

from pagelens.operators import crops, layout, tiles


def pixels(spark, shade=0, size=20):
    """Pictures whose rows Spark takes for as few as those of the table they come from."""
    rows = spark.range(3).selectExpr("id image", f"explode(sequence(0, {size - 1})) x").selectExpr("*", f"explode(sequence(0, {size - 1})) y")
    return rows.selectExpr("image", "x", "y", f"int((x * 7 + y + {shade}) % 256) r", "0 g", "0 b")


def broadcast_sides(df):
    """The plan's nodes below each broadcast side of a join, down to the first grouping."""
    found = []

    def names(node):
        below = [] if "Aggregate" in node.nodeName() else [n for i in range(node.children().size()) for n in names(node.children().apply(i))]
        return [node.nodeName(), *below]

    def walk(node):
        if node.nodeName() == "BroadcastHashJoin":
            found.append(names(node.children().apply(0 if "Left" in node.buildSide().toString() else 1)))
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(df._jdf.queryExecution().sparkPlan())
    return found


def _cut(spark):
    boxes = spark.range(3).selectExpr("id image", "0 block", "struct(2 left, 2 top, 9 right, 9 bottom) box")
    return crops.cut_out(pixels(spark), boxes, ["image"], ["image", "block"])


@pytest.mark.parametrize("made", [
    lambda s: tiles.differing_pixels(pixels(s), pixels(s, 90), ["image"]),
    lambda s: tiles.marked_differences(pixels(s), pixels(s, 90), ["image"]),
    lambda s: tiles.pixelmatch(pixels(s), pixels(s, 90, 30), ["image"], include_aa=True),
    lambda s: tiles.pixelmatch(pixels(s), pixels(s, 90, 30), ["image"]),
    lambda s: tiles.resize(pixels(s), ["image"], s.range(3).selectExpr("id image", "9 width", "11 height")),
    lambda s: layout.layout_sparsity(pixels(s), ["image"]),
    _cut,
], ids=["differing", "marked", "pixelmatch_all", "pixelmatch", "resize", "layout", "crops"])
def test_no_pixels_are_broadcast(spark, made):
    out = made(spark)
    assert not [side for side in broadcast_sides(out) if "Generate" in side]
    assert out.count() > 0


def test_tags_without_a_second_pairing(spark):
    a, b = pixels(spark), pixels(spark, 90).where("image < 2")
    want = tiles.difference_tags(tiles.pixelmatch(a, b, ["image"], include_aa=True), tiles.difference_clusters(a, b, ["image"]), ["image"])
    out = tiles.tagged_differences(a, b, ["image"])
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect())) and out.count() == 2
    assert not [side for side in broadcast_sides(out) if "Generate" in side]

"""Repeated elements against cutting random trees whose elements are compared as whole texts."""

import numpy as np

from pagelens.operators import repeats


def grown(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return "ab"[rng.integers(2)]
    return ("pqb"[rng.integers(3)], [grown(rng, depth - 1) for _ in range(rng.integers(0, 4))])


def drawn(tree):
    return tree if isinstance(tree, str) else f"<{tree[0]}>{''.join(map(drawn, tree[1]))}</{tree[0]}>"


def plain(tree, most, times):
    """The drawing of a tree without copies; '' for one that goes."""
    if isinstance(tree, str):
        return tree
    times[drawn(tree)] = times.get(drawn(tree), 0) + 1
    return "" if times[drawn(tree)] > most else f"<{tree[0]}>{''.join(plain(x, most, times) for x in tree[1])}</{tree[0]}>"


def joined(tree):
    """Texts that stand together are one."""
    if isinstance(tree, str):
        return tree
    out = []
    for child in map(joined, tree[1]):
        if isinstance(child, str) and out and isinstance(out[-1], str):
            out[-1] += child
        else:
            out.append(child)
    return (tree[0], out)


def test_random_trees():
    rng, cut = np.random.default_rng(3), 0
    for _ in range(300):
        tree = joined(("html", [grown(rng, 4) for _ in range(5)]))
        for most in (1, 2):
            html, removed = repeats.without_copies(drawn(tree), most)
            assert html == plain(tree, most, {})
            cut += removed
    assert cut > 300


def test_markup_as_found():
    html = "<!DOCTYPE html>\n<ul>\n<li  CLASS=a>x &amp; y</li><li class='a'>x & y</li>\n<li class=b>x & y</li></ul><br><br/><!-- c --><p>one<p>one"
    assert repeats.without_copies(html, 1) == (html.replace("<li class='a'>x & y</li>", "").replace("<br/>", ""), 2)
    # an unclosed element holds what follows it
    assert repeats.without_copies("<div><p>one<p>two</div><p>two", 1) == ("<div><p>one<p>two</div>", 1)
    assert repeats.without_copies("", 1) == ("", 0) and repeats.without_copies("</p>1 < 2 <", 1) == ("</p>1 < 2 <", 0)
    deep = "<i>" * 5000 + "</i>" * 5000
    assert repeats.without_copies(deep, 1) == (deep, 0)
    assert repeats.without_copies("<b>1</b>" * 60, 50) == ("<b>1</b>" * 50, 10)


def test_columns(spark):
    rows = spark.createDataFrame([(1, "<i>a</i><i>a</i>"), (2, None), (3, ""), (4, "<HTML lang=x>y"), (5, "plain")], "id int, html string")
    got = {r["id"]: (r["c"]["html"], r["c"]["removed"], r["p"]) for r in rows.select("id", repeats.cut_repeats(rows["html"], 1).alias("c"), repeats.as_page(rows["html"]).alias("p")).collect()}
    page = "<html><body><p>{}</p></body></html>".format
    assert got == {1: ("<i>a</i>", 1, page("<i>a</i><i>a</i>")), 2: (None, 0, None), 3: ("", 0, page("")), 4: ("<HTML lang=x>y", 0, "<HTML lang=x>y"), 5: ("plain", 0, page("plain"))}

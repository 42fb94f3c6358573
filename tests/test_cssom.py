"""Style scores of pairs and pages against values by hand."""

from difflib import SequenceMatcher

import pytest

from pagelens.operators import cssom


def test_groups_do_not_overlap():
    names = [p for g in cssom.STYLE_GROUPS.values() for p in g]
    assert len(names) == len(set(names)) == 39


def test_pairs_and_pages(spark):
    box = {"rx": 0.1, "ry": 0.1, "rw": 0.2, "rh": 0.2, "cx": 0.1, "cy": 0.1, "cw": 0.2, "ch": 0.2}
    half = box | {"cw": 0.1}
    given = [("p", 1, 3.0, True, box), ("p", 2, 1.0, True, half), ("p", 3, 4.0, False, box), ("q", 1, 2.0, True, box), ("q", 2, 1.0, False, box), ("r", 1, 1.0, False, box), ("t", 1, 0.0, True, box)]
    pairs = spark.createDataFrame([(page, i, w, ok, *map(float, b.values())) for page, i, w, ok, b in given], "page string, pair int, weight double, resolved boolean, " + ", ".join(f"{c} double" for c in box))
    styles = spark.createDataFrame(
        [("p", 1, "font-size", "10px", "20px"), ("p", 1, "text-align", "left", "LEFT"), ("p", 1, "opacity", "1", None), ("p", 1, "nothing", "1", "2"), ("p", 2, "color", "rgb(0, 0, 0)", "rgb(0, 0, 0)"), ("p", 3, "font-size", "1px", "1px"), ("q", 1, "margin-top", "auto", "auto")],
        "page string, pair int, property string, reference string, candidate string",
    )
    scored = cssom.pair_scores(pairs, styles, ["page"])
    got = {(r["page"], r["pair"]): tuple(r[g] for g in (*cssom.GROUPS, "score")) for r in scored.collect()}
    # half a box: overlap and area one half, centres 0.05 apart
    layout = (0.5 + 0.5 + 0.95) / 3
    assert got["p", 1] == (0.75, None, None, None, None, pytest.approx(1.0), pytest.approx(0.875))
    assert got["p", 2] == (None, 1.0, None, None, None, pytest.approx(layout), pytest.approx((1 + layout) / 2))
    assert got["p", 3] == (None,) * 7 and got["q", 1][2] == 1.0
    pages = spark.createDataFrame([("p", 0.5, 0.9), ("q", 1.0, 1.0), ("r", 1.0, 1.0), ("t", 0.5, None)], "page string, coverage double, block_score double")
    rows = {r["page"]: r for r in cssom.page_scores(scored, pages, ["page"]).collect()}
    matched = (3 * 0.875 + (1 + layout) / 2) / 4
    assert rows["p"]["matched_score"] == pytest.approx(matched) and rows["p"]["resolution_score"] == 0.5 and rows["p"]["score"] == pytest.approx(matched * 0.25)
    assert rows["p"]["color"] == 1.0 and rows["p"]["typography"] == 0.75 and rows["p"]["shape"] == 0.0
    assert (rows["p"]["pair_count"], rows["p"]["resolved_pair_count"], rows["p"]["weighted_area"]) == (3, 2, 4.0)
    assert rows["q"]["resolution_score"] == pytest.approx(2 / 3) and rows["q"]["score"] == 1.0  # all perfect
    assert rows["r"]["score"] == 0.0 and rows["t"]["score"] == 0.0
    assert cssom.page_scores(cssom.pair_scores(pairs.limit(0), styles, ["page"]), pages, ["page"]).count() == 0


def test_values_that_come_again_are_compared_once(monkeypatch):
    import pandas as pd

    from pagelens.functions import style

    seen = []
    style._known_ratio.cache_clear()
    monkeypatch.setattr(style, "SequenceMatcher", lambda *a: (seen.append(a), SequenceMatcher(*a))[1])
    a, b = pd.Series(["left", "auto", None, "auto", "x" * 200] * 50), pd.Series(["right", "5px", "a", None, "y"] * 50)
    out = style.spelling_ratios(a, b).tolist()
    want = [None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)]
    assert [None if v != v else v for v in out] == want and len(seen) == 2 + 50

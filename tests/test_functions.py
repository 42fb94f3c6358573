import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelens.functions import geometry, means, style, text
from pagelens.functions.geometry import Box
from pagelens.operators import matching, raster


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_text(spark):
    t = F.lit("Hello,  World-42!")
    row = one(spark, text.normalize_text(t).alias("n"), text.clean_text(t, 8).alias("c"), text.route_tokens(F.lit("/theAboutPage/index.html")).alias("r"), text.normalize_text(F.lit(None).cast("string")).alias("e"))
    assert row["n"] == "hello world 42" and row["c"] == "Hello, W" and row["r"] == ["about"] and row["e"] == ""


def test_containment(spark):
    s = text.containment_similarity
    row = one(spark, s(F.lit("abcd"), F.lit("ab")).alias("a"), s(F.lit(""), F.lit("x")).alias("b"), s(F.lit("abc"), F.lit("xyz")).alias("c"))
    assert (row["a"], row["b"], row["c"]) == (0.5, 0.0, None)


def test_boxes(spark):
    box = lambda *v: Box(*(F.lit(float(x)) for x in v))
    a, b = box(0, 0, 2, 2), box(1, 1, 2, 2)
    row = one(spark, geometry.iou(a, b).alias("iou"), geometry.coverage(a, b).alias("cov"), geometry.area_similarity(a, box(0, 0, 0, 0)).alias("none"), geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("empty"))
    assert row["iou"] == pytest.approx(1 / 7) and row["cov"] == 0.25 and row["none"] == 0.0 and row["empty"] == 0.0
    border = one(spark, geometry.border_area(*(F.lit(float(x)) for x in (100, 100, 1, 1, 1, 1))).alias("x"))["x"]
    assert border == 396


def test_style(spark):
    p, rgb = style.parse_number, style.parse_rgb
    row = one(spark, p(F.lit("12.5px")).alias("a"), p(F.lit(" Auto ")).alias("b"), rgb(F.lit("rgba(1, 2, 3, 0.5)")).alias("c"), rgb(F.lit("red")).alias("d"), style.colour_similarity(rgb(F.lit("rgb(0, 0, 0)")), rgb(F.lit("rgb(255, 255, 255)"))).alias("e"))
    assert row["a"] == 12.5 and row["b"] is None and row["c"] == [1, 2, 3, 0.5] and row["d"] is None and row["e"] == pytest.approx(0.1)
    assert one(spark, style.log_penalty_score(F.lit(0), F.lit(5)).alias("x"))["x"] == 100


def test_colour_difference():
    # the difference of a colour from itself, and of white from black
    c = np.array([[10.0, 20.0, 30.0, 1.0], [255.0, 255.0, 255.0, 1.0]])
    assert style.difference(c, c) == pytest.approx([0, 0], abs=1e-9)
    assert style.difference(c[1:], np.array([[0.0, 0.0, 0.0, 1.0]]))[0] == pytest.approx(100, abs=0.01)


def test_means(spark):
    rows = spark.createDataFrame([(1.0, 1.0), (None, 1.0), (0.5, 2.0)], "v double, w double")
    row = rows.agg(means.weighted_mean(F.col("v"), F.col("w")).alias("a"), means.weighted_mean_available(F.col("v"), F.col("w")).alias("b")).first()
    assert row["a"] == pytest.approx(0.5) and row["b"] == pytest.approx(2 / 3)


def test_ratio_keeps_the_order_of_its_arguments(spark):
    row = one(spark, matching.ratio(F.lit("tide"), F.lit("diet")).alias("a"), matching.ratio(F.lit("diet"), F.lit("tide")).alias("b"))
    assert (row["a"], row["b"]) == (0.25, 0.5)


@pytest.mark.parametrize("shape", [(3, 3), (2, 5), (5, 2), (1, 1)])
def test_assignment_is_cheapest(shape):
    from itertools import permutations

    rng = np.random.default_rng(sum(shape))
    for _ in range(20):
        cost = rng.random(shape)
        c = cost if shape[0] <= shape[1] else cost.T
        best = min(sum(c[i, p[i]] for i in range(c.shape[0])) for p in permutations(range(c.shape[1]), c.shape[0]))
        pairs = matching.assign(cost)
        assert len(pairs) == min(shape) and sum(cost[i, j] for i, j in pairs) == pytest.approx(best)


def test_raster():
    a = np.zeros((8, 8, 3), dtype=np.uint8)
    b = a.copy()
    b[0, 0] = 255
    assert (raster.pixel_difference(a, b) > raster.MOST * 0.01).sum() == 1
    assert raster.ssim(a[:, :, 0], a[:, :, 0]) == pytest.approx(1)
    mask = np.array([[1, 1, 0], [1, 1, 1], [0, 1, 1]], dtype=bool)
    assert raster.largest_uniform_rectangle(mask) == 4


def test_image_scores(spark):
    white, black = bytes([255] * 12), bytes(12)
    rows = spark.createDataFrame([(1, white, 2, 2, white, 2, 2), (2, white, 2, 2, black, 2, 2)], "id int, a binary, aw int, ah int, b binary, bw int, bh int")
    out = {r["id"]: r for r in raster.image_scores(rows, "id").collect()}
    assert out[1]["pixelmatch"] == 1 and out[2]["pixelmatch"] == 0 and out[2]["mse"] == 255**2

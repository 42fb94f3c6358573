import json

import pytest
from pyspark.sql import functions as F

from pagelens import registry
from pagelens.operators import coverage, diagnostics, dom, judge, manifest, matching, motion, reward, text_similarity
from pagelens.plans import evaluate
from pagelens.sources import sinks, tables
from pagelens.streaming import events

ONES = dict.fromkeys(("size", "html", "vlm", "pixel", "block", "bbox", "cssom", "dreamsim", "coverage"), 1.0)
SCHEMA = ", ".join(f"{c} double" for c in ONES)


def captured(spark, **changed):
    rows = spark.createDataFrame([tuple((ONES | changed)[c] for c in ONES)], SCHEMA)
    return reward.capture_reward(rows).first()


@pytest.mark.parametrize(
    ("changed", "before", "score"),
    [
        ({}, 1.0, 1.0),
        ({"coverage": 0.5}, 1.0, 0.5),
        ({"vlm": 0.39}, (0.05 + 0.10 + 0.20 * 0.39) / 0.70, None),
        ({"block": 0.0, "bbox": 0.0, "cssom": 0.0}, 0.5 / 0.7, None),
        ({"pixel": 0.0, "block": 0.0, "cssom": 0.0, "dreamsim": 0.0}, 0.45 / 0.7, None),
        ({"block": None, "bbox": None, "cssom": None}, 1.0, 1.0),
    ],
)
def test_capture_reward(spark, changed, before, score):
    row = captured(spark, **changed)
    assert row["before_coverage"] == pytest.approx(before)
    assert row["score"] == pytest.approx(before if score is None else score)


def test_gate(spark):
    assert captured(spark, vlm=0.39)["gate_failures"] == ["vlm"]
    assert captured(spark, vlm=None)["gate_passed"]


def test_animation_reward(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 1.0, None, None, 1.0)], "bbox_iou double, motion_delta double, delta_pixelmatch double, pixelmatch double, color_delta double, cssom_color double")
    row = reward.animation_reward(rows).first()
    assert (row["bbox"], row["pixel"], row["cssom"]) == (0, 1, 1) and row["score"] == pytest.approx(0.15 / 0.25)


def test_unknown_weight_mode():
    with pytest.raises(ValueError):
        reward.capture_weight("other", None, None)


@pytest.mark.parametrize(
    ("reference", "candidate", "expected"),
    [([(0, 0), (100, 0)], [(10, 10), (110, 10)], 1.0), ([(0, 0), (100, 0)], [(0, 0), (0, 100)], 0.0), ([(0, 0), (0, 0)], [(0, 0), (40, 0)], 0.0), ([(0, 0), (0, 0)], [(10, 10), (10, 10)], 1.0)],
)
def test_motion(spark, reference, candidate, expected):
    rows = [(1, i, *map(float, (*r, 10, 10, *c, 10, 10))) for i, (r, c) in enumerate(zip(reference, candidate, strict=True))]
    frames = spark.createDataFrame(rows, "a int, frame int, rx double, ry double, rw double, rh double, cx double, cy double, cw double, ch double")
    assert motion.motion_scores(frames, ["a"], ["frame"]).first()["motion_delta"] == pytest.approx(expected)


def test_colour_delta(spark):
    rows = [(1, 0, [0.0, 0.0, 0.0], [50.0, 0.0, 0.0], 1.0), (1, 1, [10.0, 0.0, 0.0], [60.0, 0.0, 0.0], 1.0), (2, 0, [0.0] * 3, [0.0] * 3, 1.0), (2, 1, [10.0, 0.0, 0.0], [0.0] * 3, 1.0)]
    frames = spark.createDataFrame(rows, "a int, frame int, ref array<double>, cand array<double>, area double")
    assert {r["a"]: r["color_delta"] for r in motion.colour_delta(frames, ["a"], ["frame"]).collect()} == {1: 1.0, 2: 0.0}


def test_routes(spark):
    captures = spark.createDataFrame([(1, "/a.html", None), (1, "/x.html", "about"), (1, "/y.html", None), (2, "/z.html", "home")], "site int, path string, page string")
    files = spark.createDataFrame([(1, "/a.html"), (1, "/about.html"), (1, "/index.html")], "site int, path string")
    static = {r["path"]: (r["resolved_path"], r["confidence"], r["failure"]) for r in coverage.route_chain(captures, files).collect()}
    assert static == {"/a.html": ("/a.html", 1.0, None), "/x.html": ("/about.html", 0.6, "exact_path_missing"), "/y.html": ("/index.html", 0.6, "exact_path_missing"), "/z.html": (None, 0.0, "no_matching_route_file")}
    spa = {r["path"]: (r["confidence"], r["method"]) for r in coverage.route_chain(captures, files, serve_mode="spa").collect()}
    assert spa["/x.html"] == (0.75, "spa_fallback") and spa["/z.html"] == (0.0, "spa_fallback")


def test_block_matching_and_resolution(spark):
    rows = [(1, "reference", 0, "alpha beta"), (1, "reference", 1, "gamma"), (1, "candidate", 0, "gamma"), (1, "candidate", 1, "alpha betas"), (2, "reference", 0, "x")]
    blocks = spark.createDataFrame(rows, "g int, side string, pos int, text string")
    pairs = {(r["g"], r["reference_pos"], r["candidate_pos"]) for r in matching.match_blocks(blocks, group="g").collect()}
    assert pairs == {(1, 0, 1), (1, 1, 0)}
    box = [F.lit(v).alias(c) for c, v in zip("xywh", (0.1, 0.1, 0.2, 0.2), strict=True)]
    items = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "zzz")], "g int, pos int, text string").select("*", *box)
    elements = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "g int, node int, text string").select("*", *box)
    found = {r["pos"]: r["node"] for r in matching.resolve_in_order(items, elements, group="g", minimum=0.5).collect()}
    assert found == {0: 1, 1: 0, 2: None}


def test_blocks_are_matched_whole(spark, tmp_path):
    head, one, two = "same words " * 20, "quite another ending " * 20, "1234567890 " * 40
    rows = [(1, 0, head + one), (1, 1, head + two), (1, 2, head + two), (1, 3, head + one)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    pairs = registry.block_matching(spark, str(tmp_path)).collect()
    assert {(r["reference_pos"], r["candidate_pos"], r["similarity"]) for r in pairs} == {(0, 3, 1.0), (2, 1, 1.0)}
    found = {r["pos"]: r["node"] for r in registry.ordered_resolution(spark, str(tmp_path)).collect()}
    assert found == {0: 3, 2: 1}


def test_groups(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "z", 3), ("c", "u", 1), ("c", "u", 2), ("c", "v", 3)], "g string, v string, p int")
    found = {r["g"]: (r["majority"], r["inconsistent"]) for r in diagnostics.consistency(rows, ["g"], "v", "p").collect()}
    assert found == {"a": ("y", 1), "c": ("u", 1)}
    off = diagnostics.alignment_errors(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 50.0)], "g string, x double"), group="g", value="x", tolerance=6.0).first()
    assert (off["groups"], off["errors"]) == (2, 0)


def test_judge(spark):
    row = spark.range(1).select(judge.json_object(F.lit('so: {"a": {"b": 1}} ok')).alias("j"), judge.ten_scores(F.lit("1 2 3 4 5 6 7 8 9 12")).alias("s"), judge.ten_scores(F.lit("1 2")).alias("n")).first()
    assert json.loads(row["j"]) == {"a": {"b": 1}} and row["s"][-1] == 10 and row["n"] is None
    runs = spark.createDataFrame([("m", 1, 1.0), ("m", 1, None), ("m", 2, 3.0)], "model string, r int, s double")
    out = judge.variability(runs, ["model"], "r", "s").first()
    assert (out["mean"], out["std"], out["min"], out["max"], out["errors"]) == (2, 1, 1, 3, 1)


def test_dom(spark):
    html = "<html><head><title>T</title></head><body><h1>Head <b>x</b></h1><a href='/q'>l</a><br><p>t</p></body></html>"
    pages = spark.createDataFrame([(1, html), (2, html.replace("<p>t</p>", "")), (3, None)], "id int, html string")
    kinds = [(r["kind"], r["detail"]) for r in dom.inventory(pages.where("id = 1"), "id", "html").orderBy("pos").collect()]
    assert ("title", "T") in kinds and ("heading", "Head x") in kinds and ("link", "/q") in kinds
    trees = {r["subtree"] for r in dom.subtrees(pages.where("id = 1"), "id", "html").collect()}
    assert "body_h1_a_br_p" in trees and "h1_b" in trees
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "reference int, candidate int")
    scores = {r["candidate"]: r["f1"] for r in dom.subtree_scores(pairs, dom.subtrees(pages, "id", "html"), "id").collect()}
    assert scores[1] == 1 and 0 < scores[2] < 1


def test_text_scores(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "c"], ["a", "b"]), (2, ["a"], []), (3, ["a", "a"], ["a", "a", "a"])], "id int, r array<string>, c array<string>")
    out = {r["id"]: (r["bleu_1"], r["rouge_1_recall"]) for r in text_similarity.unigram_scores(pairs, ["id"], F.col("r"), F.col("c")).collect()}
    assert out[1] == (pytest.approx(2.718281828459045 ** (1 - 3 / 2)), pytest.approx(2 / 3)) and out[2] == (0, 0) and out[3] == (pytest.approx(2 / 3), 1)


def test_text_scores_by_word(spark):
    texts = spark.createDataFrame([(1, 7, ["a", "b"]), (2, 8, []), (3, 9, ["a", "a", "a"]), (4, 7, ["z"])], "id int, ref int, words array<string>")
    references = spark.createDataFrame([(7, ["a", "b", "c"]), (8, ["a"]), (9, ["a", "a"])], "ref int, words array<string>")
    out = {r["id"]: (r["bleu_1"], r["rouge_1_recall"]) for r in text_similarity.unigram_scores_of(texts, references, "id", "ref").collect()}
    assert out[1] == (pytest.approx(2.718281828459045 ** (1 - 3 / 2)), pytest.approx(2 / 3)) and out[2] == (0, 0) and out[3] == (pytest.approx(2 / 3), 1) and out[4] == (0, 0)


def test_repeated_chunks(spark):
    rows = spark.createDataFrame([(1, "<p>" + "abcdefghij" * 100 + "</p>"), (2, "short"), (3, None)], "id int, t string")
    out = {r["id"]: r["cut"] for r in text_similarity.repeated_chunks(rows, "id", "t").collect()}
    assert out == {1: 100, 2: None, 3: None}


def test_manifest(spark):
    rows = [(0, "a", "/p"), (1, "a", "p"), (2, "b", "/none"), (3, "c", "/p"), (4, "a-2", "/p"), (5, " !", "/p"), (6, "d", "/p"), (7, "e", "/p"), (8, "f", "/p")]
    captures = spark.createDataFrame([(1, *r) for r in rows], "site int, pos int, id string, path string")
    steps = [(0, 0, "click", "#x"), (3, 0, "click", "#missing"), (1, 0, "wait", None), (4, 0, "focus", "#two"), (5, 0, "scrollBy", None), (6, 0, "click", None), (7, 0, "click", "#x"), (7, 1, "focus", "#missing"), (8, 0, "drag", "#x"), (8, 1, "wait", None)]
    actions = spark.createDataFrame([(1, *r) for r in steps], "site int, pos int, step int, type string, selector string")
    paths = spark.createDataFrame([("/p",)], "path string")
    selectors = spark.createDataFrame([("/p", "#x", 1), ("/p", "#two", 2)], "path string, selector string, count long")
    kept, dropped = manifest.sanitize_captures(captures, actions, paths, selectors)
    # ids in use are passed over; actions of no known type go alone; an effect that is lost takes its capture with it
    assert {r["pos"]: (r["id"], len(r["actions"] or [])) for r in kept.collect()} == {0: ("a", 1), 1: ("a-2", 1), 5: ("p.desktop.3", 1), 8: ("f", 1)}
    assert {r["pos"]: r["reason"] for r in dropped.collect()} == {2: "path_not_found", 3: "no_actions_left", 4: "no_actions_left", 6: "no_actions_left", 7: "effect_lost"}
    more = spark.createDataFrame([(1, 0, "a", "/p"), (1, 1, "a", "/p"), (1, 2, "a-2", "/p"), (1, 3, "a", "/p")], captures.schema)
    assert [r["id"] for r in manifest.sanitize_captures(more, actions.limit(0), paths, selectors)[0].orderBy("pos").collect()] == ["a", "a-2", "a-2-2", "a-3"]
    assert manifest.sanitize_captures(more, actions.limit(0), paths, selectors, 2)[0].count() == 2
    times = spark.createDataFrame([([100, 50, 100, -1], None), (None, 900), (None, None)], "s array<bigint>, d bigint").select(manifest.sample_times("d", "s").alias("t"))
    assert [r["t"] for r in times.collect()] == [[0, 50, 100], [0, 900], [0, 600]]


def test_evaluate(spark):
    captures = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "capture_id string, weight double")
    routes = spark.createDataFrame([("a", 1.0, True), ("b", 0.6, True)], "capture_id string, confidence double, resolved boolean")
    actions = spark.createDataFrame([("b", 0.5, True)], "capture_id string, contribution double, scored boolean")
    metrics = spark.createDataFrame([(c, n, 1.0, "ok") for c in "ab" for n in evaluate.COMPONENTS], "capture_id string, name string, value double, status string")
    out = evaluate.evaluate(captures, routes, actions, metrics)
    assert {r["capture_id"]: r["score"] for r in out.collect()} == {"a": pytest.approx(1.0), "b": pytest.approx(0.3)}
    total = evaluate.summarize(out.withColumn("run", F.lit(1)), None, ["run"]).first()
    assert total["score"] == pytest.approx((1 + 0.9) / 4)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(json.dumps({"captures": [{"id": "x", "path": "/p"}, {"id": "y", "enabled": False}], "animations": []}, indent=1))
    found = tables.captures(tables.manifests(spark, f"{tmp_path}/m"))
    assert [r["id"] for r in found.collect()] == ["x"]
    assert tables.site_files(spark, str(tmp_path), ".json").count() == 1
    number = spark.range(1).select(tables.json_number(F.lit('{"m": {"v": 0.5}}'), "m.v").alias("a"), tables.json_number(F.lit('{"m": {"skipped": true, "v": 0.5}}'), "m.v").alias("b")).first()
    assert (number["a"], number["b"]) == (0.5, None)
    assert sinks.markdown(spark.createDataFrame([("a|b", 1.5)], "k string, v double")).splitlines()[-1] == "| a\\|b | 1.5 |"


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", "end", "s", "c", 1.0), ("2024-01-01 00:00:50", "end", "s", "c", 3.0), ("2024-01-01 00:30:00", "end", "s", "c", 5.0)], "ts string, event string, stage string, capture_id string, seconds double")
    rows.write.json(f"{tmp_path}/log")
    stream = events.stage_windows(events.read_progress(spark, f"{tmp_path}/log"))
    events.write(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert [(r["stage"], r["runs"], r["total"]) for r in out] == [("s", 2, 4.0)]  # the last window is still open

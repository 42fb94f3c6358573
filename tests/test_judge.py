"""Scores of judge answers in each shape of their JSON."""

import json

from pyspark.sql import functions as F

from pagelens.functions.paths import json_payload
from pagelens.operators import judge


def test_answer_scores(spark):
    ten = [float(i) for i in range(1, 11)]
    named = dict(zip(judge.DIMENSIONS, ten, strict=True))
    short = {k: named[k] for k in judge.DIMENSIONS[:-1]}
    cases = [
        (json.dumps(ten), ten), (json.dumps({"scores": ten}), ten), ("Here: ```json\n" + json.dumps({"dimensions": named, "why": "3 of 4"}) + "```", ten), (json.dumps(named), ten),
        (json.dumps({"scores": ten[:9]}), None), (json.dumps({"scores": [*ten[:9], None]}), None), (json.dumps({"scores": [*ten[:9], "7"]}), [*ten[:9], 7.0]), (json.dumps({"scores": [-3, *ten[1:9], 99]}), [0.0, *ten[1:9], 10.0]),
        (json.dumps({"scores": "many"}), None), (json.dumps({"dimensions": short}), None), (json.dumps({"dimensions": 3}), None), ("1 2 3 4 5 6 7 8 9 10", ten), (json.dumps({"a": ten}), ten), (json.dumps({"scores": None, "a": ten}), ten), ("none", None), ("", None), (None, None),
    ]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "id int, text string")
    payload = F.when(F.startswith(F.trim("text"), F.lit("[")), F.trim("text")).otherwise(json_payload(F.col("text")))
    got = {r["id"]: r["s"] for r in rows.select("id", judge.answer_scores(F.col("text"), payload).alias("s")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]

"""The pipeline's stages on a small folder of tables."""

import random

import pytest

pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(2000)}" for _ in range(words))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    clean = [prose(i, 80) for i in range(60)]
    toxic = [prose(100 + i, 60) + " vilewords badname " + prose(200 + i, 20) for i in range(20)]
    near = [clean[0] + " one more word", clean[1].upper()]
    shared = prose(999, 120)
    passages = [prose(400 + i, 60) + " " + shared + " " + prose(500 + i, 60) for i in range(2)]
    texts = [*clean, *toxic, *near, *passages, "too short", None, "again and again " * 40]
    spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(60 <= i < 80)) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            kept[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(kept["quality"]) == set(range(84))
    assert set(kept["toxicity"]) == set(range(60)) | set(range(80, 84))
    assert set(kept["near_duplicates"]) == set(range(60)) | {82, 83}
    last = kept["substrings"]
    assert all(last[i]["text"] == kept["quality"][i]["text"] for i in range(60))
    assert all(len(last[i]["text"]) < 900 and last[i]["n_chars"] == len(last[i]["text"]) for i in (82, 83))
    pieces = pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == set(range(60)) | {82, 83}


def test_stages_on_odd_tables(spark, folder, tmp_path):
    """No rows, no labels, repeated rows, a null id, and columns with names that stages use themselves."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("score", "spans", "doc", "host", "k1", "component_id", "row", "t", "__k1")
    odd = docs.withColumns({c: docs["doc_id"] for c in names})
    odd = odd.unionByName(odd.where("doc_id = 3")).unionByName(odd.where("doc_id = 4").withColumn("doc_id", docs["doc_id"] * None))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns, name
        rows = out.collect()
        assert all(r[c] == r["doc_id"] for r in rows for c in names if r["doc_id"] is not None)
        assert sum(r["doc_id"] == 3 for r in rows) == (1 if name == "near_duplicates" else 2), name
        assert stage(spark, odd.limit(0), str(tmp_path)).collect() == []
    assert pipeline.STAGES[-1][1](spark, odd.limit(0), str(tmp_path)).collect() == []

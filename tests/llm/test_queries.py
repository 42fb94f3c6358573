"""The registered queries over a small folder: columns, folds and what follows from them."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(300)}" for _ in range(words))


COLUMNS = {
    "op1_jaccard_join": "doc_id n_shingles component_id",
    "op2_sentencepiece": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op3_lm_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_toxicity": "doc_id held_out score predicted",
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op6_embedding_dedup": "vec_id n_links component_id kept",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op13_importance_resampling": "doc_id n_features weight score rank",
}
N = 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    texts = [prose(i, 30 + i) + (" vilewords badname" if i % 3 == 0 else "") for i in range(N - 3)] + [None, "", "123"]
    spark.createDataFrame([(i, t, "xx" if i % 2 else "yy", "h", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(N - 3)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(0, prose(99, 50)), (1, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    rng = np.random.default_rng(1)
    spark.createDataFrame([(i, [float(x) for x in rng.normal(size=16)], 0) for i in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return path


@pytest.mark.parametrize("name", list(COLUMNS))
def test_query(spark, folder, name):
    from pagelens.llm import registry

    out = registry.queries()[name](spark, folder)
    wanted = COLUMNS[name].split()
    assert out.columns[: len(wanted)] == wanted
    rows = out.collect()
    if name == "op6_embedding_dedup":
        assert sorted(r["vec_id"] for r in rows) == list(range(20)) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)
        return
    if name == "op11_spelling_variants":
        assert {r["word"] for r in rows} == {"vilewords"[:i] + "vilewords"[i + 1 :] for i in range(9)} & {r["word"] for r in rows} | {"vilewords", "badname"}
        return
    if name == "op13_importance_resampling":
        assert sorted(r["rank"] for r in rows if r["rank"] is not None) == list(range(1, (N - 3) // 10 + 1))
    if name != "op9_packing":
        assert sorted(r["doc_id"] for r in rows) == list(range(N))
    fold = {"op3_lm_scoring": (5, 1), "op4_toxicity": (4, 2), "op7_language_id": (3, 1)}.get(name)
    if fold:
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold[0] == fold[1]) for r in rows)
    if name == "op4_toxicity":
        assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op7_language_id":
        assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {N - 3, N - 2, N - 1}
    if name == "op8_sharding":
        sizes = Counter(r["shard"] for r in rows)
        assert {r["law"] for r in rows} == {"rows"} and all(r["grown_shard"] is None for r in rows)
        assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
        texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
        assert all((r["size"], r["text_crc32"]) == (len(texts[r["doc_id"]]) + 8, zlib.crc32(texts[r["doc_id"]])) for r in rows)
    if name == "op9_packing":
        assert {r["doc_id"] for r in rows} == set(range(N)) and all(r["start"] + r["length"] <= r["doc_tokens"] for r in rows)


def test_folds_are_learned_apart(spark, folder, tmp_path):
    """Labels and texts of the held-out fold change nothing in the other fold's scores."""
    from pagelens.llm.registry import op4_toxicity

    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    spark.read.parquet(f"{folder}/labels.parquet").withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic"))).write.parquet(f"{tmp_path}/other/labels.parquet")
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/other/documents.parquet")
    one, two = ({r["doc_id"]: r["score"] for r in op4_toxicity(spark, p).collect()} for p in (str(tmp_path), f"{tmp_path}/other"))
    assert one == pytest.approx(two)

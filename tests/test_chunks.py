"""Chunks against heads by common subsequences, and the clusters against plain comparison of all."""

import random
from difflib import SequenceMatcher

from pagelens.operators import text_similarity
from pagelens.operators.text_similarity import Heads


def plain(text, size, similarity, repeats):
    heads = []
    for i in range(0, len(text), size):
        for head, places in heads:
            if SequenceMatcher(None, head, text[i : i + size]).ratio() >= similarity:
                places.append(i)
                if len(places) == repeats:
                    return places[1]
                break
        else:
            heads.append((text[i : i + size], [i]))


def test_common_subsequences():
    def longest(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            before = line[:]
            for j, y in enumerate(b):
                line[j + 1] = before[j] + 1 if x == y else max(line[j], before[j + 1])
        return line[-1]

    rng = random.Random(2)
    for size in (7, 8, 15, 100):
        heads, texts = Heads(size, 0.8), ["".join(rng.choices("abc é\u4e00", k=rng.randrange(1, size + 1))) for _ in range(20)]
        for t in texts:
            heads.add(t)
        for t in texts[:6] + ["zzz"]:
            assert heads.common(t).tolist() == [longest(t, h) for h in texts]


def test_clusters_as_by_plain_comparison(spark):
    rng = random.Random(3)
    texts = []
    for n in range(60):
        base = "".join(rng.choices("abcde ", k=40))
        parts = ["".join(x if rng.random() > rng.choice([0.02, 0.1, 0.2]) else rng.choice("abcdefg") for x in base) if rng.random() < n / 60 else "".join(rng.choices("abcde ", k=40)) for _ in range(rng.randrange(0, 25))]
        texts.append(("".join(parts) + "x" * rng.randrange(0, 9)).strip())
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for size, repeats in ((40, 3), (20, 5)):
        got = {r["id"]: r["cut"] for r in text_similarity.repeated_chunks(rows, "id", "t", size=size, repeats=repeats).collect()}
        assert got == {i: plain(t, size, 0.8, repeats) for i, t in enumerate(texts)}
        assert len({v is None for v in got.values()}) == 2


def test_long_texts_are_not_compared_pair_by_pair(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(text_similarity, "SequenceMatcher", lambda *a: (seen.append(1), SequenceMatcher(*a))[1])
    rng, heads = random.Random(4), Heads(100, 0.8)
    for _ in range(300):
        text = "".join(rng.choices("etaoinshrdlu ", k=100))
        if heads.first(text) is None:
            heads.add(text)
    assert len(heads.texts) == 300 and len(seen) < 300

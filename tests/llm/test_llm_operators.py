"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, slot int, bucket string, id string"


def prose(seed: int, words: int, vocabulary: int = 300) -> str:
    rng = random.Random(seed)
    return "".join(f"w{rng.randrange(vocabulary)}" + ("\n" if rng.random() < 0.08 else " ") for _ in range(words)).strip()


def corpus() -> list[tuple]:
    rng = random.Random(1)
    texts: list[str | None] = [None, "", "  \n\t ", "one", "A b C d", "a B c D", "1234 !!", "x" * 5000, "of " * 400, "ÀÉ ñandú 日本語 😀 straße x", "<|endoftext|> <s> ▁ ▁▁a"]
    base = prose(7, 300)
    shared = prose(8, 120)
    for i in range(12):  # near copies of one text
        words = base.split(" ")
        for _ in range(i % 5):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(99)}"
        texts.append(" ".join(words))
    texts += [base.upper(), base, base]
    texts += [prose(20 + i, 60) + "\n" + shared + "\n" + prose(50 + i, 40) for i in range(6)]
    texts += [prose(100 + i, rng.randrange(5, 400)) for i in range(30)] + [prose(300, 9000)]
    rows = [(i, t, "en", "host" if i % 3 else None, len(t or ""), 1, "b", "c") for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    rows.append((None, base, "en", "host", len(base), 1, "b", "c"))
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


# --- 1 ---


def shingles(text):
    w = words_of((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard_groups(docs):
    from pagelens.llm.jaccard_join import jaccard_groups

    sets = {r[0]: shingles(r[1]) for r in ROWS if r[0] is not None}
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                n = len(sets[a] & sets[b])
                if n and 100 * n >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    out = jaccard_groups(docs).collect()
    assert len(out) == len(ROWS)
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), group[r["doc_id"]]), r


def test_jaccard_rounds(spark):
    """Many variants of one text, so that cells stay open after the first pivots."""
    from pagelens.llm.jaccard_join import jaccard_groups, one_per_group

    rng, base, rows = random.Random(3), prose(9, 120).split(), []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(0, 7)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    group = {i: i for i in sets}

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for hot_level in (14, 2):  # at the second, most shingles are dealt by set too
        assert {r["doc_id"]: r["component_id"] for r in jaccard_groups(table, hot_level=hot_level).collect()} == {i: root(i) for i in sets}
    assert {r["doc_id"] for r in one_per_group(table.union(table)).collect()} == {root(i) for i in sets}
    assert one_per_group(table.union(table)).count() == len({root(i) for i in sets})


def test_jaccard_recursion(spark, monkeypatch):
    """Several pivots, their regions and three rounds at least; hot sets under several keys; lists sent or joined."""
    from pagelens.llm import jaccard_join as jj

    rounds = []
    monkeypatch.setattr(jj, "PIVOTS", 2)
    monkeypatch.setattr(jj, "MEMBERS", 4)
    monkeypatch.setattr(jj, "PAIRS_PER_KEY", 5)
    monkeypatch.setattr(jj, "LONG", 80)  # so that some sets have a wide sketch
    monkeypatch.setattr(jj, "components", lambda *a, f=jj.components: (rounds.append(1), f(*a))[1])
    rng, rows = random.Random(4), []
    base = prose(11, 90).split()
    for i in range(70):
        words = list(base)
        for _ in range(rng.randrange(0, 12)):
            words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    sets = {i: shingles(t) for i, t in rows}
    linked = {(a, b) for a in sets for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    group = {i: i for i in sets}
    for _ in sets:
        for a, b in linked:
            group[a] = group[b] = min(group[a], group[b])
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jj.jaccard_groups(table).collect()} == group and len(set(group.values())) > 3
    assert len(rounds) >= 4
    monkeypatch.setattr(jj, "SEND_IDS", 0)
    monkeypatch.setattr(jj, "PIVOTS", 8)
    some = spark.createDataFrame([*rows[:12], *((100 + i, t) for i, t in rows[:12])], table.schema)
    joined = {r["doc_id"]: r["component_id"] for r in jj.jaccard_groups(some).collect()}
    assert all(joined[i] == joined[100 + i] for i in range(12))
    assert {(a, b) for a in range(12) for b in range(a) if joined[a] == joined[b]} >= {x for x in linked if x[0] < 12}


def test_jaccard_ids_of_several_texts(spark):
    from pagelens.llm.jaccard_join import jaccard_groups, one_per_group

    a, b = prose(12, 80), prose(13, 80)
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b + " more"), (9, prose(14, 80))], "doc_id long, text string")
    assert [(r["doc_id"], r["component_id"]) for r in jaccard_groups(docs).orderBy("doc_id").collect()] == [(3, 3), (5, 3), (5, 3), (7, 3), (9, 9)]
    assert sorted(r["doc_id"] for r in one_per_group(docs.union(docs)).collect()) == [3, 9]


def test_jaccard_empty(empty):
    from pagelens.llm.jaccard_join import jaccard_groups

    assert jaccard_groups(empty).collect() == []


# --- 2 ---


def test_sentencepiece(docs, empty):
    import sentencepiece

    from pagelens.llm.sentencepiece_bpe import decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    want = Counter()
    for r in ROWS:
        ids = library.encode(r[1] or "")
        want[r[0], tuple(ids), library.decode(ids)] += 1
    out = encode(docs, path)
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in out.collect()) == want
    assert all(r["again"] == r["decoded"] for r in decode(out, path, to="again").collect())
    digest = encode(docs, path, with_ids=False, with_digest=True).where("doc_id = 9").first()
    ids = library.encode(ROWS[9][1])
    assert digest["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert encode(empty, path).collect() == []


def test_sentencepiece_any_text():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from pagelens.llm.sentencepiece_bpe import codec

    c = codec(public_tokenizers.path("piece_bpe_32k.model"))

    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from(list("aben t.\n ▁éß")), st.characters(exclude_categories=("Cs",))), max_size=120))
    def same(text):
        assert c.encode([text])[0] == c.vocabulary.library.encode(text)

    same()


# --- 3 ---


def test_language_model(docs, empty):
    from pagelens.llm.lm_scoring import score_documents

    train = lambda i: i is not None and i % 4 != 0
    tokens = [(r[0], [*words_of((r[1] or "").translate(LOWER)), None]) for r in ROWS]
    counts = Counter()
    for i, t in tokens:
        if train(i):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    want = {i: (len(t), sum(counts[x] > 0 for x in t), sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t)) for i, t in tokens}
    out = score_documents(docs.withColumn("train", F.col("doc_id") % 4 != 0), train_col="train").collect()
    assert len(out) == len(ROWS)
    for r in out:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (*want[r["doc_id"]][:2], n)
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][2]) and r["score"] < 0
    held = [r for r in out if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert score_documents(empty.withColumn("train", F.lit(True)), train_col="train").collect() == []


def test_predictive_probabilities_sum_to_one():
    from pagelens.llm import lm_scoring as lm

    rng = np.random.default_rng(0)
    pairs = np.unique(rng.integers(0, 40 * 8, 150))
    word, context = np.unique(pairs // 8, return_inverse=True)[1], pairs % 8
    counts = rng.integers(1, 400, len(pairs)).astype(float)
    words = int(word.max()) + 1
    per = np.bincount(context, counts, minlength=8)
    g = lm.Totals(int(counts.sum()), words, per, np.bincount(context, minlength=8).astype(float), float(len(pairs)), float(words), 0.6, 0.5)
    t, parent, p = lm.sweep(word, context, counts, words, np.ones(len(pairs)), g, rng)
    assert ((t >= 1) & (t <= counts)).all() and (parent <= np.bincount(word, np.ones(len(pairs)), minlength=words)).all()
    after = lm.replace(g, tables=np.bincount(context, t, minlength=8), parent_customers=t.sum(), parent_tables=parent.sum())
    parent = lm.seat(np.bincount(word, t, minlength=words), np.full(words, 0.01), 0.5, rng)
    after = lm.replace(after, parent_tables=parent.sum())
    p = lm._parent_probability(np.bincount(word, t, minlength=words), parent, after)
    assert p.sum() + after.unknown() == pytest.approx(1)
    own = np.bincount(context, (counts - g.discount * t) / (g.strength + per[context]), minlength=8)
    assert own + lm._new_table(after) == pytest.approx(np.ones(8))


def test_seating_follows_the_restaurant():
    """The mean number of tables against the exact recursion."""
    from pagelens.llm.lm_scoring import seat

    n, weight, discount = 30, 0.7, 0.4
    chance = np.zeros(n + 2)
    chance[1] = 1
    for i in range(1, n):
        new = weight / (weight + i - discount * np.arange(n + 2).clip(0, i))
        chance = np.concatenate([[0], (chance * new)[:-1]]) + chance * (1 - new)
    t = seat(np.full(20_000, n), np.full(20_000, weight), discount, np.random.default_rng(1))
    assert t.mean() == pytest.approx((chance * np.arange(n + 2)).sum(), rel=0.03)


@pytest.mark.parametrize("n", [1, 2, 12, 40])
def test_reseating_keeps_the_posterior(n):
    """Tables after some sweeps against their exact distribution, weight ** t * S(n, t), from plain recursion."""
    from pagelens.llm.lm_scoring import reseat

    weight, discount = 0.9, 0.6
    stirling = [1.0] + [0.0] * n
    for c in range(1, n + 1):
        stirling = [0.0] + [stirling[t - 1] + (c - 1 - discount * t) * stirling[t] for t in range(1, n + 1)]
    want = np.array([weight**t * stirling[t] for t in range(n + 1)])
    want /= want.sum()
    many, rng = 40_000, np.random.default_rng(3)
    t = np.ones(many)  # a start far from it
    for _ in range(12):
        t = reseat(np.full(many, n), t, np.full(many, weight), discount, rng)
    got = np.bincount(t.astype(int), minlength=n + 1) / many
    assert np.abs(got - want).sum() < 0.04
    assert t.mean() == pytest.approx((want * np.arange(n + 1)).sum(), rel=0.02)


@pytest.mark.parametrize(("n", "weight", "discount"), [(257, 0.9, 0.6), (600, 30.0, 0.8), (1500, 60.0, 0.3), (1500, 1e-5, 0.9), (400, 1e5, 0.5)])
def test_all_of_many_customers_are_seated_again(n, weight, discount):
    """Past the table of chances too: exact weights, and few sweeps from a start far away are enough."""
    from pagelens.llm.lm_scoring import _log_stirling, reseat

    log, t = np.full(n + 1, -np.inf), np.arange(1, n + 1)
    log[0] = 0
    for c in range(1, n + 1):
        with np.errstate(divide="ignore"):
            joined = np.log(np.maximum(c - 1 - discount * t, 0)) + log[1:]
        log[1:], log[0] = np.logaddexp(log[:-1], joined), -np.inf
    assert _log_stirling(np.full(n, float(n)), t.astype(float), discount) == pytest.approx(log[1:], abs=1e-6)
    want = np.exp(log[1:] + t * math.log(weight) - (log[1:] + t * math.log(weight)).max())
    want /= want.sum()
    many, rng = 10_000, np.random.default_rng(3)
    seats = np.ones(many)
    for _ in range(3):
        seats = reseat(np.full(many, n), seats, np.full(many, weight), discount, rng)
    got = np.bincount(seats.astype(int), minlength=n + 1)[1:] / many
    assert np.abs(got - want).sum() < 0.12 and np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.025


def test_one_seat_taken_again():
    """Chances to sit alone against random partitions seated customer by customer, and the limit for many customers."""
    from pagelens.llm.lm_scoring import ONE_BY_ONE, _alone

    discount, n, rng = 0.5, 6, random.Random(2)
    met = Counter()
    for _ in range(30_000):
        tables = []
        for i in range(n):
            k = rng.choices(range(len(tables) + 1), [*(x - discount for x in tables), 1.0 + discount * len(tables)])[0]
            if k == len(tables):
                tables.append(0)
            tables[k] += 1
        met[len(tables)] += 1
        met[len(tables), "alone"] += sum(x == 1 for x in tables) / n
    chance = _alone(discount)
    for t in range(1, n + 1):
        assert met[t, "alone"] / met[t] == pytest.approx(chance[n, t], abs=0.02)
    assert chance[ONE_BY_ONE, 30] == pytest.approx(discount * 30 / ONE_BY_ONE, rel=0.1)


# --- 4 ---


def toxic_rows():
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        words, toxic = prose(1000 + i, 60, 80).split(), i % 4 == 0
        # an insult alone or a group alone is harmless; both together are not
        insult, group = (True, True) if toxic else ((True, False), (False, True), (False, False))[i % 3]
        for there, word in ((insult, "vilewords"), (group, "groupname")):
            if there:
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    from pagelens.llm.toxicity import fit, score

    rows, labels = toxic_rows()
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "vilewords groupname")], "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([x for x in labels if x[0] % 5], "doc_id long, toxic int"))
    out = {r["doc_id"]: r["score"] for r in score(docs, model).collect()}
    held = [(out[i], y) for i, y in labels if i % 5 == 0]
    right = sum((p >= 0.5) == bool(y) for p, y in held) / len(held)
    assert right > 0.95 and all(0 <= p <= 1 for p in out.values()) and out[900] == out[901] < 0.5
    assert fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int")) is None
    assert {r["score"] for r in score(docs.limit(3), None).collect()} == {0.0}
    assert score(docs.limit(0), model).collect() == []
    # repeated rows, a long text and columns of any name
    more = docs.union(docs).union(spark.createDataFrame([(950, "plain " * 50_000 + "vilewords groupname")], "doc_id long, text string")).withColumns({c: F.lit(1) for c in ("score", "t", "c0", "rows")})
    again = score(more, model).collect()
    assert len(again) == 2 * docs.count() + 1 and {(r["doc_id"], r["score"]) for r in again if r["doc_id"] not in (None, 950)} == {(i, p) for i, p in out.items() if i is not None}
    assert score(more, model, to="p").columns == [*more.columns, "p"]


def test_toxicity_of_few_labels(spark):
    """Rare words of a few labelled rows do not hide what their labels share; null labels are not learned from."""
    from pagelens.llm.toxicity import fit, score

    rows = [(i, prose(i, 80, 2000) + (" vilewords badname" if i % 4 == 0 else "")) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = fit(docs, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(60)] + [(i, None) for i in range(60, 90)], "doc_id long, toxic int"))
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in score(docs, model).where("doc_id >= 60").collect())


def brute_margin(model, present):
    at = [i for i, t in enumerate(model.terms.tolist()) if t in present]
    pairs = sum(float(model.factors[a] @ model.factors[b]) for k, a in enumerate(at) for b in at[:k])
    return model.bias + sum(float(model.linear[a]) for a in at) + pairs


def test_machine_against_all_pairs():
    from pagelens.llm.toxicity import FactorizationMachine

    rng = np.random.default_rng(3)
    model = FactorizationMachine(np.arange(30, dtype=np.uint64), 0.3, rng.normal(size=30), rng.normal(size=(30, 4)))
    sets = [sorted(rng.choice(30, size=int(n), replace=False).tolist()) for n in rng.integers(0, 12, 40)]
    rows = np.repeat(np.arange(40), [len(x) for x in sets])
    assert model.margins(rows, np.array([t for x in sets for t in x], dtype=np.int64), 40) == pytest.approx([brute_margin(model, set(x)) for x in sets])


# --- 5 ---


def test_quality_measures(docs, empty):
    from pagelens.llm.quality_rules import quality_rules

    want = Counter()
    for r in ROWS:
        t, w = r[1] or "", words_of(r[1])
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[r[0], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    out = quality_rules(docs).collect()
    assert Counter(tuple(r)[:7] for r in out) == want
    assert all(not r["kept"] for r in out if r["base_failed"])
    assert quality_rules(empty).collect() == []


def test_line_frequency(spark):
    from pagelens.llm.quality_rules import filter_quality, quality_rules

    line = "this very line stands on every page of the host and says nothing at all"
    rows = [(i, f"{prose(i, 25)}\n{line}\n{prose(900 + i, 25)}" if i % 2 else f"x{i} y{i}\n{line}\nz{i} {line} q{i}\n{line.upper()}\nend{i}", "h") for i in range(60)]
    rows += [(1000 + i, prose(5000, 80), "h") for i in range(50)]  # copies of a clean text are no boilerplate
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {"line_min_docs": 20, "line_doc_percent": 5.0, "keep_word_percent": 60}
    out = {r["doc_id"]: r for r in quality_rules(docs, **how).collect()}
    n = len(line.split())
    for i in range(60):
        assert out[i]["n_line_words_removed"] == (n if i % 2 else 2 * n)
        assert out[i]["kept"] == bool(i % 2)
    assert all(out[1000 + i]["kept"] for i in range(50))
    assert {r["doc_id"] for r in filter_quality(docs, **how).collect()} == {i for i, r in out.items() if r["kept"]}


def test_lines_of_a_block(spark):
    from pagelens.llm.quality_rules import quality_rules

    header = ["welcome to the site of the town", "opening hours on all days of the week", "read our rules before you write"]
    footer = ["all rights reserved by the town", "printed on paper made of old clothes", "end of the page"]
    rows = [(i, "\n".join([*header, prose(i, 30).replace("\n", " "), *footer]), "h") for i in range(30)]
    rows += [(100 + i, "\n".join([*header, f"short{i}", *footer]), "h") for i in range(10)]  # little else than the block
    rows += [(200 + i, rows[0][1], "h") for i in range(700)]  # copies raise neither count
    how = {"line_min_docs": 20, "line_doc_percent": 5.0}
    out = {r["doc_id"]: r for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), **how).collect()}
    n = sum(len(x.split()) for x in header + footer)
    assert {r["n_line_words_removed"] for r in out.values()} == {n}
    assert all(r["kept"] == (i not in range(100, 110)) for i, r in out.items())


# --- 6 ---


def test_embedding_near_duplicates(spark):
    from pagelens.llm.embedding_dedup import _roots, decode_e8, near_duplicates

    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    vectors = [*base, *(base[i % 10] + rng.normal(size=64) * s for i, s in enumerate(np.linspace(0.05, 0.5, 60))), *([base[0]] * 5)]
    rows = [(i, [float(np.float32(x)) for x in v], i % 2 if i >= 100 else 0) for i, v in enumerate(vectors)]
    rows += [(500, [0.0] * 64, 0), (501, None, 0), (502, [float("nan")] * 64, 0), (503, rows[0][1], None), (504, [1.0, None], 0), (None, rows[0][1], 0), (505, [1.0, 2.0], 0), (506, [2.0, 4.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    fine = {i: (np.array(v, dtype=np.float64), y) for i, v, y in rows if i is not None and i not in range(500, 505)}
    links: dict = {i: set() for i, *_ in rows}
    for a, (x, p) in fine.items():
        for b, (y, q) in fine.items():
            if a != b and p == q and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links[a].add(b)
    out = {r["vec_id"]: r for r in near_duplicates(table).collect()}
    found, wanted = sum(r["n_links"] for r in out.values()), sum(map(len, links.values()))
    assert wanted > 100 and 0.97 * wanted <= found <= wanted
    assert all(out[i]["n_links"] == 0 and out[i]["component_id"] == i and out[i]["kept"] for i in range(500, 505))
    assert out[None]["n_links"] == 0 and not out[None]["kept"] and out[506]["component_id"] == 505
    assert near_duplicates(table.limit(0)).collect() == []
    points = rng.normal(size=(200, 8)) * 2
    nearest = decode_e8(points)
    assert len(_roots()) == 240 and (np.abs(_roots()).sum(axis=1) >= 2).all()
    for root in _roots():  # no neighbour is nearer
        assert (((points - nearest) ** 2).sum(axis=1) <= ((points - nearest - root) ** 2).sum(axis=1) + 1e-9).all()


# --- 7 ---


def test_language_id(spark):
    from pagelens.llm.language_id import fit, predict

    def text(lang, seed, n=40):
        rng = random.Random(seed)
        parts = {"aa": ["ka", "ko", "ku", "kana"], "bb": ["sch", "icht", "ung", "ber"], "cc": ["eau", "oux", "ille", "tion"]}[lang]
        return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(2, 5))) for _ in range(n))

    rows = [(i, text(lang, i), lang) for i in range(240) for lang in [("aa", "bb", "cc")[i % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "123 !", "aa"), (902, "", None), (903, text("aa", 1, 60) + " " + text("bb", 2, 30), None), (None, text("cc", 5), None)], "doc_id long, text string, lang string")
    model = fit(docs.where("doc_id % 2 = 0"))
    out = {r["doc_id"]: r for r in predict(docs.drop("lang"), model).collect()}
    assert sum(out[i]["lang_pred"] == lang for i, _, lang in rows) >= 0.98 * len(rows)
    assert all(out[i]["lang_pred"] == "und" and out[i]["score"] == 0 for i in (900, 901, 902))
    assert out[903]["lang_pred"] == "aa" and out[903]["languages"].startswith("aa:0.6") and "bb:0.3" in out[903]["languages"]
    assert all(0 <= r["score"] <= 1 for r in out.values())
    more = docs.union(docs).union(spark.createDataFrame([(950, text("bb", 9, 30_000), None)], docs.schema)).withColumns({c: F.lit(1) for c in ("score", "lang_pred", "languages", "t", "c0")})
    again = predict(more, model).collect()
    assert len(again) == 2 * docs.count() + 1 and {(r["doc_id"], r["lang_pred"], r["score"]) for r in again if r["doc_id"] not in (None, 950)} == {(i, r["lang_pred"], r["score"]) for i, r in out.items() if i is not None}
    assert {r["lang_pred"] for r in again if r["doc_id"] == 950} == {"bb"}
    assert fit(docs.limit(0)) is None and {r["lang_pred"] for r in predict(docs.limit(2), None).collect()} == {"und"}


def test_mixture_against_plain_expectation_maximisation():
    """Proportions of one text, computed unit by unit without arrays over texts."""
    import pyarrow as pa

    from pagelens.llm import language_id as li
    from pagelens.llm.textops import utf8_buffer

    rng = np.random.default_rng(0)
    counts = rng.integers(1, 50, (1 << li.BITS, 3)).astype(float)
    model = li.LanguageModel(["a", "b", "c"], np.log(counts / counts.sum(axis=0)).astype(np.float32))
    text = " ".join(f"wo{x}rd" for x in rng.integers(0, 999, 40))
    words = text.split(" ")
    grams = li._gram_buckets(utf8_buffer(pa.array([text]))[0])
    like, at = [], 0
    for k in range(0, len(words), 6):
        size = sum(len(w) + 1 for w in words[k : k + 6])
        like.append(model.log_prob[grams[at : at + size]].astype(float).sum(axis=0) * 0.4)
        at += size
    odds = np.exp(np.array([x - x.max() for x in like]).clip(-60))
    share = np.full(3, 1 / 3)
    for _ in range(12):
        joint = odds * share
        share = (joint / joint.sum(axis=1, keepdims=True)).mean(axis=0)
    which, found = li.infer(pa.array([text, None, text]), model, penalty=0.0)
    assert which[0, 0] == share.argmax() == which[2, 0] and which[1, 0] == -1
    assert found[0].sum() == pytest.approx(1, abs=1e-6) and found[0, 0] == pytest.approx(share.max(), abs=0.05)


# --- 8 ---


def test_sharding(docs, empty, tmp_path, spark):
    from pagelens.llm import sharding
    from pagelens.llm.sharding import _fisher_yates, shard, write_shards

    one = shard(docs, 5, bucket_bytes=20_000).select("doc_id", "text", "slot", "__shard", "__slot").collect()
    two = shard(docs.repartition(5), 5, bucket_bytes=20_000).select("doc_id", "text", "slot", "__shard", "__slot").collect()
    assert sorted(one, key=str) == sorted(two, key=str)  # the rows alone decide
    sizes = Counter(r["__shard"] for r in one)
    assert len(one) == len(ROWS) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r["__shard"], r["__slot"]) for r in one} == {(s, i) for s, n in sizes.items() for i in range(n)}
    assert shard(empty, 5).collect() == []
    clash = shard(docs.withColumns({c: F.lit("x") for c in ("offset", "bucket", "__bucket", "row", "order", "place", "c0", "__place")}), 5, bucket_bytes=20_000)
    assert sorted((tuple(r) for r in clash.select("doc_id", "text", "slot", "__shard", "__slot").collect()), key=str) == sorted(map(tuple, one), key=str)
    for buckets in (1, 10**6):  # offsets sent or joined
        sharding.SEND_BUCKETS, kept = buckets, sharding.SEND_BUCKETS
        assert sorted(shard(docs, 5, bucket_bytes=20_000).select("doc_id", "text", "slot", "__shard", "__slot").collect(), key=str) == sorted(one, key=str)
        sharding.SEND_BUCKETS = kept
    assert sorted(_fisher_yates(100, 3).tolist()) == list(range(100)) and _fisher_yates(100, 3).tolist() != list(range(100))
    first = Counter(int(_fisher_yates(4, s)[0]) for s in range(4000))
    assert all(abs(n - 1000) < 150 for n in first.values())
    write_shards(docs, f"{tmp_path}/shards", 5)
    written = spark.read.parquet(f"{tmp_path}/shards").select("doc_id", "__shard", "__slot").collect()
    assert {(r["__shard"], r["__slot"]) for r in written} == {(s, i) for s, n in sizes.items() for i in range(n)} and len(written) == len(ROWS)


# --- 9 ---


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    from pagelens.llm.packing import pack

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    rows = pack(docs).collect()
    ids = {}
    for r in ROWS:
        ids.setdefault(r[0], np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    for r in rows:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes())
    assert sum(r["length"] for r in rows) == sum(len(ids[r[0]]) for r in ROWS)
    sequences: dict = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 1024 and sum(x < 1024 for x in sequences.values()) <= docs.rdd.getNumPartitions()
    assert pack(empty).collect() == []


def test_packing_waiting_bins():
    from pagelens.llm import packing

    rng = random.Random(2)
    packer = packing._Packer(64, 0)
    sizes = [rng.randrange(1, 60) for _ in range(5000)]
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype="<u4"))
        assert len(packer.waiting) <= packing.MAX_WAITING + 1
    packer.finish()
    fill = Counter()
    for _, _, length, _, _, sequence, _ in packer.out:
        fill[sequence] += length
    assert sum(fill.values()) == sum(sizes) and sum(64 - x for x in fill.values()) < 64


# --- 10 ---


def brute_repeats(texts: list[bytes], length: int):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]) == 1)
        out.append((len(t), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("how", [{}, {"hot_contexts": 2}, {"shard_bytes": 2000}])
def test_repeated_substrings(docs, how):
    from pagelens.llm.substring_dedup import remove_repeats

    want = brute_repeats([(r[1] or "").encode() for r in ROWS], 400)
    assert sum(w[1] > 0 for w in want) > 10 and any(0 < w[1] < w[0] for w in want)
    rows = remove_repeats(docs, digest_only=True, **how).collect()
    assert Counter(tuple(r)[:5] for r in rows) == Counter((r[0], *w) for r, w in zip(ROWS, want, strict=True))
    assert all(r["n_removed"] or hashlib.sha256(r["text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)


def test_repeated_substrings_clashing_names(docs):
    from pagelens.llm.substring_dedup import remove_repeats

    clash = docs.withColumns({c: F.col("doc_id") for c in ("spans", "doc", "doc2", "row", "t", "c0")})
    out = remove_repeats(clash)
    assert out.schema == clash.schema and out.where("spans is distinct from doc_id").count() == 0
    assert sorted(map(tuple, out.select(*docs.columns).collect()), key=str) == sorted(map(tuple, remove_repeats(docs).collect()), key=str)
    assert remove_repeats(clash, digest_only=True).count() == len(ROWS)


def test_repeated_substrings_texts(docs, empty):
    from pagelens.llm.substring_dedup import remove_repeats

    out = remove_repeats(docs)
    assert out.schema == docs.schema and {r["text"] for r in out.where("doc_id = 0").collect()} == {None}
    assert remove_repeats(empty).collect() == [] and remove_repeats(empty, digest_only=True).collect() == []


def test_suffix_array():
    from pagelens.llm.suffix_array import repeated_starts, suffix_array

    rng = np.random.default_rng(4)
    for _ in range(200):
        sigma = int(rng.integers(2, 7))
        s = rng.integers(1, sigma, int(rng.integers(1, 90)))
        assert suffix_array(s, sigma).tolist() == sorted(range(len(s)), key=lambda i: tuple(s[i:]))
        length = int(rng.integers(1, 7))
        seen = Counter(tuple(s[i : i + length]) for i in range(len(s) - length + 1))
        want = [i + length <= len(s) and seen[tuple(s[i : i + length])] > 1 and 1 not in s[i : i + length] for i in range(len(s))]
        assert repeated_starts(s, sigma, length, 1).tolist() == want


def test_repeated_substrings_at_the_start_of_a_shard():
    """Texts that share their first bytes, the smaller one first in the shard or not."""
    from pagelens.llm.substring_dedup import _shard_spans
    from pagelens.llm.suffix_array import repeated_starts

    assert np.flatnonzero(repeated_starts(np.array([1, 2, 3, 255, 1, 2, 4, 255], dtype=np.uint8), 256, 2, 255)).tolist() == [0, 4]
    rng = np.random.default_rng(9)
    same, *rest = (rng.integers(97, 123, n).astype(np.uint8).tobytes() for n in (450, 300, 500))
    texts = [same + b"a" + rest[0], same + b"b" + rest[1]]
    for order in ([0, 1], [1, 0]):
        pdf = pd.DataFrame({"doc": order, "doc2": order, "start": [0, 0], "bytes": [texts[i] for i in order]})
        assert sorted(map(tuple, _shard_spans(pdf, 400).to_numpy().tolist())) == [(0, 0, 0, 450), (1, 1, 0, 450)]


# --- shared ---


def test_components_that_stand_are_seen_at_once(spark):
    """Stars, repeated and turned around, take one grouped minimum and no further round."""
    from pagelens.llm.graph import components
    from pagelens.llm.scratch import Scratch

    scratch = Scratch(spark, "t")
    edges = [(5, 1), (1, 5), (5, 1), (7, 1), (2, 9), (3, 3)]
    out = components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()
    assert sorted(map(tuple, out)) == [(1, 1), (2, 2), (5, 1), (7, 1), (9, 2)] and scratch._count == 1


def test_components(spark):
    from pagelens.llm.graph import components
    from pagelens.llm.scratch import Scratch

    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    random.Random(1).shuffle(edges)
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert out == {**dict.fromkeys(range(31), 0), **dict.fromkeys(range(100, 140), 100), 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).collect() == []

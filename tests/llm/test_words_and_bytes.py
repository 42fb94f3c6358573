"""Byte-level BPE against the tokenizers library; spelling variants and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

SCHEMA = "doc_id long, text string, lang string, word string, n int, bucket int, key string, cell long, rank int"
LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", "x", 1, 2, "k", 3, 4) for i, t in texts], SCHEMA)


# --- byte-level BPE ---

ODD = [
    None, "", " ", "  ", "a", "x\n\nword", "x \n y", "\n\n  tabs\t\tand  spaces   end  ", "don't we'll I'VE 's 'something x'so",
    "naïve café — déjà vu", "日本語のテキスト、長い文。 次の文", "a b   c  d　 e\u0085 f᠎ g  h", "é  ü   ß \x1c x \x0b y\x0c z",
    "<|endoftext|>", "start <|endoftext|> middle<|endoftext|>end <|endof", "😀👩‍👩‍👧 flags 🇩🇪", "Привет, мир! 123456 abc123def 4٣½Ⅷ", "a" * 3000, "ab" * 900 + " " + "=" * 500,
    "a\nb\n\nc \nd\n e\r\nf\t\tg\th\u0085\ni\u2003\nj é\nk\né\u2003x", "it's 'tis o'clock ''s '9 9' .'s\n's", "\x00\x01 control \x7f", "word " * 400, "x" * 63 + " " + "y" * 65 + " " + "z" * 200,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def random_text(seed: int) -> str:
    rng = random.Random(seed)
    alphabet = "aaeeinothsrlE  \n\t'.,-1290éñ 　日本кд😀<|>_/\\"
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400)))


def test_byte_bpe_equals_the_library(spark, library):
    from pagelens.llm.byte_bpe import decode, encode

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = list(enumerate([*ODD, *map(random_text, range(120))])) + [(4, "a"), (None, "no id")]
    out = encode(table(spark, texts).repartition(3), path, with_digest=True)
    found = {}
    for r in out.collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(texts) and len(found[4]) == 2
    for i, t in texts:
        want = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(want, skip_special_tokens=False)
        for r in found[i]:
            assert r["ids"] == want and r["n_tokens"] == len(want), repr(t)
            assert r["decoded"] == back
            assert r["ids_sha256"] == hashlib.sha256(np.array(want, dtype="<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(back.encode()).hexdigest()
    again = decode(out.select("doc_id", "ids", "decoded"), path, to="second")
    assert again.where("decoded != second").isEmpty()
    assert encode(table(spark, []), path).count() == 0


def test_byte_bpe_special_tokens_as_text(spark, library):
    from pagelens.llm.byte_bpe import encode

    library.encode_special_tokens = True
    try:
        rows = encode(table(spark, list(enumerate(ODD))), public_tokenizers.path("byte_bpe_50k.json"), special=False).collect()
        assert all(r["ids"] == library.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids for r in rows)
    finally:
        library.encode_special_tokens = False


def test_byte_bpe_cuts_are_in_no_token():
    from pagelens.llm.byte_bpe import ByteVocabulary

    v = ByteVocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    for i in range(0, len(v.length), 37):
        x = v.bytes[v.start[i] : v.start[i] + v.length[i]]
        if i != 50256:
            assert not v.certain[x[:-1], x[1:]].any()
    assert v.certain[ord("e"), ord(" ")] and not v.certain[ord("t"), ord("h")]
    long = bytes(np.random.default_rng(3).integers(97, 101, 600, dtype=np.uint8))
    short = v.merge(long)
    ids = [v.single[b] for b in long]
    while True:  # the plain loop over all pairs
        ranked = [(v.merges[p], i) for i in range(len(ids) - 1) if (p := (ids[i] << 32) | ids[i + 1]) in v.merges]
        if not ranked:
            break
        _, i = min(ranked)
        ids[i : i + 2] = [v.merges[(ids[i] << 32) | ids[i + 1]] & 0xFFFFFFFF]
    assert short == ids


def test_byte_bpe_forgets_and_goes_on(library, monkeypatch):
    from pagelens.llm import byte_bpe

    monkeypatch.setattr(byte_bpe, "CACHE_FRAGMENTS", 5)
    c = byte_bpe.Codec(public_tokenizers.path("byte_bpe_50k.json"), True)
    texts = [random_text(i) for i in range(30)]
    packed = c.encode(pa.array(texts))
    assert [np.frombuffer(x, "<u4").tolist() for x in packed] == [library.encode(t, add_special_tokens=False).ids for t in texts]


# --- spelling variants ---


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variant_words() -> dict[str, int]:
    rng = random.Random(5)
    out = {"a": 3, "b": 40, "ab": 2, "abc": 500, "aaaa": 7, "aaaaa": 80, "aaaaaa": 900, "señores": 9, "senores": 100, "ñññññññ": 4, "ññññññé": 41}
    for stem in ("thinking", "aabbaabb", "pressure"):  # a hot first half, and runs of one letter
        for _ in range(60):
            w = list(stem)
            for _ in range(rng.randrange(0, 4)):
                kind, at = rng.randrange(3), rng.randrange(len(w))
                if kind == 0:
                    w[at] = rng.choice("abt")
                elif kind == 1:
                    w.insert(at, rng.choice("abt"))
                elif len(w) > 3:
                    del w[at]
            out["".join(w)] = rng.choice([1, 2, 3, 20, 30, 400, 5000])
    out["x" * 300], out["x" * 299 + "y"], out["x" * 301] = 2, 30, 400
    return out


@pytest.mark.parametrize("most_pairs", [2048, 3])
def test_spelling_forms(spark, most_pairs):
    from pagelens.llm.scratch import Scratch
    from pagelens.llm.spelling_variants import near_pairs, spelling_forms

    n = variant_words()
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    words = spark.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = {r["word"]: tuple(r)[1:] for r in spelling_forms(words, most_pairs=most_pairs).collect()}
    assert got == {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}
    pairs = near_pairs(words, Scratch(spark, "t"), most_pairs=most_pairs).collect()
    assert len(pairs) == len({frozenset((r["a"], r["b"])) for r in pairs}) == sum(map(len, near.values())) // 2
    assert spelling_forms(words.limit(0)).count() == 0


def test_cells_stay_small(spark):
    """Words that share their first half: the cells joined hold at most the pairs allowed, or words that differ in one letter."""
    from pagelens.llm.scratch import Scratch
    from pagelens.llm.spelling_variants import near_pairs

    rng = random.Random(8)
    words = sorted({"common" + "".join(rng.choice("abcd") for _ in range(6)) for _ in range(900)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    scratch = Scratch(spark, "t")
    pairs = {frozenset((r["a"], r["b"])) for r in near_pairs(table, scratch, most_pairs=50).collect()}
    assert pairs == {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if one_edit(a, b)}
    assert scratch._count > 6  # several rounds of halving


def test_counted_words(spark):
    from pyspark.sql import functions as F

    from pagelens.llm.spelling_variants import counted_words, letter_dropped, letter_runs

    rng = random.Random(2)
    vocabulary = ["Straße", "thinking", "THINKING", "señorita", "über×lang", "catching", "Zürichsee", "word"]
    texts = [(i, " ".join(rng.choice(vocabulary) + rng.choice([" ", "1", "-", "_"]) for _ in range(200))) for i in range(40)] + [(41, None), (42, ""), (None, "thinking catching"), (3, "thinking")]
    want: Counter = Counter()
    dropped = 0
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at, dropped = h % len(run), dropped + 1
                run = run[:at] + run[at + 1 :]
            want[run] += 1
    runs = letter_runs(table(spark, texts), min_length=7)
    got = {r["word"]: r["n"] for r in counted_words(runs, letter_dropped(F.col("id"), F.col("run"))).collect()}
    assert dropped > 50 and got == {w: c for w, c in want.items() if len(w) >= 7 and c >= 2}


# --- importance resampling ---


def features(text, max_n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, max_n + 1) for i in range(len(words) - k + 1)]


def test_resampling(spark):
    from pagelens.llm.importance_resampling import resample

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "日本", "X9", "the"] + ["l" * 70]
    prose = lambda n: " ".join(rng.choices(vocabulary, [*[1] * 43, 60, 1], k=n)) + rng.choice([".", "\n", "\x00"])
    texts = [(i, prose(rng.randrange(0, 90))) for i in range(150)]
    texts += [(200, None), (201, ""), (202, "!!! ---"), (7, texts[7][1]), (7, texts[7][1]), (8, "another text of the same id " * 5), (None, prose(40)), (None, prose(40)), (203, prose(20_000))]
    texts += [(300 + i, texts[20][1]) for i in range(60)]  # copies
    target = [(0, prose(300)), (1, "w1 w2 w3 " * 20), (2, None)]
    for max_n, buckets in ((1, 10_000), (3, 97)):
        parts = [(i, *features(t, max_n)) for i, t in texts]
        bucket = lambda f, b=buckets: zlib.crc32(f.encode()) % b
        s = Counter(bucket(f) for _, _, fs in parts for f in fs)
        t = Counter(bucket(f) for _, x in target for f in features(x, max_n)[1])
        S, T = sum(s.values()), sum(t.values())
        gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
        rows = []
        for i, words, fs in parts:
            h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
            weight = sum(gain[bucket(f)] for f in fs)
            rows.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
        drawable = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
        drawn = {k: r[:4] for k, r in enumerate(drawable[: len(drawable) * 30 // 100], 1)}
        out = [tuple(r) for r in resample(table(spark, texts).repartition(3), table(spark, target), max_n=max_n, buckets=buckets, percent=30).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, r[2])
        assert sorted((r[:4] for r in out), key=key) == sorted((r[:4] for r in rows), key=key)
        assert {r[4]: r[:4] for r in out if r[4] is not None} == drawn and sum(r[4] is not None for r in out) == len(drawn)


def test_resampling_of_nothing(spark):
    from pagelens.llm.importance_resampling import resample

    none, one = table(spark, []), table(spark, [(1, "a b c " * 20)])
    assert resample(none, one).count() == 0
    assert [(r["n_features"], r["rank"]) for r in resample(one, none, percent=100).collect()] == [(60, 1)]

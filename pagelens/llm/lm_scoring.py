"""Language-model scores from a hierarchical Pitman-Yor model.

Model: a restaurant for each context, all with one parent, the restaurant of single
tokens, whose base is uniform over the vocabulary and one unknown token. A context is a
class of the token before (``classes`` hash classes, one of them for a text's begin), so
the context restaurants' totals are vectors of fixed length. The customers of a context's
restaurant are the tokens seen there; its tables are customers of the parent.

Sampling: a Gibbs sweep takes the customers of each (context, token) from their tables and
seats them again, one at a time, given the rest and the totals of all other restaurants as
the sweep began. Only the number of tables of a pair is kept: given it, the chance that a
customer sits alone is a ratio of generalised Stirling numbers, so that taking one away
needs no list of tables. The more than ``ONE_BY_ONE`` customers of a pair are seated all
at once: t tables have the weight S(c, t) * weight ** t, with S from a contour integral, and
a proposed number is taken or not by the exact ratio of weights. A chain starts
from seats taken in turn. After the first sweeps the predictive probabilities of
``samples`` further sweeps are averaged.

On Spark: tokens are dealt to buckets by their hash, packed by block of documents, and
written bucketed once. A bucket holds all of its tokens' pairs, so only the context
totals and the parent's totals travel between sweeps. Scoring sums each bucket's log
probabilities by document where the model is; only these sums go back. Tokens that make
up more than 1/``HEAVY`` of a sample of the text are never dealt: each task counts them in
a table of fixed size, and the second reading of the texts scores them. Which tokens take
that way does not change the model.

Defined cases
  null or empty text  the end token alone
  null id             scored like any other
  null training flag  not learned from
  repeated rows       each learned from, each scored; equal texts score alike
  ties                none: sampling is seeded by bucket
  empty table         an empty result; nothing to learn from: V and N are 0
  other columns       ignored
  long texts          whole
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.scratch import Scratch
from pagelens.llm.textops import slices, word_hashes

END = np.uint64(0x0E0D0C0B0A090807)
HEAVY = 512
ONE_BY_ONE = 256
#: Numbers proposed in a sweep for a pair with more customers, and such pairs held in arrays at once.
PROPOSALS, TOGETHER = 2, 4096
#: Places on half of the contour of a Stirling number; singles few enough for its power series instead.
CONTOUR, SERIES = 0.13 * np.arange(40), 16
BLOCK_TOKENS, BLOCK_DOCS = 1_500_000, 60_000
BUCKET_BYTES = 16 << 20
#: One in so many documents decides which tokens are heavy.
HEAVY_SAMPLE = 40


@dataclass(frozen=True)
class Totals:
    """What the restaurants share: known before a sweep."""

    tokens: int  # N
    vocabulary: int  # V
    customers: np.ndarray  # by context
    tables: np.ndarray  # by context
    parent_customers: float
    parent_tables: float
    discount: float
    parent_discount: float
    strength: float = 1.0
    parent_strength: float = 1.0

    def unknown(self) -> float:
        """The parent's probability of a token never seen."""
        return (self.parent_strength + self.parent_discount * self.parent_tables) / (self.parent_strength + self.parent_customers) / (self.vocabulary + 1)


def seat(counts: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Where a chain starts: tables of each dish after its customers sat down in turn; weight: of a new table for it.

    Past the first ``ONE_BY_ONE`` customers they sit down in groups of an eighth of those seated.
    """
    order = np.argsort(-counts, kind="stable")
    c, a = counts[order], weight[order]
    t, few = np.minimum(c, 1).astype(np.float64), -c
    i = 1
    while True:
        n = int(np.searchsorted(few, -i, side="left"))  # dishes with more than i customers
        if not n:
            break
        p = a[:n] / (a[:n] + np.maximum(i - discount * t[:n], 1e-12))
        if i < ONE_BY_ONE:
            t[:n] += rng.random(n) < p
            i += 1
        else:
            t[:n] += rng.binomial(np.minimum(c[:n] - i, i // 8).astype(np.int64), np.clip(p, 0, 1))
            i += i // 8
    out = np.empty_like(t)
    out[order] = t
    return out


@lru_cache(maxsize=4)
def _alone(discount: float) -> np.ndarray:
    """Chance that one of c customers at t tables has a table alone, at [c, t], up to ``ONE_BY_ONE`` customers.

    With S(c, t) = S(c - 1, t - 1) + (c - 1 - discount * t) * S(c - 1, t), it is S(c - 1, t - 1) / S(c, t).
    """
    out = np.zeros((ONE_BY_ONE + 1, ONE_BY_ONE + 1), dtype=np.float32)
    log = np.full(ONE_BY_ONE + 1, -np.inf)  # of S(c, t) by t
    log[0] = 0
    t = np.arange(1, ONE_BY_ONE + 1)
    for c in range(1, ONE_BY_ONE + 1):
        with np.errstate(divide="ignore"):
            joined = np.log(np.maximum(c - 1 - discount * t, 0)) + log[1:]
        alone = log[:-1].copy()
        log[1:], log[0] = np.logaddexp(alone, joined), -np.inf
        out[c, 1 : c + 1] = np.exp(alone[:c] - log[1 : c + 1])
    return out


def _log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """Logarithm of S(c, t) for 1 <= t <= c and c beyond ``ONE_BY_ONE``; its error is under 1e-6 (tested against the recursion).

    S(c, t) * t! * discount**t / c! is the coefficient of x**c in (1 - (1 - x)**discount)**t: an integral
    in w = 1 - x along a parabola that crosses the real axis at the saddle and leaves the cut w <= 0 aside.
    """
    lo, hi = np.full(len(c), -300.0), np.full(len(c), -1e-15)  # of log w at the saddle
    for _ in range(45):
        mid = (lo + hi) / 2
        right = t * discount * np.exp((discount - 1) * mid) * -np.expm1(mid) + (c + 1) * np.expm1(discount * mid) > 0
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    w = np.maximum(np.exp((lo + hi) / 2), 2 / c)
    one = -np.expm1(discount * np.log(w))
    slope = (c + 1) / (1 - w) - t * discount * w ** (discount - 1) / one
    bend = (c + 1) / (1 - w) ** 2 + t * discount * w ** (discount - 2) * ((1 - discount) * one - discount * w**discount) / one**2
    width = np.minimum(1 / np.sqrt(np.maximum(2 * w * slope + 4 * w * w * bend, 1e-300)), 1)
    u = width[:, None] * np.sinh(CONTOUR)
    log_w = np.log(w)[:, None] + np.log1p(u * u) + 2j * np.arctan(u)
    top = t * np.log(one) - (c + 1) * np.log1p(-w)
    z = t[:, None] * np.log(-np.expm1(discount * log_w)) - (c[:, None] + 1) * np.log(-np.expm1(log_w)) - top[:, None]
    step = np.cosh(CONTOUR) * CONTOUR[1]
    step[0] /= 2
    out = top + np.log(np.maximum(((np.exp(z) * (1 + 1j * u)).real @ step) * width * w * 2 / np.pi, 1e-300))
    few = np.flatnonzero(c - t < SERIES)  # nearly all alone: the first coefficients by the recurrence of a power, all terms positive
    if len(few):
        base = np.cumprod([1.0, *((j - discount) / (j + 1) for j in range(1, SERIES))])
        power = np.ones((SERIES, len(few)))
        for i in range(1, SERIES):
            power[i] = sum((t[few] * j - i + j) * base[j] * power[i - j] for j in range(1, i + 1)) / i
        out[few] = t[few] * math.log(discount) + np.log(power[(c - t)[few].astype(np.int64), np.arange(len(few))])
    factorial = lambda x: np.fromiter(map(math.lgamma, (x + 1).tolist()), np.float64, len(x))
    return out + factorial(c) - factorial(t) - t * math.log(discount)


def _reseat_many(c: np.ndarray, t: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with many customers after all of these left and sat down again.

    Numbers are proposed around the saddle of their weights S(c, t) * weight ** t and taken with the
    Metropolis-Hastings chance, which keeps the exact distribution wherever the saddle lies.
    """
    lo, hi = np.full(len(c), -300.0), np.full(len(c), -1e-15)
    for _ in range(45):
        mid = (lo + hi) / 2
        right = weight * -np.expm1(mid) * np.exp((discount - 1) * mid) > c
        lo, hi = np.where(right, mid, lo), np.where(right, hi, mid)
    log_w = (lo + hi) / 2
    middle = np.clip(weight / discount * -np.expm1(discount * log_w), 1, c)
    spread = np.sqrt(np.maximum(middle - c / (1 + (1 - discount) * np.expm1(-log_w)), 0.6))
    scale = 0.65 * spread
    log_weight = lambda t: _log_stirling(c, t, discount) + t * np.log(weight)

    def log_chance(t: np.ndarray) -> np.ndarray:
        """Of a proposal: a logistic variable, rounded."""
        far = np.abs(t - middle) / scale
        half = 0.5 / scale
        return -far - np.log1p(np.exp(-far - half)) - np.log1p(np.exp(-far + half)) + np.log(2 * np.sinh(half))

    now = log_weight(t)
    for _ in range(PROPOSALS):
        x = np.clip(rng.random(len(c)), 1e-300, 1 - 1e-16)
        to = np.floor(middle + scale * np.log(x / (1 - x)) + 0.5)
        there = (to >= 1) & (to <= c)
        to = np.where(there, to, t)
        then = log_weight(to)
        take = there & (np.log(np.maximum(rng.random(len(c)), 1e-300)) < then - now + log_chance(t) - log_chance(to))
        t, now = np.where(take, to, t), np.where(take, then, now)
    return t


def reseat(counts: np.ndarray, tables: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers left and sat down again, given all the others: one at a time, or many at once."""
    order = np.argsort(-counts, kind="stable")
    c, a, t = counts[order].astype(np.float64), weight[order], tables[order].astype(np.int64)
    alone = _alone(discount).ravel()
    few = -c
    many = int(np.searchsorted(few, -ONE_BY_ONE, side="left"))  # dishes beyond the table of chances come first
    for k in range(0, many, TOGETHER):
        part = slice(k, min(k + TOGETHER, many))
        t[part] = _reseat_many(c[part], np.clip(t[part], 1, c[part]).astype(np.float64), a[part], discount, rng)
    row = np.minimum(c, ONE_BY_ONE).astype(np.int64) * (ONE_BY_ONE + 1)
    for i in range(ONE_BY_ONE):
        n = int(np.searchsorted(few, -max(i, 1), side="left"))  # a single customer comes back to a table of its own
        if n <= many:
            break
        own = slice(many, n)
        rest = np.maximum(t[own] - (rng.random(n - many) < alone[row[own] + t[own]]), 1)
        t[own] = rest + (rng.random(n - many) * (a[own] + c[own] - 1 - discount * rest) < a[own])
    out = np.empty(len(t), dtype=np.float64)
    out[order] = t
    return out


def sweep(word: np.ndarray, context: np.ndarray, counts: np.ndarray, words: int, tables: np.ndarray, g: Totals, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One Gibbs sweep over (context, token) pairs; tables: of the sweep before. Returns tables, parent tables, parent probabilities."""
    parent_tables, p = _parent(np.bincount(word, tables, minlength=words), g, rng)
    tables = reseat(counts, tables, _table_weight(context, g) * p[word], g.discount, rng)
    return tables, parent_tables, p


def _table_weight(context: np.ndarray, g: Totals) -> np.ndarray:
    return g.strength + g.discount * g.tables[context]


def _parent(customers: np.ndarray, g: Totals, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The parent's tables and probability of each word, its customers being the tables of the contexts."""
    weight = np.full(len(customers), (g.parent_strength + g.parent_discount * g.parent_tables) / (g.vocabulary + 1))
    tables = reseat(customers, seat(customers, weight, g.parent_discount, rng), weight, g.parent_discount, rng)
    return tables, _parent_probability(customers, tables, g)


def start(word: np.ndarray, context: np.ndarray, counts: np.ndarray, words: int, g: Totals, rng: np.random.Generator) -> np.ndarray:
    """Tables of each pair to begin with: seats taken in turn, with one table a pair at the parent."""
    _, p = _parent(np.bincount(word, np.minimum(counts, 1), minlength=words), g, rng)
    return seat(counts, _table_weight(context, g) * p[word], g.discount, rng)


def _parent_probability(customers: np.ndarray, tables: np.ndarray, g: Totals) -> np.ndarray:
    return np.maximum(customers - g.parent_discount * tables, 0) / (g.parent_strength + g.parent_customers) + g.unknown()


def averaged(word, context, counts, words, g: Totals, seed: list[int], burn: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Averages over sweeps: what a context's own tables give each pair, and the parent's probability of each word.

    A pair's predictive probability is the first, plus the second times the context's weight of a new table.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    tables = start(word, context, counts, words, g, rng)
    own, p = np.zeros(len(counts)), np.zeros(words)
    for k in range(burn + samples):
        tables, _, _ = sweep(word, context, counts, words, tables, g, rng)
        if k >= burn:
            p += _parent(np.bincount(word, tables, minlength=words), g, rng)[1]
            own += np.maximum(counts - g.discount * tables, 0) / (g.strength + g.customers[context])
    return own / samples, p / samples


def _new_table(g: Totals) -> np.ndarray:
    """By context: the weight of the parent's probability."""
    return (g.strength + g.discount * g.tables) / (g.strength + g.customers)


def _tokens(texts: pa.Array, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, class of the token before, first index of each text), each text closed by its end."""
    words, first = word_hashes(texts)
    n = len(texts)
    row = np.repeat(np.arange(n), np.diff(first))
    token = np.full(len(words) + n, END, dtype=np.uint64)
    token[np.arange(len(words)) + row] = words
    starts = first + np.arange(n + 1)
    context = np.zeros(len(token), dtype=np.uint16)
    context[1:] = (token[:-1] % np.uint64(classes - 1)).astype(np.uint16) + 1
    context[starts[:-1]] = 0
    return token, context, starts


class _Heavy:
    """The index of each heavy token, -1 for others."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.map = np.zeros(1 << 16, dtype=bool)
        self.map[(known & np.uint64(65535)).astype(np.int64)] = True

    def __call__(self, token: np.ndarray) -> np.ndarray:
        out = np.full(len(token), -1, dtype=np.int16)
        maybe = np.flatnonzero(self.map[(token & np.uint64(65535)).astype(np.int64)])
        if len(self.known) and len(maybe):
            at = np.minimum(np.searchsorted(self.known, token[maybe]), len(self.known) - 1)
            hit = self.known[at] == token[maybe]
            out[maybe[hit]] = at[hit]
        return out


def _heavy_tokens(rows: DataFrame, classes: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                token, _, _ = _tokens(part.column(0), classes)
                h, n = np.unique(token, return_counts=True)
                often = n * 2 * HEAVY > len(token)
                h, n = np.append(h[often], np.uint64(0)), np.append(n[often], len(token))  # hash 0 carries the total
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    sample = rows.where(F.pmod(F.xxhash64(F.lit(5), "rid"), F.lit(HEAVY_SAMPLE)) == 0).select("t")
    # each batch gives at most 2 * HEAVY tokens; the sum has few more different ones
    found = sample.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(2 * HEAVY).collect()
    total = sum(r["n"] for r in found if r["h"] == 0)
    return np.sort(np.array([r["h"] for r in found if r["h"] != 0 and r["n"] * HEAVY > total], dtype=np.int64).view(np.uint64))


def _deal(rows: DataFrame, heavy: np.ndarray, buckets: int, classes: int) -> DataFrame:
    """Packed tokens: a row for each (bucket, block), one for each block's document keys, and counts of heavy tokens.

    kind 0: words and their counts, then contexts and documents of their occurrences, and the documents' training flags
    kind 1: the documents' keys (bucket -1); kind 2: heavy token (in block), its counts by context among training tokens
    """
    schema = "bucket long, kind int, block long, words binary, counts binary, contexts binary, docs binary, train binary"
    names = [x.split()[0] for x in schema.split(", ")]
    find = _Heavy(heavy)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        size = docs = 0
        heavy_counts = np.zeros((len(heavy), classes), dtype=np.int64)

        def packed() -> pa.RecordBatch:
            token, context, doc, train, rid = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(token, kind="stable")
            token, context, doc = token[order], context[order], doc[order]
            new = np.flatnonzero(np.r_[True, token[1:] != token[:-1]]) if len(token) else np.zeros(0, np.int64)
            words, counts = token[new], np.diff(np.append(new, len(token))).astype(np.uint32)
            # buckets are ranges of the hash, so sorting by it has sorted by bucket
            of = _bucket(words, buckets)
            cut = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)
            flags = np.packbits(train).tobytes()
            out = []
            for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(words)], strict=True):
                lo, hi = int(new[a]), int(new[b]) if b < len(new) else len(token)
                out.append((int(of[a]), 0, block, words[a:b].tobytes(), counts[a:b].tobytes(), context[lo:hi].tobytes(), doc[lo:hi].tobytes(), flags))
            out.append((-1, 1, block, rid.tobytes(), b"", b"", b"", flags))
            return _record(out)

        def _record(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for part in (x.slice(k, BLOCK_DOCS) for x in slices(batch, "t") for k in range(0, x.num_rows, BLOCK_DOCS)):  # places in a block have 16 bits
                if docs + part.num_rows > BLOCK_DOCS and held:
                    yield packed()
                    held, size, docs, block = [], 0, 0, block + 1
                token, context, starts = _tokens(part.column(1), classes)
                doc = np.repeat(np.arange(part.num_rows), np.diff(starts))
                train = np.asarray(part.column(2).to_numpy(zero_copy_only=False), dtype=bool)
                which = find(token)
                seen = (which >= 0) & train[doc]
                np.add.at(heavy_counts, (which[seen], context[seen]), 1)
                light = which < 0
                held.append((token[light], context[light], (doc[light] + docs).astype(np.uint16), train, part.column(0).to_numpy()))
                size += int(light.sum())
                docs += part.num_rows
                if size >= BLOCK_TOKENS:
                    yield packed()
                    held, size, docs, block = [], 0, 0, block + 1
        if held:
            yield packed()
        out = []
        for h in np.flatnonzero(heavy_counts.any(axis=1)).tolist():
            at = np.flatnonzero(heavy_counts[h])
            out.append((-2 - h, 2, h, b"", heavy_counts[h, at].tobytes(), at.astype(np.uint16).tobytes(), b"", b""))
        if out:
            yield _record(out)

    return rows.select("rid", "t", "train").mapInArrow(work, schema)


def _bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


class _Bucket:
    """A bucket's pairs: of all its tokens, with the counts of those to learn from."""

    def __init__(self, table: pa.Table, classes: int):
        blob = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for x in table.column(name)]
        self.blocks = table.column("block").to_pylist()
        words, counts, contexts, self.docs = blob("words", np.uint64), blob("counts", np.uint32), blob("contexts", np.uint16), blob("docs", np.uint16)
        flags = [np.unpackbits(x) for x in blob("train", np.uint8)]
        self.sizes = [len(x) for x in flags]
        train = np.concatenate([f[d] for f, d in zip(flags, self.docs, strict=True)]).astype(bool)
        known, at = np.unique(np.concatenate(words), return_inverse=True)
        word = np.repeat(at, np.concatenate(counts))
        self.words = len(known)
        pairs, self.pair = np.unique(word * classes + np.concatenate(contexts), return_inverse=True)
        self.word, self.context = pairs // classes, pairs % classes
        self.counts = np.bincount(self.pair, train, minlength=len(pairs))
        self.word_counts = np.bincount(self.word, self.counts, minlength=self.words)


def _sums(rows: DataFrame) -> np.ndarray:
    """Sum of packed vectors (group, v), first in groups and then here."""

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"v": pa.array([sum(np.frombuffer(x.as_buffer(), np.float64) for x in table.column("v")).tobytes()], pa.binary())})

    parts = rows.groupBy(F.pmod("bucket", F.lit(32)).alias("g")).applyInArrow(lambda t: add(t), "v binary").collect()
    return sum((np.frombuffer(r["v"], np.float64) for r in parts), np.zeros(1))


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_col: str, classes: int = 1 << 14, burn: int = 3, samples: int = 3) -> DataFrame:
    """One row per document: id, train flag, n_tokens, n_known, train_tokens, base_score, score and perplexity.

    The model and the base learn from the rows whose train_col is true.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language-model")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(F.col(train_col), F.lit(False)).alias("train"))
    heavy = _heavy_tokens(rows, classes)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    buckets = int(min(100_000, max(16, -(-total // BUCKET_BYTES))))
    name = "pagelens_tokens_" + scratch.root.rsplit("-", 1)[1]
    path = f"{scratch.root}/tokens"
    try:
        _deal(rows, heavy, buckets, classes).repartition(buckets, "bucket").write.bucketBy(buckets, "bucket").option("path", path).saveAsTable(name)
        dealt = spark.table(name)
        packed = dealt.where("kind = 0").select("bucket", "block", "words", "counts", "contexts", "docs", "train").groupBy("bucket")

        # counts of heavy tokens by context: at most HEAVY times classes numbers
        def add(table: pa.Table) -> pa.Table:
            out = np.zeros(classes)
            for c, at in zip(table.column("counts"), table.column("contexts"), strict=True):
                out[np.frombuffer(at.as_buffer(), np.uint16)] += np.frombuffer(c.as_buffer(), np.int64)
            return pa.table({"h": pa.array([table.column("block")[0].as_py()], pa.int64()), "v": pa.array([out.tobytes()], pa.binary())})

        heavy_counts = np.zeros((len(heavy), classes))
        for r in dealt.where("kind = 2").select("bucket", "block", "counts", "contexts").groupBy("bucket").applyInArrow(add, "h long, v binary").collect():
            heavy_counts[r["h"]] = np.frombuffer(r["v"], np.float64)
        h_word, h_context = np.nonzero(heavy_counts)
        h_pairs = heavy_counts[h_word, h_context]
        h_words = heavy_counts.sum(axis=1)

        def describe(key: tuple, table: pa.Table) -> pa.Table:
            b = _Bucket(table, classes)
            seen = b.counts > 0
            spread = np.bincount(b.word[seen], minlength=b.words)
            v = np.concatenate([np.bincount(b.context, b.counts, minlength=classes), np.bincount(b.context[seen], minlength=classes), [b.counts.sum(), (b.word_counts > 0).sum(), (b.counts == 1).sum(), (b.counts == 2).sum(), (spread == 1).sum(), (spread == 2).sum()]])
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([v.astype(np.float64).tobytes()], pa.binary())})

        vector = "bucket long, v binary"
        v = _sums(packed.applyInArrow(describe, vector))
        v = v if len(v) > 1 else np.zeros(2 * classes + 6)
        customers = v[:classes] + heavy_counts.sum(axis=0)
        tables = v[classes : 2 * classes] + np.bincount(h_context, minlength=classes)
        n, types, one, two, one_word, two_words = v[2 * classes :]
        n, types = int(n + h_words.sum()), int(types + (h_words > 0).sum())
        rate = lambda a, b: min(0.95, max(0.05, (a + 1) / (a + 2 * b + 2)))
        g = Totals(n, types, customers, tables, float(tables.sum()), float(types), rate(one, two), rate(one_word, two_words))

        def burnt(key: tuple, table: pa.Table) -> pa.Table:
            b = _Bucket(table, classes)
            rng = np.random.Generator(np.random.PCG64([key[0].as_py(), 1]))
            t = start(b.word, b.context, b.counts, b.words, g, rng)
            parent = np.zeros(0)
            for _ in range(burn):
                t, parent, _ = sweep(b.word, b.context, b.counts, b.words, t, g, rng)
            v = np.concatenate([np.bincount(b.context, t, minlength=classes), [t.sum(), parent.sum()]])
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([v.astype(np.float64).tobytes()], pa.binary())})

        v = _sums(packed.applyInArrow(burnt, vector))
        v = v if len(v) > 1 else np.zeros(classes + 2)
        rng, parent = np.random.Generator(np.random.PCG64(99)), np.zeros(0)
        t = start(h_word, h_context, h_pairs, len(heavy), g, rng)
        for _ in range(burn):
            t, parent, _ = sweep(h_word, h_context, h_pairs, len(heavy), t, g, rng)
        after = replace(g, tables=v[:classes] + np.bincount(h_context, t, minlength=classes), parent_customers=float(v[classes] + t.sum()), parent_tables=float(v[classes + 1] + parent.sum()))
        base_of = lambda c: np.log10((c + 0.5) / (n + 0.5 * (types + 1)))

        def scored(key: tuple, table: pa.Table) -> pa.Table:
            b = _Bucket(table, classes)
            own, parent = averaged(b.word, b.context, b.counts, b.words, after, [key[0].as_py(), 2], burn, samples)
            p = np.log10(own + _new_table(after)[b.context] * parent[b.word])
            base, known = base_of(b.word_counts)[b.word], (b.word_counts > 0)[b.word].astype(np.float64)
            out, places, at = [], [], 0
            for docs_, size in zip(b.docs, b.sizes, strict=True):
                pair = b.pair[at : at + len(docs_)]
                at += len(docs_)
                # only the documents that hold a token of this bucket
                held = np.flatnonzero(np.bincount(docs_, minlength=size))
                places.append(held.astype(np.uint16).tobytes())
                out.append(np.concatenate([np.bincount(docs_, x[pair], minlength=size)[held] for x in (p, base, known)]).tobytes())
            return pa.table({"block": pa.array(b.blocks, pa.int64()), "places": pa.array(places, pa.binary()), "v": pa.array(out, pa.binary())})

        light = packed.applyInArrow(scored, "block long, places binary, v binary").unionByName(dealt.where("kind = 1").select("block", F.lit(None).cast("binary").alias("places"), F.col("words").alias("v")))

        def unpacked(table: pa.Table) -> pa.Table:
            at = table.column("places")
            keys = np.frombuffer(table.filter(at.is_null()).column("v")[0].as_buffer(), np.int64)
            parts = np.zeros((3, len(keys)))
            for places, x in zip(at, table.column("v"), strict=True):
                if places.is_valid:
                    parts[:, np.frombuffer(places.as_buffer(), np.uint16)] += np.frombuffer(x.as_buffer(), np.float64).reshape(3, -1)
            return pa.table({"rid": pa.array(keys), **{c: pa.array(x) for c, x in zip(("ls", "lb", "lk"), parts, strict=True)}})

        light = light.groupBy("block").applyInArrow(unpacked, "rid long, ls double, lb double, lk double")
        # equal rows have equal sums
        light = scratch.table(light.groupBy("rid").agg(F.first("ls").alias("ls"), F.first("lb").alias("lb"), F.first("lk").alias("lk")), "light")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    dealt._scratch_path = path  # type: ignore[attr-defined]
    scratch.drop(dealt)

    # heavy tokens: their probabilities in every context, seen there or not, and their counts go to the second reading
    own, parent = averaged(h_word, h_context, h_pairs, len(heavy), after, [98], burn, samples)
    table_p = np.outer(parent, _new_table(after))
    table_p[h_word, h_context] += own
    table_p = np.log10(table_p).astype(np.float32)
    heavy_base, heavy_known, find = base_of(h_words), (h_words > 0).astype(np.float64), _Heavy(heavy)
    sent = spark.sparkContext.broadcast(table_p)  # at most HEAVY times classes numbers

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                token, context, starts = _tokens(part.column(1), classes)
                which = find(token)
                at = np.flatnonzero(which >= 0)
                doc = np.searchsorted(starts, at, side="right") - 1
                w = which[at]
                sums = [np.bincount(doc, x, minlength=part.num_rows) for x in (sent.value[w, context[at]].astype(np.float64), heavy_base[w], heavy_known[w])] if len(heavy) else [np.zeros(part.num_rows)] * 3
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array(np.diff(starts)), *map(pa.array, sums)], names=["rid", "id", "train", "n_tokens", "hs", "hb", "hk"])

    kind = dict(docs.dtypes)[id_col]
    counted = rows.select("rid", "t", "id", "train").mapInArrow(second, f"rid long, id {kind}, train boolean, n_tokens long, hs double, hb double, hk double")
    both = counted.join(light, "rid", "left")
    whole = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0.0))
    return both.select(
        F.col("id").alias(id_col), F.col("train").alias(train_col), "n_tokens", whole("hk", "lk").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        whole("hb", "lb").alias("base_score"), whole("hs", "ls").alias("score"), F.pow(F.lit(10.0), -whole("hs", "ls") / F.col("n_tokens")).alias("perplexity"),
    )

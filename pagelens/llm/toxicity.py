"""Toxicity by a factorization machine over hashed terms.

Method: a text's terms are its words and their first 4, 5 and 6 bytes, hashed. The
machine scores w0 + sum w_i + sum over pairs <v_i, v_j> over the terms present, so that
two terms together can say what neither says alone. It is fitted on a bounded sample of
labelled rows (``sample_rows``, the rows with the smallest hash of their id) over the
``n_terms`` terms that differ most between the classes there, by ``min_z`` standard
deviations at least. Scoring covers all rows with whole-array operations in Arrow batches.

Defined cases
  null or empty text  no terms: scored by the bias alone
  null id             scored; never part of the sample
  null label          not learned from; several labels of one id: the largest
  no labelled rows    every score is 0
  repeated rows       one output row each
  ties                terms of equal weight are ordered by their hash
  empty table         an empty result
  other columns       ignored, or carried along by score, whatever their names
  long texts          whole; presence of a term counts, not its number
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.textops import LOWER, mix64, slices, span_hashes, utf8_buffer

PREFIXES = (4, 5, 6)
#: Bytes of words: ASCII letters and digits, and all of other alphabets.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def _terms(column: pa.Array, wanted: Filter | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, term) of the distinct terms of each text, in that order; only the wanted ones if given."""
    data, offsets = utf8_buffer(column)
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    found_rows, found = [], []
    for size in (0, *PREFIXES):
        if size:
            some = np.flatnonzero(ends - starts >= size)
            h = span_hashes(data, starts[some], starts[some] + size)
        else:
            some, h = slice(None), span_hashes(data, starts, ends)
        h, r = mix64(h + np.uint64(size)), rows[some]
        if wanted is not None:
            keep = wanted(h)
            h, r = h[keep], r[keep]
        found_rows.append(r)
        found.append(h)
    r, h = np.concatenate(found_rows), np.concatenate(found)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return r[new], h[new]


class Filter:
    """Which hashes are among a sorted set: a bitmap first, a binary search for what passes it."""

    def __init__(self, known: np.ndarray):
        self.known = known
        self.map = np.zeros(1 << 18, dtype=bool)
        self.map[(known & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    def __call__(self, h: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.map[(h & np.uint64((1 << 18) - 1)).astype(np.int64)])
        if not len(self.known) or not len(maybe):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.known, h[maybe]), len(self.known) - 1)
        return maybe[self.known[at] == h[maybe]]


@dataclass
class FactorizationMachine:
    """Weights over sorted term hashes."""

    terms: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """rows ascending; at: index of each present term."""
        linear = np.bincount(rows, self.linear[at], minlength=n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[at, f]
            pairs += np.bincount(rows, v, minlength=n) ** 2 - np.bincount(rows, v * v, minlength=n)
        return self.bias + linear + pairs / 2

    @classmethod
    def fit(cls, terms: np.ndarray, rows: np.ndarray, at: np.ndarray, labels: np.ndarray, *, factors: int = 4, epochs: int = 150, rate: float = 0.05, precision: float = 4.0, seed: int = 5) -> FactorizationMachine:
        """Logistic loss, all rows in each step, Adam. precision: of the normal prior of all weights, so few rows move them little."""
        n, m = len(labels), len(terms)
        decay = precision / n
        rng = np.random.Generator(np.random.PCG64(seed))
        model = cls(terms, float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5))), np.zeros(m), rng.normal(0, 0.05, (m, factors)))
        theta = [np.array([model.bias]), model.linear, model.factors]
        first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
        for step in range(1, epochs + 1):
            model.bias, model.linear, model.factors = float(theta[0][0]), theta[1], theta[2]
            error = 1 / (1 + np.exp(-np.clip(model.margins(rows, at, n), -30, 30))) - labels
            each = error[rows]
            g_factors = np.empty_like(theta[2])
            for f in range(factors):
                v = theta[2][at, f]
                sums = np.bincount(rows, v, minlength=n)
                g_factors[:, f] = np.bincount(at, each * (sums[rows] - v), minlength=m)
            grads = [np.array([error.sum()]) / n, np.bincount(at, each, minlength=m) / n + decay * theta[1], g_factors / n + decay * theta[2]]
            for x, g, a, b in zip(theta, grads, first, second, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                x -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        model.bias, model.linear, model.factors = float(theta[0][0]), theta[1], theta[2]
        return model


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 20_000, n_terms: int = 4000, min_docs: int = 3, min_z: float = 2.0) -> FactorizationMachine | None:
    """Fits on the labelled rows given; None if a class is missing. labels: columns doc_id and label_col."""
    sample = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col("doc_id").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).join(F.broadcast(sample), "id")  # at most sample_rows pairs of numbers

    def distinct_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                rows, terms = _terms(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), part.column(2).take(pa.array(rows)), pa.array(terms.view(np.int64))], names=["id", "y", "term"])

    present = texts.select("id", "t", "y").mapInArrow(distinct_terms, "id long, y int, term long")
    totals = sample.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    if not totals["p"] or totals["p"] == totals["n"]:
        return None
    share = totals["p"] / totals["n"]
    counts = present.groupBy("term").agg(F.sum("y").alias("p"), F.count("*").alias("n")).where(F.col("n") >= min_docs)
    expected = F.col("n") * share
    differs = F.abs((F.col("p") - expected) / F.sqrt(expected))
    best = counts.where(differs > min_z).orderBy(differs.desc(), "term").limit(n_terms).select("term")
    terms = np.sort(np.array([r["term"] for r in best.collect()], dtype=np.int64).view(np.uint64))
    wanted = Filter(terms)

    def kept_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                rows, found = _terms(part.column(1), wanted)
                at = np.searchsorted(terms, found).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(len(part.column(0)) + 1)).astype(np.int32)), pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), lists], names=["id", "y", "at"])

    # at most sample_rows lists of at most n_terms small numbers
    table = texts.select("id", "t", "y").mapInArrow(kept_terms, "id long, y int, at array<int>").toArrow().sort_by("id").combine_chunks()
    lists = table.column("at").combine_chunks()
    sizes = np.asarray(pc.list_value_length(lists))
    return FactorizationMachine.fit(terms, np.repeat(np.arange(len(sizes)), sizes), np.asarray(lists.flatten()), table.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: FactorizationMachine | None, *, text_col: str = "text", to: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (all if None) with the probability in the column to, which replaces one of that name."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != to]
    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("t"))
    schema = docs.select(*keep).withColumn(to, F.lit(0.0)).schema
    wanted = Filter(model.terms) if model is not None else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                if model is None:
                    p = np.zeros(part.num_rows)
                else:
                    rows, found = _terms(part.column(len(keep)), wanted)
                    p = 1 / (1 + np.exp(-np.clip(model.margins(rows, np.searchsorted(model.terms, found), part.num_rows), -30, 30)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(p)], names=schema.names)

    return source.mapInArrow(work, schema)

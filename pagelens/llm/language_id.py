"""Language identification by multilingual mixture inference.

Method: each language has a smoothed distribution over hashed byte n-grams. A text is
cut into units of a few words; every unit's log-likelihood under each language follows
from its n-grams. Expectation-maximisation estimates the text's language proportions,
the languages are ordered by proportion, and the set of the first 1, 2 or 3 with the
largest penalised likelihood (half the logarithm of the number of units, times
``penalty``, for each further language) is selected. The predicted language is the
largest of the set; the score is its proportion.

The n-gram distributions are fitted on a bounded sample: about ``per_language`` rows of
each language, by a hash of the id; the model's size follows the number of languages. Inference covers all rows and whole texts.

Defined cases
  null text, no letter  ``und`` with score 0, no languages
  null id               predicted; never part of the sample
  null language         not learned from
  nothing to learn      ``und`` with score 0 for every row
  repeated rows         one output row each
  ties                  the language that comes first in code order
  empty table           an empty result
  other columns         ignored, or carried along by predict, whatever their names
  long texts            whole
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.textops import LOWER, slices, utf8_buffer, word_bounds

GRAM = 4
BITS = 16
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True


def _gram_buckets(data: np.ndarray) -> np.ndarray:
    """The bucket of the n-gram that ends at each byte; lower case, digits and spaces as one byte."""
    plain = LOWER[data].astype(np.uint32)
    plain[(data >= 48) & (data < 58)] = 48
    plain[data <= 32] = 32
    h = np.zeros(len(data), dtype=np.uint32)
    for back in range(GRAM):
        shifted = np.full(len(data), 32, dtype=np.uint32)
        shifted[back:] = plain[: len(data) - back]
        h = (h ^ shifted) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # bucket x language


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, smoothing: float = 0.5) -> LanguageModel | None:
    """The n-gram distributions of the languages of the rows given."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("lang")).where("id is not null and t is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"))
    share = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    sample = rows.join(sizes, "lang").where(share * F.col("n") < per_language).select("lang", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "t"):
                data, offsets = utf8_buffer(part.column(1))
                buckets = _gram_buckets(data)
                for i, lang in enumerate(part.column(0).to_pylist()):
                    held.setdefault(lang, np.zeros(1 << BITS, np.int64))
                    held[lang] += np.bincount(buckets[offsets[i] : offsets[i + 1]], minlength=1 << BITS)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    # at most 2**BITS numbers for each language
    table = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    if not languages:
        return None
    counts = np.full((1 << BITS, len(languages)), smoothing)
    at = {x: i for i, x in enumerate(languages)}
    lang = np.array([at[x] for x in table.column("lang").to_pylist()])
    counts[table.column("bucket").to_numpy(), lang] += table.column("n").to_numpy()
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32))


def _row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows first[i]:first[i+1]; 0 for none."""
    sums = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return sums[first[1:]] - sums[first[:-1]]


def infer(texts: pa.Array, model: LanguageModel, *, unit_words: int = 6, power: float = 0.4, penalty: float = 2.0, rounds: int = 12, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(languages by proportion, -1 for none; their proportions) of each text, most columns."""
    data, offsets = utf8_buffer(texts)
    n, k = len(texts), len(model.languages)
    starts, ends, first = word_bounds(data, offsets)
    counts = np.diff(first)
    units = -(-counts // unit_words)
    unit_first = np.concatenate([[0], np.cumsum(units)]).astype(np.int64)
    row = np.repeat(np.arange(n), units)
    word = (np.arange(unit_first[-1]) - unit_first[row]) * unit_words + first[row]
    edges = np.concatenate([starts[word], [len(data)]]) if len(word) else np.zeros(1, np.int64)
    if len(word):  # bytes before a text's first word belong to no text's likelihood that matters: they are spaces
        like = np.add.reduceat(model.log_prob[_gram_buckets(data)], edges[:-1], axis=0).astype(np.float64) * power
    else:
        like = np.zeros((0, k))
    top = like.max(axis=1, keepdims=True) if len(like) else like[:, :1]
    odds = np.exp(np.maximum(like - top, -60))
    share = np.full((n, k), 1.0 / k)
    size = np.maximum(units, 1)[:, None]

    def estimate(share: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            joint = odds * share[row]
            share = _row_sums(joint / np.maximum(joint.sum(axis=1, keepdims=True), 1e-300), unit_first) / size
        return share

    share = estimate(share)
    order = np.argsort(-share, axis=1, kind="stable")[:, :most]
    best = np.full(n, -np.inf)
    languages, proportions = np.full((n, most), -1), np.zeros((n, most))
    for m in range(1, min(most, k) + 1):
        allowed = np.zeros((n, k))
        np.put_along_axis(allowed, order[:, :m], 1.0, axis=1)
        start = share * allowed + allowed * 1e-9
        own = estimate(start / start.sum(axis=1, keepdims=True)) if m > 1 else allowed
        value = _row_sums(np.log(np.maximum((odds * own[row]).sum(axis=1), 1e-300)), unit_first) - penalty * 0.5 * (m - 1) * np.log(np.maximum(units, 2))
        better = value > best + 1e-9
        best[better] = value[better]
        ranked = np.take_along_axis(own, order[:, :m], axis=1)
        inner = np.argsort(-ranked, axis=1, kind="stable")
        languages[better] = -1
        languages[better, :m] = np.take_along_axis(order[:, :m], inner, axis=1)[better]
        proportions[better, :m] = np.take_along_axis(ranked, inner, axis=1)[better]
    # without a letter nothing is said
    letters = np.concatenate([[0], np.cumsum(_LETTER[data])])
    for i in np.flatnonzero(letters[offsets[1:]] == letters[offsets[:-1]]).tolist():
        text = texts[i].as_py()
        if text is None or not any(map(str.isalpha, text)):
            languages[i], proportions[i] = -1, 0.0
    return languages, np.clip(proportions, 0, 1)


def predict(docs: DataFrame, model: LanguageModel | None, *, text_col: str = "text", keep: list[str] | None = None, unknown: str = "und") -> DataFrame:
    """The columns in keep with lang_pred, score and languages, the selected set with its proportions; they replace columns of those names."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "languages")]
    source = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)), F.col(text_col).alias("t"))
    plain = docs.select(*keep).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "languages": F.lit("")})
    schema = plain.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                n = part.num_rows
                if model is None:
                    which, share = np.full((n, 1), -1), np.zeros((n, 1))
                else:
                    which, share = infer(part.column(len(keep)), model)
                names = [*(model.languages if model else []), unknown]
                listed = [",".join(f"{names[x]}:{p:.3f}" for x, p in zip(a, b, strict=True) if x >= 0) for a, b in zip(which.tolist(), share.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array([names[x] for x in which[:, 0]]), pa.array(share[:, 0].astype(np.float64)), pa.array(listed, pa.string())], names=schema.names)

    return source.mapInArrow(work, schema)

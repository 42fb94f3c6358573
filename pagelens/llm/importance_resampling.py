"""Importance resampling towards a target corpus, by bucket-partitioned inverted postings.

Method: word n-grams are hashed into buckets. Every document becomes postings (bucket, doc,
count), and those of the target corpus go the same way. Postings are shuffled to cells of a
group of buckets and a document, so that a bucket that every document holds is dealt out by
document. Each cell adds up its buckets for both corpora; the sums of a bucket, one row for
each of at most ``buckets`` buckets, give its gain. Every posting then emits its
contribution, count times gain, where it lies; contributions are added up inside a cell and
then by document. A draw adds Gumbel noise from a seeded hash of the id and takes the
highest scores, which is sampling without replacement by weight.

Defined cases
  null text      no features: weight 0
  null id        kept; its noise is that of an empty id, and among ties it comes last
  repeated rows  one output row each, with ranks of their own; equal ids with other texts stay apart
  ties           the smaller id
  empty table    an empty result; an empty target: every t is 0
  other columns  ignored
  long texts     whole; a text's words are in one task at a time
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pagelens.llm.scratch import Scratch
from pagelens.llm.textops import LOWER, slices, utf8_buffer

#: Groups of buckets: a document's contributions meet in so many rows at most.
GROUPS = 16
#: In place of a bucket: rows that carry a document's number of features and of words.
FEATURES, WORDS = -1, -2
#: Words of more bytes than this take their checksum one by one.
_LONG = 64

_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_TABLE = _crc_table()


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Running checksums carried on over byte ranges, side by side."""
    state, size = state.copy(), ends - starts
    for i in np.flatnonzero(size > _LONG).tolist():
        state[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    live = np.flatnonzero((size > 0) & (size <= _LONG))
    step = 0
    while len(live):
        state[live] = _TABLE[(state[live] ^ data[starts[live] + step]) & 0xFF] ^ (state[live] >> np.uint32(8))
        step += 1
        live = live[size[live] > step]
    return state


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word of lower-cased texts, and each text's first word (n+1 entries)."""
    inside = np.concatenate([[False], _IS_WORD[data], [False]])
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, offsets)


def feature_buckets(column: pa.Array, max_n: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row and the bucket of each n-gram of 1 to max_n words, and each row's number of words."""
    data, offsets = utf8_buffer(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), counts)
    state = _crc_on(np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32), data, starts, ends)
    last, rows, found = np.arange(len(starts)), [row], [state]
    for _ in range(1, max_n):
        # one word more for those with a next word in their text: a space, then the word
        on = np.flatnonzero(last + 1 < first[row + 1])
        row, last = row[on], last[on] + 1
        state = _TABLE[(state[on] ^ 0x20) & 0xFF] ^ (state[on] >> np.uint32(8))
        state = _crc_on(state, data, starts[last], ends[last])
        rows.append(row)
        found.append(state)
    return np.concatenate(rows), ((np.concatenate(found) ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64), counts


def postings(docs: DataFrame, *, id_col: str | None = "doc_id", text_col: str = "text", max_n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, doc, key, n): how often a document holds a bucket; and its totals under FEATURES and WORDS. key tells texts apart."""
    doc = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = docs.select(doc.alias("doc"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"), F.col(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                row, bucket, words = feature_buckets(part.column(2), max_n, buckets)
                cell, n = np.unique(row * buckets + bucket, return_counts=True)
                every = np.arange(part.num_rows)
                at = pa.array(np.concatenate([cell // buckets, every, every]))
                bucket = np.concatenate([cell % buckets, np.full(len(every), FEATURES), np.full(len(every), WORDS)])
                n = np.concatenate([n, np.bincount(row, minlength=len(every)), words])
                columns = [pa.array(bucket.astype(np.int32)), part.column(0).take(at), part.column(1).take(at), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "doc", "key", "n"])

    return rows.mapInArrow(work, "bucket int, doc long, key long, n long")


def _noise(id_: Column, seed: int) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    max_n: int = 1,
    buckets: int = 10_000,
    seed: int = 2024,
    min_words: int = 20,
    percent: int = 10,
) -> DataFrame:
    """Per row of docs: doc_id, n_features, weight, score, and rank where it is drawn.

    Of the N documents with at least min_words words, floor(percent * N / 100) are drawn.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resample")
    how = {"max_n": max_n, "buckets": buckets}
    both = postings(docs, id_col=id_col, text_col=text_col, **how).withColumn("target", F.lit(False)).unionByName(postings(target, id_col=None, text_col=target_text_col, **how).withColumn("target", F.lit(True)))
    cells = scratch.table(both.repartition(F.pmod("bucket", F.lit(GROUPS)), "doc", "key"), "postings")

    s, t = (F.coalesce(F.sum(F.when(F.col("target") == side, F.col("n"))), F.lit(0)) for side in (False, True))
    sums = scratch.table(cells.where("bucket >= 0").groupBy("bucket").agg(s.alias("s"), t.alias("t")), "sums")
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    as_double = lambda x: F.col(x).cast("double")
    ratio = (as_double("t") + 1) * F.lit(float(total["s"] + buckets)) / ((as_double("s") + 1) * F.lit(float(total["t"] + buckets)))
    gains = sums.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))  # at most `buckets` rows

    contributions = cells.where("not target").join(F.broadcast(gains), "bucket", "left")
    weight = F.coalesce(F.sum(F.when(F.col("bucket") >= 0, F.col("n") * F.col("gain"))), F.lit(0))
    copies = F.count_if(F.col("bucket") == FEATURES)
    of = lambda mark: F.max(F.when(F.col("bucket") == mark, F.col("n")))
    by_doc = contributions.groupBy("doc", "key").agg(weight.alias("weight"), copies.alias("copies"), of(FEATURES).alias("n_features"), of(WORDS).alias("n_words"))
    # equal rows have met: each has its share of the sum
    by_doc = by_doc.select("doc", "key", "n_features", "n_words", F.expr("weight div copies").alias("weight"), F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    scored = by_doc.withColumns({"score": F.col("weight") + _noise(F.col("doc"), seed), "drawable": F.col("n_words") >= min_words})

    order = [F.col("drawable").desc(), F.col("score").desc(), F.col("doc").asc_nulls_last(), F.col("key"), F.col("copy")]
    ordered = scored.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ordered = scratch.table(ordered, "scored")
    scratch.drop(cells, sums)
    # offsets of the parts: one row for each partition
    parts = sorted((r["part"], r["rows"], r["drawable"]) for r in ordered.groupBy("part").agg(F.count("*").alias("rows"), F.count_if("drawable").alias("drawable")).collect())
    before, offsets = 0, []
    for part, rows, _ in parts:
        offsets.append((part, before))
        before += rows
    draws = sum(x[2] for x in parts) * percent // 100
    numbered = ordered.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part")
    place = F.row_number().over(W.Window.partitionBy("part").orderBy(*order)).cast("long") + F.col("before")
    rank = F.when(F.col("drawable") & (place <= draws), place)
    return numbered.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", rank.alias("rank"))

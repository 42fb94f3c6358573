"""Removal of repeated substrings by suffix arrays.

Every byte is removed that a string of ``length`` bytes covers which also starts at any
other place, in the same text or another. The suffix arrays come from induced sorting
(see ``suffix_array``) over shards; what has to meet in a shard is found first:

  anchors   in every window of ``length`` bytes one place with the smallest 64-bit hash of
            ``gram`` bytes is an anchor. Equal strings have the same smallest hash, so the
            places of a repeated string hold anchors of one hash. Ties are broken by place
            only among equal hashes.
  contexts  an anchor's context is all that a string of ``length`` bytes around it can
            cover. Anchors whose hash occurs once are dropped. Equal contexts are covered
            whole, and one of them stands for all in what follows.
  shards    the different contexts of an anchor's hash go to one shard; overlapping
            contexts of a text there are one region. Each shard's suffix array and
            permuted common prefixes tell which strings start twice.

An anchor's hash with more than ``hot_contexts`` different contexts would fill a shard
alone; its strings are counted by their hashes with a grouped count instead, which
combines before the shuffle, so no group of texts is ever gathered in one task.

Defined cases
  null text      counts as empty: no bytes, the checksum of nothing
  null id        like any other; texts are told apart by two hashes of id and text
  repeated rows  are copies of each other: removed whole from ``length`` bytes on
  ties           of equal smallest hashes in a window any may be the anchor; removal itself has no ties
  empty table    an empty result
  other columns  ignored, or carried along by remove_repeats, whatever their names
  long texts     whole; a shard takes 64 KiB of a long text at a time
  Removal may split a character in two; remove_repeats drops the bytes of such characters.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.scratch import Scratch
from pagelens.llm.suffix_array import repeated_starts
from pagelens.llm.textops import _BASE, _BASE_INV, _BYTE_CODE, _power, mix64, slices, utf8_buffer

#: Two hashes tell a text from all others.
DOC = ["doc", "doc2"]
SHARD_BYTES = 1 << 20
#: Contexts of one hash up to which its shard is that of the first text they occur in.
FAMILY = 64
_SEPARATOR = 255  # no UTF-8 text holds this byte


class _Rolling:
    """Hashes of any byte range of a buffer."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE_CODE[data] * _power("up", _BASE, len(data)), out=self.sums[1:])
        self.down = _power("down", _BASE_INV, len(data) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.sums[ends] - self.sums[starts]) * self.down[starts])

    def grams(self, k: int) -> np.ndarray:
        return mix64((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k])


def _sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of width values, from prefix and suffix minima of blocks."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, place, start and end of the context in its text, hash of the anchor, hash of the context, places of that hash in the text, 2 at most)."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return (none,) * 4 + (none.view(np.uint64),) * 2 + (none,)
    rolling, width = _Rolling(data), length - gram + 1
    h = rolling.grams(gram)
    least = _sliding_minimum(h, width)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    whole = np.arange(len(least)) + length <= ends[: len(least)]
    # candidates: the smallest of a window; that is what the largest minimum of the windows around a place tells
    around = np.concatenate([np.full(width - 1, np.iinfo(np.uint64).max), np.where(whole, ~least, np.iinfo(np.uint64).max), np.full(width - 1, np.iinfo(np.uint64).max)])
    some = np.flatnonzero(~_sliding_minimum(around, width)[: len(h)] == h)
    # among equal hashes (runs of one phrase) any one, by a permutation of the places
    some = some[np.lexsort((some.astype(np.uint64) * _BASE, h[some]))]
    rank = np.full(len(h), np.iinfo(np.uint64).max)
    rank[some] = np.arange(len(some), dtype=np.uint64)
    chosen = np.zeros(len(h), dtype=bool)
    chosen[some[np.unique(_sliding_minimum(rank, width)[whole]).astype(np.int64)]] = True
    at = np.flatnonzero(chosen)
    row = np.searchsorted(offsets, at, side="right") - 1
    start, end = np.maximum(at - (width - 1), offsets[row]), np.minimum(at + length, offsets[row + 1])
    context = mix64(rolling.of(start, end) ^ mix64(((at - start) << 32 | (end - start)).astype(np.uint64)))
    # overlapping equal strings may share one anchor: then its hash stands at another place of the text too
    held = np.zeros(1 << 20, dtype=bool)
    held[(h[at] >> np.uint64(44)).astype(np.int64)] = True
    echo = np.flatnonzero(held[(h >> np.uint64(44)).astype(np.int64)])
    echo = echo[np.isin(h[echo], h[at])]
    pairs = np.stack([np.searchsorted(offsets, echo, side="right") - 1, h[echo].view(np.int64)], axis=1)
    order = np.lexsort((pairs[:, 1], pairs[:, 0]))
    pairs = pairs[order]
    twice = np.zeros(len(pairs), dtype=bool)
    same = (pairs[1:] == pairs[:-1]).all(axis=1)
    twice[1:] |= same
    twice[:-1] |= same
    chosen_twice = np.zeros(len(h), dtype=bool)
    chosen_twice[echo[order[twice]]] = True
    return row, at - offsets[row], start - offsets[row], end - offsets[row], h[at], context, 1 + chosen_twice[at].astype(np.int64)


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted, disjoint, not touching spans with the same union."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.flatnonzero(np.r_[True, spans[1:, 0] > reach[:-1]])
    return np.stack([spans[new, 0], reach[np.r_[new[1:] - 1, len(spans) - 1]]], axis=1)


def _shard_spans(pdf: pd.DataFrame, length: int) -> pd.DataFrame:
    """Spans of the texts in one shard that strings occurring twice cover. Columns doc, doc2, start, bytes."""
    pieces, place = [], 0
    for x in pdf["bytes"]:
        pieces += [np.frombuffer(x, dtype=np.uint8) + np.uint8(1), np.array([_SEPARATOR], dtype=np.uint8)]
    symbols = np.concatenate(pieces)
    hit = repeated_starts(symbols, 256, length, _SEPARATOR)
    doc, doc2, start, end = [], [], [], []
    for d, d2, first, x in zip(pdf["doc"], pdf["doc2"], pdf["start"], pdf["bytes"], strict=True):
        at = np.flatnonzero(hit[place : place + len(x)])
        place += len(x) + 1
        if len(at):
            for a, b in _merged(np.stack([at, at + length], axis=1)).tolist():
                doc.append(d)
                doc2.append(d2)
                start.append(first + a)
                end.append(first + b)
    return pd.DataFrame({name: np.array(x, dtype=np.int64) for name, x in (("doc", doc), ("doc2", doc2), ("start", start), ("end", end))})


def repeated_spans(texts: DataFrame, scratch: Scratch, *, length: int, gram: int = 64, hot_contexts: int = 16_384, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc, doc2, spans) for the rows (doc, doc2, t) whose text holds a repeated string; spans are in order and apart."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                row, at, start, end, h, context, seen = _anchors(*utf8_buffer(part.column(2)), length, gram)
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(pa.array(row)) for i in range(2)), pa.array(at), pa.array(start), pa.array(end), pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(seen)], names=[*DOC, "at", "start", "end", "h", "context", "seen"])

    found = scratch.table(texts.select(*DOC, "t").mapInArrow(anchors, "doc long, doc2 long, at long, start long, end long, h long, context long, seen long"), "anchors")
    repeated = found.groupBy("h").agg(F.sum("seen").alias("n")).where("n > 1").select("h")
    found = found.join(repeated, "h")
    contexts = scratch.table(found.groupBy("h", "context").agg(F.count("*").alias("n"), F.max("seen").alias("seen"), F.min(F.struct(*DOC, "at", "start", "end")).alias("one")), "contexts")
    equal = found.join(contexts.where("n > 1").select("h", "context"), ["h", "context"], "left_semi").select(*DOC, F.array(F.struct("start", "end")).alias("spans"))

    groups = contexts.groupBy("h").agg(F.count("*").alias("m"), F.max("seen").alias("seen"), F.min("one").alias("first")).where("m > 1 or seen > 1")
    groups = groups.select("h", "m", F.when(F.col("m") <= FAMILY, F.xxhash64("first.doc", F.floor(F.col("first.start") / 65536))).otherwise(F.xxhash64("h")).alias("key"))
    members = scratch.table(contexts.join(groups, "h").select("h", "m", "key", "one.*"), "members")
    total = members.where(F.col("m") <= hot_contexts).agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_bytes))
    wanted = members.where(F.col("m") <= hot_contexts).groupBy(*DOC).agg(F.collect_list(F.struct(F.pmod("key", F.lit(shards)).alias("shard"), "start", "end")).alias("regions"))
    wanted = scratch.table(wanted, "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for d, d2, text, regions in zip(*batch.columns, strict=True):
                data = text.as_buffer()
                table = np.stack([regions.values.field(i).to_numpy() for i in range(3)], axis=1)
                for shard in np.unique(table[:, 0]).tolist():
                    for a, b in _merged(table[table[:, 0] == shard, 1:]).tolist():
                        out.append((shard, d.as_py(), d2.as_py(), a, data.slice(a, b - a).to_pybytes()))
                if len(out) > 2000:
                    yield _batch(out)
                    out = []
            yield _batch(out)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in columns[:4]), pa.array(columns[4], pa.binary())], names=["shard", *DOC, "start", "bytes"])

    regions = texts.join(wanted, DOC).select(*DOC, "t", "regions").mapInArrow(cut, "shard long, doc long, doc2 long, start long, bytes binary")
    spans = regions.groupBy("shard").applyInPandas(lambda pdf: _shard_spans(pdf, length), "doc long, doc2 long, start long, end long")
    partly = spans.select(*DOC, F.array(F.struct("start", "end")).alias("spans"))

    # strings around anchors with very many contexts: a grouped count of their hashes
    hot = members.where(F.col("m") > hot_contexts)
    every = equal.unionByName(partly)
    if hot.limit(1).count():
        places = scratch.table(hot.groupBy(*DOC).agg(F.collect_list(F.struct("h", "at", "start", "end")).alias("hot")), "hot")

        def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, d2, text, around in zip(*batch.columns, strict=True):
                    rolling = _Rolling(np.frombuffer(text.as_buffer(), dtype=np.uint8))
                    table = np.stack([around.values.field(i).to_numpy() for i in range(4)], axis=1)
                    for h in np.unique(table[:, 0]).tolist():
                        # a string's start counts once, however many anchors of this hash it holds
                        starts = [np.arange(max(start, at + gram - length), min(at, end - length) + 1) for _, at, start, end in table[table[:, 0] == h].tolist()]
                        a = np.unique(np.concatenate(starts))
                        n = len(a)
                        yield pa.RecordBatch.from_arrays([*(pa.array(np.full(n, x, np.int64)) for x in (d.as_py(), d2.as_py(), h)), pa.array(a.astype(np.int64)), pa.array(rolling.of(a, a + length).view(np.int64))], names=[*DOC, "h", "start", "string"])

        held = texts.join(places, DOC).select(*DOC, "t", "hot").mapInArrow(strings, "doc long, doc2 long, h long, start long, string long")
        held = scratch.table(held, "strings")
        twice = held.groupBy("h", "string").agg(F.count("*").alias("n")).where("n > 1").select("h", "string")
        every = every.unionByName(held.join(twice, ["h", "string"], "left_semi").select(*DOC, F.array(F.struct("start", (F.col("start") + length).alias("end"))).alias("spans")))
    found = every.groupBy(*DOC).agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_merged(np.stack([x.values.field(i).to_numpy() for i in range(2)], axis=1)) for x in batch.column(2)]
            flat = np.concatenate(lists) if lists else np.zeros((0, 2), dtype=np.int64)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32)), spans)], names=[*DOC, "spans"])

    return scratch.table(found.mapInArrow(merged, "doc long, doc2 long, spans array<struct<start:long,end:long>>"), "spans")


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int | None = None, digest_only: bool = False, **how) -> DataFrame:
    """docs with repeated substrings removed from the text.

    gram: bytes of an anchor, a fifth of the length but 64 at most unless given.
    digest_only: instead, per row the id, n_bytes, n_removed, n_spans and kept_sha256 of the
    bytes left, and the text left.
    """
    scratch = Scratch(docs.sparkSession, "substrings")
    # rows of the same id and text are alike: their spans are found once a row and merged
    keys = [F.xxhash64(F.col(id_col), F.octet_length(text_col), F.col(text_col)), F.xxhash64(F.lit(21), F.col(text_col), F.col(id_col))]
    names = docs.columns
    own = docs.select(F.struct(*names).alias("row"), *[k.alias(c) for k, c in zip(keys, DOC, strict=True)])
    text = F.col("row").getField(text_col)
    texts = own.where(F.octet_length(text) >= length).select(*DOC, text.alias("t"))
    spans = repeated_spans(texts, scratch, length=length, gram=gram or min(64, max(1, length // 5)), **how)
    joined = own.join(spans, DOC, "left")

    def left(text, regions) -> tuple[int, int, int, bytes]:
        data = text.as_buffer() if text.is_valid else pa.py_buffer(b"")
        if not regions.is_valid:
            return data.size, 0, 0, memoryview(data)
        merged = _merged(np.stack([regions.values.field(i).to_numpy() for i in range(2)], axis=1))
        keep = np.ones(data.size, dtype=bool)
        for a, b in merged.tolist():
            keep[a:b] = False
        return data.size, int((merged[:, 1] - merged[:, 0]).sum()), len(merged), np.frombuffer(data, dtype=np.uint8)[keep].tobytes()

    def text_left(text, spans) -> str | None:
        return bytes(left(text, spans)[3]).decode("utf-8", "ignore") if spans.is_valid else text.as_py()

    if digest_only:

        def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [left(t, s) for t, s in zip(batch.column(1), batch.column(2), strict=True)]
                numbers = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                texts = [bytes(r[3]).decode("utf-8", "ignore") for r in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), *numbers, pa.array([hashlib.sha256(r[3]).hexdigest() for r in rows], pa.string()), pa.array(texts, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

        out = joined.select(F.col("row").getField(id_col).cast("long").alias("id"), text.alias("t"), "spans").mapInArrow(digest, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
        return out.withColumnRenamed("id", id_col)

    at = names.index(text_col)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_left(t, s) for t, s in zip(batch.column(at), batch.column(len(names)), strict=True)]
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1 : len(names)]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*(F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(names)), "spans").mapInArrow(rewrite, docs.schema)

"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Method: a length n has the reciprocal class k = floor(capacity / n), so k documents of
class k always fit one bin. Each worker keeps one open bin for each class and closes it
when it holds k documents. What the bin lacks to the capacity, at most capacity/(k+1),
is topped up with a slice of the next document that is cut anyway (one longer than the
capacity) or, when many bins wait, of any next document. Workers share nothing: a
partition's sequences hold its own documents only; at its end, the bins still open or
waiting are cut up to fill each other, so that one sequence of a partition is padded.

Defined cases
  null text      counts as empty: the document is its end id alone
  null id        kept, as a null id
  repeated rows  packed one by one
  ties           documents are taken in the order of their partition
  empty table    an empty result
  other columns  ignored
  long texts     cut into slices of the capacity; one text at a time is in memory
"""

from __future__ import annotations

import base64
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bins that may wait for a top-up before any next document is cut for them.
MAX_WAITING = 512


class ByteTokenizer:
    """Ids of the byte-level vocabulary.

    The rank file beside the tokenizers file holds the same vocabulary and is read faster.
    Texts with characters outside Latin, where two libraries' Unicode tables might differ,
    go through the tokenizers library itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str, pattern: str):
        import re

        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._full = Tokenizer.from_file(tokenizer_path)
        self._full.encode_special_tokens = True
        self._plain = re.compile("[\t\n\r\x20-\x7e\xa1\xa3-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ſ‐-‧]*").fullmatch

    def __call__(self, text: str) -> np.ndarray:
        if self._plain(text):
            return np.asarray(self._fast.encode_to_numpy(text, disallowed_special=()), dtype="<u4")
        return np.array(self._full.encode(text, add_special_tokens=False).ids, dtype="<u4")


def byte_tokenizer(folder_path) -> ByteTokenizer:
    """The tokenizer of the installed vocabulary files; folder_path(name) gives a file's place."""
    import public_tokenizers

    return ByteTokenizer(folder_path("byte_bpe_50k.json"), folder_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


class _Packer:
    """The open bins of one worker. add() and finish() append rows to out.

    A piece is (document, its ids, its first place in the document, the document's tokens).
    """

    def __init__(self, capacity: int, worker: int):
        self.capacity, self.next_id = capacity, worker << 36
        self.open: dict[int, list] = {}
        self.waiting: deque = deque()  # [tokens held, pieces] of bins that have their count but are not full
        self.out: list[tuple] = []

    def emit(self, pieces: list) -> None:
        sequence, offset = self.next_id, 0
        self.next_id += 1
        for doc, ids, start, total in pieces:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))
            offset += len(ids)

    def top_up(self, piece: tuple) -> tuple | None:
        """Fills the first waiting bin from the piece; what is left of it, or None."""
        doc, ids, start, total = piece
        bin_ = self.waiting[0]
        length = min(self.capacity - bin_[0], len(ids))
        bin_[0] += length
        bin_[1].append((doc, ids[:length], start, total))
        if bin_[0] == self.capacity:
            self.emit(self.waiting.popleft()[1])
        return (doc, ids[length:], start + length, total) if length < len(ids) else None

    def add(self, doc, ids: np.ndarray) -> None:
        piece: tuple | None = (doc, ids, 0, len(ids))
        if len(ids) > self.capacity or len(self.waiting) >= MAX_WAITING:
            while piece and self.waiting:
                piece = self.top_up(piece)
        while piece and len(piece[1]) >= self.capacity:
            _, left, start, total = piece
            self.emit([(doc, left[: self.capacity], start, total)])
            piece = (doc, left[self.capacity :], start + self.capacity, total) if len(left) > self.capacity else None
        if not piece:
            return
        k = self.capacity // len(piece[1])
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) == k:
            pieces = self.open.pop(k)
            held = sum(len(x[1]) for x in pieces)
            if held == self.capacity:
                self.emit(pieces)
            else:
                self.waiting.append([held, pieces])

    def finish(self) -> None:
        """Bins short of their count, and then the emptiest waiting ones, are cut up to fill the others."""
        loose = [x for k in sorted(self.open) for x in self.open[k]]
        self.open = {}
        self.waiting = deque(sorted(self.waiting, key=lambda b: -b[0]))
        while loose or len(self.waiting) > 1:
            if not loose:
                loose = self.waiting.pop()[1]
            if not self.waiting:
                self.waiting.append([0, []])
            left = self.top_up(loose.pop())
            if left:
                loose.append(left)
        if self.waiting:
            self.emit(self.waiting.pop()[1])

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        columns = list(zip(*out, strict=True)) if out else [[]] * 7
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 0, tokenizer=None) -> DataFrame:
    """One row for each piece: where it lies in its document and in its sequence.

    tokenizer: a function without arguments, run once in each task, that gives a function
    from a text to its ids. Every document's ids are followed by end_id.
    """

    def default():
        import public_tokenizers

        return byte_tokenizer(public_tokenizers.path)

    make = tokenizer or default

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = make(), np.array([end_id], dtype="<u4")
        packer = _Packer(capacity, TaskContext.get().partitionId())
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                packer.add(doc, np.concatenate([encode(text), end]) if text else end)
                if len(packer.out) >= 50_000:
                    yield packer.rows()
            yield packer.rows()
        packer.finish()
        yield packer.rows()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(work, SCHEMA)

"""SentencePiece encoding and decoding for merge-type vocabularies.

Method: a text's symbols start as its characters. The agenda holds every adjacent pair
whose concatenation is a piece, ordered by the piece's score, the leftmost first among
equals; the best pair is merged and its neighbours enter the agenda, until it is empty.
No piece holds the space mark after another character, so the text falls into chunks, a
run of space marks with what follows, that never merge across. A worker encodes each new
chunk once. The agendas of many chunks run side by side: one array holds the scores of
all pairs of all chunks, and each round pops every chunk's best pair at once. Chunks of
over ``_WIDE`` characters use a heap.

Every chunk's ids are checked against the sentencepiece library in the Arrow batch that
brings the chunk; a difference stops the task. Decoding is the library's.

Defined cases
  null text      counts as empty: no ids, an empty decoded text
  null id        kept
  repeated rows  one output row each
  ties           equal scores: the leftmost pair, as in the library
  empty table    an empty result
  other columns  ignored
  long texts     whole; a chunk is whole too, however long
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_WIDE = 48
#: Chunks a worker remembers; beyond it, it starts afresh.
CACHE_CHUNKS = 600_000
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


class MergeVocabulary:
    """Pieces, scores and pair merges of a sentencepiece model of the merge type."""

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_path)
        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or not model.trainer_spec.byte_fallback:
            raise ValueError("not a merge-type model with byte fallback and plain normalisation")
        kinds = pb.ModelProto.SentencePiece
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces) or any(re.search(f"[^{MARK}]{MARK}", x) for x in self.ids):
            raise ValueError("pieces that are not merged by score alone")
        self.score = {x: model.pieces[i].score for x, i in self.ids.items()}
        self.byte = [0] * 256
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte[int(p.piece[1:-1], 16)] = i
        # symbols: the pieces by id, and characters that are no piece from len(pieces) on
        pairs = {}
        for x in self.ids:
            for cut in range(1, len(x)):
                a, b = self.ids.get(x[:cut]), self.ids.get(x[cut:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = (self.ids[x], self.score[x])
        order = sorted(pairs)
        self.pair_keys = np.array(order, dtype=np.int64)
        self.pair_piece = np.array([pairs[k][0] for k in order], dtype=np.int32)
        # a pair's priority: the rank of its score; equal scores share one, so that the leftmost comes first
        _, rank = np.unique(np.array([pairs[k][1] for k in order]), return_inverse=True)
        self.priority = np.append(rank, -1).astype(np.int32)
        # an open-addressed table over the pairs: two probes instead of a binary search
        self.bits = max(4, int(np.ceil(np.log2(len(order) * 4 + 1))))
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        for i, k in enumerate(order):
            at = self._slot(np.int64(k))
            while self.table[at] >= 0:
                at = (at + 1) & ((1 << self.bits) - 1)
            self.table[at] = i
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for x, i in self.ids.items():
            if len(x) == 1:
                self.char_ids[ord(x)] = i

    def _slot(self, keys):
        with np.errstate(over="ignore"):
            return ((np.asarray(keys).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The index of each pair of symbols, -1 where they don't merge."""
        known = np.flatnonzero((left >= 0) & (right >= 0))
        out = np.full(len(left), -1, dtype=np.int32)
        keys = (left[known].astype(np.int64) << 32) | right[known]
        at = self._slot(keys)
        while len(known):
            there = self.table[at]
            hit = there >= 0
            same = hit & (self.pair_keys[np.maximum(there, 0)] == keys)
            out[known[same]] = there[same]
            on = hit & ~same
            known, keys, at = known[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()]

    def encode_chunks(self, chunks: list[str]) -> list[tuple[int, ...]]:
        """The ids of each chunk. Chunks of about one length share an array."""
        out: list = [None] * len(chunks)
        lengths = np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            width = int(lengths[order[at]])
            if width > _WIDE:
                for i in order[at:]:
                    out[i] = self._by_heap(chunks[i])
                break
            width = min(_WIDE, max(4, width + 2))
            to = at + int(np.searchsorted(lengths[order[at:]], width, side="right"))
            to = min(to, at + 200_000 // width)
            for i, ids in zip(order[at:to].tolist(), self._side_by_side([chunks[i] for i in order[at:to].tolist()], width), strict=True):
                out[i] = ids
            at = to
        return out

    def _side_by_side(self, chunks: list[str], width: int) -> list[tuple[int, ...]]:
        n = len(chunks)
        points = np.frombuffer("".join([x.ljust(width, "\0") for x in chunks]).encode("utf-32-le"), dtype=np.uint32).reshape(n, width)
        length = np.fromiter(map(len, chunks), dtype=np.int64, count=n)
        inside = np.arange(width)[None, :] < length[:, None]
        sym = self.char_ids[points]
        foreign = np.flatnonzero(((sym < 0) & inside).any(axis=1))
        sym[~inside] = -1
        agenda = self.priority[self.find(sym[:, :-1].ravel(), sym[:, 1:].ravel())].reshape(n, width - 1)
        agenda[foreign] = -1
        out: list = [None] * n
        live, places = np.arange(n), np.arange(width - 1)
        while len(live):
            best = agenda.argmax(axis=1)
            rows = np.arange(len(live))
            top = agenda[rows, best]
            empty = top < 0
            if empty.any():
                ended = np.flatnonzero(empty)
                for i, ids, k in zip(live[ended].tolist(), sym[ended].tolist(), length[ended].tolist(), strict=True):
                    out[i] = tuple(ids[:k])
                on = np.flatnonzero(~empty)
                if not len(on):
                    break
                most = int(length[on].max())  # the arrays narrow as chunks shorten
                live, length, best, top = live[on], length[on], best[on], top[on]
                sym, agenda, places = sym[on, :most], agenda[on, : most - 1], places[: most - 1]
                rows = np.arange(len(live))
            merged = self.pair_piece[self.find(sym[rows, best], sym[rows, best + 1])]
            # the right symbol of the merged pair goes: what follows moves one place to the left
            later = places[None, :] > best[:, None]
            sym[:, :-1] = np.where(later, sym[:, 1:], sym[:, :-1])
            sym[:, -1] = -1
            sym[rows, best] = merged
            length -= 1
            np.copyto(agenda[:, :-1], agenda[:, 1:].copy(), where=later[:, 1:])
            agenda[:, -1] = -1
            for at in (best - 1, best):
                ok = np.flatnonzero((at >= 0) & (at < sym.shape[1] - 1))
                agenda[ok, at[ok]] = self.priority[self.find(sym[ok, at[ok]], sym[ok, at[ok] + 1])]
        for i in foreign.tolist():
            out[i] = self._by_heap(chunks[i])
        return out

    def _by_heap(self, chunk: str) -> tuple[int, ...]:
        text = list(chunk)
        n = len(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0:
                piece = text[a] + text[b]
                score = self.score.get(piece)
                if score is not None:
                    heapq.heappush(agenda, (-score, a, b, piece))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, piece = heapq.heappop(agenda)
            if not text[a] or not text[b] or after[a] != b or text[a] + text[b] != piece:
                continue
            text[a], text[b] = piece, ""
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        return tuple(chain.from_iterable((self.ids[x],) if x in self.ids else self.fallback(x) for x in text if x))


def chunks_of(text: str) -> list[str]:
    """The chunks of a text that is not empty, with the mark the library puts before it."""
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return _CHUNK.findall(MARK + text.replace(" ", MARK))
    return [MARK + x for x in text.split(" ")]


class Codec:
    """Encodes the texts of Arrow batches; remembers chunks."""

    def __init__(self, model_path: str):
        self.vocabulary = MergeVocabulary(model_path)
        self.ids: dict[str, tuple[int, ...]] = {}
        self.numbers = [str(i) for i in range(self.vocabulary.library.get_piece_size())]

    def learn(self, chunks: set[str]) -> None:
        new = [x for x in chunks if x not in self.ids]
        if len(self.ids) + len(new) > CACHE_CHUNKS:
            self.ids, new = {}, list(chunks)
        found = self.vocabulary.encode_chunks(new)
        expected = self.vocabulary.library.encode([x[1:] for x in new], num_threads=1)
        for x, ids, want in zip(new, found, expected, strict=True):
            # an empty text has no ids, while a lone mark within a text has
            if list(ids) != want and x != MARK:
                raise AssertionError(f"chunk {x!r}: {ids} differs from the library's {want}")
            self.ids[x] = ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text."""
        split = [chunks_of(x) if x else [] for x in texts]
        self.learn(set(chain.from_iterable(split)))
        return [list(chain.from_iterable(map(self.ids.__getitem__, x))) for x in split]

    def written(self, ids: list[int]) -> str:
        """The ids in decimal, joined by commas."""
        numbers = self.numbers
        return ",".join([numbers[i] for i in ids])


_codecs: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    """The worker's codec; a Python worker that serves several tasks keeps it."""
    if model_path not in _codecs:
        _codecs[model_path] = Codec(model_path)
    return _codecs[model_path]


def _groups(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[tuple[list, list[str]]]:
    ids, texts, held = [], [], 0
    for i, x in zip(batch.column(0), batch.column(1), strict=True):
        x = x.as_py() or ""
        ids.append(i.as_py())
        texts.append(x)
        held += len(x)
        if held >= most:
            yield ids, texts
            ids, texts, held = [], [], 0
    if ids:
        yield ids, texts


def encode(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, with_digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and ids (with_ids), decoded (with_ids) or the digests of both."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long" + ", ids array<int>, decoded string" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digest
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, while passes over millions of remembered tuples cost a third of the time
        try:
            for batch in batches:
                for keys, texts in _groups(batch):
                    ids = c.encode(texts)
                    decoded = c.vocabulary.library.decode(ids, num_threads=1)
                    columns = [pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64())]
                    if with_ids:
                        columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    if with_digest:
                        columns += [pa.array([hashlib.sha256(x.encode()).hexdigest() for x in side]) for side in (map(c.written, ids), decoded)]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            if collects:  # the worker may serve other tasks
                gc.enable()

    return rows.mapInArrow(work, schema)


def decode(rows: DataFrame, model_path: str, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the decoded text of a column of ids."""

    @F.pandas_udf("string")
    def text(column):
        library = codec(model_path).vocabulary.library
        return column.map(lambda x: "" if x is None else library.decode([int(i) for i in x]))

    return rows.withColumn(to, text(ids_col))

"""Byte-level BPE encoding and decoding by forced-boundary splitting.

Method: a pair of bytes that stands inside no token of the vocabulary can only lie across
a token's border, so a table of 256 x 256 entries marks certain cuts. A batch's texts are
cut at once, at those certain cuts that are a border for the library's own splitting rule
too, whatever stands around them: between ASCII characters of different kinds, and before
white space that follows anything else. A worker encodes each new fragment once: the
library's rule splits it, each part is cut again at all certain cuts, and what remains is
merged by rank. No merge crosses a certain cut, so a text's ids are those of its fragments,
one after another.

Decoding puts the tokens' bytes together, a batch at once.

Defined cases
  null text      counts as empty: no ids, an empty decoded text
  null id        kept
  repeated rows  one output row each
  ties           equal ranks: the leftmost pair, as in the library
  special tokens their strings in a text become their ids, as in the library by default;
                 special=False takes them as ordinary text
  empty table    an empty result
  other columns  ignored
  long texts     whole; a text without a certain cut is one fragment, merged with a heap
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.llm.textops import slices, utf8_buffer

#: Fragments a worker remembers, and the longest of them; beyond that number it starts afresh.
CACHE_FRAGMENTS = 400_000
LONGEST_KEPT = 64
#: Fragments of more bytes than this are merged with a heap.
SHORT = 24
#: A fragment that the library's splitting rule leaves whole.
_WHOLE = re.compile(rb" ?(?:[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]+)").fullmatch
#: White space outside ASCII, as UTF-8.
_WIDE_SPACE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x180E)]


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary's file: itself where printable, else the next free one from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xFF and b != 0xAD]
    out = {chr(b): b for b in plain}
    return out | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def splitting_borders() -> np.ndarray:
    """Pairs of bytes between which the splitting rule of byte-level vocabularies has a border in any text.

    Kinds of characters part letters, numbers, white space and others; only an apostrophe goes
    with letters behind it, and a space with what follows. After white space a border depends
    on more than the pair. A byte of a character outside ASCII may be of any kind; behind it
    white space is a border unless it ends white space itself, which _wide_spaces tells.
    """
    letter, number, other, space, wide = range(5)
    kind = np.full(256, -1)
    kind[0x21:0x7F] = other
    kind[0x30:0x3A] = number
    kind[0x41:0x5B] = kind[0x61:0x7B] = letter
    kind[[0x20, *range(0x09, 0x0E)]] = space
    kind[0x80:] = wide
    left, right = kind[:, None], kind[None, :]
    out = (left >= 0) & (right >= 0) & (left != right) & (left != space) & (right != wide) & ((left != wide) | (right == space))
    out[ord("'"), kind == letter] = False
    return out


class ByteVocabulary:
    """Tokens, merges and certain cuts of a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, special: bool = True):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        added = {x["content"]: x for x in spec["added_tokens"] if special}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in added.values()):
            raise ValueError("special tokens that take up what stands beside them")
        self.special = {x: t["id"] for x, t in added.items()}
        self.special_pattern = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str

        self.byte_of = byte_characters()
        to_bytes = lambda x: bytes(map(self.byte_of.__getitem__, x))
        tokens = {i: to_bytes(x) for x, i in model["vocab"].items()}
        inside = np.zeros((256, 256), dtype=bool)
        for x in tokens.values():
            inside[list(x[:-1]), list(x[1:])] = True
        self.certain = ~inside
        self.certain_pairs = self.certain.tobytes()
        self.border = self.certain & splitting_borders()
        self.single = [model["vocab"].get(c) for c, _ in sorted(self.byte_of.items(), key=lambda x: x[1])]
        if None in self.single:
            raise ValueError("a byte without a token")
        ids = {x: i for i, x in tokens.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges: dict[int, int] = {}  # the pair of ids -> its rank and the merged id
        for rank, (a, b) in enumerate(pairs):
            a, b = to_bytes(a), to_bytes(b)
            self.merges.setdefault((ids[a] << 32) | ids[b], (rank << 32) | ids[a + b])
        for x in spec["added_tokens"]:  # a special token is decoded to its string
            tokens.setdefault(x["id"], x["content"].encode())
        size = max(tokens) + 1
        self.length = np.array([len(tokens.get(i, b"")) for i in range(size)], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), dtype=np.uint8)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]

    def cuts(self, data: np.ndarray) -> np.ndarray:
        """Places where every text may be cut before it is split."""
        if len(data) < 2:
            return np.zeros(0, np.int64)
        before, here = data[:-1], data[1:]
        border = self.border[before, here]
        # behind a single tab or line break too, as neither joins what follows
        lone = (here >= 0x09) & (here <= 0x0D)
        lone[-1:] = False
        at = np.flatnonzero(lone) + 1
        at = at[~_is_space(data[at - 1]) & ~_is_space(data[at + 1]) & (data[at - 1] < 0x80) & (data[at + 1] < 0x80) & self.certain[data[at], data[at + 1]]]
        border[at] = True
        at = np.flatnonzero(border) + 1
        wide = at[data[at - 1] >= 0x80]
        return np.setdiff1d(at, wide[_wide_spaces(data, wide)], assume_unique=True) if len(wide) else at

    def merge(self, fragment: bytes) -> list[int]:
        """Ids of bytes without a certain cut between them."""
        ids = [self.single[b] for b in fragment]
        if len(ids) > SHORT:
            return self._merge_by_heap(ids)
        get, none = self.merges.get, 1 << 62
        found = [get((a << 32) | b, none) for a, b in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best == none:
                break
            at = found.index(best)
            new = ids[at] = best & 0xFFFFFFFF
            del ids[at + 1], found[at]
            if at < len(found):
                found[at] = get((new << 32) | ids[at + 1], none)
            if at:
                found[at - 1] = get((ids[at - 1] << 32) | new, none)
        return ids

    def _merge_by_heap(self, ids: list[int]) -> list[int]:
        n = len(ids)
        before, after, alive = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        agenda: list[tuple[int, int, int]] = []

        def offer(a: int, b: int) -> None:
            found = self.merges.get((ids[a] << 32) | ids[b])
            if found:
                heapq.heappush(agenda, (found, a, b))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            found, a, b = heapq.heappop(agenda)
            if not alive[a] or not alive[b] or after[a] != b or self.merges.get((ids[a] << 32) | ids[b]) != found:
                continue
            ids[a], alive[b] = found & 0xFFFFFFFF, False
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
                offer(a, after[b])
            if before[a] >= 0:
                offer(before[a], a)
        return [ids[i] for i in range(n) if alive[i]]

    def encode_fragment(self, fragment: bytes, known: dict[bytes, bytes]) -> bytes:
        """Packed ids of a fragment; known has those of parts between certain cuts."""
        out = []
        for raw in [fragment] if _WHOLE(fragment) else [bytes(map(self.byte_of.__getitem__, x)) for x, _ in self.split(fragment.decode())]:
            if len(raw) <= LONGEST_KEPT:
                places = [i for i in range(1, len(raw)) if self.certain_pairs[(raw[i - 1] << 8) | raw[i]]]
            else:
                data = np.frombuffer(raw, np.uint8)
                places = (np.flatnonzero(self.certain[data[:-1], data[1:]]) + 1).tolist()
            for a, b in zip([0, *places], [*places, len(raw)], strict=True):
                piece = raw[a:b]
                packed = known.get(piece)
                if packed is None:
                    packed = b"".join([self.packed[i] for i in self.merge(piece)])
                    if len(piece) <= LONGEST_KEPT:
                        known[piece] = packed
                out.append(packed)
        return b"".join(out)

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all tokens and the place after each token's."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        at = np.repeat(self.start[ids] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)
        return self.bytes[at], ends


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))


def _wide_spaces(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the places stand behind white space outside ASCII."""
    out = np.zeros(len(at), dtype=bool)
    for space in _WIDE_SPACE:
        here = at >= len(space)
        for j, byte in enumerate(space):
            here[here] = data[at[here] - len(space) + j] == byte
        out |= here
    return out


class Codec:
    """Encodes the texts of Arrow batches; remembers fragments, and parts of fragments, apart."""

    def __init__(self, path: str, special: bool):
        self.vocabulary = ByteVocabulary(path, special)
        self.fragments: dict[bytes, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

    def _packed(self, fragments: list[bytes]) -> list[bytes]:
        found = list(map(self.fragments.get, fragments))
        for i, packed in enumerate(found):
            if packed is None:
                x = fragments[i]
                packed = self.fragments.get(x)
                if packed is None:
                    packed = self.vocabulary.encode_fragment(x, self.parts)
                    if len(x) <= LONGEST_KEPT:
                        self.fragments[x] = packed
                found[i] = packed
        for kept in (self.fragments, self.parts):
            if len(kept) > CACHE_FRAGMENTS:
                kept.clear()
        return found

    def _one(self, text: bytes) -> bytes:
        """A text that holds a special token."""
        v, out = self.vocabulary, []
        for x in v.special_pattern.split(text.decode()):
            if x in v.special:
                out.append(np.array([v.special[x]], dtype="<u4").tobytes())
            elif x:
                raw = x.encode()
                places = v.cuts(np.frombuffer(raw, np.uint8)).tolist()
                out += self._packed([raw[a:b] for a, b in zip([0, *places], [*places, len(raw)], strict=True)])
        return b"".join(out)

    def encode(self, column: pa.Array) -> list[bytes]:
        """Packed ids (little-endian unsigned 32-bit) of each text."""
        data, offsets = utf8_buffer(column)
        raw = data.tobytes()
        # a cut at every text's start as well; empty texts have no fragment
        places = np.union1d(self.vocabulary.cuts(data), offsets)
        starts = places[places < len(data)]
        first = np.searchsorted(starts, offsets).tolist()
        bounds = [*starts.tolist(), len(raw)]
        packed = self._packed([raw[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        out = [b"".join(packed[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
        if any(x.encode() in raw for x in self.vocabulary.special):
            ends = offsets.tolist()
            for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if any(x.encode() in raw[a:b] for x in self.vocabulary.special):
                    out[i] = self._one(raw[a:b])
        return out

    def decode(self, packed: list[bytes]) -> list[str]:
        """The text of each; bytes that are no UTF-8 become the replacement character."""
        data, ends = self.vocabulary.decode_bytes(np.frombuffer(b"".join(packed), dtype="<u4"))
        raw, counts = data.tobytes(), np.cumsum([0, *(len(x) // 4 for x in packed)])
        at = np.concatenate([[0], ends])[counts].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]


_codecs: dict[tuple[str, bool], Codec] = {}


def codec(path: str, special: bool = True) -> Codec:
    """The worker's codec; a Python worker that serves several tasks keeps it."""
    if (path, special) not in _codecs:
        _codecs[path, special] = Codec(path, special)
    return _codecs[path, special]


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", special: bool = True, with_ids: bool = True, with_digest: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, and ids and decoded (with_ids) or the digests of both (with_digest)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long" + ", ids array<long>, decoded string" * with_ids + ", ids_sha256 string, decoded_sha256 string" * with_digest
    names = [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, special)
        for batch in batches:
            for part in slices(batch, "text"):
                packed = c.encode(part.column(1))
                decoded = c.decode(packed)
                columns = [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64())]
                if with_ids:
                    ids = np.frombuffer(b"".join(packed), dtype="<u4").astype(np.int64)
                    ends = np.cumsum([0, *(len(x) // 4 for x in packed)])
                    columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)), pa.array(decoded, pa.string())]
                if with_digest:
                    columns += [pa.array([hashlib.sha256(x).hexdigest() for x in packed]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(work, schema)


def decode(rows: DataFrame, path: str, *, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of a column of ids; null gives an empty text."""

    @F.pandas_udf("string")
    def text(column):
        import pandas as pd

        return pd.Series(codec(path).decode([b"" if x is None else np.asarray(x).astype("<u4").tobytes() for x in column]), index=column.index)

    return rows.withColumn(to, text(ids_col))

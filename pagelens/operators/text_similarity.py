"""Unigram scores of text pairs, and repeated passages within a text."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import bleu1, rouge1_recall


def unigram_scores(pairs: DataFrame, keys: list[str], reference: Column, candidate: Column) -> DataFrame:
    """keys, bleu_1 and rouge_1_recall of two token arrays on each row.

    Tokens are counted as rows: one shuffle by pair and token, one by pair, however long the texts.
    """
    side = lambda tokens, which: pairs.select(*keys, F.explode(tokens).alias("token"), F.lit(which).alias("side"))
    counted = side(reference, 0).unionByName(side(candidate, 1)).groupBy(*keys, "token").agg(F.count_if(F.col("side") == 0).alias("r"), F.count_if(F.col("side") == 1).alias("c"))
    sums = counted.groupBy(*keys).agg(F.sum(F.least("r", "c")).alias("matched"), F.sum("r").alias("rn"), F.sum("c").alias("cn"), F.count_if((F.col("r") > 0) & (F.col("c") > 0)).alias("shared"), F.count_if(F.col("r") > 0).alias("distinct_r"))
    scored = sums.select(*keys, bleu1(F.col("matched"), F.col("cn"), F.col("rn")).alias("bleu_1"), rouge1_recall(F.col("shared"), F.col("distinct_r")).alias("rouge_1_recall"))
    return pairs.select(*keys).distinct().join(scored, keys, "left").fillna(0.0, ["bleu_1", "rouge_1_recall"])


def unigram_scores_of(texts: DataFrame, references: DataFrame, key: str, ref: str) -> DataFrame:
    """bleu_1 and rouge_1_recall of each text against its reference. texts: key, ref, words; references: ref, words.

    Words are counted once a text and once a reference; only words that both hold meet.
    """
    count = lambda rows, keys: rows.select(*keys, F.explode("words").alias("x")).groupBy(*keys, "x").agg(F.count("*").alias("n"))
    shared = count(texts, [key, ref]).join(count(references, [ref]).withColumnRenamed("n", "rn"), [ref, "x"])
    shared = shared.groupBy(key).agg(F.sum(F.least("n", "rn")).alias("m"), F.count("*").alias("common"))
    sizes = references.select(ref, F.size("words").alias("rt"), F.size(F.array_distinct("words")).alias("distinct"))
    rows = texts.select(key, ref, F.size("words").alias("ct")).join(sizes, ref).join(shared, key, "left").fillna(0, ["m", "common"])
    bleu, recall = bleu1(F.col("m"), F.col("ct"), F.col("rt")), rouge1_recall(F.col("common"), F.col("distinct"))
    return rows.select(key, ref, bleu.alias("bleu_1"), recall.alias("rouge_1_recall"))


class Heads:
    """Texts of at most size characters, and which of them can be as similar to a text as wanted.

    Matching blocks are a common subsequence, so the longest one bounds their ratio. Its lengths
    with all heads are found at once: bits of one whole number, a lane for each head, with a
    free bit that takes the carry.
    """

    def __init__(self, size: int, similarity: float):
        self.texts: list[str] = []
        self.lane, self.similarity = (size + 8) // 8 * 8, similarity
        self.full, self.places = 0, {}

    def add(self, text: str) -> None:
        shift = self.lane * len(self.texts)
        own: dict[str, int] = {}
        for i, c in enumerate(text):
            own[c] = own.get(c, 0) | 1 << i
        for c, bits in own.items():
            self.places[c] = self.places.get(c, 0) | bits << shift
        self.full |= ((1 << len(text)) - 1) << shift
        self.texts.append(text)

    def common(self, text: str) -> np.ndarray:
        """Lengths of the longest common subsequences of text and each head."""
        left = self.full
        for c in text:
            hit = left & self.places.get(c, 0)
            if hit:
                left = ((left + hit) | (left - hit)) & self.full
        gone = (self.full & ~left).to_bytes(self.lane // 8 * len(self.texts), "little")
        return np.bitwise_count(np.frombuffer(gone, dtype=np.uint8)).reshape(len(self.texts), -1).sum(axis=1)

    def first(self, text: str) -> int | None:
        """The first head that is similar enough."""
        if not self.texts:
            return None
        bound = self.common(text)
        for i in np.flatnonzero(2.0 * bound >= self.similarity * len(text)):
            head = self.texts[i]
            if 2.0 * int(bound[i]) / (len(head) + len(text)) >= self.similarity and SequenceMatcher(None, head, text).ratio() >= self.similarity:
                return int(i)
        return None


def repeated_chunks(docs: DataFrame, key: str, text: str, *, size: int = 100, similarity: float = 0.8, repeats: int = 5) -> DataFrame:
    """key, chunks and cut: where a text starts to repeat itself, null if it does not.

    The text without tags is cut into chunks; each joins the first cluster whose first chunk
    is similar enough; a cluster of enough chunks tells the offset to cut at. A row helper
    in pandas: similarity here is that of matching blocks, which has no built-in form.
    """

    def cut(pdf_iter):
        for pdf in pdf_iter:
            counts, cuts = [], []
            for x in pdf["t"]:
                chunks = [x[i : i + size] for i in range(0, len(x), size)]
                heads, members = Heads(size, similarity), []
                at = None
                for i, c in enumerate(chunks):
                    own = heads.first(c)
                    if own is None:
                        heads.add(c)
                        members.append([i])
                        continue
                    members[own].append(i)
                    if len(members[own]) == repeats:
                        at = members[own][1] * size
                        break
                counts.append(len(chunks))
                cuts.append(at)
            yield pd.DataFrame({key: pdf[key], "chunks": counts, "cut": pd.array(cuts, dtype="Int64")})

    plain = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<[^>]*>", ""))
    return docs.select(key, plain.alias("t")).mapInPandas(cut, f"{key} {dict(docs.dtypes)[key]}, chunks long, cut long")

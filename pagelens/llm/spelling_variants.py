"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

Method: a word of length l is cut in two halves whose lengths depend on l alone. One edit
touches one half, so two words one edit apart agree in the other: a word enters one cell
for each of its halves, and probes the cells of its own length with its halves and the
cells of words one shorter with the first half at its place and the second half one place
further right. What meets in a cell is a candidate; one edit is verified, and a pair is
kept only in the cell that holds its first difference, so that none comes twice.

A cell in which very many pairs would meet (words that share half their letters) is not
joined. Its words agree but for one half, so the same argument holds inside it: the half
is cut in two, and its words go on in the two smaller cells. That ends with cells whose
words differ in one letter, which the alphabet bounds. Nothing is dropped.

Everything is built of DataFrame functions.

Defined cases
  null text      no words
  null id        counts as an empty id in the text that stands for a word's occurrence
  repeated rows  count again
  ties           forms of equal count: the smallest in code-point order
  empty table    an empty result
  other columns  ignored
  long texts     whole; very long words too, one half at a time
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.llm.scratch import Scratch

LETTERS = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cells in which more pairs than this would meet are halved again.
MOST_PAIRS = 2048


def letter_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 1) -> DataFrame:
    """(id, run): every maximal run of letters of at least min_length in every text, A-Z lower-cased."""
    runs = F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(LETTERS), F.lit(0))
    return docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.filter(runs, lambda x: F.length(x) >= min_length)).alias("run"))


def letter_dropped(id_: Column, run: Column, every: int = 31) -> Column:
    """The run without one letter where every divides the checksum of "<id>:<run>", else the run; a seeded source of misspellings."""
    h = F.crc32(F.concat(id_, F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def counted_words(runs: DataFrame, word: Column, *, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """(word, n): distinct words of at least min_length code points that occur at least min_count times."""
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _cell() -> Column:
    """The cell of a word whose edit lies in [lo, hi) of the shorter word: what stands before and behind that range."""
    behind = F.col("hi") + F.col("longer").cast("int")
    return F.xxhash64("l", "lo", "hi", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", behind + 1, F.length("word")))


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two cells for an edit in either half of its range."""
    middle = F.col("lo") + F.floor((F.col("hi") - F.col("lo")) / 2).cast("int")
    ranges = F.array(F.struct(middle.alias("lo"), F.col("hi")), F.struct(F.col("lo"), middle.alias("hi")))
    split = rows.select("word", "n", "l", "longer", F.explode(ranges).alias("r")).select("word", "n", "l", "longer", "r.lo", "r.hi")
    return split.where("hi > lo").withColumn("cell", _cell())


def near_pairs(words: DataFrame, scratch: Scratch, *, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): each pair of distinct words exactly one edit apart, once. words: word and n, words distinct.

    A cell's candidates are at most most_pairs, or those of words that differ in one letter.
    """
    size = F.length("word")
    roles = F.array(F.struct(size.alias("l"), F.lit(False).alias("longer")), F.struct((size - 1).alias("l"), F.lit(True).alias("longer")))
    start = words.where(size > 0).select("word", "n", F.explode(roles).alias("r")).select("word", "n", "r.l", "r.longer", F.lit(0).alias("lo"), F.col("r.l").alias("hi"))
    # one-letter words have no half to share: the one cell of their length holds them
    rows = _halves(start.where("l > 1")).unionByName(start.where("l <= 1").withColumn("cell", _cell()))
    found: list[DataFrame] = []
    while True:
        rows = scratch.table(rows, "cells")
        own, longer = F.count_if(~F.col("longer")), F.count_if("longer")
        cells = rows.groupBy("cell").agg((own * (own - 1) / 2 + own * longer).alias("pairs")).where("pairs > 0")
        meeting = scratch.table(rows.join(cells, "cell").withColumn("split", (F.col("pairs") > most_pairs) & (F.col("hi") - F.col("lo") > 1)), "meeting")
        scratch.drop(rows)
        joined = meeting.where("not split")
        a = joined.where("not longer").select("cell", "l", "hi", F.col("word").alias("a"), F.col("n").alias("n_a"))
        b = joined.select("cell", "longer", F.col("word").alias("b"), F.col("n").alias("n_b"))
        candidates = a.join(b, "cell").where("longer or a < b")
        first_here = (F.col("hi") == F.col("l")) | (F.substring("a", F.lit(1), F.col("hi")) != F.substring("b", F.lit(1), F.col("hi")))
        verified = candidates.where((F.levenshtein("a", "b", 1) == 1) & first_here)
        found.append(scratch.table(verified.select("a", "n_a", "b", "n_b"), "pairs"))
        left = meeting.where("split")
        if left.isEmpty():
            scratch.drop(meeting)
            break
        rows = _halves(left.drop("cell", "pairs", "split"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def spelling_forms(words: DataFrame, *, ratio: int = 10, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n. words: word and n, words distinct.

    A word's form is its near word of largest n, if that is at least ratio times the word's
    n. Counts grow by ratio along a chain of forms, so chains are short: their ends are
    found by doubling.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.table(words, "words")
    pairs = near_pairs(words, scratch, most_pairs=most_pairs)
    ways = F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n")))
    near = pairs.select(F.explode(ways).alias("w")).select("w.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("minus"), F.col("other"))).alias("best"))
    known = words.join(near, "word", "left")
    is_form = -F.col("best.minus") >= ratio * F.col("n")
    known = scratch.table(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.minus")).alias("form_n")), "forms")
    at = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = scratch.table(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        at = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return known.join(at, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

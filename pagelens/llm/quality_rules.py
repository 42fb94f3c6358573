"""Quality rules with cross-document line frequency, in DataFrame functions only.

Method: every line of a document is normalised and hashed; per host, the distinct
documents holding a line are counted; lines above the limits are removed; a document
that keeps too few of its words is rejected. Two base rules on word count and repeated
eight-word windows come first.

Defined cases
  null text      counts as empty: no words, base_failed true, kept false
  null host      the rows without host are one host of their own
  repeated rows  one output row each; texts of a host with equal normalised lines count as one document
  ties           none: all decisions are on counts
  empty table    an empty result with the same columns
  other columns  ignored; clashing names do no harm because inputs are renamed first
  long texts     whole; repeated windows of a text are grouped by (text, window), so no
                 task holds more than one text's windows
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.scratch import Scratch

SPACE = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


#: Rejected texts up to this number are sent to the tasks; more are joined by shuffle.
SEND_KEYS = 1_000_000


def _keys(text: Column, host: Column) -> tuple[Column, Column, Column]:
    """Two hashes of the text and one of the host, which tell a missing host from an empty one."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text), F.xxhash64(F.coalesce(host, F.lit("")), host.isNull())


def _measures(text: Column, host: Column) -> list[Column]:
    one_space = F.translate(text, SPACES, " " * len(SPACES))
    k1, k2, k3 = _keys(text, host)
    return [k1.alias("k1"), k2.alias("k2"), k3.alias("host"), F.array_remove(F.split(one_space, " "), "").alias("words"), F.filter(F.split(text, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("lines"), text.alias("text")]


def _plain(line: Column) -> Column:
    """A line in lower case, digits as 0, one space between words."""
    return F.btrim(F.regexp_replace(F.translate(F.lower(line), "123456789", "0" * 9), SPACE, " "))


def _line_rows() -> Column:
    """(hash, words) for each entry of the column plain."""
    return F.transform("plain", lambda x: F.struct(F.xxhash64(x).alias("line"), (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).alias("words")))


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """One row of measures and a verdict for each row of docs; see _judged for the parameters."""
    return _judged(docs, id_col=id_col, **how).drop("k1", "k2", "host")


def filter_quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **how) -> DataFrame:
    """The rows of docs that are kept. Verdicts depend on text and host, so rows are matched by their hashes."""
    judged = _judged(docs, id_col=id_col, text_col=text_col, host_col=host_col, **how)
    rejected = Scratch(docs.sparkSession, "rejected").table(judged.where("not kept").select("k1", "k2", "host").distinct(), "rejected")
    host = F.col(host_col).cast("string") if host_col in docs.columns else F.lit(None).cast("string")
    free = max(docs.columns, key=len)  # with anything behind it, no column's name
    keys = dict(zip((f"{free}_k1", f"{free}_k2", f"{free}_host"), _keys(F.coalesce(F.col(text_col), F.lit("")), host), strict=True))
    rejected = rejected.toDF(*keys)
    return docs.withColumns(keys).join(F.broadcast(rejected) if rejected.count() <= SEND_KEYS else rejected, list(keys), "left_anti").select(*docs.columns)


def _judged(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_percent: int = 30,
    line_min_docs: int = 100,
    line_doc_percent: float = 0.5,
    keep_word_percent: int = 30,
) -> DataFrame:
    """One row of measures and a verdict for each row of docs.

    A line of a host is removed when more than line_min_docs distinct documents of the host
    and more than line_doc_percent of them hold it, whatever stands beside it. Documents are
    distinct when their normalised lines are.
    A document is depleted when the lines left hold under keep_word_percent of its words.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "quality")
    host = F.col(host_col) if host_col in docs.columns else F.lit(None)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), host.cast("string").alias("h"))
    split = base.select("id", *_measures(F.col("t"), F.col("h")))
    n = F.size("words")
    # a window's hash from those of its halves: three passes over the words instead of one slice for each window
    once = F.transform("words", lambda w: F.xxhash64(w))

    def joined(col: str, step: int) -> Column:
        return F.when(n >= WINDOW, F.zip_with(F.slice(F.col(col), F.lit(1), F.size(col) - step), F.slice(F.col(col), F.lit(step + 1), F.size(col) - step), lambda a, b: F.xxhash64(a, b)))

    # a window of eight occurs twice only if one of two and one of four do: most texts stop there
    hashed = split.withColumn("h1", F.when(n >= WINDOW, once))
    for step, (src, to) in zip((1, 2, 4), (("h1", "h2"), ("h2", "h4"), ("h4", "h8")), strict=True):
        hashed = hashed.withColumn(to, F.when(F.size(F.array_distinct(src)) < F.size(src), joined(src, step))).drop(src)
    rows = hashed.select(
        "id", "k1", "k2", "host",
        n.cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("h8")) < F.size("h8"), F.col("h8")).alias("windows"),
        F.transform("lines", _plain).alias("plain"),
    )
    rows = scratch.table(rows.withColumns({"page": F.xxhash64("plain"), "lines": _line_rows()}).drop("plain"), "rows")

    # repeated windows, for texts that have any; copies of a text are measured once
    repeats = (
        rows.where("windows is not null").select("k1", "k2", "windows").dropDuplicates(["k1", "k2"])
        .select("k1", "k2", F.posexplode("windows").alias("at", "window"))
        .groupBy("k1", "k2", "window").agg(F.collect_list("at").alias("at")).where(F.size("at") > 1)
        .select("k1", "k2", F.explode("at").alias("at"))
        .groupBy("k1", "k2").agg(F.sort_array(F.collect_list("at")).alias("at"))
    )
    gaps = F.zip_with(F.slice("at", F.lit(2), F.size("at") - 1), F.slice("at", F.lit(1), F.size("at") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    repeats = repeats.select("k1", "k2", F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x).cast("long").alias("n_repeat_words"))

    # lines above the limits
    lined = rows.select("k1", "k2", "host", "page", F.inline("lines"))
    distinct = lined.select("host", "line", "page").distinct()
    lines = distinct.groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > line_min_docs)
    copies = rows.groupBy("k1", "k2", "host").agg(F.count("*").alias("copies"))
    hosts = rows.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    frequent = lines.join(hosts, "host").where(F.col("n_docs") > F.col("host_docs") * F.lit(line_doc_percent / 100)).select("host", "line")
    removed = lined.join(frequent, ["host", "line"], "left_semi").groupBy("k1", "k2", "host").agg(F.sum("words").alias("words"))
    removed = removed.join(copies, ["k1", "k2", "host"]).select("k1", "k2", "host", F.expr("words div copies").alias("n_line_words_removed"))

    out = rows.drop("windows", "lines", "page").join(repeats, ["k1", "k2"], "left").join(removed, ["k1", "k2", "host"], "left")
    repeat = F.coalesce("n_repeat_words", F.lit(0)).cast("long")
    gone = F.coalesce("n_line_words_removed", F.lit(0)).cast("long")
    failed = (F.col("n_words") < min_words) | (100 * repeat > max_repeat_percent * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - gone) < keep_word_percent * F.col("n_words")
    return out.select("k1", "k2", "host", F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", repeat.alias("n_repeat_words"), failed.alias("base_failed"), (~failed & ~depleted).alias("kept"), gone.alias("n_line_words_removed"))

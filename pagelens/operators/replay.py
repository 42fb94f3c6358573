"""Replayed actions: what changed on the page, whether it was expected, and what it contributes.

Input is a table of actions with the state before and after on both sides:
scroll positions, the active element's type, and visible texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.text import normalize_text

# Pixels that count as scrolling, texts looked at, and actions that move the focus.
SCROLL_PX = 8
MOST_TEXTS = 20
FOCUSING = ("click", "focus", "fill")
BAD = ("failed", "missing", "unsupported", "error")


def text_delta(before: Column, after: Column) -> Column:
    """Texts that are new after an action: in order, repeats kept, short ones left out, the first twenty."""
    known = F.transform(F.coalesce(before, F.array().cast("array<string>")), normalize_text)
    new = F.filter(F.coalesce(after, F.array().cast("array<string>")), lambda t: (F.length(normalize_text(t)) >= 3) & ~F.array_contains(known, normalize_text(t)))
    return F.slice(new, 1, MOST_TEXTS)


def post_state(actions: DataFrame) -> DataFrame:
    """Adds post_state. Columns: type, ref_scroll, cand_scroll (differences), ref_active, cand_active, ref_texts_before, ref_texts_after, cand_text."""
    expected = text_delta(F.col("ref_texts_before"), F.col("ref_texts_after"))
    out = actions.withColumn("__expected", expected)
    shown = normalize_text(F.col("cand_text"))
    matched = F.size(F.filter("__expected", lambda t: (normalize_text(t) != "") & F.contains(shown, normalize_text(t))))
    scrolled = F.when((F.abs("ref_scroll") <= SCROLL_PX) | (F.abs("cand_scroll") > SCROLL_PX), 1.0).otherwise(0.0)
    active = F.when(F.coalesce("ref_active", F.lit("")) != "", (F.col("ref_active").eqNullSafe(F.col("cand_active"))).cast("double")).otherwise(F.col("cand_active").isNotNull().cast("double"))
    texts = F.when(F.size("__expected") > 0, matched / F.size("__expected")).otherwise(1.0)
    return out.withColumn("post_state", F.when(F.col("type") == "scroll", scrolled).when(F.col("type").isin(*FOCUSING), active).otherwise(texts)).drop("__expected")


def contributions(actions: DataFrame, *, mapped: bool = False) -> DataFrame:
    """Adds contribution: confidence times post_state, or for a mapped manifest whether the action was completed."""
    done = (F.col("status") == "completed").cast("double")
    return actions.withColumn("contribution", done if mapped else F.coalesce("confidence", F.lit(0.0)) * F.coalesce("post_state", F.lit(0.0)))


def first_failure(actions: DataFrame, key: str) -> DataFrame:
    """key and failure: why the first bad action of a capture stops its block extraction."""
    bad = actions.where(F.col("status").isin(*BAD) | (F.col("contribution") <= 0))
    return bad.groupBy(key).agg(F.min_by(F.coalesce("failure", "status"), "pos").alias("failure"))

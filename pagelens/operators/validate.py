"""Checks of plans, concepts, critiques and reports: one row for each rule that a document breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bounds of a generation request, and the words that fields may hold.
BOUNDS = {"count": (1, 500), "max_concept_rounds": (1, 10), "max_builder_repair_rounds": (0, 10), "max_parallel_sites": (1, 32)}
DIFFICULTIES, SEVERITIES, STATUSES = ("easy", "medium", "hard"), ("info", "warning", "error"), ("approved", "needs_repair", "rejected")
LEAST_PAGES, MOST_CONCEPTS = 5, 4


def broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that does not hold; a rule that is unknown for want of a value counts as broken."""
    found = F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()))
    return rows.select(key, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("rule"))


def filled(c: Column) -> Column:
    return F.length(c) >= 1


def not_blank(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def request_rules() -> dict[str, Column]:
    """Of a generation request: its numbers' bounds, a prompt, and a folder for the output."""
    rules = {k: F.coalesce(F.col(k).between(*b), F.lit(True)) for k, b in BOUNDS.items()}
    return rules | {"prompt": filled(F.col("prompt")), "output_root": F.coalesce(not_blank(F.col("output_root")), F.lit(True))}


def plan_rules() -> dict[str, Column]:
    """Of a dataset plan: as many seeds as its size says, one at least."""
    return {"dataset_size": F.col("dataset_size") >= 1, "site_seeds": F.size("site_seeds") >= 1, "size_matches_seeds": F.col("dataset_size") == F.size("site_seeds")}


def concept_rules() -> dict[str, Column]:
    return {"pages": F.size("pages") >= LEAST_PAGES, "difficulty": F.coalesce(F.col("difficulty"), F.lit("medium")).isin(*DIFFICULTIES)}


def critique_rules() -> dict[str, Column]:
    """Of a critique: scores from 0 to 1, and a best candidate, if any, that was scored. candidates: array of (id, score)."""
    ids = F.transform("candidates", lambda x: x["id"])
    return {
        "candidates": F.size("candidates") >= 1, "scores": F.forall("candidates", lambda x: x["score"].between(0, 1)),
        "best_candidate": F.col("best_candidate_id").isNull() | F.array_contains(ids, F.col("best_candidate_id")),
    }


def report_rules() -> dict[str, Column]:
    """Of a verifier's report: a known status, and issues or instructions unless it approves."""
    some = (F.coalesce(F.size("issues"), F.lit(0)) > 0) | (F.coalesce(F.size("repair_instructions"), F.lit(0)) > 0)
    return {"status": F.col("status").isin(*STATUSES), "issue_context": (F.col("status") == "approved") | some}


def timeline_rules() -> dict[str, Column]:
    """Of a timeline: two samples at least, none of them negative."""
    return {"duration": F.col("duration") >= 0, "samples": F.size("samples") >= 2, "samples_not_negative": F.forall("samples", lambda x: x >= 0)}


def report_of_checks(checks: DataFrame) -> DataFrame:
    """A deterministic check as a report: approved or rejected, its issues as instructions. checks: site, passed, issues (array of struct with message)."""
    return checks.select(
        "site", F.when(F.col("passed"), "approved").otherwise("rejected").alias("status"), F.when(F.col("passed"), 1.0).otherwise(0.0).alias("contract"),
        F.transform("issues", lambda x: x["message"]).alias("repair_instructions"),
    )

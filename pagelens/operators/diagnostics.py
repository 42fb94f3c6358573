"""Consistency diagnostics of groups of elements."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagelens.functions.style import log_penalty_score


def majority(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, majority, its count and the group's: the most frequent value, the first seen among equals."""
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias("majority"), F.max("n").alias("majority_count"), F.sum("n").alias("total"))


def consistency(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per group: members off the majority, and the log penalty. Groups of one are not judged."""
    found = majority(rows, keys, value, order).where("total > 1")
    bad = F.col("total") - F.col("majority_count")
    return found.withColumns({"inconsistent": bad, "score": log_penalty_score(bad, F.col("total"))})


def uniformity(rows: DataFrame, keys: list[str], categories: list[str], sizes: list[str], tolerance: float = 1.0) -> DataFrame:
    """Per group of two or more: which of the given properties differ, and 100 less 25 for each."""
    checks = {c: F.count_distinct(c) > 1 for c in categories} | {c: F.max(c) - F.min(c) > tolerance for c in sizes}
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("members"), *[check.alias(f"differs_{c}") for c, check in checks.items()]).where("members > 1")
    failed = sum((F.col(f"differs_{c}").cast("int") for c in checks), F.lit(0))
    return grouped.withColumns({"failed": failed, "score": F.greatest(F.lit(0.0), 100.0 - 25.0 * failed)})


def tags(rows: DataFrame, keys: list[str], conditions: dict[str, Column]) -> DataFrame:
    """Per group: the sorted names of the conditions that any row meets."""
    met = rows.groupBy(*keys).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(name) for name, c in conditions.items()])
    return met.select(*keys, F.array_sort(F.array_compact(F.array(*(F.when(F.col(n), F.lit(n)) for n in conditions)))).alias("tags"))


def alignment_errors(rects: DataFrame, *, group: str, value: str, tolerance: float) -> DataFrame:
    """Per group: number of alignment groups and members off their group's median.

    Values in order join the open alignment group while they are within the tolerance of its running median.
    """

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        groups: list[list[float]] = []
        for x in np.sort(pdf[value].to_numpy()):
            if groups and abs(x - np.median(groups[-1])) <= tolerance:
                groups[-1].append(x)
            else:
                groups.append([x])
        off = sum(int((np.abs(np.array(g) - np.median(g)) > tolerance).sum()) for g in groups if len(g) > 1)
        return pd.DataFrame({group: [pdf[group].iloc[0]], "groups": [len(groups)], "errors": [off]})

    return rects.select(group, value).dropna().groupBy(group).applyInPandas(count, f"{group} {dict(rects.dtypes)[group]}, groups int, errors int")

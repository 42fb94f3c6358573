"""Writers: JSON rows, long metric tables, Markdown reports of bounded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.write.mode(mode).json(path)


def append_events(rows: DataFrame, path: str) -> None:
    """Adds JSON lines to a progress log."""
    rows.write.mode("append").json(path)


def long_metrics(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """key, name and value: one row for each metric."""
    return rows.unpivot([key], [F.col(m).cast("double").alias(m) for m in metrics], "name", "value")


def rounded(column: Column, digits: int = 6) -> Column:
    """For reports; scores are carried unrounded until then."""
    return F.round(column.cast("double"), digits)


def markdown(rows: DataFrame, limit: int = 200) -> str:
    """A table of at most limit rows; pipes are escaped."""
    cell = lambda x: "" if x is None else (f"{x:.6g}" if isinstance(x, float) else str(x)).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows.limit(limit).collect()])

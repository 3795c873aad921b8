"""Introduced drift: the multiset difference of two snapshots' findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def introduced(before: DataFrame, now: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of now beyond the number of equal keys in before, the last ones in the given order; null keys are equal to each other."""
    counts = before.groupBy(*key).agg(F.count("*").alias("_known"))
    ranked = now.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key]
    joined = ranked.alias("n").join(counts.alias("b"), same, "left")
    return joined.where(F.col("_rn") > F.coalesce("_known", F.lit(0))).select(*(F.col(f"n.{c}") for c in now.columns))


def introduced_findings(before: DataFrame, now: DataFrame) -> DataFrame:
    """Of findings(path, rule, line, column, snippet): those new by (path, rule, stripped snippet)."""
    tidy = lambda df: df.withColumn("_text", F.trim("snippet"))
    return introduced(tidy(before), tidy(now), ["path", "rule", "_text"], ["line", "column"]).drop("_text")

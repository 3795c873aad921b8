"""Findings of other tools: runtime accessibility reports and screenshot comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILING_IMPACTS = ("minor", "moderate", "serious", "critical")


def impact_severity(impact: str | Column) -> Column:
    impact = F.col(impact) if isinstance(impact, str) else impact
    return F.when(impact.isin("critical", "serious"), "error").when(impact == "moderate", "warning").when(impact == "minor", "suggestion").otherwise("warning")


def deep_accessibility(pages: DataFrame) -> DataFrame:
    """(rule, impact, description, help_url, url, selector, severity, failing) of each node of each violation."""
    each = pages.select(F.explode("pages").alias("p")).select("p.url", F.explode("p.violations").alias("v")).select("url", "v", F.explode("v.nodes").alias("n"))
    impact = F.col("v.impact")
    return each.select(
        F.col("v.id").alias("rule"), impact.alias("impact"), F.coalesce("v.help", "v.description").alias("description"), F.col("v.helpUrl").alias("help_url"), "url",
        F.get("n.target", F.lit(0)).alias("selector"), impact_severity(impact).alias("severity"), F.coalesce(impact.isin(*FAILING_IMPACTS), F.lit(False)).alias("failing"),
    )


def visual_findings(diffs: DataFrame, threshold: float = 0.0) -> DataFrame:
    """diffs(scenario, mismatch_ratio, ...) with `failing`: no ratio, or one over the threshold."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must lie in 0..1")
    return diffs.withColumn("failing", F.col("mismatch_ratio").isNull() | (F.col("mismatch_ratio") > threshold))


def mismatch_label(ratio: str | Column, status: str | Column) -> Column:
    ratio, status = (F.col(c) if isinstance(c, str) else c for c in (ratio, status))
    return F.when(ratio.isNotNull(), F.concat(F.round(ratio * 100, 2).cast("string"), F.lit("% mismatch"))).otherwise(status)


def region_label(regions: str | Column) -> Column:
    return F.array_join(F.transform(regions, lambda r: F.format_string("%d,%d %dx%d", r["x"], r["y"], r["w"], r["h"])), "; ")

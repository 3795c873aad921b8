"""Rewrites of sources: literals replaced by design tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.functions.colors import match_tokens

#: Which tokens fix which rule.
COMPATIBLE = {"raw_color": "css_var", "tailwind_arbitrary": "tailwind"}


def fixable(drift: DataFrame, tokens: DataFrame, threshold: int = 4, policy: str = "notify") -> DataFrame:
    """drift(path, line, column, rule, value) that a token fixes; near matches only by policy `fix`."""
    parts = [match_tokens(drift.where(F.col("rule") == rule), tokens.where(F.col("syntax") == syntax), "value", threshold, policy == "fix") for rule, syntax in COMPATIBLE.items()]
    both = parts[0].unionByName(parts[1])
    return both.where("match_name IS NOT NULL")


def _edited(line: Column, e: Column) -> Column:
    """The line after one edit; itself where the source no longer reads as the edit expects."""
    head, tail = F.substring(line, F.lit(1), e["column"] - 1), F.substring(line, e["column"], F.length(line))
    color = F.when(tail.startswith(e["value"]), F.concat(head, F.lit("var(--"), e["name"], F.lit(")"), F.substring(tail, F.length(e["value"]) + 1, F.length(tail))))
    prefix = F.regexp_extract(head, r"([^\s\"':]+)-$", 1)
    bracket = F.instr(tail, "]")
    utility = F.when(tail.startswith("[") & (bracket > 0) & (prefix != ""), F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit("-"), e["name"], F.substring(tail, bracket + 1, F.length(tail))))
    return F.coalesce(F.when(e["rule"] == "raw_color", color).otherwise(utility), line)


def apply(files: DataFrame, fixes: DataFrame) -> DataFrame:
    """(path, content) of the files that the fixes change; edits of a line go from right to left."""
    edit = F.struct((-F.col("column")).alias("order"), "column", "rule", "value", F.col("match_name").alias("name"))
    by_line = fixes.groupBy("path", "line").agg(F.array_sort(F.collect_list(edit)).alias("edits"))
    by_file = by_line.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("line", "edits"))).alias("at"))
    ends = F.when(F.col("content").endswith("\n"), "\n").otherwise("")
    joined = files.join(by_file, "path")
    changed = F.transform(T.lines("content"), lambda x, i: F.when(F.col("at")[i + 1].isNotNull(), F.aggregate(F.col("at")[i + 1], x, _edited)).otherwise(x))
    fixed = joined.select("path", F.col("content").alias("_old"), F.concat(F.array_join(changed, "\n"), ends).alias("content"))
    return fixed.where("content <> _old").drop("_old")


def residual(drift: DataFrame, fixes: DataFrame) -> DataFrame:
    """drift without what stands where a fix was made."""
    return drift.join(fixes.select("path", "line", "column").distinct(), ["path", "line", "column"], "left_anti")


def suggestion(snippet: str | Column, value: str | Column, token: str | Column) -> Column:
    """The utility with its variants, and the token for the bracket: `lg:hover:bg-[#06f]` as `lg:hover:bg-primary`."""
    left = F.substring_index(snippet, F.concat(F.lit("["), value, F.lit("]")) if not isinstance(value, str) else value, 1)
    return F.concat(F.regexp_extract(left, r"([^\s\"']+-)$", 1), token if isinstance(token, Column) else F.col(token))

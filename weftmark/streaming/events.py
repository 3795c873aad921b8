"""Introduced drift over a stream of edits: each micro-batch compares the edited files with their state before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from weftmark.operators import changes, views
from weftmark.sources import markup


def findings_of(files: DataFrame) -> DataFrame:
    tree = markup.nodes(files)
    return views.with_snippets(views.view_drift(tree, files).unionByName(views.accessibility(tree)), files)


def on_edit(edited: DataFrame, before: DataFrame) -> DataFrame:
    """Findings that edited(path, content) have beyond before; a file that was not there is all new."""
    known = before.join(edited.select("path").distinct(), "path", "left_semi")
    return changes.introduced_findings(findings_of(known), findings_of(edited)).withColumn("severity", F.create_map(*[F.lit(x) for p in views.SEVERITIES.items() for x in p])[F.col("rule")])


def on_stop(edited: DataFrame, before: DataFrame, asked: bool = False) -> DataFrame:
    """One row: the count of introduced findings, and whether they block; a turn that was blocked once is let go."""
    found = on_edit(edited, before)
    return found.agg(F.count("*").alias("introduced"), (F.coalesce(F.bool_or(F.col("severity") == "error"), F.lit(False)) & F.lit(not asked)).alias("block"))


def watch(edits: DataFrame, before: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """A writer over a stream edits(path, content) that hands each batch's introduced findings to the sink; start() it."""

    def batch(df: DataFrame, epoch: int) -> None:
        sink(on_edit(df, before()), epoch)

    return edits.writeStream.foreachBatch(batch)

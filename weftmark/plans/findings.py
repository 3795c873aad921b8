"""One schema for all findings, their roll-ups, and the registry of detectors."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.operators import views

LOCATION, DETAIL = "struct<file:string,line:int,column:int>", "struct<label:string,value:string>"
SEVERITIES = ("error", "warning", "suggestion")
COLUMNS = ("category", "severity", "title", "suggestion", "locations", "snippet", "details", "auto_fix")
AUTO_FIX = ("raw_color", "tailwind_arbitrary")
TYPE_ORDER = ("raw_color", "tailwind_arbitrary", "inline_style", "helper_recommended")
SUGGESTIONS = {
    "inline_style": "move the declarations to a class", "raw_color": "use a colour token", "tailwind_arbitrary": "use a named utility", "helper_recommended": "use the tag helper",
    "image_alt": 'add an alt attribute, empty if the image is decorative', "button_name": "add text or an aria-label", "link_name": "add link text or an aria-label", "input_label": "add an aria-label or a label for the id",
}


def rank(severity: str | Column) -> Column:
    severity = F.col(severity) if isinstance(severity, str) else severity
    return F.coalesce(*(F.when(severity == s, F.lit(i)) for i, s in enumerate(SEVERITIES)), F.lit(len(SEVERITIES)))


def parse_severity(text: str | None, default: str = "suggestion") -> str:
    """error, warning or suggestion; also plurals, `suggest` and `all`; blank is the default; anything else is an error."""
    word = (text or "").strip().lower()
    known = {"": default, "all": "suggestion", "suggest": "suggestion"} | {s: s for s in SEVERITIES} | {f"{s}s": s for s in SEVERITIES}
    if word not in known:
        raise ValueError(f"unknown severity {text!r}")
    return known[word]


def finding(category: Column, severity: Column, title: Column, suggestion: Column, locations: Column, snippet: Column | None = None, details: Column | None = None, auto_fix: Column | None = None) -> list[Column]:
    return [
        category.alias("category"), severity.alias("severity"), title.alias("title"), suggestion.alias("suggestion"), locations.cast(f"array<{LOCATION}>").alias("locations"),
        (snippet if snippet is not None else F.lit(None)).cast("string").alias("snippet"), (details if details is not None else F.array()).cast(f"array<{DETAIL}>").alias("details"), (auto_fix if auto_fix is not None else F.lit(False)).alias("auto_fix"),
    ]


def _at(file: str = "path", line: str | None = "line", column: str | None = "column") -> Column:
    no = F.lit(None).cast("int")
    return F.struct(F.col(file).alias("file"), (F.col(line) if line else no).alias("line"), (F.col(column) if column else no).alias("column"))


def _lookup(values: dict[str, str], key: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col(key)]


def of_views(found: DataFrame) -> DataFrame:
    """view drift(rule, path, line, column, value, snippet), one finding each."""
    shown = F.coalesce(F.nullif(F.col("value"), F.lit("")), "snippet")
    return found.select(*finding(F.col("rule"), _lookup(views.SEVERITIES, "rule"), F.concat(F.col("rule"), F.lit(": "), T.clipped(shown, 60)), _lookup(SUGGESTIONS, "rule"), F.array(_at()), F.col("snippet"), auto_fix=F.col("rule").isin(*AUTO_FIX)))


def of_accessibility(found: DataFrame) -> DataFrame:
    return found.select(*finding(F.lit("a11y (static)"), F.lit("error"), F.concat(F.col("rule"), F.lit(": "), F.substring("snippet", 1, 60)), _lookup(SUGGESTIONS, "rule"), F.array(_at()), F.col("snippet")))


def of_deep(found: DataFrame) -> DataFrame:
    pairs = F.filter(F.array(*(F.struct(F.lit(n).alias("label"), F.col(c).alias("value")) for n, c in (("url", "url"), ("selector", "selector"), ("help", "help_url")))), lambda p: p["value"].isNotNull())
    title = F.concat(F.lit("["), F.coalesce("impact", F.lit("unknown")), F.lit("] "), F.col("rule"), F.lit(": "), F.coalesce("description", F.lit("")))
    return found.select(*finding(F.lit("a11y (deep)"), F.col("severity"), title, F.coalesce("help_url", F.lit("")), F.array(), details=pairs))


def of_controllers(audit: DataFrame, locations: DataFrame) -> DataFrame:
    at = locations.groupBy("status", "name").agg(F.array_sort(F.collect_list(F.struct("file", "line", F.lit(None).cast("int").alias("column")))).alias("locations"))
    joined = audit.join(at, ["status", "name"], "left")
    label = F.concat(F.lit("stimulus "), F.col("status"))
    hint = F.when(F.col("status") == "orphaned", F.concat(F.lit("define the controller "), F.col("name"))).otherwise(F.concat(F.lit("remove the controller "), F.col("name")))
    return joined.select(*finding(label, F.lit("warning"), F.concat(label, F.lit(": "), F.col("name")), hint, F.coalesce("locations", F.array().cast(f"array<{LOCATION}>"))))


def of_previews(names: DataFrame) -> DataFrame:
    path = names.withColumn("path", F.concat(F.lit("app/components/"), F.col("name"), F.lit("_component.rb")))
    return path.select(*finding(F.lit("missing previews"), F.lit("suggestion"), F.concat(F.lit("missing preview: "), F.col("name")), F.lit("add a preview"), F.array(_at(line=None, column=None))))


def of_slots(slots: DataFrame) -> DataFrame:
    title = F.concat(F.lit("orphan slot: "), F.col("component"), F.lit("#"), F.col("slot"))
    return slots.select(*finding(F.lit("orphan slots"), F.lit("warning"), title, F.lit("render the slot or remove it"), F.array(_at("file", "line", None))))


def of_similar(pairs: DataFrame) -> DataFrame:
    title = F.format_string("%.2f similar: %s ↔ %s", "score", "file_a", "file_b")
    hint = F.when(F.col("score") >= 0.95, "merge the two files").when(F.col("score") >= 0.85, "extract a shared partial with parameters").otherwise("look for a shared partial")
    tags = F.array(F.struct(F.lit("tags").alias("label"), F.concat_ws(" / ", F.col("tag_count_a").cast("string"), F.col("tag_count_b").cast("string")).alias("value")))
    return pairs.select(*finding(F.lit("similar partials"), F.lit("suggestion"), title, hint, F.array(_at("file_a", None, None), _at("file_b", None, None)), details=tags))


def of_patterns(patterns: DataFrame) -> DataFrame:
    hint = F.when(F.col("count") >= 6, "extract a component").when(F.col("size") >= 10, "extract a partial").otherwise("consider a partial")
    shape = F.array(F.struct(F.lit("shape").alias("label"), F.col("shape").alias("value")))
    at = F.transform("occurrences", lambda o: F.struct(o["file"].alias("file"), o["line"].alias("line"), o["column"].alias("column")))
    return patterns.select(*finding(F.lit("cross-codebase patterns"), F.lit("suggestion"), F.concat(F.col("count").cast("string"), F.lit("x "), T.clipped("shape", 120, "...")), hint, at, details=shape))


def of_clusters(clusters: DataFrame) -> DataFrame:
    listed = F.array_join("classes", " ")
    hint = F.when(F.size("classes") >= 8, "extract a component").when(F.col("count") >= 6, "extract a class").otherwise("consider a shared class")
    details = F.array(F.struct(F.lit("classes").alias("label"), listed.alias("value")))
    return clusters.select(*finding(F.lit("class-itis"), F.lit("suggestion"), F.concat(F.col("count").cast("string"), F.lit("x "), F.col("tag"), F.lit("."), T.clipped(listed, 100, "...")), hint, F.col("occurrences"), details=details))


def of_visual(diffs: DataFrame, label: Column) -> DataFrame:
    at = F.array(_at("diff_path", None, None), _at("baseline_path", None, None))
    return diffs.select(*finding(F.lit("visual diff"), F.lit("error"), F.concat(label, F.lit(": "), F.col("scenario")), F.lit("look at the diff, then fix or approve it"), at))


def union(*parts: DataFrame) -> DataFrame:
    """All findings; what a severity floor cuts off vanishes from the plan, since each part's severity is a literal."""
    return reduce(DataFrame.unionByName, parts)


def at_least(found: DataFrame, floor: str) -> DataFrame:
    return found.where(rank("severity") <= SEVERITIES.index(parse_severity(floor)))


def files_of(locations: str = "locations") -> Column:
    return F.array_distinct(F.filter(F.transform(locations, lambda x: x["file"]), lambda f: f.isNotNull()))


def containing(found: DataFrame, needle: str) -> DataFrame:
    """Case-insensitive search in category, title, suggestion and files."""
    return found.where(F.instr(F.lower(F.concat_ws("\n", "category", "title", "suggestion", files_of())), needle.lower()) > 0)


def by_category(found: DataFrame) -> DataFrame:
    """(severity, category, count), errors first, then by count."""
    return found.groupBy("severity", "category").agg(F.count("*").alias("count")).orderBy(rank("severity"), F.desc("count"), "category")


def by_severity(found: DataFrame) -> DataFrame:
    """(severity, categories, total) of all three severities, zero where there is nothing."""
    spark = found.sparkSession
    every = spark.range(len(SEVERITIES)).select(F.get(F.array(*map(F.lit, SEVERITIES)), F.col("id").cast("int")).alias("severity"))
    counted = found.groupBy("severity").agg(F.countDistinct("category").alias("categories"), F.count("*").alias("total"))
    return every.join(counted, "severity", "left").select("severity", F.coalesce("categories", F.lit(0)).alias("categories"), F.coalesce("total", F.lit(0)).alias("total"))


def by_file(found: DataFrame) -> DataFrame:
    """(file, count, worst): a finding counts once in each of its files, or under `(no file)`."""
    each = found.select("severity", F.explode_outer(files_of()).alias("file")).withColumn("file", F.coalesce("file", F.lit("(no file)")))
    worst = F.get(F.array(*map(F.lit, SEVERITIES)), F.least(F.min(rank("severity")), F.lit(2)))
    return each.groupBy("file").agg(F.count("*").alias("count"), worst.alias("worst")).orderBy(F.desc("count"), "file")


#: Categories whose findings fail a run; similar files do, repeated shapes and class lists never do.
FAILING = ("raw_color", "tailwind_arbitrary", "inline_style", "helper_recommended", "a11y (static)", "stimulus orphaned", "stimulus dead", "missing previews", "orphan slots", "similar partials", "visual diff")


def failing(found: DataFrame) -> DataFrame:
    """One row: whether the run fails. Runtime accessibility fails by impact, a null impact never does."""
    deep = (F.col("category") == "a11y (deep)") & ~F.col("title").startswith("[unknown]")
    return found.agg(F.coalesce(F.bool_or(F.col("category").isin(*FAILING) | deep), F.lit(False)).alias("failing"))


def top_locations(found: DataFrame, k: int = 10) -> DataFrame:
    """found with the first k locations and how many more there are."""
    return found.withColumn("shown", F.slice("locations", 1, k)).withColumn("more", F.greatest(F.size("locations") - k, F.lit(0)))


class Detector(Protocol):
    """An extension: named findings from a corpus."""

    name: str
    max_severity: str

    def enabled(self, options: dict) -> bool: ...

    def run(self, corpus: DataFrame) -> DataFrame: ...


@dataclass
class Registry:
    """Detectors and sources that others add; they run after the built-in ones and obey the severity floor."""

    detectors: list[Detector] = field(default_factory=list)
    sources: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)

    def register(self, detector: Detector) -> None:
        for name in ("name", "max_severity", "enabled", "run"):
            if not hasattr(detector, name):
                raise TypeError(f"a detector needs {name}")
        parse_severity(detector.max_severity)
        self.detectors = [d for d in self.detectors if d.name != detector.name] + [detector]

    def run(self, corpus: DataFrame, floor: str = "suggestion", options: dict | None = None) -> list[DataFrame]:
        least = SEVERITIES.index(parse_severity(floor))
        return [d.run(corpus).select(*COLUMNS) for d in self.detectors if d.enabled(options or {}) and SEVERITIES.index(d.max_severity) <= least]

    def source(self, name: str) -> Callable[..., DataFrame]:
        if name not in self.sources:
            raise KeyError(f"unknown source {name!r}; there are {', '.join(sorted(self.sources)) or 'none'}")
        return self.sources[name]


def multimap(details: Sequence[tuple[str, str]]) -> dict:
    """Details as JSON has them: a label that repeats becomes a list."""
    out: dict = {}
    for label, value in details:
        out.setdefault(label, []).append(value)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}

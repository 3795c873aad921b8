"""Corpora as files(path, content): scans of a tree, tables read as files, and the predicates on paths."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Path segments and patterns that scans leave out or look for.
IGNORED_SEGMENTS = ("vendor", "node_modules", "tmp", "public", "log")
SYMBOL_IGNORED_SEGMENTS = ("vendor", "node_modules", "tmp", "public", "log", "spec", "test", "previews")
MAILER_SEGMENT = r"^(\w+_)?mailer$"
VIEWS = (r"^app/views/.*\.html\.erb$", r"^app/components/.*\.html\.erb$")
CONTROLLERS = (r"^app/(javascript|frontend)/(.*/)?[^/]*_controller\.(js|ts)$",)
COMPONENTS = (r"^app/components/(.*/)?[^/]*_component\.rb$",)
PREVIEWS = (r"^(test|spec)/components/previews/(.*/)?[^/]*_component_preview\.rb$",)
PARTIALS = (r"^app/(views|components)/(.*/)?_[^/]*\.html\.erb$", r"^app/components/(.*/)?[^/]*_component\.html\.erb$")
STYLESHEETS = (r"^app/assets/stylesheets/.*\.(css|scss)$", r"^app/assets/tailwind/.*\.css$")
ICON_USERS = (*VIEWS, r"^app/components/.*\.rb$", r"^app/assets/stylesheets/.*\.(css|scss|sass)$", r"^app/javascript/.*\.(js|ts|jsx|tsx)$")
SYMBOL_FILES = (r"^app/views/.*\.html\.erb$", r"^app/components/.*\.(html\.erb|rb)$", r"^app/(helpers|models|presenters)/.*\.rb$", r"^app/javascript/.*\.(js|ts|jsx|tsx)$", r"^config/locales/.*\.yml$")
TAILWIND_CONFIGS = ("tailwind.config.js", "config/tailwind.config.js")
ICON_SOURCE, SPRITE_OUTPUT = "app/assets/images/icons", "app/assets/images/icons/sprite.svg"


def files(spark: SparkSession, root: str, patterns: Sequence[str] = (), content: bool = True) -> DataFrame:
    """path relative to root, and content; paths are filtered before any content is decoded.

    Without `content` no file is read: the scan lists names alone.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    at = F.length(F.regexp_extract("path", f"^(.*?{_quoted(base.removeprefix('file:'))}/)", 1)) + 1
    out = raw.select(F.substring("path", at, F.length("path")).alias("path"), *([F.decode("content", "UTF-8").alias("content")] if content else []))
    return out.where(matches(patterns)) if patterns else out


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\.^$|?*+()[]{}" else c for c in text)


def from_table(df: DataFrame, path: str | Column, content: str | Column) -> DataFrame:
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return df.select(as_column(path).cast("string").alias("path"), as_column(content).cast("string").alias("content"))


def matches(patterns: Sequence[str], path: str = "path") -> Column:
    """Whether the path fits any of the patterns: the union of globs, each file once."""
    return reduce(lambda a, b: a | b, (F.col(path).rlike(p) for p in patterns), F.lit(False))


def ignored(path: str = "path", segments: Sequence[str] = IGNORED_SEGMENTS, mailers: bool = True, prefixes: Sequence[str] = ()) -> Column:
    """Whether a segment is an ignored one or names a mailer, or the path is or lies under a prefix."""
    parts = F.split(path, "/")
    out = F.arrays_overlap(parts, F.array(*map(F.lit, segments)))
    if mailers:
        out = out | F.exists(parts, lambda s: s.rlike(MAILER_SEGMENT))
    for p in prefixes:
        out = out | (F.col(path) == p) | F.col(path).startswith(f"{p}/")
    return out


def covers(path: str = "path", scan_paths: Sequence[str] = ("app/views", "app/components"), ignore: Sequence[str] = ()) -> Column:
    """Whether the view audit looks at a path: extension, scan path, and not ignored."""
    inside = reduce(lambda a, b: a | b, (F.col(path).startswith(f"{p}/") for p in scan_paths), F.lit(False))
    return F.col(path).endswith(".html.erb") & inside & ~ignored(path, prefixes=ignore)


def tailwind_config(paths: DataFrame, configured: str | None = None) -> str | None:
    """The configured path, whether or not it exists; else the first usual one that does."""
    if configured:
        return configured
    there = {r.path for r in paths.where(F.col("path").isin(*TAILWIND_CONFIGS)).select("path").distinct().collect()}  # two names at most
    return next((p for p in TAILWIND_CONFIGS if p in there), None)


def icon_sources(df: DataFrame, source: str = ICON_SOURCE, sprite: str = SPRITE_OUTPUT) -> DataFrame:
    """(name, path, content) of the *.svg directly in the source folder, but for the sprite itself."""
    inside = F.col("path").rlike(f"^{_quoted(source)}/[^/]+\\.svg$") & (F.col("path") != sprite)
    return df.where(inside).withColumn("name", F.regexp_extract("path", r"([^/]+)\.svg$", 1)).orderBy("name")


def screenshot_diffs(paths: DataFrame) -> DataFrame:
    """The *.diff.png but for heat maps, each with its scenario and its baseline's name, which may not exist."""
    own = paths.where(F.col("path").endswith(".diff.png") & ~F.col("path").endswith(".heatmap.diff.png"))
    return own.select(F.col("path").alias("diff_path"), F.regexp_replace("path", r"\.diff\.png$", ".png").alias("baseline_path"), F.regexp_replace("path", r"\.diff\.png$", "").alias("scenario"))


PAGES = "array<struct<url:string,violations:array<struct<id:string,impact:string,description:string,help:string,helpUrl:string,tags:array<string>,nodes:array<struct<target:array<string>,html:string>>>>>>"


def accessibility_pages(df: DataFrame, column: str = "value") -> DataFrame:
    """(pages) of JSON text: an object or an array of objects; what is malformed gives null."""
    return df.select(F.from_json(F.col(column), PAGES).alias("pages"))


def patched_files(patch: str | Column) -> Column:
    """array<string>: file names in the headers of a patch text."""
    return F.regexp_extract_all(patch, F.lit(r"(?m)^\*\*\* (?:Add File|Update File|Move to): (.+)$"), F.lit(1))


def load_config(text: str | None, strict: bool = False, section: str | None = None) -> dict:
    """The named section of a configuration file, or its only one; blank is empty, and so is what can't be read unless `strict`."""
    try:
        import yaml
    except ImportError:
        yaml = None
    if not text or not text.strip():
        return {}
    try:
        read = yaml.safe_load(text) if yaml else __import__("json").loads(text)
    except Exception:
        if strict:
            raise
        return {}
    named = read if isinstance(read, dict) else {}
    found = named.get(section or (next(iter(named)) if len(named) == 1 else None))
    return found if isinstance(found, dict) else {}

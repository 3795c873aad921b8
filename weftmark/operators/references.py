"""What is referenced but undefined, and defined but unused: controllers, components, icons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.sources import corpus

# How views and sources refer to things, and the sprite's defaults.
CONTROLLER_ATTRIBUTE = r"data-controller\s*=\s*[\"']([^\"']+)[\"']"
CONTROLLER_HASH = r"(?s)data:?\s*(?:=>)?\s*\{[^}]*?controller:?\s*(?:=>)?\s*[\"']([^\"']+)[\"']"
SLOT = r"^\s*(renders_one|renders_many)\s+:([a-z_]\w*)"
ICON_USES = (
    r"#icon-([\w-]+)",
    r"\bimage_tag\s*\(?\s*[\"'](?:[^\"']*/)?([\w-]+)\.(?:svg|png|gif|jpe?g|webp)[\"']",
    r"\b(?:asset_path|asset_url|image_path|image_url)\s*\(?\s*[\"'](?:[^\"']*/)?([\w-]+)\.(?:svg|png|gif|jpe?g|webp)[\"']",
    r"(?i)url\s*\(\s*[\"']?(?:[^\"')]*/)?([\w-]+)\.(?:svg|png|gif|jpe?g|webp)",
)
SPRITE_USE = r"#icon-([\w-]+)"
ERB_BLOCK, SVG_BLOCK = r"<%[\s\S]*?%>", r"<svg\b[^>]*>[\s\S]*?</svg>"
DEFAULT_VIEWBOX = "0 0 24 24"


def missing(left: DataFrame, right: DataFrame, key: str = "name") -> DataFrame:
    """Distinct keys of left that right lacks."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key).distinct(), key, "left_anti")


def named_controllers(content: str | Column) -> Column:
    """array<string>: controllers named by attribute or by Ruby hash; a value names several, split at white space."""
    values = F.concat(*(F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in (CONTROLLER_ATTRIBUTE, CONTROLLER_HASH)))
    return F.filter(F.flatten(F.transform(values, lambda v: F.split(F.trim(v), r"\s+"))), lambda n: n != "")


def controllers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(defined, referenced), each name and path."""
    defined = files.where(corpus.matches(corpus.CONTROLLERS)).select(T.controller_name("path").alias("name"), "path").where("name <> ''")
    referenced = files.where(corpus.matches(corpus.VIEWS)).select(F.explode(named_controllers("content")).alias("name"), "path")
    return defined, referenced


def controller_audit(files: DataFrame) -> DataFrame:
    """(status, name): `orphaned` is referenced but not defined, `dead` is defined but not referenced."""
    defined, referenced = controllers(files)
    return missing(referenced, defined).select(F.lit("orphaned").alias("status"), "name").unionByName(missing(defined, referenced).select(F.lit("dead").alias("status"), "name"))


def controller_locations(files: DataFrame, audit: DataFrame) -> DataFrame:
    """(status, name, file, line): lines that refer to an orphan, the whole file where the reference spans lines; files of the dead."""
    defined, _ = controllers(files)
    views = files.where(corpus.matches(corpus.VIEWS))
    by_line = views.select("path", F.posexplode(T.lines("content")).alias("i", "text")).select(F.explode(F.array_distinct(named_controllers("text"))).alias("name"), F.col("path").alias("file"), (F.col("i") + 1).alias("line"))
    whole = views.select(F.explode(F.array_distinct(named_controllers("content"))).alias("name"), F.col("path").alias("file"))
    lone = whole.join(by_line, ["name", "file"], "left_anti").withColumn("line", F.lit(None).cast("int"))
    orphans = by_line.unionByName(lone).join(audit.where("status = 'orphaned'"), "name")
    dead = defined.select("name", F.col("path").alias("file"), F.lit(None).cast("int").alias("line")).join(audit.where("status = 'dead'"), "name")
    return orphans.unionByName(dead).select("status", "name", "file", "line")


def missing_previews(files: DataFrame) -> DataFrame:
    own = files.where(corpus.matches(corpus.COMPONENTS)).select(F.regexp_extract("path", r"^app/components/(.*)_component\.rb$", 1).alias("name"))
    shown = files.where(corpus.matches(corpus.PREVIEWS)).select(F.regexp_extract("path", r"components/previews/(.*)_component_preview\.rb$", 1).alias("name"))
    return missing(own, shown)


def orphan_slots(files: DataFrame) -> DataFrame:
    """(component, slot, slot_kind, file, line) of declared slots that the template beside never names; no template counts as empty."""
    declared = files.where(corpus.matches(corpus.COMPONENTS)).select("path", F.posexplode(T.lines("content")).alias("i", "text"))
    slots = declared.select("path", (F.col("i") + 1).alias("line"), F.regexp_extract("text", SLOT, 1).alias("slot_kind"), F.regexp_extract("text", SLOT, 2).alias("slot")).where("slot <> ''")
    slots = slots.withColumn("stem", F.regexp_replace("path", r"\.rb$", ""))
    templates = files.where(corpus.matches(corpus.VIEWS)).select(F.regexp_replace("path", r"\.html\.erb$", "").alias("stem"), F.col("content").alias("template"))
    unused = ~F.rlike(F.coalesce("template", F.lit("")), F.concat(F.lit(r"\b"), F.col("slot"), F.lit(r"\b")))
    name = F.regexp_extract("path", r"^app/components/(.*)_component\.rb$", 1)
    return slots.join(templates, "stem", "left").where(unused).select(name.alias("component"), "slot", "slot_kind", F.col("path").alias("file"), "line")


def icon_names(content: str | Column) -> Column:
    return F.array_distinct(F.concat(*(F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in ICON_USES)))


def icon_audit(files: DataFrame, source: str = corpus.ICON_SOURCE, sprite: str = corpus.SPRITE_OUTPUT) -> DataFrame:
    """(status, name): `dead` icons are used nowhere, `unknown` sprite references have no icon."""
    icons = corpus.icon_sources(files, source, sprite).select("name")
    users = files.where(corpus.matches(corpus.ICON_USERS))
    used = users.select(F.explode(icon_names("content")).alias("name"))
    referenced = users.select(F.explode(F.regexp_extract_all("content", F.lit(SPRITE_USE), F.lit(1))).alias("name"))
    return missing(icons, used).select(F.lit("dead").alias("status"), "name").unionByName(missing(referenced, icons).select(F.lit("unknown").alias("status"), "name"))


def inline_svgs(files: DataFrame) -> DataFrame:
    """(path, line, column, snippet) of SVG blocks in views that are no use of the sprite; column is always 1."""
    views = files.where(corpus.matches(corpus.VIEWS)).withColumn("masked", T.mask_newlines_first("content", ERB_BLOCK))
    found = views.select("path", "masked", F.explode(T.matches("masked", SVG_BLOCK)).alias("m")).where(~F.col("m.value").contains("<use"))
    return found.select("path", T.line_of("masked", F.col("m.offset")).alias("line"), F.lit(1).alias("column"), F.trim(F.substring_index("m.value", "\n", 1)).alias("snippet"))


def sprite_symbols(icons: DataFrame) -> DataFrame:
    """(name, symbol): each icon as a symbol of the sprite; icons without inner markup are left out."""
    box = F.regexp_extract("content", r"(?i)\bviewBox\s*=\s*[\"']([^\"']+)[\"']", 1)
    inner = F.trim(F.regexp_extract("content", r"(?s)<svg\b[^>]*>(.*?)</svg>", 1))
    view = F.when(box != "", box).otherwise(F.lit(DEFAULT_VIEWBOX))
    return icons.where(inner != "").select("name", F.format_string('<symbol id="icon-%s" viewBox="%s">%s</symbol>', "name", view, inner).alias("symbol"))


def sprite(icons: DataFrame) -> DataFrame:
    """One row: the sprite's markup, symbols in order of name."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "symbol"))), lambda s: s["symbol"]), "\n")
    return sprite_symbols(icons).agg(F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" style="display: none">\n'), body, F.lit("\n</svg>\n")).alias("sprite"))

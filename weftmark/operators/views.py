"""View drift and static accessibility rules over the node table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.sources import markup

# Fixed values of the rules.
COLOR_ATTRIBUTES = ("fill", "stroke", "color", "bgcolor", "background", "flood-color", "lighting-color", "stop-color")
DATA_COLOR = r"(?i)^data-[\w-]*colou?r[\w-]*$"
HEX = r"#[0-9a-fA-F]{3,8}\b"
RGB = r"\brgba?\(\s*\d+\s*,\s*\d+\s*,\s*\d+(?:\s*,\s*[\d.]+)?\s*\)"
ARBITRARY = r"\[[^\]]+\]"
STYLE_SOURCE = r"\bstyle\s*=\s*[\"'][^\"']+[\"']"
SILENT_INPUTS = ("hidden", "submit", "button", "reset", "image")
SEVERITIES = {"inline_style": "warning", "raw_color": "error", "tailwind_arbitrary": "error", "helper_recommended": "warning", "image_alt": "error", "button_name": "error", "link_name": "error", "input_label": "error"}


#: A node's columns by name: `F.col` of a row of nodes, or a node in an array.
Node = Callable[[str], Column]
FOUND = "array<struct<rule:string,line:int,column:int,value:string>>"


def has(name: str, n: Node = F.col) -> Column:
    return F.exists(n("attrs"), lambda a: a["name"] == name)


def static(name: str, n: Node = F.col) -> Column:
    """The static value of the first attribute of that name; null without one or without a value."""
    return F.get(F.filter(n("attrs"), lambda a: a["name"] == name), F.lit(0))["static_value"]


def _labelled(n: Node) -> Column:
    return has("aria-label", n) | has("aria-labelledby", n)


def _at_attribute(tree: DataFrame, wanted) -> DataFrame:
    return markup.elements(tree).select("path", F.explode(F.filter("attrs", wanted)).alias("a"))


def _is_style(a: Column) -> Column:
    return a["name"] == "style"


def _style_source(lines: Column, line: Column, column: Column) -> Column:
    """A style attribute as its source line has it."""
    tail = F.substring(F.get(lines, line - 1), column, F.lit(2**31 - 1))
    source = F.regexp_extract(tail, f"({STYLE_SOURCE})", 1)
    return F.when(source != "", source).otherwise(F.get(F.split(tail, r"\s", 2), F.lit(0)))


def inline_style(tree: DataFrame, files: DataFrame) -> DataFrame:
    """One row an attribute named style; its value is read from the source line."""
    found = _at_attribute(tree, _is_style).select("path", "a.line", "a.column")
    return found.join(files, "path").select(F.lit("inline_style").alias("rule"), "path", "line", "column", _style_source(T.lines("content"), F.col("line"), F.col("column")).alias("value"))


def _is_color(a: Column) -> Column:
    return a["name"].isin(*COLOR_ATTRIBUTES) | a["name"].rlike(DATA_COLOR)


def _is_class(a: Column) -> Column:
    return a["name"] == "class"


#: Which attributes hold literals, what they look like, and what of a match is the value.
LITERALS = {
    "raw_color": (_is_color, (HEX, RGB), lambda v: v),
    "tailwind_arbitrary": (_is_class, (ARBITRARY,), lambda v: F.substring(v, F.lit(2), F.length(v) - 2)),
}


def _matches(a: Column, rule: str) -> Column:
    return F.concat(*(T.matches(a["static_value"], p) for p in LITERALS[rule][1]))


def _literals(tree: DataFrame, rule: str) -> DataFrame:
    wanted, _, value = LITERALS[rule]
    found = _at_attribute(tree, wanted).where(F.coalesce(F.col("a.static_value"), F.lit("")) != "")
    each = found.select("path", "a", F.explode(_matches(F.col("a"), rule)).alias("m"))
    return each.select(F.lit(rule).alias("rule"), "path", F.col("a.val_line").alias("line"), (F.col("a.val_column") + F.col("m.offset")).alias("column"), value(F.col("m.value")).alias("value"))


def raw_color(tree: DataFrame) -> DataFrame:
    """Colour literals in attributes that bear colours, in the static part of the value."""
    return _literals(tree, "raw_color")


def tailwind_arbitrary(tree: DataFrame) -> DataFrame:
    """What stands in brackets in static classes."""
    return _literals(tree, "tailwind_arbitrary")


def _is(n: Node, *tags: str) -> Column:
    return n("kind").isin("element", "void") & n("tag").isin(*tags)


def _unnamed(n: Node) -> Column:
    return ~_labelled(n) & ~n("has_erb_output") & (F.coalesce(n("visible_text"), F.lit("")) == "")


def _unlabelled_input(n: Node) -> Column:
    """An input without a name and without a label of the same file for its id."""
    kind = F.lower(F.coalesce(static("type", n), F.lit("text")))
    return _is(n, "input") & ~kind.isin(*SILENT_INPUTS) & ~_labelled(n) & ~n("labelled")


ELEMENTS = {
    "helper_recommended": lambda n: (_is(n, "button") | _is(n, "a") & has("href", n)) & ~_labelled(n) & n("has_erb_output"),
    "image_alt": lambda n: _is(n, "img") & ~has("alt", n),
    "button_name": lambda n: _is(n, "button") & _unnamed(n),
    "link_name": lambda n: _is(n, "a") & has("href", n) & ~has("title", n) & _unnamed(n),
    "input_label": _unlabelled_input,
}
ACCESSIBILITY = ("image_alt", "button_name", "link_name", "input_label")


def _elements(tree: DataFrame, rule: str) -> DataFrame:
    return tree.where(ELEMENTS[rule](F.col)).select(F.lit(rule).alias("rule"), "path", "line", "column", F.col("tag").alias("value"))


def helper_recommended(tree: DataFrame) -> DataFrame:
    return _elements(tree, "helper_recommended")


def image_alt(tree: DataFrame) -> DataFrame:
    return _elements(tree, "image_alt")


def button_name(tree: DataFrame) -> DataFrame:
    return _elements(tree, "button_name")


def link_name(tree: DataFrame) -> DataFrame:
    return _elements(tree, "link_name")


def input_label(tree: DataFrame) -> DataFrame:
    return _elements(tree, "input_label")


def _literals_of(n: Node, rule: str, at: Callable[..., Column]) -> Column:
    wanted, _, value = LITERALS[rule]
    own = F.filter(n("attrs"), lambda a: wanted(a) & (F.coalesce(a["static_value"], F.lit("")) != ""))
    return F.flatten(F.transform(own, lambda a: F.transform(_matches(a, rule), lambda m: at(rule, a["val_line"], a["val_column"] + m["offset"], value(m["value"])))))


def _of_node(n: Node) -> Column:
    """FOUND of a node by all rules; the value of a style attribute is null until its line is read."""
    at = lambda rule, line, column, value: F.struct(F.lit(rule).alias("rule"), line.alias("line"), column.alias("column"), value.alias("value"))
    styles = F.transform(F.filter(n("attrs"), _is_style), lambda a: at("inline_style", a["line"], a["column"], F.lit(None).cast("string")))
    found = [F.filter(F.array(*(F.when(wanted(n), at(rule, n("line"), n("column"), n("tag"))) for rule, wanted in ELEMENTS.items())), lambda f: f.isNotNull()), styles]
    found += [_literals_of(n, rule, at) for rule in LITERALS]
    return F.concat(*(f.cast(FOUND) for f in found))


def of_trees(nodes: str = "nodes", content: str = "content") -> Column:
    """array<struct<rule, line, column, value, snippet>> of a file's nodes and content by all rules, the lines split once."""
    found = F.flatten(F.transform(F.filter(nodes, lambda n: n["kind"].isin("element", "void")), lambda n: _of_node(n.__getitem__)))
    read = lambda lines, f: F.struct(
        f["rule"].alias("rule"), f["line"].alias("line"), f["column"].alias("column"),
        F.when(f["rule"] == "inline_style", _style_source(lines, f["line"], f["column"])).otherwise(f["value"]).alias("value"), T.snippet(lines, f["line"]).alias("snippet"),
    )
    return F.get(F.transform(F.array(T.lines(content)), lambda lines: F.transform(found, lambda f: read(lines, f))), F.lit(0))


def view_drift(tree: DataFrame, files: DataFrame) -> DataFrame:
    """All view-drift rules: rule, path, line, column, value."""
    return inline_style(tree, files).unionByName(raw_color(tree)).unionByName(tailwind_arbitrary(tree)).unionByName(helper_recommended(tree))


def accessibility(tree: DataFrame) -> DataFrame:
    """All static accessibility rules."""
    return image_alt(tree).unionByName(button_name(tree)).unionByName(link_name(tree)).unionByName(input_label(tree))


def with_snippets(found: DataFrame, files: DataFrame) -> DataFrame:
    return found.join(files, "path").withColumn("snippet", T.snippet(T.lines("content"), F.col("line"))).drop("content")

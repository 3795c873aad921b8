"""Positions, masks, lines and symbols of text as columns, without UDFs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code-point ranges of the glyph tier, and marks that are no icons.
GLYPH_RANGES = ((0x2190, 0x21FF), (0x2300, 0x23FF), (0x25A0, 0x25FF), (0x2600, 0x26FF), (0x2700, 0x27BF), (0x2B00, 0x2BFF))
TYPOGRAPHIC = (0x00A9, 0x00AE, 0x2122)
_ZWJ, _PICTOGRAPH = "‍", "📄"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(text: str | Column, pattern: str) -> Column:
    """array<struct<value, offset>>: all matches, offset counted in characters from 0.

    The pattern must not match the empty text nor look behind past its own start.
    """
    text = _col(text)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    between = F.transform(F.split(text, pattern, -1), F.length)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,offset:int>>").alias("out"))
    step = lambda a, x: F.struct((a["at"] + x["gap"] + F.length(x["value"])).alias("at"), F.concat(a["out"], F.array(F.struct(x["value"].alias("value"), (a["at"] + x["gap"]).alias("offset")))).alias("out"))
    pairs = F.filter(F.zip_with(between, found, lambda g, v: F.struct(g.alias("gap"), v.alias("value"))), lambda x: x["value"].isNotNull())
    return F.aggregate(pairs, start, step, lambda a: a["out"])


def line_of(text: str | Column, offset: Column) -> Column:
    before = F.substring(_col(text), F.lit(1), offset)
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def column_of(text: str | Column, offset: Column) -> Column:
    before = F.substring(_col(text), F.lit(1), offset)
    return F.length(F.substring_index(before, "\n", -1)) + 1


def mask(text: str | Column, pattern: str) -> Column:
    """Each match replaced by blanks, newlines kept: every position stays."""
    text = _col(text)
    blanks = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.regexp_replace(m, r"[^\n]", " "))
    return F.concat_ws("", F.flatten(F.zip_with(F.split(text, pattern, -1), blanks, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))


def mask_newlines_first(text: str | Column, pattern: str) -> Column:
    """Each match replaced by its newlines, then blanks: line numbers stay, columns after a match of many lines do not."""
    text = _col(text)
    newlines = lambda m: F.length(m) - F.length(F.replace(m, F.lit("\n"), F.lit("")))
    blanks = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda m: F.concat(F.repeat(F.lit("\n"), newlines(m)), F.repeat(F.lit(" "), F.length(m) - newlines(m))))
    return F.concat_ws("", F.flatten(F.zip_with(F.split(text, pattern, -1), blanks, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))))


def lines(text: str | Column) -> Column:
    """array<string>: the lines without their ends; a newline at the end begins no line."""
    return F.split(F.regexp_replace(_col(text), r"\n\z", ""), "\n", -1)


def snippet(all_lines: Column, line: Column) -> Column:
    """The line, stripped; null past the end."""
    return F.regexp_replace(F.get(all_lines, line - 1), r"^\s+|[\s\x00]+$", "")


def clipped(text: str | Column, width: int, suffix: str = "") -> Column:
    """The text, cut to `width` characters, the suffix among them."""
    text = _col(text)
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, width - len(suffix)), F.lit(suffix)))


def graphemes(text: str | Column) -> Column:
    """array<struct<value, offset>>: grapheme clusters and the characters before each."""
    found = F.regexp_extract_all(_col(text), F.lit(r"(\X)"), F.lit(1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,offset:int>>").alias("out"))
    return F.aggregate(found, start, lambda a, g: F.struct((a["at"] + F.length(g)).alias("at"), F.concat(a["out"], F.array(F.struct(g.alias("value"), a["at"].alias("offset")))).alias("out")), lambda a: a["out"])


def pictographic(char: Column) -> Column:
    """Extended_Pictographic, by what joins into one grapheme cluster with a zero-width joiner and a pictograph."""
    return F.concat(char, F.lit(_ZWJ + _PICTOGRAPH)).rlike(r"^\X$")


def symbol_tier(cluster: Column, glyphs: bool = True, allowed: Sequence[str] = ()) -> Column:
    """`emoji`, `glyph` or null of a grapheme cluster."""
    code = F.ascii(cluster)
    ranged = reduce(lambda a, b: a | b, (code.between(*r) for r in GLYPH_RANGES))
    single = F.when(code.isin(*TYPOGRAPHIC), None).when(ranged, F.lit("glyph") if glyphs else None).when((code > 127) & pictographic(cluster), "emoji")
    flag = cluster.rlike(r"^[\x{1F1E6}-\x{1F1FF}]{2}$")
    keycap = cluster.rlike(r"^[0-9#*]\x{FE0F}?\x{20E3}$")
    chars = F.regexp_extract_all(cluster, F.lit(r"(?s)(.)"), F.lit(1))
    many = F.when(flag | keycap | F.exists(chars, lambda c: (F.ascii(c) > 127) & pictographic(c)), "emoji")
    out = F.when(F.length(cluster) > 1, many).otherwise(single)
    return F.when(~cluster.isin(*allowed), out) if allowed else out


def code_points(cluster: Column) -> Column:
    """`U+XXXX U+YYYY`."""
    return F.array_join(F.transform(F.regexp_extract_all(cluster, F.lit(r"(?s)(.)"), F.lit(1)), lambda c: F.format_string("U+%04X", F.ascii(c))), " ")


def without_variation(cluster: str | Column) -> Column:
    return F.replace(_col(cluster), F.lit("️"), F.lit(""))


def escaped(text: str | Column) -> Column:
    """HTML escape."""
    out = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def anchor(text: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def controller_name(path: str | Column) -> Column:
    """A controller's identifier: below the last `controllers/`, else the file's name."""
    path = _col(path)
    below = F.when(path.contains("/controllers/"), F.substring_index(path, "/controllers/", -1)).otherwise(F.substring_index(path, "/", -1))
    return F.translate(F.replace(F.regexp_replace(below, r"_controller\.(js|ts)$", ""), F.lit("/"), F.lit("--")), "_", "-")


def component_path(name: str | Column) -> Column:
    """`Admin::CardComponent` as `admin/card_component`."""
    snake = F.regexp_replace(F.regexp_replace(F.replace(_col(name), F.lit("::"), F.lit("/")), "([A-Z]+)([A-Z][a-z])", "$1_$2"), r"([a-z\d])([A-Z])", "$1_$2")
    return F.lower(snake)

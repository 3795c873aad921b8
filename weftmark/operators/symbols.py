"""Emoji and glyphs used as icons, outside comments and suppressed lines."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions import text as T
from weftmark.sources import corpus

# Comments by file type, the marker that silences a line, and names of icons that replace symbols.
ERB_COMMENT, BLOCK_COMMENT, LINE_COMMENT, YAML_COMMENT = r"<%#[\s\S]*?%>", r"/\*[\s\S]*?\*/", r"//[^\n]*", r"(?:(?<=\s)|(?m:^))#[^\n]*"
MARKER = r"\b[\w-]+-ok:\s*emoji\b"
SPRITE_HINTS = {
    "✓": ("check", "checkmark"), "✔": ("check", "checkmark"), "✕": ("x", "close"), "✖": ("x", "close"), "✗": ("x", "close"), "✘": ("x", "close"), "×": ("x", "close"),
    "★": ("star", "favorite"), "☆": ("star", "favorite"), "⚠": ("warning", "alert"), "📄": ("file", "document"), "📎": ("attachment", "paperclip"), "🔑": ("key",),
    "👤": ("user", "person", "avatar"), "🏢": ("building", "office"), "🗑": ("trash", "delete"), "✏": ("edit", "pencil"), "➕": ("plus", "add"), "➖": ("minus", "remove"),
    "🔔": ("bell", "notification"), "🔇": ("mute", "bell-off"), "📦": ("package", "zip", "archive"), "🎬": ("video", "film"), "🎵": ("audio", "music", "note"), "📊": ("chart", "bar-chart"),
}

_RUBY = re.compile(
    r"""(?P<doc>^=begin\b.*?(?:^=end\b[^\n]*|\Z))|(?P<here><<[~-]?(["'`]?)(?P<mark>[A-Z_a-z]\w*)\3)|(?P<text>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`)|(?P<char>\?\S)|(?P<note>\#[^\n]*)""",
    re.S | re.M | re.X,
)


def mask_ruby(source: str) -> str:
    """Ruby comments as blanks; # in strings, heredocs and interpolation is no comment."""
    out, at = [], 0
    while m := _RUBY.search(source, at):
        end = m.end()
        if m["here"]:
            line = source.find("\n", end)
            close = re.compile(rf"^[ \t]*{re.escape(m['mark'])}\b", re.M).search(source, line + 1) if line >= 0 else None
            if close:  # the rest of the line may hold a comment, the body does not
                rest = source[end:line]
                out += [source[at:end], mask_ruby(rest), source[line : close.end()]]
                at = close.end()
                continue
        if m["note"] or m["doc"]:
            out += [source[at : m.start()], re.sub(r"[^\n]", " ", m[0])]
        else:
            out.append(source[at:end])
        at = end
    return "".join([*out, source[at:]])


def _ruby_masks(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = [c and mask_ruby(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("content"), pa.array(masked, pa.string())], names=["path", "content", "masked"])

    return files.select("path", "content").mapInArrow(run, "path string, content string, masked string")


def masked(files: DataFrame) -> DataFrame:
    """files with `masked`: comments blanked, by file type; only Ruby files go through Python."""
    end = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    by_type = (
        F.when(end == ".erb", T.mask_newlines_first("content", ERB_COMMENT))
        .when(end.isin(".js", ".ts", ".jsx", ".tsx", ".scss", ".sass", ".css"), T.mask(T.mask_newlines_first("content", BLOCK_COMMENT), LINE_COMMENT))
        .when(end.isin(".yml", ".yaml"), T.mask("content", YAML_COMMENT))
        .otherwise(F.col("content"))
    )
    own = files.select("path", "content")
    return own.where(end != ".rb").withColumn("masked", by_type).unionByName(_ruby_masks(own.where(end == ".rb")))


def suppressed(raw: Column, clean: Column) -> Column:
    """array<int>: lines with a marker, and the line after one where nothing but the comment stands."""
    on = F.filter(F.sequence(F.lit(1), F.greatest(F.size(raw), F.lit(1))), lambda i: F.coalesce(F.get(raw, i - 1).rlike(MARKER), F.lit(False)))
    after = F.transform(F.filter(on, lambda i: F.coalesce(F.trim(F.get(clean, i - 1)), F.lit("")) == ""), lambda i: i + 1)
    return F.array_union(on, after)


def find_symbols(files: DataFrame, glyphs: bool = True, allow_files: Sequence[str] = (), allow_chars: Sequence[str] = ()) -> DataFrame:
    """(path, line, column, snippet, codepoints, tier) of symbols; column counts characters from 1."""
    kept = files.where(~F.col("path").isin(*allow_files)) if allow_files else files
    lined = masked(kept).select("path", T.lines("content").alias("raw"), T.lines("masked").alias("clean")).withColumn("quiet", suppressed(F.col("raw"), F.col("clean")))
    lines = lined.select("path", "quiet", F.posexplode("clean").alias("i", "text")).withColumn("line", F.col("i") + 1)
    lines = lines.where(~F.array_contains("quiet", F.col("line")) & F.col("text").rlike(r"[^\x00-\x7F]"))
    each = lines.select("path", "line", F.explode(T.graphemes("text")).alias("g")).withColumn("tier", T.symbol_tier(F.col("g.value"), glyphs, allow_chars))
    return each.where("tier IS NOT NULL").select("path", "line", (F.col("g.offset") + 1).alias("column"), F.col("g.value").alias("snippet"), T.code_points(F.col("g.value")).alias("codepoints"), "tier")


def scan(files: DataFrame, **options) -> DataFrame:
    """find_symbols over the files that are scanned by default."""
    return find_symbols(files.where(corpus.matches(corpus.SYMBOL_FILES) & ~corpus.ignored(segments=corpus.SYMBOL_IGNORED_SEGMENTS, mailers=False)), **options)


def with_hints(found: DataFrame, icons: DataFrame, snippet: str = "snippet") -> DataFrame:
    """found with sprite_name: the first hinted icon that exists, else null."""
    hints = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in SPRITE_HINTS.items() for x in pair])
    known = found.select(F.col(snippet).alias("_snippet")).distinct()
    hinted = known.withColumn("_hints", F.coalesce(hints[T.without_variation("_snippet")], F.array().cast("array<string>")))
    each = hinted.select("_snippet", F.posexplode("_hints").alias("_i", "name")).join(icons.select("name").distinct(), "name").groupBy("_snippet").agg(F.min_by("name", "_i").alias("sprite_name"))
    return found.join(each, F.col(snippet) == F.col("_snippet"), "left").drop("_snippet")

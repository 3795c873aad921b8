"""Colour values and design tokens: normal form, distance, exact and nearest match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normal_hex(value: str | Column) -> Column:
    """Lower case, trimmed; #rgb and #rgba doubled, alpha dropped. Values without # stay as they are then."""
    v = F.trim(F.lower(_col(value)))
    doubled = F.concat(F.lit("#"), F.regexp_replace(F.substring(v, 2, 100), "(.)", "$1$1"))
    size = F.length(v)
    return F.when(~v.startswith("#"), v).when(size == 4, doubled).when(size == 5, F.substring(doubled, 1, 7)).when(size == 9, F.substring(v, 1, 7)).otherwise(v)


def _channel(value: Column, at: int) -> Column:
    return F.coalesce(F.conv(F.substring(value, at, 2), 16, 10).cast("int"), F.lit(0))


def hex_distance(a: str | Column, b: str | Column) -> Column:
    """Largest difference of a channel; null unless both are colours of six digits in normal form."""
    a, b = normal_hex(a), normal_hex(b)
    fits = lambda v: v.startswith("#") & (F.length(v) == 7)
    return F.when(fits(a) & fits(b), F.greatest(*(F.abs(_channel(a, i) - _channel(b, i)) for i in (2, 4, 6))))


def match_tokens(literals: DataFrame, tokens: DataFrame, value: str = "value", threshold: int = 4, near: bool = True) -> DataFrame:
    """literals with match_name, match_value, match_kind (exact or near) and match_distance, null where nothing matches.

    tokens(name, value, ordinal). Of tokens with equal values the last wins; else of those within 1..threshold the nearest,
    the first of equals. Nearest tokens meet literals in cubes of the three channels as wide as the threshold, each literal in its
    own and the 26 beside it, so that neither side is broadcast or paired as a whole and only near colours meet.
    """
    named = tokens.select("name", F.col("value").alias("token_value"), "ordinal", normal_hex("value").alias("norm"))
    last = named.withColumn("rn", F.row_number().over(Window.partitionBy("norm").orderBy(F.desc("ordinal")))).where("rn = 1").select("norm", F.col("name").alias("exact_name"), F.col("token_value").alias("exact_value"))
    keyed = literals.withColumn("norm", normal_hex(value))
    joined = keyed.join(last, "norm", "left")
    empty = {"near_name": F.lit(None).cast("string"), "near_value": F.lit(None).cast("string"), "distance": F.lit(None).cast("int")}
    if near and threshold > 0:
        colour = F.col("norm").startswith("#") & (F.length("norm") == 7)
        channels = {c: _channel(F.col("norm"), at) for c, at in (("red", 2), ("green", 4), ("blue", 6))}
        width = threshold + 1
        cube = lambda by: sum(((F.floor(F.col(c) / width) + 1 + by[i]) * 300**i for i, c in enumerate(channels)), F.lit(0)).cast("int")
        beside = [cube((i, j, k)) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
        wanted = joined.where(F.col("exact_name").isNull() & colour).select("norm").distinct().withColumns(channels).withColumn("cube", F.explode(F.array(*beside)))
        first = named.where(colour).groupBy("norm").agg(F.min(F.struct("ordinal", "name", "token_value")).alias("t"))  # the first of equal colours
        there = first.withColumns(channels).select(cube((0, 0, 0)).alias("cube"), "t.*", *(F.col(c).alias(f"token_{c}") for c in channels))
        close = wanted.join(there, "cube").withColumn("d", F.greatest(*(F.abs(F.col(c) - F.col(f"token_{c}")) for c in channels))).where(F.col("d").between(1, threshold))
        best = close.groupBy("norm").agg(F.min(F.struct("d", "ordinal", "name", "token_value")).alias("m"))
        best = best.select("norm", F.col("m.name").alias("near_name"), F.col("m.token_value").alias("near_value"), F.col("m.d").alias("distance"))
        joined = joined.join(best, "norm", "left")
    else:
        joined = joined.withColumns(empty)
    kind = F.when(F.col("exact_name").isNotNull(), "exact").when(F.col("near_name").isNotNull(), "near")
    return joined.select(
        *literals.columns, F.coalesce("exact_name", "near_name").alias("match_name"), F.coalesce("exact_value", "near_value").alias("match_value"),
        kind.alias("match_kind"), F.when(F.col("exact_name").isNotNull(), 0).otherwise(F.col("distance")).alias("match_distance"),
    )


def layered(literals: DataFrame, tokens: DataFrame, layers: list[str], value: str = "value", threshold: int = 4, policy: str = "notify") -> DataFrame:
    """Match against the tokens of one syntax after another; the first layer with a match wins.

    By policy `leave` a near match is hidden, and the next layer is tried.
    """
    out = literals
    for i, syntax in enumerate(layers):
        out = match_tokens(out, tokens.where(F.col("syntax") == syntax), value, threshold, policy != "leave")
        out = out.withColumnsRenamed({c: f"{c}_{i}" for c in ("match_name", "match_value", "match_kind", "match_distance")})
    pick = lambda c: F.coalesce(*(F.col(f"{c}_{i}") for i in range(len(layers))))
    syntax = F.coalesce(*(F.when(F.col(f"match_name_{i}").isNotNull(), F.lit(s)) for i, s in enumerate(layers)))
    return out.select(*literals.columns, *(pick(c).alias(c) for c in ("match_name", "match_value", "match_kind", "match_distance")), syntax.alias("match_syntax"))


def token_text(name: str | Column, syntax: str | Column) -> Column:
    name, syntax = _col(name), _col(syntax)
    return F.when(syntax == "css_var", F.concat(F.lit("var(--"), name, F.lit(")"))).when(syntax == "scss_var", F.concat(F.lit("$"), name)).otherwise(name)

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftmark.functions import colors
from weftmark.functions import text as T


def values(spark, rows, **columns):
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    return [tuple(r) for r in df.select(*(c(F.col("v")).alias(n) for n, c in columns.items())).collect()]


@pytest.mark.parametrize("value,normal", [("#FA3", "#ffaa33"), ("#fa38", "#ffaa33"), ("#FFAA33", "#ffaa33"), ("#ffaa33aa", "#ffaa33"), (" 1REM ", "1rem"), ("#12345", "#12345"), ("", "")])
def test_normal_hex(spark, value, normal):
    assert values(spark, [value], n=colors.normal_hex) == [(normal,)]


@pytest.mark.parametrize("a,b,distance", [("#000000", "#0a0500", 10), ("#ffaa33", "#ffaa33aa", 0), ("#0066ff", "#0066fe", 1), ("#000", "rgb(0,0,0)", None), ("#fff", "#000", 255)])
def test_hex_distance(spark, a, b, distance):
    assert values(spark, [a], d=lambda v: colors.hex_distance(v, F.lit(b))) == [(distance,)]


@pytest.mark.parametrize(
    "token_values,literal,threshold,expected",
    [
        (["#FFAA33"], "#fa3", 4, ("t0", "exact", 0)),
        (["#0066ff"], "#0066fe", 4, ("t0", "near", 1)),
        (["#0066ff"], "#0066fe", 0, (None, None, None)),
        (["#0066ff", "#0066fe"], "#0066ff", 4, ("t0", "exact", 0)),
        (["#0066ff"], "#abcdef", 4, (None, None, None)),
        (["#0066ff", "#06f"], "#0066ff", 4, ("t1", "exact", 0)),
        (["#000002", "#000000"], "#000001", 4, ("t0", "near", 1)),
        (["1rem"], "1rem", 4, ("t0", "exact", 0)),
    ],
)
def test_match_tokens(spark, token_values, literal, threshold, expected):
    tokens = spark.createDataFrame([(f"t{i}", v, i) for i, v in enumerate(token_values)], "name string, value string, ordinal int")
    row = colors.match_tokens(spark.createDataFrame([(literal,)], "value string"), tokens, threshold=threshold).first()
    assert (row.match_name, row.match_kind, row.match_distance) == expected


def test_layers_fall_through_by_policy(spark):
    tokens = spark.createDataFrame([("t", "#000001", "tailwind", 0), ("c", "#000000", "css_var", 1)], "name string, value string, syntax string, ordinal int")
    literal = spark.createDataFrame([("#000000",)], "value string")
    assert colors.layered(literal, tokens, ["tailwind", "css_var"]).first().match_name == "t"
    assert colors.layered(literal, tokens, ["tailwind", "css_var"], policy="leave").first().match_name == "c"


TIERS = {
    "7": None, "#": None, "*": None, "a": None, "—": None, "“": None, "❤️": "emoji", "👨‍👩‍👧": "emoji", "🇫🇷": "emoji", "1️⃣": "emoji", "✓": "glyph", "→": "glyph", "■": "glyph", "★": "glyph", "⚠": "glyph", "📄": "emoji", "©": None, "®": None, "™": None, "é": None, "×": None,
}


def test_symbol_tier(spark):
    assert dict(values(spark, TIERS, v=lambda v: v, t=T.symbol_tier)) == TIERS
    assert values(spark, ["✓", "📄"], t=lambda v: T.symbol_tier(v, glyphs=False)) == [(None,), ("emoji",)]
    assert values(spark, ["✓"], t=lambda v: T.symbol_tier(v, allowed=["✓"])) == [(None,)]
    assert values(spark, ["🇫🇷"], c=T.code_points) == [("U+1F1EB U+1F1F7",)]


def test_matches_count_characters(spark):
    [(found,)] = values(spark, ["📄 #abc x #def"], m=lambda v: T.matches(v, "#[a-f]{3}"))
    assert [(m.value, m.offset) for m in found] == [("#abc", 2), ("#def", 9)]
    assert values(spark, ["", None], m=lambda v: F.size(T.matches(v, "#")))[0] == (0,)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab*/\n é📄", max_size=30), min_size=1, max_size=20))
def test_mask_keeps_every_position(spark, texts):
    for before, after in values(spark, texts, v=lambda v: v, m=lambda v: T.mask(v, r"/\*[\s\S]*?\*/")):
        assert len(before) == len(after) and [c == "\n" for c in before] == [c == "\n" for c in after]


def test_names(spark):
    paths = ["app/javascript/controllers/users/profile_controller.js", "app/javascript/js/controllers/foo_controller.js", "lib/a_b_controller.ts"]
    assert [n for (n,) in values(spark, paths, n=T.controller_name)] == ["users--profile", "foo", "a-b"]
    assert values(spark, ["Admin::CardComponent", "HTMLBox"], n=T.component_path) == [("admin/card_component",), ("html_box",)]
    assert values(spark, ["a" * 130], n=lambda v: F.length(T.clipped(v, 120, "..."))) == [(120,)]
    assert values(spark, ['<a href="x">&'], n=T.escaped) == [("&lt;a href=&quot;x&quot;&gt;&amp;",)]

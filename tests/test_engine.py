import json

import pytest
from pyspark.sql import functions as F

from weftmark.operators import audits, changes, fixes, graph, references, structure, symbols, views
from weftmark.operators import tokens as design
from weftmark.plans import audit, findings, reports
from weftmark.sources import corpus, markup
from weftmark.streaming import events

VIEW = "app/views/x/show.html.erb"


def many(spark, contents):
    return spark.createDataFrame(list(contents.items()), "path string, content string")


def tree(spark, source, path=VIEW):
    return markup.nodes(many(spark, {path: source}))


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# parsing


def test_tag_stream_of_nested_markup(spark):
    assert markup.tag_tokens(tree(spark, "<div><h1>a</h1><p>b<br></p></div>")).first().tokens == ["div", "h1", "h1", "p", "br", "p", "div"]


def test_shapes_skip_what_lies_in_erb_blocks_but_the_stream_does_not(spark):
    t = tree(spark, "<div><% if x %><p>1</p><% end %><b>2</b></div>")
    assert t.where("tag = 'div'").first()["shape"] == "div(b)"
    assert markup.tag_tokens(t).first().tokens == ["div", "p", "p", "b", "b", "div"]


def test_comments_and_erb_bodies_hold_no_elements(spark):
    t = tree(spark, '<!-- <img> --><%= "<b>" %><%# <i> %><script>var a = "</p><p>"</script><u>x</u>')
    assert [r.tag for r in markup.elements(t).orderBy("node_id").collect()] == ["script", "u"]


@pytest.mark.parametrize("source", ["", "<", "<div", "<div class=\"a", "</p></div>", "<p><p><b>", "<% if", "<!-- x", "<a href='<%= x %>'>", "a < b > c", "<li><li><ul><li>", "<x" * 2000])
def test_parser_never_fails(spark, source):
    nodes = markup.parse(source)
    assert all(n["subtree_end"] >= n["node_id"] for n in nodes)


def test_static_values_leave_erb_out_and_know_where_they_start(spark):
    a = tree(spark, '<p\n  class="a <%= b > c %> d" id=x hidden>').first().attrs
    assert [(x.name, x.static_value, x.has_erb, x.val_line, x.val_column) for x in a] == [("class", "a  d", True, 2, 10), ("id", "x", False, 2, 31), ("hidden", None, False, 2, 33)]


# view rules


BROKEN = """<h1 style="top: 1px">A</h1>
<rect fill="#0066ff"/><rect fill="#0066fe"/><rect stroke="rgb(1, 2, 3)" data-hover-color="#abcdef" data-id="#123"/>
<div class="lg:hover:bg-[#fa3] p-[7px] <%= x %>">d</div>
<img src="a.png"><img alt="">
<button></button><button><%= label %></button><button aria-label="x"></button>
<a href="/x"><i></i></a><a></a><a href="/x" title="t"></a>
<input id="a"><label for="b">B</label><input id="b"><input type="hidden">
"""


def test_view_drift(spark):
    source = many(spark, {VIEW: BROKEN})
    found = rows(views.view_drift(markup.nodes(source), source), "rule", "line", "column", "value")
    assert found == [
        ("helper_recommended", 5, 18, "button"), ("inline_style", 1, 5, 'style="top: 1px"'), ("raw_color", 2, 13, "#0066ff"), ("raw_color", 2, 35, "#0066fe"),
        ("raw_color", 2, 59, "rgb(1, 2, 3)"), ("raw_color", 2, 91, "#abcdef"), ("tailwind_arbitrary", 3, 25, "#fa3"), ("tailwind_arbitrary", 3, 34, "7px"),
    ]


def test_accessibility(spark):
    found = rows(views.accessibility(tree(spark, BROKEN)), "rule", "line", "column")
    assert found == [("button_name", 5, 1), ("image_alt", 4, 1), ("input_label", 7, 1), ("link_name", 6, 1)]


def test_labels_count_in_their_own_file_only(spark):
    t = markup.nodes(many(spark, {"a": '<label for="q">Q</label>', "b": '<input id="q">'}))
    assert rows(views.input_label(t), "path") == [("b",)]


# structure


def test_class_clusters(spark):
    page = '<p class="e d c b a a"></p>' * 2 + '<p class="a b c d e"></p><p class="a b"></p>'
    [found] = structure.class_clusters(tree(spark, page)).collect()
    assert (found.tag, found.classes, found["count"]) == ("p", ["a", "b", "c", "d", "e"], 3)


def test_nested_shapes_with_equal_counts_are_dropped(spark):
    card = "<article><h2></h2><div><a></a><a></a><a></a></div></article>"
    [one] = structure.shape_patterns(tree(spark, card * 4), min_size=4).collect()
    assert (one["size"], one["count"], one["shape"]) == (6, 4, "article(h2,div(a,a,a))")
    two = structure.shape_patterns(tree(spark, card * 4 + "<div><a></a><a></a><a></a></div>" * 2), min_size=4)
    assert rows(two, "count", "size") == [(4, 6), (6, 4)]


def test_a_prefix_is_no_child_shape(spark):
    page = "<div><a></a><a></a><span></span><span></span></div>" * 3 + "<div><a></a><a></a><a></a><span></span></div>" * 3
    assert structure.shape_patterns(tree(spark, page)).count() == 2


def brute(sets, least):
    out = []
    for i, (a, x) in enumerate(sorted(sets.items())):
        for b, y in sorted(sets.items())[i + 1 :]:
            if x and y and len(x & y) / len(x | y) >= least:
                out.append((a, b, len(x & y), len(x | y)))
    return sorted(out)


def test_similar_pairs_against_brute_force(spark):
    import random

    rng = random.Random(3)
    tokens = {f"f{i}": [rng.choice("abc") for _ in range(rng.randrange(4, 9))] for i in range(60)}
    df = spark.createDataFrame(list(tokens.items()), "path string, tokens array<string>")
    sets = {p: {" ".join(t[i : i + 3]) for i in range(len(t) - 2)} for p, t in tokens.items() if len(t) >= 5}
    assert rows(structure.similar_pairs(df, 0.5), "file_a", "file_b", "shared", "total") == sorted(brute(sets, 0.5), key=repr)


def test_similarity_groups(spark):
    pairs = spark.createDataFrame([("a", "b", 0.8), ("b", "c", 0.9), ("x", "y", 0.7)], "file_a string, file_b string, score double")
    found = {tuple(r.files): (r.score_min, r.score_max, r.pair_count, tuple(r.sample_pair)) for r in structure.similarity_groups(pairs).collect()}
    assert found == {("a", "b", "c"): (0.8, 0.9, 2, ("b", "c")), ("x", "y"): (0.7, 0.7, 1, ("x", "y"))}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(500, 400), (7, 7)], "a long, b long")
    found = {r.node: r.component for r in graph.components(edges).collect()}
    assert all(found[i] == 0 for i in range(101)) and found[500] == 400


# references


def test_references(spark):
    corpus_ = many(spark, {
        "app/javascript/controllers/dead_controller.js": "", "app/javascript/controllers/ok_controller.ts": "",
        "app/views/a.html.erb": '<p data-controller="ok missing">\n<%= tag.div(data: {\n controller: "other" }) %>',
        "app/components/card_component.rb": "renders_one :title\n  renders_many :rows", "app/components/card_component.html.erb": "<%= title? %> arrows",
        "app/components/lone_component.rb": "renders_one :a", "spec/components/previews/card_component_preview.rb": "",
    })
    audit_ = references.controller_audit(corpus_)
    assert rows(audit_, "status", "name") == [("dead", "dead"), ("orphaned", "missing"), ("orphaned", "other")]
    assert rows(references.controller_locations(corpus_, audit_), "name", "file", "line") == [("dead", "app/javascript/controllers/dead_controller.js", None), ("missing", "app/views/a.html.erb", 1), ("other", "app/views/a.html.erb", None)]
    assert rows(references.missing_previews(corpus_), "name") == [("lone",)]
    assert rows(references.orphan_slots(corpus_), "component", "slot", "line") == [("card", "rows", 2), ("lone", "a", 1)]


def test_icons(spark):
    corpus_ = many(spark, {
        "app/assets/images/icons/a.svg": '<svg viewBox="0 0 1 1"><g/></svg>', "app/assets/images/icons/b.svg": "<svg><g/></svg>", "app/assets/images/icons/sprite.svg": "<svg/>",
        "app/views/x.html.erb": '<use href="#icon-a"/><use href="#icon-zz"/>\n<%= "<svg>" %><svg\n><path/></svg><svg><use/></svg>',
    })
    assert rows(references.icon_audit(corpus_), "status", "name") == [("dead", "b"), ("unknown", "zz")]
    assert rows(references.inline_svgs(corpus_), "line", "column", "snippet") == [(2, 1, "<svg")]
    assert references.sprite(corpus.icon_sources(corpus_)).first().sprite.count("<symbol") == 2


# tokens, fixes


CONFIG = """module.exports = { theme: { colors: { ...base, primary: { 500: '#0066ff', "dark-er": "#000" }, gray: f(1), white: '#fff' } }, extend: { colors: { x: 'red' } } }"""


def test_tailwind_colors():
    assert design.tailwind_colors(CONFIG) == [("primary-500", "#0066ff"), ("primary-dark-er", "#000"), ("white", "#fff"), ("x", "red")]
    assert design.tailwind_colors("colors: { a: 'b'") == [] and design.tailwind_colors("") == []


def test_stylesheets(spark):
    sheets = many(spark, {"app/assets/stylesheets/t.css": "--a: #0066ff;\n$b: #fff;", "app/assets/stylesheets/x.scss": "a { color: #06f; } // #111\n/* #222\n*/ b { color: #abcdef }\n", "app/assets/stylesheets/vendor/y.css": "#fff"})
    tokens = design.defined(sheets)
    assert rows(tokens, "name", "value", "syntax", "line") == [("a", "#0066ff", "css_var", 1), ("b", "#fff", "scss_var", 2)]
    found = design.stylesheet_drift(sheets, tokens, ("app/assets/stylesheets/t.css",))
    assert rows(found, "line", "column", "value", "token") == [(1, 12, "#06f", "a"), (3, 15, "#abcdef", None)]
    evidence = design.stack_evidence(sheets).first()
    assert (evidence.files_scanned, evidence.custom_property_files, evidence.scss_variable_files, evidence.raw_hex_files, evidence.strategy) == (2, 1, 1, 1, "css_custom_properties")


def test_fixes_edit_from_right_to_left_and_leave_the_rest(spark):
    source = many(spark, {VIEW: '<i fill="#0066ff" class="lg:bg-[#0066fe] m-[1px]"></i>\nkeep\n'})
    tokens = spark.createDataFrame([("p", "#0066ff", "css_var", 0), ("t", "#0066ff", "tailwind", 1)], "name string, value string, syntax string, ordinal int")
    drift = views.view_drift(markup.nodes(source), source)
    exact, near = fixes.fixable(drift, tokens), fixes.fixable(drift, tokens, policy="fix")
    assert fixes.apply(source, exact).first().content == '<i fill="var(--p)" class="lg:bg-[#0066fe] m-[1px]"></i>\nkeep\n'
    assert fixes.apply(source, near).first().content == '<i fill="var(--p)" class="lg:bg-t m-[1px]"></i>\nkeep\n'
    assert rows(fixes.residual(drift, near), "value") == [("1px",)]


# symbols


def test_symbols_outside_comments_and_quiet_lines(spark):
    found = symbols.scan(many(spark, {
        "app/views/a.html.erb": "<%# ✓ %>é✓\n<%# lint-ok: emoji %>\n★\n📄 <%# lint-ok: emoji %>\n→",
        "app/models/b.rb": "x = \"#✓\" # ★\n# →\n", "config/locales/en.yml": "a: ✓ # ★", "app/javascript/c.js": "/* ✓\n*/ '★' // →", "spec/d.rb": "✓",
    }))
    assert rows(found, "path", "line", "column", "snippet") == [("app/javascript/c.js", 2, 9, "★"), ("app/models/b.rb", 1, 7, "✓"), ("app/views/a.html.erb", 1, 10, "✓"), ("app/views/a.html.erb", 5, 1, "→"), ("config/locales/en.yml", 1, 4, "✓")]
    icons = spark.createDataFrame([("checkmark",)], "name string")
    assert {r.snippet: r.sprite_name for r in symbols.with_hints(found, icons).collect()} == {"✓": "checkmark", "★": None, "→": None}


# changes


def snapshot(spark, content):
    return events.findings_of(spark.createDataFrame([(VIEW, content)] if content else [], "path string, content string"))


@pytest.mark.parametrize(
    "before,now,expected",
    [
        ('<div style="a"></div>', '<p></p>\n<div style="a"></div>\n<img>', [("image_alt", 3)]),
        ('<div style="a"></div>', '<div style="a"></div>\n<div style="a"></div>', [("inline_style", 2)]),
        (None, "<button></button>", [("button_name", 1)]),
        ('<img>', '<img>', []),
    ],
)
def test_introduced_drift(spark, before, now, expected):
    assert rows(changes.introduced_findings(snapshot(spark, before), snapshot(spark, now)), "rule", "line") == expected


def test_stop_blocks_on_errors_once(spark):
    edited, before = many(spark, {VIEW: "<img>"}), spark.createDataFrame([], "path string, content string")
    assert tuple(events.on_stop(edited, before).first()) == (1, True)
    assert events.on_stop(edited, before, asked=True).first().block is False


def test_stream_of_edits(spark, tmp_path):
    many(spark, {VIEW: "<img>"}).write.parquet(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("path string, content string").parquet(str(tmp_path / "in"))
    run = events.watch(stream, lambda: spark.createDataFrame([], "path string, content string"), lambda df, epoch: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r.rule, r.severity) for r in got] == [("image_alt", "error")]


# other tools


def test_runtime_accessibility(spark):
    page = {"url": "u", "violations": [{"id": "r", "impact": "serious", "description": "d", "help": "h", "helpUrl": "w", "nodes": [{"target": ["#a", "#b"]}, {}]}, {"id": "q", "impact": None, "description": "d", "nodes": [{"target": []}]}]}
    text = [json.dumps(page), json.dumps([page, {"url": "v"}]), "broken"]
    found = audits.deep_accessibility(corpus.accessibility_pages(spark.createDataFrame([(t,) for t in text], "value string")))
    assert found.count() == 6
    assert rows(found.distinct(), "rule", "description", "selector", "severity", "failing") == [("q", "d", None, "warning", False), ("r", "h", "#a", "error", True), ("r", "h", None, "error", True)]


def test_screenshots(spark):
    diffs = corpus.screenshot_diffs(many(spark, {"a/x.png": "", "a/x.diff.png": "", "a/x.heatmap.diff.png": ""}))
    assert rows(diffs, "scenario", "baseline_path") == [("a/x", "a/x.png")]
    rated = diffs.withColumn("mismatch_ratio", F.lit(None).cast("double"))
    assert audits.visual_findings(rated, 0.5).first().failing
    with pytest.raises(ValueError):
        audits.visual_findings(rated, 2)


# roll-ups and reports


def some_findings(spark):
    f = lambda *xs: [(x, 1, 1) for x in xs]
    data = [("raw_color", "error", "t", "s", f("a"), None, [], True), ("raw_color", "error", "t", "s", f("b"), None, [], True), ("inline_style", "warning", "t", "s", f("a"), None, [], False), ("similar partials", "suggestion", "<t>", "s", f("a", "c", "a"), None, [("k", "1"), ("k", "2")], False), ("a11y (deep)", "error", "[unknown] r", "s", [], None, [], False)]
    return spark.createDataFrame(data, f"category string, severity string, title string, suggestion string, locations array<{findings.LOCATION}>, snippet string, details array<{findings.DETAIL}>, auto_fix boolean")


def test_rollups(spark):
    found = some_findings(spark)
    assert [tuple(r) for r in findings.by_file(found).collect()] == [("a", 3, "error"), ("(no file)", 1, "error"), ("b", 1, "error"), ("c", 1, "suggestion")]
    assert rows(findings.by_severity(found), "severity", "categories", "total") == [("error", 2, 3), ("suggestion", 1, 1), ("warning", 1, 1)]
    assert findings.at_least(found, "errors").count() == 3 and findings.containing(found, "INLINE").count() == 1
    assert findings.failing(found).first().failing and not findings.failing(found.where("category = 'a11y (deep)'")).first().failing
    assert findings.by_severity(found.limit(0)).agg(F.sum("total")).first()[0] == 0


def test_severity_words():
    assert [findings.parse_severity(x) for x in ("", " Errors ", "suggest", "all")] == ["suggestion", "error", "suggestion", "suggestion"]
    with pytest.raises(ValueError):
        findings.parse_severity("loud")


def test_reports(spark):
    found = some_findings(spark)
    out = json.loads(reports.as_json(found))
    assert out["total"] == 5 and out["files"] == 3 and sum(c["count"] for c in out["categories"]) == 5
    assert [f["details"] for c in out["categories"] for f in c["findings"] if c["name"] == "similar partials"] == [{"k": ["1", "2"]}]
    page = reports.as_html(found)
    assert "&lt;t&gt;" in page and "<t>" not in page
    assert "raw_color: 2 findings (error)" in reports.as_text(found)
    assert "## a" in reports.as_markdown(found)[1]


def test_whole_audit_and_extension(spark):
    corpus_ = many(spark, {VIEW: BROKEN, "app/views/layouts/skip.html.erb": BROKEN, "app/components/lone_component.rb": "renders_one :a"})

    class Extra:
        name, max_severity = "extra", "warning"

        def enabled(self, options):
            return True

        def run(self, df):
            return some_findings(df.sparkSession).where("category = 'inline_style'")

    registry = findings.Registry()
    registry.register(Extra())
    found = audit.audit(corpus_, audit.Options(ignore=("app/views/layouts",)), registry)
    counts = {r.category: r["count"] for r in findings.by_category(found).collect()}
    assert counts == {"raw_color": 4, "tailwind_arbitrary": 2, "inline_style": 2, "helper_recommended": 1, "a11y (static)": 8, "orphan slots": 1, "missing previews": 1}
    errors = audit.audit(corpus_, audit.Options(severity="error"), registry)
    assert {r.severity for r in errors.collect()} == {"error"}
    with pytest.raises(TypeError):
        registry.register(object())


# corpus


def test_paths(spark):
    paths = ["app/views/a.html.erb", "app/views/vendor/b.html.erb", "app/views/user_mailer/c.html.erb", "app/views/mailer_x/d.html.erb", "app/views/layouts/e.html.erb", "lib/f.html.erb"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert [r.path for r in df.where(corpus.covers(ignore=("app/views/layouts",))).collect()] == [paths[0], paths[3]]
    assert corpus.tailwind_config(df) is None and corpus.tailwind_config(df, "x.js") == "x.js"
    patch = "*** Update File: a.erb\n*** Move to: b.erb\nx"
    assert df.limit(1).select(corpus.patched_files(F.lit(patch)).alias("p")).first().p == ["a.erb", "b.erb"]


def test_scan_of_a_folder(spark, tmp_path):
    (tmp_path / "app/views").mkdir(parents=True)
    (tmp_path / "app/views/é.html.erb").write_text("<p>ü</p>", encoding="utf-8")
    (tmp_path / "x.txt").write_text("x")
    found = corpus.files(spark, str(tmp_path), corpus.VIEWS).collect()
    assert [(r.path, r.content) for r in found] == [("app/views/é.html.erb", "<p>ü</p>")]


def test_config():
    assert corpus.load_config('{"tool": {"audit": {"ignore": ["a"]}}}') == {"audit": {"ignore": ["a"]}}
    assert corpus.load_config('{"a": {"x": 1}, "b": {}}', section="a") == {"x": 1}
    assert [corpus.load_config(t) for t in (None, " ", "[1", "3", "{}")] == [{}] * 5
    with pytest.raises(Exception):
        corpus.load_config("[1", strict=True)

"""The parts' views: parsed in many tasks, once a file, with what was found the same as rule by rule."""

import re

import pytest
from pyspark.sql import functions as F

from weftmark.operators import structure, views
from weftmark.plans import registry, seeds
from weftmark.sources import markup

DATA = "/root/testdata/sf0.001"
ODD = {
    "a": '<i style="top: 1px" fill="#0066ff" class="w-[1px] lg:p-[2px] c d e f">é📄</i>\n  <img><p style=x\n class="a b c d e">\n',
    "b": "<button style='<%= x %>'><%= y %></button><a href=x></a><a href>t</a><a></a><button aria-label=b></button><button> </button>",
    "c": '<label for="q">Q</label><input id="q"><input id=r><input type=HIDDEN><input><label for></label><input id>',
    "d": "", "e": "no markup", "f": '<b stroke="rgb(1, 2, 3) #abc" data-Color="\n#1234"\n style = "a">\n\n<% if x %><img alt><% end %>',
}


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([*ODD.items(), ("g", None)], "path string, content string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_parts_of_one_split_are_dealt_out(spark):
    parts = seeds.parts(spark, DATA)
    sizes = [r[0] for r in parts.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert parts.rdd.getNumPartitions() >= 4 and max(sizes) < sum(sizes) / 2


NAMED = "auto_fix button_name class_clusters file_rollup run_fails severity_floor helper_recommended inline_style input_label severity_totals top_occurrences finding_filter image_alt severity_rollup link_name tailwind_arbitrary raw_color".split()


@pytest.mark.parametrize("name", NAMED)
def test_what_is_parsed_is_dealt_out(spark, name):
    plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
    plan = plan[plan.index("== Optimized") :]
    optimized, physical = plan.split("== Physical Plan ==")
    parsed, dealt = len(re.findall("MapInArrow", physical)), len(re.findall("REPARTITION_BY_NUM", physical))
    spark.catalog.clearCache()
    assert 0 < parsed <= dealt


def test_a_batch_holds_many_files(spark, odd):
    batches = list(markup._parsed(iter(odd.toArrow().to_batches()), lambda paths, contents, trees: len(paths)))
    assert sum(batches) == 7 and len(batches) < 7


def test_found_in_trees_is_what_the_rules_find(spark, odd):
    tree, columns = markup.nodes(odd), ("rule", "path", "line", "column", "value", "snippet")
    want = views.with_snippets(views.view_drift(tree, odd).unionByName(views.accessibility(tree)), odd)
    got = markup.trees(odd).select("path", F.inline(views.of_trees()))
    assert rows(got, *columns) == rows(want, *columns) and {r[0] for r in rows(want, *columns)} == set(views.SEVERITIES)
    lists = markup.trees(odd).select(F.inline(structure.class_lists_of_trees()))
    assert rows(lists, "tag", "classes", "at") == rows(structure.class_lists(tree), "tag", "classes", "at") and lists.count() == 2


def test_inputs_of_a_form_know_their_labels_without_a_second_parse(spark, odd):
    found = views.input_label(markup.nodes(odd))
    assert rows(found.where("path = 'c'"), "column") == [(39,), (70,), (96,)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftmark.llm import common, exact_dedup, language_id


def test_unique_rows(spark):
    rows = [(3, "a  b", "x"), (1, "a b", "y"), (1, "a b", "y"), (1, "other", "y"), (None, "a\tb", "z"), (None, "alone", "z"), (7, None, "n"), (8, "", "n"), (9, "long " * 60_000, "l")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    kept = sorted(((r.doc_id, (r.text or "")[:5]) for r in exact_dedup.unique(docs).collect()), key=str)
    assert kept == sorted([(1, "a b"), (1, "other"), (None, "alone"), (7, ""), (9, "long ")], key=str)
    assert exact_dedup.unique(docs).columns == docs.columns and exact_dedup.unique(docs.limit(0)).count() == 0


def test_rows_of_a_known_language(spark, documents):
    model = language_id.train(documents, per_language=5)
    kept = language_id.known(documents, model).collect()
    assert {r.doc_id for r in kept}.isdisjoint({2, 3, 4, 8}) and sum(r.doc_id is None for r in kept) == 1 and sum(r.doc_id == 9 for r in kept) == 2
    assert language_id.known(documents, model).columns == documents.columns and language_id.known(documents.limit(0), model).count() == 0


@pytest.mark.parametrize("most", [0, 100])
def test_keys_by_broadcast_and_by_shuffle(spark, most):
    rows = spark.createDataFrame([(i if i % 10 else None, i % 3) for i in range(50)], "id long, keys int")
    keys = spark.createDataFrame([(i,) for i in range(0, 25)] + [(None,)], "id long")
    left = common.keyed(rows, keys, {"id": F.col("id")}, "left_anti", most)
    assert {r.id for r in left.collect()} == {i for i in range(25, 50) if i % 10} and left.columns == ["id", "keys"]
    assert common.keyed(rows, keys, {"id": F.col("id")}, "left_semi", most).count() == 50 - left.count()


def test_uneven_joins(spark):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(1500)], "k long, v long")
    ones = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    got = common.join_uneven(rows, ones, ["k"], "n", 1500)
    assert sorted(map(tuple, got.select("k", "v", "n", "top").collect())) == sorted(map(tuple, rows.join(ones, "k").select("k", "v", "n", "top").collect()))


@pytest.mark.parametrize("stage", ["without_near_copies", "mixed"])
def test_stages_on_odd_rows(spark, documents, stage):
    run = getattr(corpus_pipeline, stage)
    out = run(spark, documents, "/root/testdata/sf0.001")
    ids = [r.doc_id for r in out.collect()]
    assert out.columns == documents.columns and len(ids) <= documents.count()
    if stage == "without_near_copies":
        assert None in ids and 5 in ids and 6 not in ids and {2, 3, 4} <= set(ids)
    assert run(spark, documents.limit(0), "/root/testdata/sf0.001").count() == 0

"""Similar sets of all sizes against brute force, with few candidates; counts of pairs without the pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from weftmark.operators import structure
from weftmark.plans import registry


def corpus(seed, count=160, sizes=(1, 2, 3, 4, 5, 6, 8, 12, 20, 24, 25, 30, 34)):
    """Sets of many sizes, half of them another with a few grams taken or added."""
    rng, out = random.Random(seed), []
    for i in range(count):
        if i % 2 and out:
            own = set(rng.choice(out))
            own = own - set(rng.sample(sorted(own), rng.randint(0, min(len(own) - 1, 1 + len(own) // 6)))) | {f"g{rng.randrange(60)}" for _ in range(rng.randint(0, 1 + len(own) // 6))}
        else:
            own = {f"g{rng.randrange(60)}" for _ in range(rng.choice(sizes))}
        out.append(sorted(own))
    return [(f"f{i:03}", tokens) for i, tokens in enumerate(out)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.9])
def test_sets_of_all_sizes_against_brute_force(spark, threshold):
    files = corpus(int(threshold * 10))
    want = {(a, b, len(set(x) & set(y)), len(set(x) | set(y))) for (a, x), (b, y) in combinations(files, 2) if len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold}
    got = structure.similar_pairs(spark.createDataFrame(files, "path string, tokens array<string>"), threshold, n=1, min_tokens=1)
    rows = [tuple(r) for r in got.select("file_a", "file_b", "shared", "total").collect()]
    assert len(rows) == len(want) > 20 and set(rows) == want


def test_small_sets_over_common_grams_have_few_candidates(spark):
    rng = random.Random(1)
    sets = [(i, [f"g{g}" for g in rng.sample(range(200), size)], size) for i, size in enumerate(rng.choices(range(3, 8), k=4000))]
    assert structure.candidates(spark.createDataFrame(sets, "set long, grams array<string>, size int"), 0.7).count() < 4 * len(sets)  # over one gram: 169,676


def test_pairs_are_counted_without_being_made(spark, monkeypatch):
    files = corpus(3, 60) * 2
    tokens = spark.createDataFrame([(f"{i}", t) for i, (_, t) in enumerate(files)], "path string, tokens array<string>")
    want = structure.similar_pairs(tokens, 0.7, n=1, min_tokens=1).groupBy("shared", "total").agg(F.count("*").alias("pairs"))
    assert sorted(map(tuple, structure.similar_counts(tokens, 0.7, n=1, min_tokens=1).collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.delattr(structure, "similar_pairs")
    assert registry.QUERIES["page_similarity"](spark, "/root/testdata/sf0.001").count() > 0

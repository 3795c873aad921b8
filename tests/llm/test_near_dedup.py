import random

import numpy as np
import pytest

import corpus_pipeline
from weftmark.llm import near_dedup


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(texts):
    sets, of = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}
    pairs = [(a, b) for a in texts for b in texts if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(of[a], of[b])
            changed |= of[a] != of[b]
            of[a] = of[b] = least
    return of


def corpus(seed=3):
    """Near copies of one changed word, copies around the threshold, and a passage that many texts share."""
    rng = random.Random(seed)
    words, texts = [f"w{i}" for i in range(400)], []
    passage = rng.choices(words, k=40)
    for _ in range(40):
        base = rng.choices(words, k=rng.randrange(3, 150))
        texts.append(base)
        for k in (1, 1, 2, 4):
            copy = list(base)
            for _ in range(k):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    texts += [passage + rng.choices(words, k=rng.randrange(5, 60)) for _ in range(60)]
    group = rng.choices(words, k=120)
    texts += [[*group[:at], "changed", *group[at + 1 :]] for at in range(80)]
    return dict(enumerate([*map(" ".join, texts), "", None, "a b"]))


@pytest.mark.parametrize("most, block, grams, pairs", [(256, 1024, 1_000_000, 250_000), (4, 16, 1_000_000, 250_000), (4, 16, 300, 250_000), (256, 1024, 600, 250_000), (256, 1024, 1_000_000, 8)])
def test_near_dedup_against_brute_force(spark, most, block, grams, pairs):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs, bucket_most=most, block=block, block_grams=grams, block_pairs=pairs).collect()}
    assert {i: found.get(i, i) for i in texts} == plain_components(texts)
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_the_order_of_shingles_does_not_change_that_similar_sets_meet():
    rng = np.random.default_rng(4)
    for _ in range(300):
        a = np.unique(rng.integers(0, 1000, rng.integers(5, 60)))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1000, 2)]))
        common = np.unique(rng.integers(0, 1000, 200))
        counts = rng.integers(4, 9, len(common))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            assert np.intersect1d(near_dedup.prefix(a, common, counts, 0.8), near_dedup.prefix(b, common, counts, 0.8)).size


def test_the_stage_drops_a_copy_with_one_changed_word(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(0, 40, 2):
        base = rng.choices(words, k=100)
        copy = [*base[:50], "changed", *base[51:]]
        rows += [(i, " ".join(base)), (i + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, "").collect()} == set(range(0, 40, 2))

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftmark.llm import mixing


@pytest.fixture(scope="module")
def bilingual(spark):
    """Two languages, clean and of low quality; the words that mark clean texts are those of the first language."""
    rng, docs, labels = random.Random(7), [], []
    for i in range(1200):
        german = i % 4 == 0
        junk = rng.random() < 0.25
        words = rng.choices([f"{'g' if german else 'e'}{k}" for k in range(40)], k=60)
        if junk and not german:
            words = [f"e{k}" for k in rng.choices(range(30, 40), k=20)] + ["junkword"] * 5
        docs.append((i, " ".join(words)))
        labels.append((i, int(not junk), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_clean_texts_without_telling_words_stay_clean(bilingual):
    docs, labels = bilingual
    domains = {r.doc_id: r.domain for r in mixing.mix(docs, labels, multiples=corpus_pipeline.MULTIPLES).collect()}
    clean = [r.doc_id for r in labels.where("quality = 1").collect()]
    for german in (True, False):
        own = [i for i in clean if (i % 4 == 0) == german]
        assert sum(domains[i] == "quality1_toxic0" for i in own) >= 0.97 * len(own)


def test_the_stage_keeps_what_is_likeliest_clean(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id long, text string")
    rates = {1: ("quality1_toxic0", 0), 2: ("quality0_toxic0", 0), 3: ("quality0_toxic0", 1)}

    class Fixed:
        def decide(self, text, row_id, body):
            domain, copies = F.lit(None), F.lit(None)
            for i, (d, c) in rates.items():
                domain, copies = F.when(row_id == i, d).otherwise(domain), F.when(row_id == i, c).otherwise(copies)
            return body(domain, copies)

    monkeypatch.setattr(corpus_pipeline.mixing, "plan", lambda *a, **k: Fixed())
    assert {r.doc_id for r in corpus_pipeline.mixed(spark, docs, "/root/testdata/sf0.001").collect()} == {1, 3}


def test_rates_against_a_dense_fit(spark):
    """The passes reach the optimum that plain projected gradient finds on the rates themselves."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], size=200)
    tokens = rng.integers(1, 300, 200)
    scored = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(tokens, p))], "doc_id long, tokens long, posterior array<double>").cache()
    every = float(tokens.sum())
    for targets, cap in (([0.5 * every, 0.3 * every, 0.4 * every], 8.0), ([0.0, 0.6 * every, 0.1 * every], 2.0), ([0.9 * every, 0.0, 0.0], 1.0)):
        move, totals, _ = mixing.fit_rates(scored, targets, cap)
        rows = scored.select("doc_id", mixing.rate_of(F.col("posterior"), move, cap).alias("r")).orderBy("doc_id").collect()
        got = np.array([r.r for r in rows])
        a, size = p * tokens[:, None], mixing.PULL * every

        def cost(r):
            return ((r @ a - targets) ** 2).sum() / (2 * size) + (tokens * (r - 1) ** 2).sum() / 2

        # conditions of the optimum: no gradient inside the bounds, none that points inwards at them
        slope = a @ (got @ a - targets) / size / tokens + got - 1
        assert np.abs(np.clip(got - slope, 0, cap) - got).max() < 1e-2
        r = np.ones(200)
        bound = np.linalg.eigvalsh((p * tokens[:, None]).T @ p)[-1] / size + 1
        for _ in range(3000):
            r = np.clip(r - (a @ (r @ a - targets) / size / tokens + r - 1) / bound, 0, cap)
        assert cost(got) <= cost(r) * (1 + 1e-6) + 1e-6
        assert np.abs(got @ a - totals).max() < 1e-6 * every


def test_labels_that_conflict_have_a_defined_domain(spark):
    docs = spark.createDataFrame([(i, "good text here" if i % 2 else "vile text here") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i in range(100) for q in (1, 0)], "doc_id long, quality int, toxic int")
    assert mixing.train(docs, labels).domains == ["quality0_toxic0"]

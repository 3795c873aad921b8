import random

import numpy as np
from pyspark.sql import functions as F

from weftmark.llm import pii


def test_the_model_learns_from_every_example_of_every_row(spark):
    """More examples than a bounded sample of 50,000 would hold, in rows of which few are distinct."""
    rng = random.Random(5)
    texts = [" ".join(f"call +1 555 {rng.randrange(1000, 9999)} {rng.randrange(100, 999)} or me{rng.randrange(99)}@mail.org, no {rng.randrange(10**12)} at 1.2.3.{rng.randrange(400)}" for _ in range(30)) for _ in range(80)]
    docs = spark.createDataFrame([(i, texts[i % 80]) for i in range(1200)], "doc_id long, text string")
    models = [pii.train(docs, most_held=most) for most in (300_000, 0)]
    of = [pii.examples(t) for t in texts]
    test = {r.doc_id: r.test for r in docs.select("doc_id", (F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(1_000_000)) % 5 == 0).alias("test")).collect()}
    teaching, held_out = ([e for i in range(1200) if test[i] == side for e in of[i % 80]] for side in (False, True))
    assert len(teaching) > 50_000
    share = np.mean([good for good, _ in teaching])
    x, y = np.array([x for _, x in held_out]), np.array([good for good, _ in held_out])
    for model in models:  # held by the driver, and summed by Spark
        assert np.isclose(model.trees.start, np.log(share / (1 - share)), rtol=1e-12)
        score = np.floor(model.trees.predict(x) * pii.CELLS) / pii.CELLS
        for i, kind in enumerate(pii.KINDS):
            own = x[:, i] == 1
            fit = [s for s in np.unique(score[own]) if y[own & (score >= s)].mean() >= 0.99 and (own & (score >= s)).sum() >= 10]
            assert model.thresholds[kind] == (max(min(fit), 0.5) if fit else 2.0)
    assert models[0].thresholds == models[1].thresholds and all(np.array_equal(p, q) for a, b in zip(models[0].trees.nodes, models[1].trees.nodes) for p, q in zip(a, b))


def test_quantiles_of_counted_values():
    rng = np.random.default_rng(2)
    for _ in range(50):
        values, n = rng.permutation(30)[: rng.integers(1, 30)], None
        n = rng.integers(1, 9, len(values))
        shares = np.linspace(0, 1, 33)
        assert np.allclose(pii.quantiles(values, n, shares), np.quantile(np.repeat(values, n), shares))

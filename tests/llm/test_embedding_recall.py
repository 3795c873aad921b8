import numpy as np
import pytest

from weftmark.llm import embeddings


def vectors(kind, rng, count=6000, dim=64):
    """Vectors with near partners: isotropic, with a common offset, or with a decaying spectrum."""
    scale = np.ones(dim) if kind != "spectrum" else 1 / np.arange(1, dim + 1)
    base = rng.normal(size=(count, dim)) * scale
    if kind == "offset":
        base += 1.2 * np.sqrt((base**2).sum(axis=1).mean()) * np.eye(dim)[3]
    base /= np.linalg.norm(base, axis=1)[:, None]
    away = rng.normal(size=(count // 2, dim)) * scale
    away -= (away * base[: count // 2]).sum(axis=1)[:, None] * base[: count // 2]
    away /= np.linalg.norm(away, axis=1)[:, None]
    cosine = rng.uniform(0.931, 0.96, size=(count // 2, 1))
    return np.concatenate([base, cosine * base[: count // 2] + np.sqrt(1 - cosine**2) * away])


@pytest.mark.parametrize("kind", ["isotropic", "offset", "spectrum"])
def test_recall_of_the_tables(kind):
    """Keys learnt for ten million rows still meet in a table; queries are the rows with ids divisible by 50."""
    x = vectors(kind, np.random.default_rng(3))
    codes = embeddings.learn(x[::3], 10_000_000, 0.93)
    keys = codes.keys(x)
    queries = np.arange(0, len(x), 50)
    near = x[queries] @ x.T >= 0.93
    found = np.zeros_like(near)
    for t in range(keys.shape[1]):
        found |= keys[queries, t][:, None] == keys[:, t]
    assert (found & near).sum() / near.sum() >= 0.9


def test_tables_grow_with_the_rows():
    x = vectors("isotropic", np.random.default_rng(4), 2000)
    small, large = embeddings.learn(x, 1000, 0.93), embeddings.learn(x, 10**8, 0.93)
    assert len(small.tables[0]) < len(large.tables[0]) and len(small.tables) < len(large.tables)


def test_dimensions_and_tiny_components(spark):
    rng = np.random.default_rng(5)
    rows = []
    for dim in (3, 7, 16):
        v = rng.normal(size=dim)
        rows += [(len(rows) + k, (v * (1 + k)).tolist(), 1) for k in range(3)]
    rows += [(9, [1e-200, 0.0, 0.0], 1), (10, [1e-200, 1e-203, 0.0], 1), (11, [0.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()}
    assert got == {**{i: (2, i - i % 3) for i in range(9)}, 9: (1, 9), 10: (1, 9), 11: (0, 11)}

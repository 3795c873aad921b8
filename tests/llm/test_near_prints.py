import itertools
import random

import numpy as np
import pytest

from weftmark.llm import near_dedup

WORDS = [f"w{i}" for i in range(300)]


def bucket(seed, sizes):
    """Sets of a large bucket: texts that share a passage, some with near copies."""
    rng, sets = random.Random(seed), []
    passage = rng.choices(WORDS, k=12)
    for size in sizes:
        base = passage[: max(1, size // 8)] + rng.choices(WORDS, k=size)
        sets += [near_dedup.shingles(" ".join(words).encode()) for words in (base, [*base[:-1], "changed"], ["more", *base], rng.choices(WORDS, k=size))]
    return sets


def similar(a, b):
    both = len(np.intersect1d(a, b))
    return 10 * both >= 8 * (len(a) + len(b) - both)


@pytest.mark.parametrize("sizes", [[60, 90, 200, 300] * 8, [4, 5, 6, 8, 12, 16, 20] * 6])
def test_large_buckets_lose_no_link(sizes):
    sets = bucket(len(sizes), sizes)
    pairs = {(i, j) for j, i in itertools.combinations(range(len(sets)), 2) if similar(sets[i], sets[j])}
    found = set(zip(*(side.tolist() for side in near_dedup._near_prints(sets, 0.8))))
    assert pairs <= found and len(found) < len(sets) * (len(sets) - 1) / 2
    of = list(range(len(sets)))
    for i, j in sorted(pairs) * 4:
        of[i] = of[j] = min(of[i], of[j])
    far, near = near_dedup._all_links(np.arange(len(sets)), sets, 0.8)
    got = list(range(len(sets)))
    for i, j in sorted(zip(far, near)) * 4:
        got[i] = got[j] = min(got[i], got[j])
    assert got == of


def test_fingerprints_decide_what_is_verified_in_large_buckets(monkeypatch):
    sets = bucket(1, [100] * 10)
    ids = np.arange(len(sets))
    assert near_dedup._all_links(ids, sets, 0.8)[0]
    far = iter(itertools.cycle([0, (1 << 64) - 1, (1 << 32) - 1, ((1 << 32) - 1) << 32]))
    monkeypatch.setattr(near_dedup, "simhash_of", lambda hashes: next(far))
    kept = {(i, j) for i, j in zip(*near_dedup._near_prints(sets, 0.8))}
    assert kept and all((i - j) % 4 == 0 for i, j in kept)  # equal prints only; near copies stand beside each other
    assert near_dedup._all_links(ids, sets, 0.8) == ([], [])


def test_bits_by_which_small_sets_differ():
    rng = np.random.default_rng(3)
    for least, size, both in ((4, 5, 4), (9, 9, 8), (12, 15, 12)):
        hashes = rng.integers(0, 1 << 63, (400, 2 * size), dtype=np.uint64) << np.uint64(1)
        hashes |= rng.integers(0, 2, hashes.shape, dtype=np.uint64)
        bits = [int(near_dedup.simhash_of(h[:least]) ^ near_dedup.simhash_of(np.concatenate([h[:both], h[size : 2 * size - both]]))).bit_count() for h in hashes]
        assert np.mean(bits) / 64 < near_dedup._differs(0.8, least) + 0.01 and max(bits) <= near_dedup.widest(0.8, least=1)

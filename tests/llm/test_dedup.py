import hashlib
import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weftmark.llm import exact_dedup, simhash
from weftmark.llm.common import Workspace
from weftmark.llm.components import components


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 300)), max_size=600))
def test_index_keeps_what_is_live(steps):
    index, live = exact_dedup.CuckooIndex(), {}
    for add, i in steps:
        if add:
            assert index.insert(digest(i), i, i) == (i not in live)
            live[i] = live.get(i, 0) + 1
        else:
            assert index.delete(digest(i), i) == (live.pop(i, None) is not None)
    assert {(d, n, k, c) for d, n, k, c in index.entries()} == {(digest(i), i, i, c) for i, c in live.items()}
    assert all(index.find(digest(i), i) is not None for i in live) and index.live == len(live)


def test_overflow_resizes_and_loses_nothing():
    index = exact_dedup.CuckooIndex()
    for i in range(5000):
        index.insert(digest(i), 1, i)
    assert index.resizes > 0 and all(index.find(digest(i), 1) for i in range(5000))
    assert sum(index.filter.contains(digest(-i)) for i in range(1, 20001)) < 20  # false hits are rare, and are verified


def test_same_digest_prefix_is_told_apart():
    index = exact_dedup.CuckooIndex()
    a, b = digest(1), digest(1)[:10] + bytes(22)
    index.insert(a, 5, 1)
    assert index.find(b, 5) is None and index.find(a, 6) is None
    assert index.insert(b, 5, 2) and index.live == 2


def test_exact_dedup(spark, documents):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(documents).collect()}
    assert {(0, 0, 2, True), (1, 0, 2, False), (2, 2, 2, True), (3, 2, 2, False), (4, 4, 1, True), (5, 5, 2, True), (6, 5, 2, False), (9, 9, 2, True), (None, None, 1, False)} <= got
    row = exact_dedup.exact_dedup(documents).where("doc_id = 1").first()
    assert row.text_sha256 == hashlib.sha256(b"Hello brave new world of words").hexdigest()
    assert exact_dedup.exact_dedup(documents.limit(0)).count() == 0


def test_stored_index_takes_and_drops_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i % 50}") for i in range(200)], "doc_id long, text string")
    index = exact_dedup.index_of(exact_dedup.digests(docs), 4)
    assert index.count() == 50 and index.agg({"group_size": "sum"}).first()[0] == 200
    more = exact_dedup.insert(index, exact_dedup.digests(docs.where("doc_id < 10")), 4)
    assert more.count() == 50 and more.agg({"group_size": "sum"}).first()[0] == 210
    less = exact_dedup.delete(more, exact_dedup.digests(docs.where("doc_id < 10")), 4)
    assert less.count() == 40


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    ids, of = list(prints), {}
    for i in ids:
        of[i] = i
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if of[b] < of[a] and (prints[a] ^ prints[b]).bit_count() <= 2:
                    of[a], changed = of[b], True
    return of


def test_simhash_against_brute_force(spark, documents):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(0, 200))) for _ in range(60)]
    texts += [t + " extra" for t in texts[:30]] + ["É à ö É", "é à ö é", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_dedup(docs).collect()}
    prints = {i: plain_print(t) for i, t in enumerate(texts)}
    of = plain_components(prints)
    assert got == {i: (f"{p:016x}", of[i]) for i, p in prints.items()}
    odd = {r.doc_id: r for r in simhash.simhash_dedup(documents).collect()}
    assert odd[2].fingerprint == "0" * 16 and odd[3].component_id == odd[4].component_id == 2 and odd[None].component_id is None
    assert simhash.simhash_dedup(documents.limit(0)).count() == 0


def test_links_are_whole_with_and_without_large_buckets(spark):
    rng = random.Random(9)
    prints = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        prints |= {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)} | {base}
    prints |= {rng.getrandbits(20) for _ in range(300)}  # these share their high bits: large buckets
    prints = dict(enumerate(sorted(prints)))
    of = plain_components(prints)
    df = spark.createDataFrame([(int(np.uint64(p).astype(np.int64)), i) for i, p in prints.items()], "fp long, node long")
    for most in (8, 10_000):
        space = Workspace(spark, "test-links")
        found = {r.node: r.component for r in components(simhash.links(df, space, bucket_most=most), space).collect()}
        assert {i: found.get(i, i) for i in prints} == of


def test_no_pair_within_the_distance_escapes_the_chains():
    rng = np.random.default_rng(1)
    ring = simhash.segments(5)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
    for bits in (0, 1, 2, 3):
        b = a.copy()
        for _ in range(bits):
            b ^= np.uint64(1) << rng.integers(0, 64, len(a), dtype=np.uint64)
        near = np.bitwise_count(a ^ b) <= 2
        found = np.zeros(len(a), dtype=bool)
        for start in range(5):
            found |= simhash.viable(a, b, start, ring, 2)
        assert (found == near).all()


def test_components_take_loops_and_nulls(spark):
    edges = spark.createDataFrame([(1, 1), (2, 3), (3, 2), (3, 9), (None, 4), (20, 10)], "a long, b long")
    assert {(r.node, r.component) for r in components(edges, Workspace(spark, "test-components")).collect()} == {(2, 2), (3, 2), (9, 2), (10, 10), (20, 10)}

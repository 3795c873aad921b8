import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from weftmark.llm import packing, token_output
from weftmark.llm.common import Workspace
from weftmark.llm.tokens import ChunkTokenizer, public_path

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
PLAIN = {k: Tokenizer.from_file(public_path(f)) for k, f in FILES.items()}
KNOWN = {k: ChunkTokenizer(public_path(f), k, most=200) for k, f in FILES.items()}
TEXT = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "\u00a0", "\u2003", "\x1c", "\x85", "a", "It's", "'s", "don't", "Éé", "e\u0301", "İ", "ß", "Ω", "Σ", "日本", "12", "½", ",", "...", "<|endoftext|>", "<", "|", "🙂", "\u200d", "X1", "_", "'ll", "ll"]), max_size=14).map("".join)


@pytest.mark.parametrize("kind", FILES)
@settings(max_examples=400, deadline=None)
@given(texts=st.lists(TEXT | st.text(max_size=12), max_size=4))
def test_ids_equal_those_of_whole_texts(kind, texts):
    for text, ids in zip(texts, KNOWN[kind].encode(texts)):
        assert np.frombuffer(ids, KNOWN[kind].dtype).tolist() == PLAIN[kind].encode(text, add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("count", [0, 1, 7, 600, 70_000])
def test_coder_round_trip(count):
    ids = (np.random.default_rng(count).zipf(1.3, count) % 5000).astype(np.uint16)
    coder = token_output.Coder(token_output.frequencies(np.bincount(ids, minlength=5000)))
    block = coder.encode(ids, checkpoint_steps=16)
    assert (coder.decode(block) == ids).all()


def test_spans_decode_alone_and_damage_is_found():
    ids = (np.random.default_rng(2).zipf(1.2, 50_000) % 300).astype(np.uint16)
    coder = token_output.Coder(token_output.frequencies(np.bincount(ids, minlength=300)))
    block = coder.encode(ids, lanes=64, checkpoint_steps=100)
    assert (coder.decode(block, 3, 2) == ids[3 * 6400 : 5 * 6400]).all()
    broken = bytearray(block)
    broken[-5] ^= 1
    with pytest.raises((ValueError, IndexError)):
        coder.decode(bytes(broken))
    with pytest.raises(ValueError):
        coder.decode(b"XXXX" + block[4:])
    p = np.bincount(ids)[np.bincount(ids) > 0] / len(ids)
    assert len(coder.encode(ids, lanes=8, checkpoint_steps=10**6)) < 1.02 * len(ids) * -(p * np.log2(p)).sum() / 8 + 1000


def test_frequencies_keep_every_id():
    counts = np.array([10**9, 1, 0, 1, 5] + [1] * 1000)
    freq = token_output.frequencies(counts, 11)
    assert freq.sum() == 2048 and ((freq > 0) == (counts > 0)).all()


def test_token_output(spark, documents):
    target = f"{Workspace(spark, 'test-tokens').root}/set"
    token_output.write_tokens(documents, target, block_ids=1000)
    want, start = [], 0
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    for r in sorted(documents.collect(), key=key):
        ids = PLAIN["byte"].encode(r.text or "", add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output.token_digests(spark, target).collect()]
    assert sorted(got, key=lambda x: x[1]) == want
    whole = {r.start: r.ids for r in token_output.read_tokens(spark, target).collect()}
    assert [crc(whole[s]) for _, s, _, _ in want] == [w[3] for w in want]


def test_token_output_of_nothing(spark, documents):
    target = f"{Workspace(spark, 'test-tokens').root}/set"
    token_output.write_tokens(documents.limit(0), target)
    assert token_output.token_digests(spark, target).count() == 0


def plain_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80))
def test_plan_places_all_and_equals_best_fit(lengths):
    histogram = {n: lengths.count(n) for n in set(lengths)}
    used, placed = {}, {n: set() for n in histogram}
    for n, rank, count, sequence, offset in packing.plan(histogram, 40):
        for i in range(count):
            placed[n].add(rank + i)
            used.setdefault(sequence + i, []).append((offset, n))
    assert all(placed[n] == set(range(c)) for n, c in histogram.items())
    for spans in used.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 40
    assert packing.sequence_counts(histogram, 40)[0] == len(used) == plain_best_fit(lengths, 40)


def test_packing(spark, documents):
    want = []
    for r in documents.collect():
        ids = PLAIN["word"].encode(r.text or "", add_special_tokens=False).ids + [0]
        want += [(r.doc_id, k, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for k, s in enumerate(range(0, len(ids), 2048))]
    rows = packing.pack(documents).collect()
    key = lambda t: (t[0] is None, *(x or 0 for x in t))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) <= 2048
    assert len(by) == -(-sum(r.length for r in rows) // 2048)
    assert packing.pack(documents.limit(0)).count() == 0


def test_many_pieces_of_one_length(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "word " * (300 if i % 3 else rng.randrange(1, 900))) for i in range(300)], "doc_id long, text string")
    cut = Workspace(spark, "test-pack").write(packing.pieces(docs, public_path(FILES["word"]), "word", 0, 512, "doc_id", "text"), "pieces")
    rows = packing.place(cut, 512, per_group=10).collect()
    assert len(rows) == cut.count() and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)

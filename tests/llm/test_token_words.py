import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from weftmark.llm.tokens import ChunkTokenizer, public_path

FILES = {"byte": "byte_bpe_50k.json", "word": "word_bpe_49k.json"}
LETTERS = [chr(c) for c in range(256) if chr(c).isalpha() and chr(c) not in "ªºµ"]


@pytest.mark.parametrize("kind", FILES)
def test_words_of_latin_letters_need_the_model_only(kind, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices(LETTERS[:52] if i % 2 else LETTERS, k=rng.randrange(1, 30))) for i in range(3000)] + ["ab" * 5000, *LETTERS]
    known, plain = ChunkTokenizer(public_path(FILES[kind]), kind, most=500), Tokenizer.from_file(public_path(FILES[kind]))
    known._raw([" "])
    monkeypatch.setattr(known, "_raw", lambda texts: [b"" for t in texts if pytest.fail(f"encoded by the whole library: {t!r}")])
    text = words[0] + "".join(" " + w for w in words[1:])
    for one in (text, *words):
        assert np.frombuffer(known.encode([one])[0], known.dtype).tolist() == plain.encode(one, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", FILES)
def test_the_cache_is_bounded_and_keeps_what_is_used(kind):
    known = ChunkTokenizer(public_path(FILES[kind]), kind, most=50)
    for i in range(500):
        known.encode([f"again {'x' * i} Ωm{i}, {i}"])
        assert len(known.cache) <= 50 and len(known.cache.older) <= 50
    assert any("again" in chunk for chunk in known.cache)

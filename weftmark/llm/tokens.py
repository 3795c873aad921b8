"""Exact tokenisation with the tokenizers library, cached by chunk."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Sequence

import numpy as np

_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
#: After a run of letters the pre-tokenizers always cut before an ASCII character that is no letter.
_CUT = r"(?=[\x00-\x40\x5b-\x60\x7b-\x7f]|\Z)"
#: White space is kept by byte-level vocabularies and dropped by word vocabularies.
_CHUNKS = {
    "byte": re.compile(rf" ?[{_LETTER}]++{_CUT}| ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]"),
    "word": re.compile(rf"[{_LETTER}]++{_CUT}|[^{_SPACE}]+"),
}
#: Texts with special tokens, or with separators on which regex engines differ, are encoded in one piece.
_WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")


#: A chunk that is one word of the pre-tokenizers and that their normalizers at most lower-case.
_WORD = re.compile(rf" ?[{_LETTER}]+")
#: The character that byte-level vocabularies have for each byte.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTES = {b: b if b in _PRINTABLE else 256 + sum(c not in _PRINTABLE for c in range(b)) for b in range(256)}
_SPACED = chr(_BYTES[0x20])


class _Cache(dict):
    """Ids of chunks in two generations of at most `most` entries: when the younger is full it becomes the older, whose entries are
    dropped unless they were used since. What neither has comes from `find`."""

    def __init__(self, find: Callable[[str], bytes], most: int):
        self.find, self.most, self.older = find, most, {}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self.find(chunk)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class ChunkTokenizer:
    """Ids of whole texts, equal to encode(text, add_special_tokens=False).

    The pre-tokenizer never joins two chunks, so the ids of a text are those of its chunks in a row. Chunks
    seen before come from a cache (see _Cache). Of the others, the library's model merges words of Latin letters, which need no more than
    their bytes' characters (in lower case, where the vocabulary has that), and the whole library encodes the rest.
    """

    def __init__(self, path: str, kind: str, most: int = 100_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.lower = self.tokenizer.model.tokenize, kind == "word"
        self.chunks, self.cache = _CHUNKS[kind], _Cache(self._find, most)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")

    def _raw(self, texts: Sequence[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _find(self, chunk: str) -> bytes:
        if not _WORD.fullmatch(chunk):
            return self._raw([chunk])[0]
        if self.lower:
            chunk = chunk.lower()
        if not chunk.isascii():
            chunk = chunk.encode().decode("latin-1").translate(_BYTES)
        elif chunk[0] == " ":
            chunk = _SPACED + chunk[1:]
        return array(self.dtype.char, [t.id for t in self.tokenize(chunk)]).tobytes()

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text as little-endian integers of `dtype`; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if t and any(mark in t for mark in _WHOLE)]
        for i, ids in zip(whole, self._raw([texts[i] for i in whole])):
            out[i] = ids
        skip, find, get = set(whole), self.chunks.findall, self.cache.__getitem__
        for i, t in enumerate(texts):
            if t and i not in skip:
                out[i] = b"".join(map(get, find(t)))
        return out


_LOADED: dict[tuple[str, str, int], ChunkTokenizer] = {}


def tokenizer(path: str, kind: str, most: int = 100_000) -> ChunkTokenizer:
    """The worker's tokenizer of a file; it lives as long as the worker, so its cache serves all of its tasks."""
    if (path, kind, most) not in _LOADED:
        _LOADED[path, kind, most] = ChunkTokenizer(path, kind, most)
    return _LOADED[path, kind, most]


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)

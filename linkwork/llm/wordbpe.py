"""Token ids of whole texts for a word-splitting BPE file of the ``tokenizers`` library.

The vocabulary file splits a normalised text into words and encodes each word on its own, so ids
of a word seen before need not be worked out again.  Texts made only of characters whose
normal form and lower case are beyond doubt are cut, vectorised, into pieces at which the file's
own pattern always splits; each new piece, and every other text, goes through ``tokenizers``.
"""

from __future__ import annotations

import json
import re

import numpy as np
from tokenizers import Tokenizer

from linkwork.llm.tokens import hash_spans

#: ASCII and letters of Latin-1 and Latin Extended-A: unchanged by NFC, lower-cased to one
#: letter of the same kind everywhere.
_PLAIN = re.compile("[\t\n\r\x20-\x7eªµºÀ-ÖØ-öø-įĲ-ňŊ-ž]*").fullmatch
#: Pieces remembered by a Python worker at most.
CACHE_PIECES = 600_000
_LETTER, _PUNCT, _APOSTROPHE = 1, 2, 3
_CLASS = np.full(256, _LETTER, dtype=np.uint8)
_CLASS[:128] = [0 if chr(b).isspace() or b < 32 else _LETTER if chr(b).isalnum() else _PUNCT for b in range(128)]
_CLASS[ord("'")] = _APOSTROPHE
_ENCODERS: dict[str, WordEncoder] = {}


def pieces(buf: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans: cut at white space and between letters and punctuation, never at an apostrophe,
    which the pattern may join to the letters after it or to other punctuation."""
    kind = _CLASS[np.frombuffer(buf, dtype=np.uint8)]
    before = np.concatenate([[0], kind[:-1]])
    cut = (kind != before) & ((kind == 0) | (before == 0) | ((kind != _APOSTROPHE) & (before != _APOSTROPHE)))
    at = np.flatnonzero(cut)
    ends = np.append(at[1:], len(buf))
    real = kind[at] != 0
    return at[real], ends[real]


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.known: dict[bytes, bytes] = {}
        suffix, vocabulary = spec["model"]["end_of_word_suffix"], spec["model"]["vocab"]
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """The worker's encoder for a file; a worker that is used again keeps what it knows."""
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def exact(self, text: str) -> bytes:
        out = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(out.ids, dtype="<u4").tobytes()

    def learn(self, new: list[bytes]) -> None:
        """Words go in one call: the last token of a word carries the word-end suffix."""
        words = [w for w in new if w.decode().isalpha()]
        if words:
            data = self.exact(b" ".join(words).decode())
            ends = np.flatnonzero(self.closes[np.frombuffer(data, dtype="<u4")]) + 1
            if len(ends) != len(words):
                raise ValueError("the vocabulary file does not close each word with its suffix")
            at = 0
            for word, end in zip(words, (4 * ends).tolist(), strict=True):
                self.known[word] = data[at:end]
                at = end
        for piece in new:
            if piece not in self.known:
                self.known[piece] = self.exact(piece.decode())

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        data = [t.lower().encode() for t in texts]
        buf = b"\n".join(data) + b"\n" + b"\0" * 8
        text_at = np.concatenate([[0], np.cumsum([len(d) + 1 for d in data])])
        start, end = pieces(buf[:-8])
        _, first, which = np.unique(hash_spans(buf, start, end - start), return_index=True, return_inverse=True)
        names = [buf[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        if new := [n for n in names if n not in self.known]:
            self.learn(new)
        ids = [self.known[n] for n in names]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        flat, at = np.frombuffer(b"".join(ids), dtype="<u4"), np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.cumsum(counts)
        out = flat[np.repeat(at[which] - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
        piece_at = np.searchsorted(start, text_at)
        token_at = np.concatenate([[0], ends])[piece_at]
        return [out[a:b] for a, b in zip(token_at[:-1].tolist(), token_at[1:].tolist(), strict=True)]

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        texts = [t or "" for t in texts]
        plain = [_PLAIN(t) is not None and not any(s in t for s in self.special) for t in texts]
        fast = iter(self.plain([t for t, p in zip(texts, plain, strict=True) if p]) if any(plain) else [])
        return [next(fast) if p else np.frombuffer(self.exact(t), dtype="<u4") for t, p in zip(texts, plain, strict=True)]

"""Encoders of the public vocabularies, one of each kept by a Python worker."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .pretokens import WordEncoder


@functools.cache
def byte_alphabet() -> dict[int, str]:
    """Printable stand-ins of the 256 bytes in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _by_model(tokenizer):  # noqa: ANN001, ANN202
    model, table = tokenizer.model, byte_alphabet()

    blank, tokenize = table[32], model.tokenize

    def spelt(word: str) -> str:
        if word.isascii() and word.isprintable():
            return word.replace(" ", blank)
        return word.encode().decode("latin-1").translate(table)

    def encode(new: list[str]) -> list[bytes]:
        ids: list[int] = []
        ends = [0]
        for w in new:
            ids += [t.id for t in tokenize(spelt(w))]
            ends.append(4 * len(ids))
        flat = np.array(ids, np.int32).tobytes()
        return [flat[a:b] for a, b in zip(ends, ends[1:])]

    return encode


def _lower(text: str) -> str:
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.lru_cache(4)
def library_encoder(path: str) -> WordEncoder:
    """The ``tokenizers`` file at ``path``: its model encodes each distinct word, words are cut as its pre-tokenizer does."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    lower = tokenizer.normalizer is not None
    return WordEncoder(_by_model(tokenizer), spaces=not lower, prepare=_lower if lower else None)

"""Vectorised pre-tokenisation: whole batches of texts are cut into words with array operations.

Both patterns used by the byte-level vocabularies here are decided by the classes of neighbouring characters, so the
boundaries of all words in a batch follow from a few passes over an array of code points. Equal words are then found
by a 64-bit hash whose equality is confirmed character by character, and only distinct words are encoded.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd

OTHER, LETTER, NUMBER, SPACE = range(4)
#: Characters handled at once; bounds the memory of a worker (about 100 bytes a character).
CHUNK_CHARS = 600_000
#: Distinct words whose ids a worker remembers; beyond that it starts afresh.
CACHE_WORDS = 300_000


@functools.cache
def _classes() -> np.ndarray:
    import regex

    table = np.zeros(0x110000, np.uint8)
    points = np.array([i for i in range(0x110000) if not 0xD800 <= i < 0xE000], np.uint32)
    text = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            table[points[m.start() : m.end()]] = kind
    return table


@functools.cache
def _mix() -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, 0x110000, dtype=np.uint64) | np.uint64(1)


@functools.lru_cache(4)
def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, 0x9E3779B97F4A7C15, np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _contractions(cp: np.ndarray, cls: np.ndarray, start: np.ndarray, first: np.ndarray) -> None:
    """'s 't 're 've 'm 'll 'd at the beginning of a word are words of their own; changes ``start``."""
    n = len(cp)
    at = np.flatnonzero(start & (cp == 39))
    at = at[at + 1 < n]
    at = at[(cls[at + 1] == LETTER) & ~first[at + 1]]
    one = np.isin(cp[at + 1], [ord(c) for c in "stmd"])
    inside = at + 2 < n
    next_ = np.where(inside, cp[np.minimum(at + 2, n - 1)], 0)
    inside &= ~first[np.minimum(at + 2, n - 1)]
    two = np.zeros(len(at), bool)
    for a, b in ("re", "ve", "ll"):
        two |= (cp[at + 1] == ord(a)) & (next_ == ord(b)) & inside
    hit = one | two
    start[at[hit] + 1] = False
    end = at[hit] + np.where(one[hit], 2, 3)
    end = end[end < n]
    end = end[(cls[end] == LETTER) & ~first[end]]
    start[end] = True


def words(cp: np.ndarray, lengths: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word. ``lengths``: characters of each text.

    spaces: a blank belongs to the word after it and runs of white space are words (every character is in a word);
    otherwise white space separates words and each number character stands alone.
    """
    n = len(cp)
    cls = _classes()[cp]
    first = np.zeros(n + 1, bool)
    first[np.concatenate(([0], np.cumsum(lengths)))] = True
    end_of_text, first = first[1:], first[:n]
    change = first.copy()
    change[1:] |= cls[1:] != cls[:-1]
    blank = cls == SPACE
    start = change.copy()
    if spaces:
        run_end = np.ones(n, bool)
        run_end[:-1] = change[1:]
        before_word = blank & run_end & ~end_of_text
        start |= before_word
        joined = np.flatnonzero(before_word & (cp == 32)) + 1
        start[joined] = False
        _contractions(cp, cls, start, first)
        begin = np.flatnonzero(start)
        return begin, np.append(begin[1:], n)
    start |= cls == NUMBER
    _contractions(cp, cls, start, first)
    begin = np.flatnonzero(start)
    end = np.append(begin[1:], n)
    solid = ~blank[begin]
    return begin[solid], end[solid]


def distinct(cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each word, index of the first word of each code); equal codes mean equal words."""
    size = end - begin
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = int(size.sum())
    base = np.cumsum(size) - size
    within = np.arange(total) - np.repeat(base, size)
    chars = cp[np.repeat(begin, size) + within]
    key = np.add.reduceat(_mix()[chars] * _powers(1 << int(size.max()).bit_length())[within], base)
    codes, _ = pd.factorize(key)
    rep = np.empty(codes.max() + 1, np.int64)
    rep[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    same = size[rep[codes]] == size
    other = chars[np.repeat(np.where(same, base[rep[codes]], base), size) + within]
    wrong = np.flatnonzero(~same | (np.add.reduceat((other != chars).astype(np.int64), base) > 0))
    if len(wrong):  # a collision of the hash: these words stand for themselves
        codes[wrong] = len(rep) + np.arange(len(wrong))
        rep = np.append(rep, wrong)
    return codes, rep


def gather(flat: np.ndarray, offset: np.ndarray, length: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Concatenates ``flat[offset[c] : offset[c] + length[c]]`` for each c of ``codes``."""
    n = length[codes]
    total = int(n.sum())
    ends = np.cumsum(n)
    return flat[np.repeat(offset[codes] - (ends - n), n) + np.arange(total)]


def text_pieces(text: str, limit: int) -> list[str]:
    """``text`` in pieces of about ``limit`` characters, cut where any word ends: behind a letter, before a sign or blank."""
    import regex

    ends, out, a = regex.compile(r"(?<=\p{L})[^\p{L}\p{N}\p{M}]"), [], 0
    while a < len(text):
        found = ends.search(text, a + limit) if a + limit < len(text) else None
        b = found.start() if found else len(text)
        out.append(text[a:b])
        a = b
    return out


class WordEncoder:
    """Encodes texts word by word; ``encode_words`` gives the ids of new distinct words as int32 bytes."""

    def __init__(self, encode_words: Callable[[list[str]], list[bytes]], spaces: bool, prepare: Callable[[str], str] | None = None) -> None:
        self.encode_words, self.spaces, self.prepare = encode_words, spaces, prepare
        self.cache: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text). A long text that stands alone is encoded piece by piece."""
        if len(texts) == 1 and len(texts[0]) > 2 * CHUNK_CHARS:
            ids = np.concatenate([self._encode([p])[0] for p in text_pieces(texts[0], CHUNK_CHARS)])
            return ids, np.array([len(ids)])
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.prepare:
            texts = [self.prepare(t) for t in texts]
        joined = "".join(texts)
        lengths = np.array([len(t) for t in texts], np.int64)
        cp = code_points(joined)
        begin, end = words(cp, lengths, self.spaces)
        codes, rep = distinct(cp, begin, end)
        known = [joined[a:b] for a, b in zip(begin[rep].tolist(), end[rep].tolist(), strict=True)]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        found = list(map(self.cache.get, known))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            new = [known[i] for i in missing]
            for i, w, ids in zip(missing, new, self.encode_words(new), strict=True):
                found[i] = ids
                if len(w) <= 64:
                    self.cache[w] = ids
        flat = np.frombuffer(b"".join(found), np.int32)
        size = np.array(list(map(len, found)), np.int64) // 4
        ids = gather(flat, np.cumsum(size) - size, size, codes)
        per_word = np.concatenate(([0], np.cumsum(size[codes])))
        of = np.searchsorted(begin, np.concatenate(([0], np.cumsum(lengths))))
        return ids, np.diff(per_word[of])

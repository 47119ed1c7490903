"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Each word has a segment tree whose leaf at byte i holds the rank of the pair that begins there with its live
neighbour, and whose nodes hold the least of their leaves: the root is the leftmost pair of minimum rank. A merge
joins two live neighbours and updates three leaves (the joined, the swallowed and the preceding one), each along one
path to the root. Distinct words of one size class are merged in step, as rows of one array of trees; words beyond
the largest class use a single tree of the same kind.

Defined results: a null text is an empty one (no ids, no bytes); repeated rows are encoded each; an empty table gives
no rows; other columns are not looked at. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks
from .pretokens import CHUNK_CHARS, WordEncoder, gather

#: No pair of neighbours is in the vocabulary.
NONE = np.int64(1) << 60
#: Size classes (bytes) of the words that are merged in step.
CLASSES = (4, 8, 16, 32, 64)


class BytePairs:
    """A vocabulary: ranks of byte strings, which are also their ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], NONE)
        self.values = np.append(np.array(values, np.int64)[order], NONE)
        self.pair = dict(zip(keys, values, strict=True))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array(list(map(len, tokens)), np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_words(self, new: list[str]) -> list[bytes]:
        """Ids of each word as int32 bytes."""
        data = [w.encode("utf-8", "surrogatepass") for w in new]
        out: list[bytes] = [b""] * len(new)
        groups: dict[int, list[int]] = {}
        get = self.ranks.get
        for i, w in enumerate(data):
            whole = get(w)
            if whole is not None:
                out[i] = whole.to_bytes(4, "little")
            elif len(w) > CLASSES[-1]:
                out[i] = np.array(self.merge_long(w), np.int32).tobytes()
            else:
                groups.setdefault(next(c for c in CLASSES if len(w) <= c), []).append(i)
        for width, members in groups.items():
            for a in range(0, len(members), 8192):
                part = members[a : a + 8192]
                for i, ids in zip(part, self.merge_many([data[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def merge_many(self, data: list[bytes], width: int) -> list[bytes]:
        n = len(data)
        size = np.array(list(map(len, data)), np.int64)
        raw = np.zeros((n, width), np.uint8)
        raw[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(data), np.uint8)
        column = np.arange(width)
        token = self.single[raw]
        after = np.where(column + 1 < size[:, None], column + 1, width)  # width: none
        before = np.broadcast_to(column - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE)
        ranks = np.full((n, width), NONE)
        inside = column[:-1] + 1 < size[:, None]
        ranks[:, :-1][inside] = self.rank(token[:, :-1][inside], token[:, 1:][inside])
        tree[:, width:] = np.where(ranks < NONE, ranks * width + column, NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        rows = np.arange(n)
        while True:
            rows = rows[tree[rows, 1] < NONE]
            if not len(rows):
                break
            best = tree[rows, 1]
            i = best % width
            token[rows, i] = best // width
            j = after[rows, i]
            k = after[rows, j]
            after[rows, i] = k
            before[rows[k < width], k[k < width]] = i[k < width]
            token[rows, j] = -1
            self._set(tree, rows, j, np.full(len(rows), NONE), width)
            value = np.full(len(rows), NONE)
            right = np.flatnonzero(k < width)
            value[right] = self._keyed(token[rows[right], i[right]], token[rows[right], k[right]], i[right], width)
            self._set(tree, rows, i, value, width)
            left = np.flatnonzero(before[rows, i] >= 0)
            p = before[rows[left], i[left]]
            self._set(tree, rows[left], p, self._keyed(token[rows[left], p], token[rows[left], i[left]], p, width), width)
        live = (token >= 0) & (column < size[:, None])
        flat = token[live].astype(np.int32).tobytes()
        ends = 4 * np.cumsum(live.sum(axis=1))
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _keyed(self, a: np.ndarray, b: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        rank = self.rank(a, b)
        return np.where(rank < NONE, rank * width + at, NONE)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
        node = at + width
        tree[rows, node] = value
        while width > 1:
            node = node // 2
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            width //= 2

    def merge_long(self, word: bytes) -> list[int]:
        """One word of any length: n merges of log n steps."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        none, pair = int(NONE), self.pair.get
        token = array("q", self.single[np.frombuffer(word, np.uint8)].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        after[n - 1] = -1
        tree = array("q", [none]) * (2 * width)

        def leaf(i: int) -> int:
            k = after[i]
            rank = pair(token[i] << 32 | token[k]) if k >= 0 else None
            return none if rank is None else rank * width + i

        def put(i: int, value: int) -> None:
            node = i + width
            tree[node] = value
            node //= 2
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node //= 2

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        while tree[1] < none:
            i = tree[1] % width
            token[i] = tree[1] // width
            j = after[i]
            k = after[i] = after[j]
            token[j] = -1
            if k >= 0:
                before[k] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [t for t in token if t >= 0]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ``ids``, a slice of them at a time."""
        if len(ids) <= CHUNK_CHARS:
            return gather(self.bytes, self.offset, self.length, ids)
        return np.concatenate([gather(self.bytes, self.offset, self.length, ids[a : a + CHUNK_CHARS]) for a in range(0, len(ids), CHUNK_CHARS)])


@functools.lru_cache(4)
def load(path: str) -> BytePairs:
    """A rank file: base64 of the bytes, a blank and the rank on each line."""
    with open(path, "rb") as file:
        return BytePairs({base64.b64decode(a): int(b) for a, b in map(bytes.split, file)})


@functools.lru_cache(4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(load(path).encode_words, spaces=True)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(texts, CHUNK_CHARS):
                ids, counts = encode(texts[i:j])
                yield pa.record_batch([batch.column(0).slice(i, j - i), _binary(ids.astype("<u4").view(np.uint8), 4 * counts)], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded (binary) of encoded documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = load(path)
        for batch in batches:
            data = batch.column(1).to_pylist()
            i = 0
            while i < len(data):
                j, size = i, 0
                while j < len(data) and (j == i or size + len(data[j]) <= 2 * CHUNK_CHARS):
                    size += len(data[j])
                    j += 1
                counts = np.array(list(map(len, data[i:j])), np.int64) // 4
                ids = np.frombuffer(b"".join(data[i:j]), "<u4").astype(np.int64)
                ends = np.concatenate(([0], np.cumsum(counts)))
                width = np.concatenate(([0], np.cumsum(pairs.length[ids])))[ends]
                yield pa.record_batch([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), _binary(pairs.decode(ids), np.diff(width))], ["doc_id", "ids", "decoded"])
                i = j

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded binary")


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary array of consecutive slices of ``data``."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])

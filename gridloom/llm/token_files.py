"""Token-id output in patched frame-of-reference blocks.

A shard file holds the ids of consecutive documents. The ids are cut into blocks of ``BLOCK`` values; of each block
the minimum is subtracted, the rest is packed at the bit width that covers a chosen percentile of the values, and the
values that need more bits are stored in the block's exception list. An index of block starts allows reading any
range of ids without reading the blocks before it.

Layout (little-endian): magic "PFR1" | block bytes ... | block index: uint64 byte offset of each block, and of the
end | documents: int64 doc_id, uint64 first id (in the shard), uint8 1 if doc_id is null | footer: uint64 number of
ids, uint64 number of documents, uint64 place of the block index, magic.
A block: uint32 minimum, uint8 width, uint16 exceptions, packed bits (first value in the lowest bits), uint16
positions, uint32 values above the minimum.

Documents are range-partitioned by (doc_id, hash of the text) before they are encoded, so shards follow each other in
doc_id order and no single key fills one shard. A shard is written under a temporary name and renamed, and its name
and content depend on its rows alone: a task that runs twice writes the same file.

Defined results: a null text is an empty one (a document that is only its end id); rows with a null doc_id come
first; repeated rows are written each, ties ordered by text; an empty table gives no shards and no rows; other
columns are not looked at.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, new_path, written
from .pretokens import CHUNK_CHARS
from .vocabularies import library_encoder

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 0.95
#: Documents of a shard at most, about, where the number of shards isn't given.
SHARD_DOCS = 100_000
HEAD = struct.Struct("<IBH")
FOOT = struct.Struct("<QQQ4s")


def pack_block(values: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(values.min())
    rest = (values - low).astype(np.uint32)
    bits = np.ceil(np.log2(rest.astype(np.float64) + 1)).astype(np.int64)
    width = int(np.sort(bits)[max(0, int(np.ceil(percentile * len(bits))) - 1)])
    over = np.flatnonzero(bits > width)
    body = b""
    if width:
        plain = rest & np.uint32((1 << width) - 1)
        body = np.packbits((plain[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1), bitorder="little").tobytes()
    return HEAD.pack(low, width, len(over)) + body + over.astype("<u2").tobytes() + rest[over].astype("<u4").tobytes()


def unpack_block(data: bytes, n: int) -> np.ndarray:
    low, width, over = HEAD.unpack_from(data)
    at = HEAD.size
    size = (n * width + 7) // 8
    values = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little")[: n * width].reshape(n, width)
        values = (bits.astype(np.uint32) << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)
    at += size
    places = np.frombuffer(data, "<u2", over, at)
    values[places] = np.frombuffer(data, "<u4", over, at + 2 * over)
    return values + np.uint32(low)


class ShardWriter:
    """Writes one shard to a stream; holds one block of ids and 17 bytes a document."""

    def __init__(self, stream) -> None:  # noqa: ANN001
        self.stream, self.pending, self.held, self.n = stream, [], 0, 0
        self.starts: list[int] = []
        self.docs: list[tuple[int | None, int]] = []
        self.at = stream.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.n))
        self.n += len(ids)
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        values = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        full = len(values) if last else len(values) // BLOCK * BLOCK
        for a in range(0, full, BLOCK):
            self.starts.append(self.at)
            self.at += self.stream.write(pack_block(values[a : min(a + BLOCK, full)]))
        self.pending, self.held = [values[full:]], len(values) - full

    def close(self) -> None:
        self._flush(True)
        tail = np.array([*self.starts, self.at], "<u8").tobytes()
        ids = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        firsts = np.array([s for _, s in self.docs], "<u8").tobytes()
        nulls = np.array([d is None for d, _ in self.docs], np.uint8).tobytes()
        self.stream.write(tail + ids + firsts + nulls + FOOT.pack(self.n, len(self.docs), self.at, MAGIC))


class ShardReader:
    """Reads a shard from a seekable file or buffer."""

    def __init__(self, file) -> None:  # noqa: ANN001
        self.file = file
        file.seek(0, 2)
        size = file.tell()
        self.n, m, index, magic = FOOT.unpack(self._read(size - FOOT.size, FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        blocks = (self.n + BLOCK - 1) // BLOCK
        tail = self._read(index, size - FOOT.size - index)
        self.starts = np.frombuffer(tail, "<u8", blocks + 1)
        at = 8 * (blocks + 1)
        self.doc_ids = np.frombuffer(tail, "<i8", m, at)
        self.firsts = np.append(np.frombuffer(tail, "<u8", m, at + 8 * m).astype(np.int64), self.n)
        self.nulls = np.frombuffer(tail, np.uint8, m, at + 16 * m).astype(bool)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def ids(self, a: int, b: int) -> np.ndarray:
        """Ids a .. b of the shard, from the blocks that hold them only."""
        if a >= b:
            return np.zeros(0, np.uint32)
        first, last = a // BLOCK, (b - 1) // BLOCK
        base = int(self.starts[first])
        data = self._read(base, int(self.starts[last + 1]) - base)
        parts = []
        for k in range(first, last + 1):
            at = int(self.starts[k]) - base
            parts.append(unpack_block(data[at : int(self.starts[k + 1]) - base], min(BLOCK, self.n - k * BLOCK)))
        return np.concatenate(parts)[a - first * BLOCK : b - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.firsts[i]), int(self.firsts[i + 1]))


def _place(uri: str):  # noqa: ANN202
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int, shards: int | None = None) -> DataFrame:
    """Encodes ``docs`` and writes them as shards in ``folder``; returns shard, n_docs, n_ids, path (a written table)."""
    n = shards or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // SHARD_DOCS)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("_tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(n, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(vocabulary)
        writer = stream = None
        shard = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                shard = batch.column(2)[0].as_py()
                fs, base = _place(folder)
                fs.create_dir(base, recursive=True)
                import uuid

                part = f"{base}/.{shard:06d}-{uuid.uuid4().hex}"
                stream = fs.open_output_stream(part)
                writer = ShardWriter(stream)
            ids_of, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in chunks(texts, CHUNK_CHARS):
                ids, counts = encode(texts[i:j])
                at = 0
                for doc_id, m in zip(ids_of[i:j], counts.tolist(), strict=True):
                    writer.add(doc_id, np.append(ids[at : at + m], np.int32(end_id)).astype(np.uint32))
                    at += m
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(part, f"{base}/{shard:06d}.pfr")
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([len(writer.docs)], pa.int64()), pa.array([writer.n], pa.int64()), pa.array([f"{folder}/{shard:06d}.pfr"])], ["shard", "n_docs", "n_ids", "path"])

    return written(ordered.mapInArrow(write, "shard int, n_docs long, n_ids long, path string"), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it, over all shards), ids (binary) of every document in the shards."""
    from pyspark.sql import Window

    # one row per shard: the only global state, and as small as a list of files
    first = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = shards.select("path", first.alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, place = _place(path)
                with fs.open_input_file(place) as file:
                    reader = ShardReader(file)
                    a, m = 0, len(reader.doc_ids)
                    while a < m:  # about a million ids at a time
                        b = max(a + 1, int(np.searchsorted(reader.firsts, reader.firsts[a] + 1_000_000, side="right")) - 1)
                        ids = reader.ids(int(reader.firsts[a]), int(reader.firsts[b])).astype("<u4").tobytes()
                        at = ((reader.firsts[a : b + 1] - reader.firsts[a]) * 4).astype(np.int64)
                        data = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(ids)]).cast(pa.binary())
                        yield pa.record_batch([pa.array(reader.doc_ids[a:b], pa.int64(), mask=reader.nulls[a:b]), pa.array(reader.firsts[a:b] + start, pa.int64()), data], ["doc_id", "start", "ids"])
                        a = b

    parts = max(1, min(int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards.count()))
    return listed.repartition(parts, "path").mapInArrow(read, "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, shards: int | None = None) -> DataFrame:
    """Writes ``docs`` as token shards and reads them back."""
    return read_shards(write_shards(docs, folder or new_path(docs.sparkSession, "tokens"), vocabulary, end_id, shards))

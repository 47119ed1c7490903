"""Best-fit packing of tokenised documents into sequences under several capacities.

Vector best-fit: every open sequence has a residual vector (tokens, documents, attention cost); pieces are placed in
descending length, each into the feasible sequence with the best score, which is either the weighted dot-product of
the piece's demand with the residual or the (negative) norm of the residual that would remain.

The plan is made for classes of equal pieces, not for single ones: pieces of one length are alike, so the driver only
needs the histogram of lengths (at most ``capacity`` counts, whatever the corpus) and handles groups of alike
sequences at once. Each step of the plan says "pieces of this length with ranks lo .. hi go, k to a sequence, into
these sequences"; the executors then place each piece by its rank among the pieces of its length. No task sees more
than a salted slice of one length, and nothing about single documents reaches the driver.

Defined results: a null text is an empty one (a document that is only its end id); a document longer than the
capacity is cut into full pieces behind a first one that may be shorter; repeated rows are packed each; rows with a
null doc_id are packed like others; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, written
from .pretokens import CHUNK_CHARS
from .vocabularies import library_encoder


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence. ``attention`` bounds the sum of squared piece lengths (cost under block-diagonal attention)."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.1)
    score: str = "norm"  # or "dot"


def plan(histogram: dict[int, int], cap: Capacity) -> np.ndarray:
    """Steps (length, lo, hi, each, sequence, offset, document) of a vector best-fit decreasing.

    Pieces of ``length`` with rank in [lo, hi) go to sequences ``sequence + (rank - lo) // each`` at token
    ``offset + (rank - lo) % each * length``. Groups of alike sequences are kept as ranges of sequence numbers.
    """
    limit = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights) / limit**2
    residual = np.empty((0, 3))  # of each open group
    first = np.empty(0, np.int64)
    many = np.empty(0, np.int64)
    steps: list[tuple[int, ...]] = []
    used = 0
    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        demand = np.array([length, 1.0, float(length) ** 2])
        if (demand > limit).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        lo, left = 0, int(histogram[length])
        alive = (residual[:, 0] > 0) & (residual[:, 1] > 0) & (residual[:, 2] > 0)
        residual, first, many = residual[alive], first[alive], many[alive]
        while left:
            fits = np.flatnonzero((residual >= demand).all(axis=1))
            if len(fits):
                room = residual[fits]
                score = (room * demand * weights).sum(axis=1) if cap.score == "dot" else -((room - demand) ** 2 * weights).sum(axis=1)
                group = int(fits[score.argmax()])
            else:  # open as many sequences as this class fills, and at least one
                each = int((limit // demand).min())
                residual = np.vstack((residual, limit))
                first = np.append(first, used)
                many = np.append(many, max(1, left // each))
                used += int(many[-1])
                group = len(first) - 1
            each = int((residual[group] // demand).min())
            bins = min(int(many[group]), left // each)
            if not bins:
                each, bins = left, 1
            taken = bins * each
            steps.append((length, lo, lo + taken, each, int(first[group]), int(limit[0] - residual[group, 0])))
            lo, left = lo + taken, left - taken
            after = residual[group] - each * demand
            if bins < many[group]:
                residual = np.vstack((residual, after))
                first = np.append(first, first[group])
                many[group] -= bins
                first[group] += bins
                many = np.append(many, bins)
            else:
                residual[group] = after
    return np.array(steps, np.int64).reshape(-1, 6)


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit) of every document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = library_encoder(vocabulary)
        for batch in batches:
            ids_of, texts = batch.column(0), [t or "" for t in batch.column(1).to_pylist()]
            for i, j in chunks(texts, CHUNK_CHARS):
                ids, counts = encode(texts[i:j])
                row, piece, start, length, data = [], [], [], [], []
                at = 0
                for k, n in enumerate(counts.tolist()):
                    own = np.append(ids[at : at + n], np.int32(end_id)).astype("<u4").tobytes()
                    at += n
                    a, number, size = 0, 0, (n + 1) % capacity or min(n + 1, capacity)
                    while a <= n:
                        row.append(i + k)
                        piece.append(number)
                        start.append(a)
                        length.append(size)
                        data.append(own[4 * a : 4 * (a + size)])
                        a, number, size = a + size, number + 1, capacity
                yield pa.record_batch([ids_of.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(data, pa.binary())], ["doc_id", "piece", "start", "length", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids binary")


def pack(items: DataFrame, cap: Capacity | None = None) -> DataFrame:
    """Adds sequence_id and offset to ``items`` (doc_id, piece, length and any payload).

    Shuffles the items once by (length, salt): the salt is a hash of the row's number in the written table, and there
    are enough salts that a slice of one length stays small however many pieces share it, of one doc_id or of many.
    """
    cap = cap or Capacity()
    items = written(items.withColumn("_item", F.monotonically_increasing_id()), "pieces")
    spark = items.sparkSession
    salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), items.count() // 100_000)
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("_item"), F.lit(salts)).cast("int"))
    counts = written(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # at most cap.tokens rows
    steps = plan(histogram, cap)
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("length", "_salt", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_item"))
    ranked = salted.withColumn("_row", place).join(before.hint("merge"), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    return _placed(ranked.drop("_salt", "_before", "_row", "_item"), steps)


def _placed(ranked: DataFrame, steps: np.ndarray) -> DataFrame:
    """Looks each piece's step up by (length, rank). The steps' number depends on the set of lengths alone; they go along with the tasks."""
    order = np.lexsort((steps[:, 1], steps[:, 0]))
    steps = steps[order]
    shared = ranked.sparkSession.sparkContext.broadcast(steps)

    def look_up(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        s = shared.value
        # lengths and ranks as one sortable key
        width = int(s[:, 2].max()) + 1
        at = np.searchsorted(s[:, 0] * width + s[:, 1], length.to_numpy() * width + rank.to_numpy(), side="right") - 1
        step, within = s[at], rank.to_numpy() - s[at, 1]
        return pd.DataFrame({"sequence_id": step[:, 4] + within // step[:, 3], "offset": step[:, 5] + within % step[:, 3] * step[:, 0]})

    found = F.pandas_udf(look_up, "sequence_id long, offset long")
    return ranked.withColumn("_at", found(F.col("length"), F.col("_rank"))).withColumns({"sequence_id": F.col("_at.sequence_id"), "offset": F.col("_at.offset")}).drop("_at", "_rank")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, cap: Capacity | None = None, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with sequence_id and offset, and ids_crc32 or (keep_ids) the ids themselves."""
    cap = cap or Capacity()
    cut = pieces(docs, vocabulary, end_id, cap.tokens)
    if not keep_ids:
        cut = cut.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
    return pack(cut, cap)


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences: one row per sequence_id with its concatenated ids (binary) and the doc_ids in it."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"]))
    return rows.select("sequence_id", joined.alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())

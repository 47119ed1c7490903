"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints come from word shingles. Equal fingerprints are one class from the start, so only distinct ones are
compared. Two fingerprints within ``radius`` bits agree in at least ``blocks - radius`` of ``blocks`` bit blocks, so
comparing those that agree in some choice of blocks loses no link. A bucket is named by its mask (the bits that agree)
and their value. Buckets with more than ``HOT`` members are split by agreement in parts of their free bits before they
are dealt to tasks, and again inside a task beyond ``DIRECT``: of ``radius + 1`` parts one agrees, so that loses no
link either. Nothing else depends on a size.

Within a bucket the comparison is bit-sliced: bit plane j of 64 fingerprints is one machine word, and the distances of
64 fingerprints from a pivot grow together in vertical counters. Eight planes at a time go through a tree of carry-save
adders (three words in, sum and carry out); then the lanes beyond the radius are struck out, and a word is abandoned
as soon as all its lanes are.

A bucket emits a spanning forest of its links, never all pairs; components come from star contraction over written
tables. Nothing of this reaches the driver.

Defined results: a null text is an empty one; texts without a word have fingerprint zero and are linked like any
other; repeated rows are rows of their own with equal results; a component's id is its smallest non-null doc_id; an
empty table gives no rows; very long texts are hashed piece by piece; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, remove, written

#: Fingerprints compared directly in one bucket of a task; larger ones are split first.
DIRECT = 2048
#: Members of a bucket that go to one task; larger ones are split over tasks first.
HOT = 100_000
#: Pairs of a pivot and a word that are compared at a time.
ITEMS = 32_768
#: Bytes of a text whose shingles are made at a time.
PIECE = 1_000_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: _BELOW[k]: the lowest k lanes of a word.
_BELOW = np.array([(1 << k) - 1 for k in range(65)], np.uint64)


def shingle_hashes(text: str, size: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of every shingle of ``size`` words, repeats included, in pieces; ASCII capitals are lower-cased.

    A text of fewer words is one shingle; one without a word has none.
    """
    import xxhash

    digest = xxhash.xxh64_intdigest
    data = text.encode("utf-8", "surrogatepass").lower()
    carried: list[bytes] = []
    a, some = 0, False
    while a < len(data):
        b = min(a + PIECE, len(data))
        while b < len(data) and data[b] not in b" \t\n\v\f\r":
            b += 1
        words = carried + data[a:b].split()
        a = b
        if len(words) < size:
            carried = words
            continue
        some = True
        joined = b" ".join(words)
        ends = np.cumsum(np.array(list(map(len, words)), np.int64) + 1) - 1
        begins = np.concatenate(([0], ends[:-1] + 1))
        yield np.array([digest(joined[p:q], 42) for p, q in zip(begins[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)], np.uint64)
        carried = words[len(words) - size + 1 :]
    if carried and not some:
        yield np.array([digest(b" ".join(carried), 42)], np.uint64)


def fingerprint(text: str, size: int = 3) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``size`` words; 0 without a word."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, size):
        n += len(hashes)
        for a in range(0, len(hashes), 65536):
            total += np.unpackbits(hashes[a : a + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def carry_save(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three words, lane by lane."""
    half = a ^ b
    return half ^ c, (a & b) | (half & c)


def _eight(d: np.ndarray, ones: np.ndarray, twos: np.ndarray, fours: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Adds eight planes to the lowest three digits of vertical counters; returns these and the carry (eights)."""
    ones, a = carry_save(ones, d[0], d[1])
    ones, b = carry_save(ones, d[2], d[3])
    twos, e = carry_save(twos, a, b)
    ones, a = carry_save(ones, d[4], d[5])
    ones, b = carry_save(ones, d[6], d[7])
    twos, f = carry_save(twos, a, b)
    fours, carry = carry_save(fours, e, f)
    return ones, twos, fours, carry


def _at_least(count: list[np.ndarray], limit: np.ndarray) -> np.ndarray:
    """Lanes whose counter is ``limit`` (one for each word) or more."""
    more, same = np.zeros_like(count[0]), np.full_like(count[0], ONES)
    for d in reversed(range(len(count))):
        wanted = np.uint64(0) - (limit >> np.uint64(d) & np.uint64(1))
        more |= same & count[d] & ~wanted
        same &= ~(count[d] ^ wanted)
    return more | same


def sliced(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64 k, words) of fingerprints (n, k) of k words each; lanes beyond n are zero."""
    n, k = fps.shape
    padded = np.zeros((-(-n // 64) * 64, k), np.uint64)
    padded[:n] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(len(padded), 8 * k), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view(np.uint64)


def near_pairs(fps: np.ndarray, ends: np.ndarray, limits: np.ndarray, order: list[int], tally: dict[str, int] | None = None, sooner: dict[int, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs p < q < ends[p] whose fingerprints (n, k) differ in fewer than ``limits[p]`` of the bits ``order``.

    Items are pairs of a pivot p and a word with lanes q. Each is compared eight planes at a time; lanes beyond the
    limit are struck out, and items without a lane left are abandoned. ``tally`` counts items and compared blocks.
    ``sooner``: further limits, for the first so many bits (multiples of eight).
    """
    stages = sorted((sooner or {}).items()) + [(len(order), limits)]
    n = len(fps)
    planes = sliced(fps)
    pivots = np.flatnonzero(ends > np.arange(n) + 1)
    first = (pivots + 1) // 64
    upto = np.cumsum((ends[pivots] - 1) // 64 - first + 1)
    high = max(0, int(limits.max(initial=0)).bit_length() - 3)
    for a in range(0, int(upto[-1]) if len(upto) else 0, ITEMS):
        flat = np.arange(a, min(a + ITEMS, int(upto[-1])))
        of = np.searchsorted(upto, flat, side="right")
        pivot = pivots[of]
        word = first[of] + flat - np.where(of > 0, upto[of - 1], 0)
        live = _BELOW[np.minimum(ends[pivot] - 64 * word, 64)] & ~_BELOW[np.clip(pivot + 1 - 64 * word, 0, 64)]
        stage = 0
        limit = stages[0][1][pivot].astype(np.uint64)
        ones, twos, fours = (np.zeros(len(flat), np.uint64) for _ in range(3))
        upper = [np.zeros(len(flat), np.uint64) for _ in range(high)]
        if tally is not None:
            tally["items"] = tally.get("items", 0) + len(flat)
        for s in range(0, len(order), 8):
            if s >= stages[stage][0]:
                stage += 1
                limit = stages[stage][1][pivot].astype(np.uint64)
            if tally is not None:
                tally["blocks"] = tally.get("blocks", 0) + len(pivot)
            d = np.zeros((8, len(pivot)), np.uint64)
            for k, bit in enumerate(order[s : s + 8]):
                own = fps[pivot, bit >> 6] >> np.uint64(bit & 63) & np.uint64(1)
                d[k] = planes[bit, word] ^ (np.uint64(0) - own)
            ones, twos, fours, carry = _eight(d, ones, twos, fours)
            for k in range(high):
                upper[k], carry = upper[k] ^ carry, upper[k] & carry
            live = live & ~(carry | _at_least([ones, twos, fours, *upper], limit))
            left = np.flatnonzero(live)
            if len(left) <= 0.8 * len(live):
                pivot, word, live, limit, ones, twos, fours = (x[left] for x in (pivot, word, live, limit, ones, twos, fours))
                upper = [x[left] for x in upper]
            if not len(left):
                break
        k, lane = np.nonzero(np.unpackbits(live.reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")) if len(live) else (np.zeros(0, np.int64),) * 2
        if len(k):
            yield pivot[k], 64 * word[k] + lane


class Forest:
    """Union-find over 0 .. n-1 with the least member as root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            root = self.roots()
            x, y = root[a], root[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def parts_of(free: list[int], radius: int) -> list[list[int]]:
    """``radius + 1`` parts of the free bits; fingerprints within the radius agree in one of them."""
    return [free[k :: radius + 1] for k in range(radius + 1)]


def link(fps: np.ndarray, index: np.ndarray, free: list[int], radius: int, forest: Forest) -> None:
    """Joins all pairs of distinct ``fps`` within ``radius`` that differ in ``free`` bits only."""
    if len(fps) < 2:
        return
    if len(fps) <= DIRECT or len(free) <= radius + 1:
        for p, q in near_pairs(fps.reshape(-1, 1), np.full(len(fps), len(fps)), np.full(len(fps), radius + 1), free):
            forest.join(index[p], index[q])
        return
    for own in parts_of(free, radius):
        mask = np.uint64(sum(1 << j for j in own))
        order = np.argsort(fps & mask, kind="stable")
        cuts = np.flatnonzero(np.diff((fps & mask)[order])) + 1
        rest = [j for j in free if j not in set(own)]
        for run in np.split(order, cuts):
            link(fps[run], index[run], rest, radius, forest)


def link_many(fps: np.ndarray, starts: np.ndarray, masks: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within buckets ``fps[starts[k] : starts[k + 1]]``; returns (member, root) as a spanning forest.

    ``masks``: the agreeing bits of each row's bucket. Small buckets lie side by side in the words.
    """
    forest = Forest(len(fps))
    size = np.diff(starts)
    small = np.repeat(size <= DIRECT, size)
    for mask in np.unique(masks).tolist():
        free = [j for j in range(64) if not mask >> j & 1]
        rows = np.flatnonzero(small & (masks == mask))
        if len(rows):
            bucket = np.repeat(np.arange(len(size)), size)[rows]
            ends = np.searchsorted(bucket, bucket, side="right")
            for p, q in near_pairs(fps[rows].reshape(-1, 1), ends, np.full(len(rows), radius + 1), free):
                forest.join(rows[p], rows[q])
    for k in np.flatnonzero(size > DIRECT):
        a, b = starts[k], starts[k + 1]
        link(fps[a:b], np.arange(a, b), [j for j in range(64) if not int(masks[a]) >> j & 1], radius, forest)
    root = forest.roots()
    member = np.flatnonzero(root != np.arange(len(fps)))
    return member, root[member]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def buckets(distinct: DataFrame, radius: int = 2, blocks: int = 4, hot: int | None = None) -> DataFrame:
    """fp, mask, value: each fingerprint in all its buckets, none of which has more than ``hot`` members.

    (A bucket whose free bits are used up stays as it is; it has at most 2 to the power of ``radius + 1`` members.)
    """
    edges = [64 * k // blocks for k in range(blocks + 1)]
    parts = [range(edges[k], edges[k + 1]) for k in range(blocks)]
    masks = [sum(1 << j for k in kept for j in parts[k]) for kept in combinations(range(blocks), blocks - radius)]
    keyed = distinct.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    keyed = keyed.withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    done = None
    while True:
        sizes = keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > (HOT if hot is None else hot))
        splits = {m: [m | sum(1 << j for j in own) for own in parts_of(free, radius)] for m in masks for free in [[j for j in range(64) if not m >> j & 1]] if len(free) > radius + 1}
        heavy = written(sizes.select("mask", "value"), "heavy") if splits else None
        if heavy is None or heavy.isEmpty():
            return keyed if done is None else done.unionByName(keyed)
        rest = keyed.join(heavy, ["mask", "value"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        finer = F.create_map(*[x for m, into in splits.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(i)) for i in into]))])
        hit = keyed.join(heavy, ["mask", "value"], "left_semi")
        keyed = hit.select("fp", F.explode(finer[F.col("mask")]).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = sorted({i for into in splits.values() for i in into})


def by_bucket(batches: Iterator[pa.RecordBatch], keys: list[int], least: int = 1) -> Iterator[tuple[list[pa.Array], np.ndarray]]:
    """Whole buckets of rows sorted by the (long) columns ``keys``, about ``least`` rows at a time: columns and bucket starts."""
    held: list[pa.RecordBatch] = []
    n = goal = 0

    def cut(last: bool):  # noqa: ANN202
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        columns = [np.asarray(table.column(k)) for k in keys]
        new = np.flatnonzero(np.any([np.diff(c) != 0 for c in columns], axis=0)) + 1
        starts = np.concatenate(([0], new, [table.num_rows])).astype(np.int64)
        if not last:  # the last bucket may go on in the next batch
            held.extend(table.slice(starts[-2]).to_batches())
            starts = starts[:-1]
        if len(starts) > 1:
            whole = table.slice(0, starts[-1]).combine_chunks()
            yield [whole.column(k).chunk(0) for k in range(whole.num_columns)], starts

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= max(least, goal):
                yield from cut(False)
                n = sum(b.num_rows for b in held)
                goal = 2 * n  # a long bucket is not looked at again and again
    if held:
        yield from cut(True)


def links(distinct: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """a, b: a spanning forest, for each bucket, of the links between distinct fingerprints (column fp)."""
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = buckets(distinct, radius, blocks).repartition(n, "mask", "value").sortWithinPartitions("mask", "value", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (mask, _, fp), starts in by_bucket(batches, [0, 1]):
            fp = np.asarray(fp)
            a, b = link_many(fp.view(np.uint64), starts, np.asarray(mask).view(np.uint64), radius)
            if len(a):
                yield pa.record_batch([pa.array(fp[a]), pa.array(fp[b])], ["a", "b"])

    return dealt.select("mask", "value", "fp").mapInArrow(run, "a long, b long")


def _forests(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """A spanning forest of each ``most`` edges that a task reads."""
    held, n = [], 0

    def solved() -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        nodes, index = np.unique(np.concatenate((a, b)), return_inverse=True)
        forest = Forest(len(nodes))
        forest.join(index[: len(a)], index[len(a) :])
        root = forest.roots()
        member = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.record_batch([pa.array(nodes[member]), pa.array(nodes[root[member]])], ["a", "b"])

    for batch in batches:
        if batch.num_rows:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            n += batch.num_rows
            if n >= most:
                yield solved()
                held, n = [], 0
    if held:
        yield solved()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of all nodes in ``edges`` (a, b): large-star and small-star steps.

    Each task first replaces the edges it has by a spanning forest of them, which has the same components.
    """
    def joined(pairs: DataFrame) -> DataFrame:
        return written(pairs.select("a", "b").mapInArrow(_forests, "a long, b long"), "edges")

    current, seen = joined(edges), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = state
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("uses"))
        large = written(_star(both, written(least, "least"), F.col("b") > F.col("a"), 2 * state[0]), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("uses")), "least")
        following = joined(_star(large, least, F.lit(True), 2 * state[0]))
        remove(current)
        remove(large)
        current = following


def _star(edges: DataFrame, least: DataFrame, keep, total: int) -> DataFrame:  # noqa: ANN001
    """Each neighbour b of a (where ``keep``), and a itself, get an edge to the least of a's neighbourhood."""
    joined = attach(edges, least, ["a"], "uses", total)
    moved = joined.filter(keep).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def near_groups(docs: DataFrame, radius: int = 2, blocks: int = 4, size: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, component_id (the smallest doc_id linked to it, itself included)."""
    rows = written(fingerprints(docs, size), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("uses")), "distinct")
    roots = components(links(distinct.select("fp"), radius, blocks))
    rooted = written(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "rep", "uses", F.coalesce("root", "fp").alias("root")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("members")), "least")
    named = written(attach(rooted, least, ["root"], "members", max(1, rooted.count())).select("fp", "uses", "component_id"), "named")
    return attach(rows, named, ["fp"], "uses", max(1, rows.count())).select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, radius: int = 2, blocks: int = 4, size: int = 3) -> DataFrame:
    """One row of each component of ``docs``, with all its columns: that with the component's id as doc_id.

    Rows without a doc_id are kept. Of rows that repeat that doc_id, one stays.
    """
    groups = near_groups(docs, radius, blocks, size)
    kept = written(groups.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct(), "kept")
    known = docs.filter(F.col("doc_id").isNotNull())
    out = known.join(kept, known["doc_id"] == kept["doc_id"], "left_semi")
    if not known.groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.unionByName(docs.filter(F.col("doc_id").isNull()))


def hex_fingerprint(fp):  # noqa: ANN001, ANN201
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))

"""Near copies by SimHash candidates and the exact Jaccard similarity of word shingles.

Two texts are linked when the sets of their shingles of ``size`` words have a similarity of ``at_least`` / 100 or more
(parameters are made for 80 and more). At that similarity about 15 % of a SimHash's bits differ, too many to look up
by blocks of equal bits, so texts first meet by the key of one of ``BANDS`` bands of ``ROWS`` minima: a pair at 0.8
shares none with a probability of (1 - 0.8^5)^32 = 3e-6, at 0.9 of 1e-12. Those that meet are compared by SimHashes of
``WORDS`` * 64 bits over their sets, bit-sliced as in :mod:`.simhash`; the radius is 4.5 standard deviations beyond the
share of bits that differ at 0.8 (missed: 4e-6 for each of the four ``CHECKS``). What is within the radius is verified by the two sets themselves, so
a link is never wrong.

Each bucket first verifies its members against the least one only; those found in one component are not compared
again, and the pairs of a bucket that are still apart are compared in a second step. So a large group of near copies
costs one comparison per member and bucket. A pair that meets in several buckets is emitted by the first. Buckets of
more than ``HOT`` rows in that step are split by a second and a third band before they are dealt to tasks (a pair at
0.8 shares fewer than two bands with a probability of 5e-5, fewer than three of 4e-4).

Defined results: a null text is an empty one; words are cut and lower-cased as for SimHash; a text of fewer than
``size`` words is one shingle, and texts without a word are all alike; one row of each component stays, that with the
smallest doc_id (a null one comes last) and then the smallest SHA-256 of its text; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, written
from .exact_dedup import keep_rows
from .simhash import by_bucket, carry_save, components, near_pairs, shingle_hashes

BANDS, ROWS = 32, 5
_RANDOM = np.random.default_rng(42).integers(0, 1 << 64, (3, BANDS * ROWS), np.uint64, endpoint=False)
_TIMES, _PLUS, _MIX = _RANDOM[0] | np.uint64(1), _RANDOM[1], _RANDOM[2] | np.uint64(1)
#: Words of a SimHash, and the random numbers that make so many hashes of one.
WORDS = 64
#: Bits after which texts that differ too much are left, besides the last.
CHECKS = (512, 1024, 2048)
_SPREAD = np.random.default_rng(43).integers(0, 1 << 64, (3, WORDS), np.uint64, endpoint=False) | np.uint64(1)
#: Shingles whose images are made at a time.
STEP = 2048
#: Rows of a bucket that one task compares.
HOT = 20_000


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``size`` words (that of the empty text, if it has no word)."""
    import xxhash

    found = [np.unique(h) for h in shingle_hashes(text, size)]
    return np.unique(np.concatenate(found)) if found else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def band_keys(found: np.ndarray) -> np.ndarray:
    """The key of each band of minima over the set ``found``."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(found), STEP):
        image = found[a : a + STEP, None] * _TIMES
        image += _PLUS
        np.minimum(least, image.min(axis=0), out=least)
    mixed = (least ^ (least >> np.uint64(29))) * _MIX
    return (mixed ^ (mixed >> np.uint64(32))).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64)


def _add(digits: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One word for each digit from many words of equal weight: carry-save adders over whole layers of words."""
    out, k = [], 0
    while k < len(digits):
        layer = np.concatenate(digits[k]) if digits[k] else np.zeros((0, WORDS), np.uint64)
        if k + 1 == len(digits) and len(layer) > 1:
            digits.append([])
        while len(layer) > 2:
            n = len(layer) // 3
            total, carry = carry_save(layer[:n], layer[n : 2 * n], layer[2 * n : 3 * n])
            digits[k + 1].append(carry)
            layer = np.concatenate((total, layer[3 * n :]))
        if len(layer) == 2:
            digits[k + 1].append(layer[:1] & layer[1:])
            layer = layer[:1] ^ layer[1:]
        out.append(layer[0] if len(layer) else np.zeros(WORDS, np.uint64))
        k += 1
    return out


def wide_fingerprint(found: np.ndarray) -> np.ndarray:
    """SimHash of ``WORDS`` words of the set ``found``: bits set in over half of its members."""
    layers: list[list[np.ndarray]] = [[]]
    for a in range(0, len(found), STEP):
        x = found[a : a + STEP, None] * _SPREAD[0]
        x = (x ^ (x >> np.uint64(29))) * _SPREAD[1]
        x = (x ^ (x >> np.uint64(32))) * _SPREAD[2]
        part = _add([[x ^ (x >> np.uint64(29))]])
        layers += [[] for _ in range(len(part) - len(layers))]
        for k, word in enumerate(part):
            layers[k].append(word[None])
    count, limit = _add(layers), len(found) // 2 + 1
    more, same = np.zeros(WORDS, np.uint64), np.full(WORDS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in reversed(range(max(len(count), limit.bit_length()))):
        digit = count[k] if k < len(count) else np.zeros(WORDS, np.uint64)
        if limit >> k & 1:
            same = same & digit
        else:
            more, same = more | same & digit, same & ~digit
    return more | same


def limits(n: np.ndarray, bits: int = 64 * WORDS) -> np.ndarray:
    """A number of differing bits reached with a probability below 4e-6 at a similarity of 0.8, for sets of ``n`` members.

    A bit differs with a probability of at most 0.153; sets of under 16 have ties more often and reach 0.19.
    """
    share = np.where(n < 16, 0.19, 0.153)
    return np.ceil(bits * share + 4.5 * np.sqrt(bits * share * (1 - share))).astype(np.int64)


def similar(a: np.ndarray, b: np.ndarray, at_least: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= at_least * (len(a) + len(b) - common)


def _tagged(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("text_sha256"))


def _nodes(docs: DataFrame, size: int) -> DataFrame:
    """One row per distinct text: node, text_sha256, rep (its smallest doc_id), n (shingles), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(1)]
            keys = [band_keys(s).view(np.int64) for s in sets]
            flat = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), flat], ["doc_id", "text_sha256", "n", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = _tagged(docs).mapInArrow(run, f"doc_id {kind}, text_sha256 string, n long, keys array<long>")
    each = written(signed, "signatures").groupBy("text_sha256").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("keys").alias("keys"))
    return written(each.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, found (its shingle hashes as bytes), fp (its wide fingerprint) of the ``wanted`` nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), size) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([wide_fingerprint(x).tobytes() for x in sets], pa.binary())], ["node", "found", "fp"])

    tagged = _tagged(docs).withColumnRenamed("doc_id", "rep")
    one = tagged.join(wanted, (tagged["text_sha256"] == wanted["text_sha256"]) & tagged["rep"].eqNullSafe(wanted["rep"])).select("node", "text")
    made = one.mapInArrow(run, "node long, found binary, fp binary")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        made = made.dropDuplicates(["node"])  # rows that repeat both doc_id and text
    return written(made, "sets")


def _verified(pairs: DataFrame, sets: DataFrame, at_least: int) -> DataFrame:
    """The ``pairs`` (a, b; a may be in many) whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), at_least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    pairs = written(pairs.distinct(), "pairs")
    uses = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("uses"))
    left = written(sets.withColumnRenamed("node", "a").join(uses, "a").withColumnRenamed("found", "x"), "left")
    right = sets.select(F.col("node").alias("b"), F.col("found").alias("y"))
    both = attach(pairs, left, ["a"], "uses", max(1, pairs.count())).join(right, "b")
    return written(both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), "links")


def _apart(named: DataFrame, nodes: DataFrame, sets: DataFrame, at_least: int, hot: int) -> DataFrame:
    """a, b: pairs of one bucket, in different parts, whose fingerprints are within the radius; each pair once."""
    spark = named.sparkSession
    rows = named.select("node", "part", F.col("key").alias("bucket"), F.lit(0).cast("long").alias("depth")).join(nodes.select("node", "n", "keys"), "node").join(sets.select("node", "fp"), "node")
    rows, done = written(rows, "members"), None
    for depth in (1, 2):  # split what is too large for a task by a further band
        sizes = rows.groupBy("bucket", "depth").count().filter(F.col("count") > hot).select("bucket", "depth")
        heavy = written(sizes, "heavy")
        if heavy.isEmpty():
            break
        rest = rows.join(heavy, ["bucket", "depth"], "left_anti")
        done = rest if done is None else done.unionByName(rest)
        further = rows.join(heavy, ["bucket", "depth"], "left_semi").withColumn("band", F.explode("keys"))
        rows = written(further.withColumn("bucket", F.xxhash64("bucket", "band")).withColumn("depth", F.lit(depth).cast("long")).drop("band"), "split")
    rows = rows if done is None else done.unionByName(rows)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("depth", "bucket", "node", "part", "n", "fp", "keys").repartition(parts, "depth", "bucket").sortWithinPartitions("depth", "bucket", "node")

    def names(keys: np.ndarray, bucket: np.ndarray, p: np.ndarray, q: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Pairs for which this bucket is the first they share, by the order of bands (deeper buckets: each comes from its own first)."""
        same = keys[p] == keys[q]
        first = keys[p, same.argmax(axis=1)]
        return (depth[p] > 0) | (first == bucket[p])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (depth, bucket, node, part, n, fp, keys), starts in by_bucket(batches, [0, 1], 8192):
            depth, bucket, node, part, n = (np.asarray(x) for x in (depth, bucket, node, part, n))
            prints = np.frombuffer(b"".join(fp.to_pylist()), np.uint64).reshape(len(node), WORDS)
            bands = np.asarray(keys.flatten()).reshape(len(node), BANDS)
            ends = np.repeat(starts[1:], np.diff(starts))
            for p, q in near_pairs(prints, ends, limits(n), list(range(64 * WORDS)), sooner={b: limits(n, b) for b in CHECKS}):
                fit = (part[p] != part[q]) & (100 * np.minimum(n[p], n[q]) >= at_least * np.maximum(n[p], n[q]))
                p, q = p[fit], q[fit]
                mine = names(bands, bucket, p, q, depth)
                if mine.any():
                    p, q = p[mine], q[mine]
                    yield pa.record_batch([pa.array(np.minimum(node[p], node[q])), pa.array(np.maximum(node[p], node[q]))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, size: int = 5, at_least: int = 80, hot: int | None = None) -> DataFrame:
    """One row per distinct text of ``docs``: text_sha256, rep (its smallest doc_id), root (its component)."""
    nodes = _nodes(docs, size)
    members = nodes.select("node", "n", F.explode("keys").alias("key"))
    least = written(members.groupBy("key").agg(F.min(F.struct("node", "n")).alias("first"), F.count(F.lit(1)).alias("uses")).filter("uses > 1"), "buckets")
    shared = written(attach(members, least, ["key"], "uses", max(1, BANDS * nodes.count())).filter("uses is not null").select("key", "node", "n", F.col("first.node").alias("pivot"), F.col("first.n").alias("pivot_n"), "uses"), "shared")
    sets = _sets(docs, written(shared.select("node").distinct().join(nodes.select("node", "text_sha256", "rep"), "node"), "wanted"), size)
    stars = shared.filter(F.col("node") != F.col("pivot")).filter(_sizes("n", "pivot_n", at_least))
    links = _verified(stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")), sets, at_least)
    roots = written(components(links), "roots")
    # buckets whose members are in several components; a root is the least of its component, so no hot key is large
    parted = written(shared.join(roots, "node", "left").select("key", "node", "uses", F.coalesce("root", "node").alias("part")), "parted")
    open_ = parted.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.first("uses").alias("uses")).filter("low < high")
    named = attach(parted.drop("uses"), written(open_.select("key", "low", "uses"), "open"), ["key"], "uses", max(1, parted.count())).filter("low is not null").select("key", "node", "part")
    more = _verified(_apart(written(named, "named"), nodes, sets, at_least, HOT if hot is None else hot), sets, at_least)
    roots = written(components(links.unionByName(more)), "roots")
    return nodes.join(roots, "node", "left").select("text_sha256", "rep", F.coalesce("root", "node").alias("root"))


def _sizes(a: str, b: str, at_least: int):  # noqa: ANN202
    """Sets of these sizes can be similar."""
    return 100 * F.least(a, b) >= at_least * F.greatest(a, b)


def near_dedup(docs: DataFrame, size: int = 5, at_least: int = 80) -> DataFrame:
    """One row of each component of ``docs``, with all its columns."""
    groups = near_groups(docs, size, at_least)
    least = groups.groupBy("root").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), F.col("rep").alias("id"), F.col("text_sha256").alias("sha"))).alias("least"))
    return keep_rows(docs, least.select(F.col("least.id").alias("doc_id"), F.col("least.sha").alias("text_sha256")), F.coalesce(F.col("text"), F.lit("")))

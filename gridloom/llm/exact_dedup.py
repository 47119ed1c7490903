"""Exact deduplication by deterministic block naming, in DataFrame operations only.

Every text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and each gets an integer
name; then adjacent pairs of names are named in the same way, level by level, until one name is left for each
document. Names come from sorting, not from hashing, so equal identities mean equal texts.

A block travels through one shuffle only (partially aggregated, so copies meet on the map side). The names go back
to their documents by a 128-bit digest; the digests of all distinct blocks are checked to be distinct, and if two
should ever collide the level is repeated with other digests.

Defined results: a null text counts as empty and an empty text is an ordinary text (all of them are equal); repeated
rows are separate rows of one group, of which one is kept (the row first in the table's order among those with the
smallest doc_id); rows with a null doc_id come last in that order; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fresh, remove, written

#: Characters that count as white space.
SPACE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def _blocks(norm: Column, block_bytes: int) -> Column:
    data = norm.cast("binary")
    last = F.greatest(F.ceil(F.length(data) / F.lit(block_bytes)), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block_bytes + 1, F.lit(block_bytes)))


def _digest(block: Column, salt: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * salt), block), F.xxhash64(F.lit(2 * salt + 1), block)]


def _named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct keys with their number of rows, sorted in each hash partition and numbered: partition, then place."""
    counted = keys.groupBy(*columns).agg(F.count(F.lit(1)).alias("uses"))
    return counted.sortWithinPartitions(*columns).withColumn("name", F.monotonically_increasing_id())


def identities(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, text_sha256, level, name. (level, name) is the text's identity."""
    source = docs.select(F.col("doc_id"), normalised(F.col("text")).alias("norm"))
    salt = 0
    while True:
        cut = source.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), _blocks(F.col("norm"), block_bytes).alias("blocks"))
        rows = written(cut.select("row_id", "doc_id", "text_sha256", F.transform("blocks", lambda b: F.struct(*(h.alias(n) for h, n in zip(_digest(b, salt), ("h1", "h2"), strict=True)))).alias("keys")), "rows")
        first = _named(source.select(F.explode(_blocks(F.col("norm"), block_bytes)).alias("block")), ["block"])
        names = written(first.select(*(h.alias(n) for h, n in zip(_digest(F.col("block"), salt), ("h1", "h2"), strict=True)), "uses", "name"), "names")
        if names.groupBy("h1", "h2").count().filter("count > 1").isEmpty():
            break
        remove(rows)
        remove(names)
        salt += 1
    total, longest = rows.agg(F.sum(F.size("keys")), F.max(F.size("keys"))).first()
    if not total:
        return rows.select("row_id", "doc_id", "text_sha256", F.lit(0).alias("level"), F.lit(0).cast("long").alias("name"))
    parts = rows.select("row_id", F.size("keys").alias("n"), F.posexplode("keys").alias("pos", "key")).select("row_id", "n", "pos", "key.h1", "key.h2")
    current = written(attach(parts, names, ["h1", "h2"], "uses", total).select("row_id", "n", "pos", "name"), "level")
    remove(names)
    done = current.filter("n = 1").select("row_id", F.lit(0).alias("level"), "name")
    level = 0
    while longest > 1:
        level += 1
        pairs = current.filter("n > 1").groupBy("row_id", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b")
        )
        pairs = written(pairs, "pairs")
        names = written(_named(pairs, ["a", "b"]), "names")
        count = pairs.count()
        current = written(attach(pairs, names, ["a", "b"], "uses", count).select("row_id", F.expr("(n + 1) div 2").cast("int").alias("n"), "pos", "name"), "level")
        remove(pairs)
        remove(names)
        done = done.unionByName(current.filter("n = 1").select("row_id", F.lit(level).alias("level"), "name"))
        longest = (longest + 1) // 2
    return written(rows.drop("keys").join(done, "row_id"), "identities")


def exact_groups(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256; row_id tells repeated rows apart."""
    named = identities(docs, block_bytes)
    groups = named.groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("row_id").alias("row"))).alias("first")
    )
    groups = written(groups.select("level", "name", "group_size", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row")), "groups")
    out = attach(named, groups, ["level", "name"], "group_size", named.count())
    return out.select("doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"), "text_sha256", "row_id")


def exact_dedup(docs: DataFrame, block_bytes: int = 4096) -> DataFrame:
    """The kept rows of ``docs`` with all their columns."""
    return keep_rows(docs, exact_groups(docs, block_bytes).filter("kept"), normalised(F.col("text")))


def keep_rows(docs: DataFrame, kept: DataFrame, norm: Column) -> DataFrame:
    """Rows of ``docs`` whose (doc_id, sha-256 of ``norm``) is in ``kept``, each pair once.

    A semi-join by both, so rows with a null doc_id are spread by their texts. Where doc_ids repeat, rows that repeat
    both are reduced to one.
    """
    ids = written(kept.select("doc_id", "text_sha256"), "kept")
    sha = fresh(docs.columns, "sha")
    tagged = docs.withColumn(sha, F.sha2(norm, 256))
    out = tagged.join(ids, tagged["doc_id"].eqNullSafe(ids["doc_id"]) & (tagged[sha] == ids["text_sha256"]), "left_semi")
    if not docs.groupBy("doc_id").count().filter("count > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", sha])
    return out.drop(sha)

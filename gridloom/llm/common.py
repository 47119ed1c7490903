"""Shared helpers: work tables in the cluster's shared folder, heavy-hitter joins, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than this share of the rows is a heavy hitter; there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.01


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; unset with a local master (tests), a new one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = spark.conf.get("gridloom.shared.dir", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
            spark.conf.set("gridloom.shared.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, lost executors cost no rerun."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` that no later plan reads."""
    jvm = df.sparkSession._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(hadoop, True)


def attach(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Left-join ``right`` (unique ``keys``; ``weight`` counts the left rows of a key) without letting a hot key meet in one task.

    Keys that hold more than ``HOT_SHARE`` of the ``total`` left rows are at most ``1 / HOT_SHARE``: a proven bound
    for naming them in a filter and for broadcasting their rows. All others take the shuffled join, where no key is
    large. ``right`` must be cheap to read again (a written table), ``left`` too where there is a hot key.
    """
    heavy = F.col(weight) > F.lit(max(total * HOT_SHARE, 1000.0))
    named = right.filter(heavy).select(*keys).collect()
    if not named:
        return left.join(right, keys, "left")
    of = F.lit(False)
    for row in named:
        same = F.lit(True)
        for k in keys:
            same = same & (F.col(k) == F.lit(row[k]))
        of = of | same
    of = F.coalesce(of, F.lit(False))
    return left.filter(of).join(F.broadcast(right.filter(heavy)), keys, "left").unionByName(left.filter(~of).join(right.filter(~heavy), keys, "left"))


def is_train(doc_id: Column) -> Column:
    """Rows that a model may learn from: crc32 of the id as text, modulo 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def text_hash(name: str) -> Column:
    """The hash by which texts are chosen for the sample ``name``."""
    return F.xxhash64(F.coalesce("text", F.lit("")), F.lit(name))


def sample_of(rows: DataFrame, docs: DataFrame, label: str, size: int, name: str) -> DataFrame:
    """doc_id, ``label``, text of at most ``size`` rows for each value of ``label``, no two of equal label and text.

    rows: doc_id, ``label`` and hash (:func:`text_hash`) of the rows of ``docs`` to choose from; texts are fetched for
    the chosen ones alone. The choice depends on the rows alone, so a task that runs again makes the same one. A first
    pass takes about four times as many as wanted by a threshold of the hash; labels whose rows all fail it (they
    repeat few texts) get a pass of their own without threshold.
    """
    rows = rows.select("doc_id", label, "hash")
    sizes = written(rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows")), "label-sizes")  # one row per label
    first = Window.partitionBy(label).orderBy("hash", F.col("doc_id").asc_nulls_last())

    def best(some: DataFrame) -> DataFrame:
        each = some.groupBy(label, "hash").agg(F.min("doc_id").alias("doc_id"))
        return each.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= size).select("doc_id", label, "hash")

    chance = F.pmod("hash", F.lit(1_000_003)) / 1_000_003
    found = written(best(rows.join(F.broadcast(sizes), label).filter(chance < 4.0 * size / F.col("rows"))), name)
    missing = written(sizes.join(found.select(label).distinct(), label, "left_anti").select(label), "label-missing")
    if not missing.isEmpty():
        found = written(found.unionByName(best(rows.join(F.broadcast(missing), label, "left_semi"))), name)
    texts = docs.select("doc_id", "text", text_hash(name).alias("hash")).join(found, ["doc_id", "hash"])
    return written(texts.dropDuplicates([label, "hash"]).select("doc_id", label, "text"), name + "-texts")


def chunks(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts with about ``limit`` characters each; a longer text stands alone."""
    i, n = 0, len(texts)
    while i < n:
        j, size = i, 0
        while j < n and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j

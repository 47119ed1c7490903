"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


#: Bytes of an Arrow batch between the JVM and a Python worker; Spark's default of 64 MB costs several times that on both sides.
BATCH_BYTES = 8 * 1024 * 1024
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable by the Python workers of ``spark`` (once per context), and bound its Arrow batches.

    The bound is a session setting; one that differs from Spark's default is left as it is.
    """
    if spark.conf.get(_LIMIT, "67108864b") == "67108864b":
        spark.conf.set(_LIMIT, str(BATCH_BYTES))
    context = spark.sparkContext
    if not getattr(context, "_gridloom_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        folder = tempfile.mkdtemp(prefix="gridloom-")
        base = shutil.copytree(os.path.join(root, "gridloom"), os.path.join(folder, "src", "gridloom"), ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.path.join(folder, "gridloom"), "zip", os.path.dirname(base)))
        context._gridloom_shipped = True
    return spark


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors reach by plain paths, for files that readers open themselves.

    It is made below ``spark.checkpoint.dir``; only with a local master, where that is unset, it is a temporary one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        return tempfile.mkdtemp(prefix="gridloom-")
    scheme, _, rest = base.rpartition(":")
    if scheme not in ("", "file"):
        raise ValueError(f"{base} can't be reached by plain paths")
    path = os.path.join("/" + rest.lstrip("/"), f"gridloom-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path

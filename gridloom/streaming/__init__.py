"""Partial results while frames arrive, with Structured Streaming.

Reductions over frames are additive, so a stream of frames is an ordinary grouped aggregate in complete mode: every
micro-batch yields a full snapshot. Per-frame results are append mode. The positions seen so far ("damage") are one
more aggregate. Queries carry tags, can be stopped between micro-batches, and take new parameters between batches.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable
from concurrent.futures import Future
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.cube import Cube


def read_frames(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of frames (frame_id, frame) from Parquet files that appear in ``path``."""
    return spark.readStream.schema("frame_id long, frame array<double>").option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_cube(frames: DataFrame, nav_shape: tuple[int, ...], sig_shape: tuple[int, ...]) -> Cube:
    return Cube(frames, tuple(nav_shape), tuple(sig_shape))


@dataclass
class Snapshots:
    """Snapshots of a running query; iterating waits for the next one until the stream ends.

    The last ``keep`` are held; a reader that falls behind them goes on with the oldest that is left.
    """

    query: StreamingQuery | None = None
    keep: int = 16
    _items: deque[tuple[int, list]] = field(default_factory=deque)
    _gone: int = 0
    _news: threading.Condition = field(default_factory=threading.Condition)

    def add(self, batch: int, rows: list) -> None:
        with self._news:
            self._items.append((batch, rows))
            while len(self._items) > self.keep:
                self._items.popleft()
                self._gone += 1
            self._news.notify_all()

    def latest(self) -> list | None:
        with self._news:
            return self._items[-1][1] if self._items else None

    def __iter__(self):  # noqa: ANN204
        at = 0
        while True:
            with self._news:
                while at >= self._gone + len(self._items):
                    if self.query is not None and not self.query.isActive:
                        if self.query.exception():
                            raise self.query.exception()
                        return
                    self._news.wait(0.2)
                at = max(at, self._gone)
                item = self._items[at - self._gone]
            at += 1
            yield item

    def cancel(self) -> None:
        """Stops between micro-batches."""
        self.query.stop()

    def progress(self) -> dict:
        last = self.query.lastProgress
        return {"batch": last["batchId"], "rows": last["numInputRows"]} if last else {"batch": -1, "rows": 0}


def snapshots(result: DataFrame, mode: str = "complete", once: bool = True, checkpoint: str | None = None, keep: int = 16) -> Snapshots:
    """Runs a streaming aggregate; each micro-batch's full result is one snapshot.

    A snapshot is as large as the result (a frame, or a row per navigation position for append mode), not the input.
    """
    out = Snapshots(keep=keep)

    def keep(batch: DataFrame, number: int) -> None:
        out.add(number, batch.collect())

    writer = result.writeStream.outputMode(mode).foreachBatch(keep)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    out.query = (writer.trigger(availableNow=True) if once else writer).start()
    return out


def damage(cube: Cube) -> DataFrame:
    """How many navigation positions have arrived, and of how many."""
    return cube.df.agg(F.approx_count_distinct("frame_id").alias("seen_about"), F.count(F.lit(1)).alias("frames")).withColumn("total", F.lit(cube.n_frames))


class Adjustable:
    """Parameters that may change while a stream runs; each micro-batch uses those set last."""

    def __init__(self, **params) -> None:  # noqa: ANN003
        self._params, self._lock = params, threading.Lock()

    def update(self, **params) -> None:  # noqa: ANN003
        with self._lock:
            self._params = self._params | params

    def current(self) -> dict:
        with self._lock:
            return dict(self._params)


def per_batch(cube: Cube, run: Callable[[Cube, dict], DataFrame], params: Adjustable, sink: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Applies ``run`` to each micro-batch with the current parameters and hands the result to ``sink``."""

    def step(batch: DataFrame, number: int) -> None:
        sink(run(Cube(batch, cube.nav_shape, cube.sig_shape, cube.complex), params.current()), number)

    writer = cube.df.writeStream.foreachBatch(step)
    return (writer.trigger(availableNow=True) if once else writer).start()


def in_background(f: Callable, *args) -> Future:  # noqa: ANN002
    """Runs a query in a thread; the future has its result."""
    out: Future = Future()

    def run() -> None:
        try:
            out.set_result(f(*args))
        except BaseException as error:  # noqa: BLE001  handed to the waiting side
            out.set_exception(error)

    threading.Thread(target=run, daemon=True).start()
    return out


class Cancelled(RuntimeError):
    """A run was cancelled."""


class Job:
    """A tagged batch query that can be cancelled."""

    def __init__(self, spark: SparkSession, tag: str) -> None:
        self.spark, self.tag = spark, tag

    def run(self, f: Callable):  # noqa: ANN201
        self.spark.addTag(self.tag)
        try:
            return f()
        except Exception as error:
            if "cancel" in str(error).lower():
                raise Cancelled(self.tag) from error
            raise
        finally:
            self.spark.removeTag(self.tag)

    def cancel(self) -> None:
        self.spark.interruptTag(self.tag)

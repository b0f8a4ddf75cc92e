"""Live detections: newest frames first, trackers with kept state that agree with their batch twins, and collection of batches.

State is kept in typed values of ``transformWithStateInPandas``, which needs the RocksDB state store; ``live_frames`` sets that for the
session where no store is set. The rows that a trigger brings for one clip are sorted in one task, so a trigger's files should be
few (``files_per_trigger``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from trackframe.operators.catalog import new_batches, progress
from trackframe.operators.tracking import METHODS, Walk

DETECTIONS = "clip long, frame long, id long, x double, y double, w double, h double, conf double"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BOX = ["x", "y", "w", "h", "conf"]


def live_frames(spark: SparkSession, path: str, schema: str = DETECTIONS, files_per_trigger: int = 1) -> DataFrame:
    """A stream of detection files."""
    if not spark.conf.get(STORE, "").endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _fresh(parts: Iterator[pd.DataFrame], last: int | None) -> tuple[pd.DataFrame, int]:
    """A trigger's rows of a clip after frame ``last``, in order, and how many others there are."""
    pdf = pd.concat(list(parts))
    fresh = pdf if last is None else pdf[pdf["frame"] > last]
    return fresh.sort_values(["frame", "conf", "id"], ascending=[True, False, True]), len(pdf) - len(fresh)


class _Tracking(StatefulProcessor):
    def __init__(self, method: str, first: int | None, visit: str | None, options: dict):
        self.method, self.first, self.visit, self.options = method, first, visit, options

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tracker", f"last long, stale long, {METHODS[self.method].STATE}")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        walk, stale = Walk(self.method, self.first, self.visit, **self.options), 0
        if self.state.exists():
            walk.last, stale, *known = self.state.get()
            walk.tracker.load(*known)
        fresh, dropped = _fresh(rows, walk.last)
        stale, out = stale + dropped, []
        frames, columns = fresh["frame"].to_numpy(), [fresh[c].to_numpy() for c in BOX]
        cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(frames)] if len(frames) else []
        for a, b in zip(cuts, cuts[1:]):
            out += [(key[0], *r, stale) for r in walk(frames[a], [c[a:b] for c in columns])]
        self.state.update((walk.last, stale, *walk.tracker.dump()))
        yield pd.DataFrame(out, columns=["clip", "frame", "id", "x", "y", "w", "h", "conf", "stale"])

    def close(self) -> None:
        pass


def track_stream(detections: DataFrame, method: str = "single", first: int | None = None, visit: str | None = None, **options) -> DataFrame:
    """Tracks with state per clip, equal to those of ``tracking.track`` with the same options.

    Inside a trigger frames run in order. Frames not after the last one seen come too late: they are dropped, and ``stale`` counts their rows so far.
    """
    return detections.groupBy("clip").transformWithStateInPandas(_Tracking(method, first, visit, options), DETECTIONS + ", stale long", "append", "None")


class _Newest(StatefulProcessor):
    def __init__(self, mode: str):
        self.mode = mode

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("seen", "last long, counter long, dropped long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, counter, dropped = self.state.get() if self.state.exists() else (None, 0, 0)
        pdf = pd.concat(list(rows))
        fresh = pdf if last is None else pdf[pdf["frame"] > last]
        dropped += pdf["frame"].nunique() - fresh["frame"].nunique()
        frames = np.unique(fresh["frame"].to_numpy())
        if self.mode == "latest" and len(frames) > 1:
            dropped += len(frames) - 1
            frames = frames[-1:]
        out = fresh[fresh["frame"].isin(frames)].sort_values(["frame", "id"])
        out = out.assign(clip=key[0], counter=counter + 1 + np.searchsorted(frames, out["frame"].to_numpy()), dropped=dropped)
        if len(frames):
            last, counter = int(frames[-1]), counter + len(frames)
        self.state.update((last, counter, dropped))
        yield out[["clip", "frame", "id", *BOX, "counter", "dropped"]]

    def close(self) -> None:
        pass


def newest(detections: DataFrame, mode: str = "latest") -> DataFrame:
    """What a reader sees that takes the newest frame of each clip at a trigger (``mode`` all: every frame).

    A frame not after the last one given out is stale, whenever it comes. ``counter`` numbers the frames given out and never falls;
    ``dropped`` counts those that were not, stale ones included. Rows have the columns of ``DETECTIONS``.
    """
    if mode not in ("latest", "all"):
        raise ValueError("mode is latest or all")
    return detections.groupBy("clip").transformWithStateInPandas(_Newest(mode), DETECTIONS + ", counter long, dropped long", "append", "None")


def collect_new(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append what has not been seen yet, then stop: a run that can be repeated."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: What names a batch of labelled material.
BATCH = ["source", "wave", "split", "batch"]


def collected(spark: SparkSession, target: str) -> DataFrame | None:
    """(source, wave, split, batch, n, commit): the batches in ``target``; None before the first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/state")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("source string, wave string, split string, batch string, n long, commit long").parquet(f"{target}/state")


def collect_batches(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Take the rows of batches that are not in yet, then stop. ``stream`` has the columns of ``BATCH`` and any others.

    Each trigger writes its rows to ``rows/commit=<trigger>`` and then its batches to ``state/commit=<trigger>``, both in place of what the same
    trigger wrote before. So a trigger that runs again after a failure adds nothing twice, and batches count as taken only when
    their rows are in. Rows of a batch that later triggers bring again are left out.
    """

    def one(rows: DataFrame, number: int) -> None:
        state = collected(rows.sparkSession, target)
        fresh = rows if state is None else new_batches(rows, state.where(F.col("commit") != number))
        out = f"{target}/rows/commit={number}"
        fresh.write.mode("overwrite").parquet(out)
        taken = rows.sparkSession.read.schema(fresh.schema).parquet(out).groupBy(*BATCH).agg(F.count("*").alias("n"))
        taken.write.mode("overwrite").parquet(f"{target}/state/commit={number}")

    stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def finalise(spark: SparkSession, target: str, expected: DataFrame) -> DataFrame:
    """(wave, split, n, missing): batches in by wave and split, with those of ``expected`` that have none."""
    state = collected(spark, target)
    return progress(expected, expected.limit(0).select("wave", "split") if state is None else state)

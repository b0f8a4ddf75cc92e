"""Choosing frames: how much consecutive frames differ, thresholds, near-duplicate hashes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.geometry import iou
from trackframe.functions.text import hamming
from trackframe.operators.scans import scan_frames
from trackframe.operators.scratch import written

# Thresholds of the simulation.
THRESHOLDS = (0.70, 0.75, 0.80, 0.85, 0.88, 0.90, 0.92, 0.94, 0.96, 0.98)
BOX = "xywh"


def min_ious(boxes: DataFrame) -> DataFrame:
    """(clip, frame, min_iou): least IoU of a track shared with the labelled frame before; frames that share none are left out."""
    frames = boxes.select("clip", "frame").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("clip").orderBy("frame")))
    ranked = boxes.join(frames, ["clip", "frame"])
    before = ranked.select("clip", "id", (F.col("_r") + 1).alias("_r"), *(F.col(c).alias(f"b{c}") for c in BOX))
    overlap = iou(tuple(F.col(c) for c in BOX), tuple(F.col(f"b{c}") for c in BOX))
    return ranked.join(before, ["clip", "id", "_r"]).groupBy("clip", "frame").agg(F.min(overlap).alias("min_iou"))


def percentiles(values: DataFrame, by: str, value: str) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    names = {"p0": 0.0, "p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p100": 1.0}
    q = F.percentile(value, F.array(*map(F.lit, names.values())))
    return values.groupBy(by).agg(F.count("*").alias("n"), q.alias("_q")).select(by, "n", *(F.round(F.get("_q", F.lit(i)), 6).alias(k) for i, k in enumerate(names)))


def simulate(values: DataFrame, boxes: DataFrame, train_share: float = 0.85) -> DataFrame:
    """Frames kept at each threshold: those with a smaller least IoU, and one for each clip of ``boxes``; split into train and val."""
    counts = values.agg(*(F.count_if(F.col("min_iou") < t).alias(str(i)) for i, t in enumerate(THRESHOLDS)))
    both = counts.crossJoin(F.broadcast(boxes.select("clip").distinct().agg(F.count("*").alias("clips"))))  # one row each
    rows = both.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), (F.col(str(i)) + F.col("clips")).alias("kept")) for i, t in enumerate(THRESHOLDS)))).alias("r")).select("r.*")
    train = F.floor(F.col("kept") * train_share)
    return rows.select("threshold", "kept", train.alias("train"), (F.col("kept") - train).alias("val"))


class _Keeper:
    """Keeps a frame that shares no track with the last kept one, or differs from it."""

    def __init__(self, differs):
        self.differs, self.last = differs, None

    def __call__(self, frame: int, columns: list[np.ndarray]) -> list[tuple]:
        own = dict(zip(columns[0].tolist(), np.stack(columns[1:], axis=1).astype(float)))
        shared = [] if self.last is None else sorted(own.keys() & self.last.keys())
        if shared and not self.differs(np.array([self.last[i] for i in shared]), np.array([own[i] for i in shared])):
            return []
        self.last = own
        return [(frame,)]


def _least_iou(a: np.ndarray, b: np.ndarray) -> float:
    wide = np.clip(np.minimum(a[:, 0] + a[:, 2], b[:, 0] + b[:, 2]) - np.maximum(a[:, 0], b[:, 0]), 0, None)
    high = np.clip(np.minimum(a[:, 1] + a[:, 3], b[:, 1] + b[:, 3]) - np.maximum(a[:, 1], b[:, 1]), 0, None)
    union = a[:, 2] * a[:, 3] + b[:, 2] * b[:, 3] - wide * high
    return float(np.where(union > 0, wide * high / np.where(union > 0, union, 1), 0).min())


def _most_moved(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.hypot(*((b[:, :2] + b[:, 2:] / 2) - (a[:, :2] + a[:, 2:] / 2)).T).max())


def fresh_starts(boxes: DataFrame) -> DataFrame:
    """``boxes`` with ``_part``: the last frame at or before theirs whose tracks are all new in the clip. Nothing before such a frame matters after it."""
    first = F.min("frame").over(Window.partitionBy("clip", "id"))
    new = F.min((F.col("frame") == F.col("_first")).cast("int")).over(Window.partitionBy("clip", "frame"))
    part = F.max(F.when(F.col("_new") == 1, F.col("frame"))).over(Window.partitionBy("clip").orderBy("frame"))
    return boxes.withColumn("_first", first).withColumn("_new", new).withColumn("_part", part.cast("long")).drop("_first", "_new")


def keep_frames(boxes: DataFrame, threshold: float, rule: str = "iou") -> DataFrame:
    """Frames that differ from the last kept one: rule iou, least shared IoU below; displacement, a centre moved at least so far.

    Frames are scanned in order with the last kept one alone in memory; parts of a clip that start with new tracks only run in parallel.
    """
    test = (lambda a, b: _least_iou(a, b) < threshold) if rule == "iou" else (lambda a, b: _most_moved(a, b) >= threshold)
    kinds = {f.name: f.dataType.simpleString() for f in boxes.schema}
    rows = fresh_starts(boxes.select("clip", "frame", "id", *BOX))
    return scan_frames(rows, ["clip", "_part"], ["id", *BOX], lambda key: _Keeper(test), f"clip {kinds['clip']}, _part long, frame {kinds['frame']}", [F.asc("id")]).drop("_part")


def first_wins(hashes: DataFrame, threshold: int, bits: int = 64, write=None) -> DataFrame:
    """Rows (seq, hash) that are further than ``threshold`` bits from every kept row before them.

    Equal hashes stand or fall with the first of them. Two hashes within the threshold agree in one of threshold + 1 bands. The
    earliest undecided row is kept and removes its neighbours, round after round; ``write`` cuts the lineage of each round (default: checkpoint).
    """
    if threshold <= 0:
        return hashes
    write = write or written
    hashes = write(hashes.groupBy("hash").agg(F.min("seq").alias("seq")).select("seq", "hash"))
    edges = np.linspace(0, bits, threshold + 2).astype(int)
    bands = F.array(*(F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("hash", int(a)).bitwiseAND(F.lit((1 << int(b - a)) - 1)).alias("part")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:]))))
    banded = hashes.select("seq", "hash", F.explode(bands).alias("b")).select("seq", "hash", "b.band", "b.part")
    other = banded.select(F.col("seq").alias("later"), F.col("hash").alias("h2"), "band", "part")
    near = write(banded.join(other, ["band", "part"]).where((F.col("seq") < F.col("later")) & (hamming(F.col("hash"), F.col("h2")) <= threshold)).select("seq", "later").distinct())
    open_rows, kept = hashes.select("seq", "hash"), None
    while True:
        sure = open_rows.join(near, open_rows["seq"] == near["later"], "left_anti")
        kept = sure if kept is None else kept.unionByName(sure)
        gone = near.join(sure.select("seq"), "seq", "left_semi").select(F.col("later").alias("seq")).distinct()
        rest = write(open_rows.join(sure.select("seq"), "seq", "left_anti").join(gone, "seq", "left_anti"))
        if not rest.limit(1).count():
            return kept
        near = write(near.join(rest.select("seq"), "seq", "left_semi").join(rest.select(F.col("seq").alias("later")), "later", "left_semi").select("seq", "later"))
        open_rows, kept = rest, write(kept)

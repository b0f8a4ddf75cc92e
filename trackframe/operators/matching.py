"""Pairs of boxes in a frame, their optimal assignment, and identity switches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.geometry import iou

FRAME = ["clip", "frame"]


#: Costs of up to so many pairs are solved on plain numbers, which a frame's few boxes are too few for arrays to repay.
SMALL = 400


def assign(cost: np.ndarray) -> np.ndarray:
    """Column of each row (-1: none) in a cheapest assignment of min(n, m) pairs: shortest augmenting paths, O(n^3).

    Equal costs go to the lower row, then the lower column.
    """
    cost = np.asarray(cost, float)
    if not cost.size:
        return np.full(cost.shape[0], -1)
    if cost.size <= SMALL and np.isfinite(cost).all():
        return np.array(assign_few(cost.tolist()))
    if cost.shape[0] > cost.shape[1]:
        across = assign(cost.T)
        out = np.full(cost.shape[0], -1)
        for column, row in enumerate(across):
            out[row] = column
        return out
    n, m = cost.shape
    nearest = cost.argmin(1)
    if len(np.unique(nearest)) == n:  # every row has its cheapest column
        return nearest
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = np.flatnonzero(~used[1:]) + 1
            reduced = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def assign_few(cost: list[list[float]]) -> list[int]:
    """``assign`` for a few finite costs as lists, in the same steps and with the same result to the bit; at least one row and column."""
    n, m = len(cost), len(cost[0])
    if n > m:
        out = [-1] * n
        for column, row in enumerate(assign_few([list(c) for c in zip(*cost)])):
            out[row] = column
        return out
    nearest = [row.index(min(row)) for row in cost]
    if len(set(nearest)) == n:  # every row has its cheapest column
        return nearest
    u, v = [0.0] * (n + 1), [0.0] * (m + 1)
    owner, way = [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used, free = [np.inf] * (m + 1), [0], list(range(1, m + 1))
        while True:
            i0 = owner[j0]
            row, ui, delta, j1 = cost[i0 - 1], u[i0], np.inf, 0
            for j in free:
                reduced = row[j - 1] - ui - v[j]
                if reduced < least[j]:
                    least[j], way[j] = reduced, j0
                if least[j] < delta:
                    delta, j1 = least[j], j
            for j in used:
                u[owner[j]] += delta
                v[j] -= delta
            for j in free:
                least[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
            free.remove(j0)
            used.append(j0)
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if owner[j]:
            out[owner[j] - 1] = j - 1
    return out


def unique_ids(boxes: DataFrame) -> DataFrame:
    """One box an id and frame: the first by position."""
    first = Window.partitionBy("clip", "frame", "id").orderBy("x", "y", "w", "h")
    return boxes.withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def repeated_ids(boxes: DataFrame) -> DataFrame:
    """(clip, repeated): boxes beyond the first of an id and frame."""
    n = boxes.groupBy("clip", "frame", "id").agg(F.count("*").alias("n"))
    return n.groupBy("clip").agg((F.sum("n") - F.count("*")).alias("repeated"))


def frame_pairs(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(clip, frame, gid, pid, iou) of all pairs of boxes in the same frame."""
    g = gt.select("clip", "frame", F.col("id").alias("gid"), *(F.col(c).alias(f"g{c}") for c in "xywh"))
    p = pred.select("clip", "frame", F.col("id").alias("pid"), *(F.col(c).alias(f"p{c}") for c in "xywh"))
    overlap = iou(tuple(F.col(f"g{c}") for c in "xywh"), tuple(F.col(f"p{c}") for c in "xywh"))
    return g.join(p, FRAME).select("clip", "frame", "gid", "pid", overlap.alias("iou"))


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, f in group.groupby("frame", sort=True):
        gids, pids = np.unique(f["gid"]), np.unique(f["pid"])
        weight = np.zeros((len(gids), len(pids)))
        np.maximum.at(weight, (np.searchsorted(gids, f["gid"]), np.searchsorted(pids, f["pid"])), f["iou"])
        rows = assign(-weight)
        keep = [(g, p) for g, p in enumerate(rows) if p >= 0 and weight[g, p] > 0]
        out += [(f["clip"].iloc[0], f["frame"].iloc[0], gids[g], pids[p], weight[g, p]) for g, p in keep]
    return pd.DataFrame(out, columns=["clip", "frame", "gid", "pid", "iou"])


def match(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, span: int = 512) -> DataFrame:
    """One-to-one pairs that maximise the sum of IoU in each frame; of those, the ones with IoU >= ``threshold``.

    Of several boxes with one id in a frame the best-fitting one takes part (``unique_ids`` leaves the first, ``repeated_ids`` counts them).
    Frames where every box overlaps at most one other need no solver. Only contested frames go to Python, many frames a group.
    """
    pairs = frame_pairs(gt, pred).where("iou > 0")
    in_frame = Window.partitionBy("clip", "frame")
    degree = F.greatest(F.count("*").over(Window.partitionBy("clip", "frame", "gid")), F.count("*").over(Window.partitionBy("clip", "frame", "pid")))
    marked = pairs.withColumn("_d", degree).withColumn("_d", F.max("_d").over(in_frame))
    plain = marked.where("_d = 1").drop("_d")
    contested = marked.where("_d > 1").drop("_d").withColumn("_bucket", F.floor(F.col("frame") / span))
    solved = contested.groupBy("clip", "_bucket").applyInPandas(lambda pdf: _solve(pdf.drop(columns="_bucket")), pairs.schema)
    return plain.unionByName(solved).where(F.col("iou") >= threshold)


def switches(matched: DataFrame) -> DataFrame:
    """Matches whose predicted id differs from that of the same true id's previous match."""
    before = F.lag("pid").over(Window.partitionBy("clip", "gid").orderBy("frame"))
    return matched.withColumn("previous_pid", before).where("previous_pid IS NOT NULL AND previous_pid <> pid").select("clip", "frame", "gid", "previous_pid", "pid")

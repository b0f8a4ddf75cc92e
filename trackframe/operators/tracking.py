"""Order-dependent trackers: small kernels over frames in order, in batch and as streams; their boxes and state are plain numbers, since a frame has few."""

from __future__ import annotations

from collections.abc import Callable
from operator import add, ge, sub

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators.matching import SMALL, assign, assign_few
from trackframe.operators.scans import scan_frames
from trackframe.operators.tracks import fill_gaps
from trackframe.sources.writers import unfinished_rows, write_partitions


def iou_table(a: np.ndarray, b: np.ndarray, eps: float = 0.0) -> np.ndarray:
    """IoU of every x1, y1, x2, y2 box of ``a`` with every one of ``b``."""
    wide = np.clip(np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0]), 0, None)
    high = np.clip(np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1]), 0, None)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    union = area(a)[:, None] + area(b)[None, :] - wide * high + eps
    return np.divide(wide * high, union, out=np.zeros_like(union), where=union > 0)


def overlaps(a: list[tuple], b: list[tuple], eps: float = 0.0) -> list[list[float]]:
    """``iou_table`` as lists, on plain numbers for the few boxes of a frame."""
    if len(a) * len(b) > SMALL:
        return iou_table(np.array(a, float), np.array(b, float), eps).tolist()
    sizes = [(q[2] - q[0]) * (q[3] - q[1]) for q in b]
    out = []
    for x1, y1, x2, y2 in a:
        size, row = (x2 - x1) * (y2 - y1), []
        for q, other in zip(b, sizes):
            wide = (x2 if x2 < q[2] else q[2]) - (x1 if x1 > q[0] else q[0])
            if wide > 0 and (high := (y2 if y2 < q[3] else q[3]) - (y1 if y1 > q[1] else q[1])) > 0:
                union = size + other - wide * high + eps
                row.append(wide * high / union if union > 0 else 0.0)
            else:
                row.append(0.0)
        out.append(row)
    return out


def cheapest(table: list[list[float]]) -> list[int]:
    """The column of each row (-1: none) in an assignment of the largest sum of overlaps."""
    cost = [[1 - v for v in row] for row in table]
    return assign_few(cost) if len(cost) * len(cost[0]) <= SMALL else assign(np.array(cost)).tolist()


def best_n(boxes: list[tuple], conf: list[float], n: int) -> tuple[list[tuple], list[float]]:
    """The ``n`` most confident boxes and their confidences, most confident first, ties in order."""
    if all(map(ge, conf, conf[1:])):
        return boxes[:n], conf[:n]
    keep = np.argsort(-np.array(conf, float), kind="stable")[:n].tolist()
    return [boxes[i] for i in keep], [conf[i] for i in keep]


def in_fours(values: list) -> list[tuple]:
    return [tuple(values[i : i + 4]) for i in range(0, len(values), 4)]


class Slots:
    """Identities 1..n: every frame is matched to the frame before without a limit; leftovers take the lowest free id, else a new one."""

    VISITS, STATE = "once", "ids array<long>, boxes array<double>"

    def __init__(self, n: int = 9):
        self.n, self.ids, self.boxes = n, [], []

    def dump(self) -> tuple:
        return list(self.ids), [v for b in self.boxes for v in b]

    def load(self, ids: list, boxes: list) -> None:
        self.ids, self.boxes = list(ids), in_fours(boxes)

    def update(self, boxes: list[tuple], conf: list[float]) -> list[tuple[int, tuple, float]]:
        boxes, conf = best_n(boxes, conf, self.n)
        ids = [0] * len(boxes)
        if self.ids and boxes:
            for row, column in enumerate(cheapest(overlaps(self.boxes, boxes, 1e-8))):
                if column >= 0:
                    ids[column] = self.ids[row]
        used = {i for i in ids if i > 0}
        for i, known in enumerate(ids):
            if not known:
                ids[i] = next((k for k in range(1, self.n + 1) if k not in used), max(used, default=0) + 1)
                used.add(ids[i])
        self.ids, self.boxes = ids, boxes
        return list(zip(ids, boxes, conf))


class Gated:
    """Optimal matching of at least ``least`` IoU; unmatched tracks end, unmatched boxes get new ids; an empty frame changes nothing."""

    VISITS, STATE = "seen", "next long, ids array<long>, boxes array<double>"

    def __init__(self, n: int = 9, least: float = 0.3):
        self.n, self.least, self.next = n, least, 1
        self.ids, self.boxes = [], []

    def dump(self) -> tuple:
        return self.next, list(self.ids), [v for b in self.boxes for v in b]

    def load(self, next_id: int, ids: list, boxes: list) -> None:
        self.next, self.ids, self.boxes = next_id, list(ids), in_fours(boxes)

    def update(self, boxes: list[tuple], conf: list[float]) -> list[tuple[int, tuple, float]]:
        boxes, conf = best_n(boxes, conf, self.n)
        if not boxes:
            return []
        ids = [0] * len(boxes)
        if self.ids:
            table = overlaps(self.boxes, boxes)
            for row, column in enumerate(cheapest(table)):
                if column >= 0 and table[row][column] >= self.least:
                    ids[column] = self.ids[row]
        for i, known in enumerate(ids):
            if not known:
                ids[i], self.next = self.next, self.next + 1
        self.ids, self.boxes = ids, boxes
        return list(zip(ids, boxes, conf))


class Variance:
    """Covariance of a place and its velocity, as four numbers. A constant-velocity filter of several coordinates falls apart into such pairs, since none of
    its matrices ties one coordinate to another, and coordinates with equal noise share one."""

    __slots__ = ("a", "b", "c", "d", "q", "qv", "r")

    def __init__(self, place: float, velocity: float, q: float, qv: float, r: float):
        self.a, self.b, self.c, self.d, self.q, self.qv, self.r = place, 0.0, 0.0, velocity, q, qv, r

    def predict(self) -> None:
        self.a, self.b = (self.a + self.c) + (self.b + self.d) + self.q, self.b + self.d
        self.c, self.d = self.c + self.d, self.d + self.qv

    def update(self) -> tuple[float, float]:
        """The gains of place and velocity."""
        inverse = 1.0 / (self.a + self.r)
        k, kv = self.a * inverse, self.c * inverse
        self.c, self.d = self.c - kv * self.a, self.d - kv * self.b
        self.a, self.b = (1.0 - k) * self.a, (1.0 - k) * self.b
        return k, kv


def matrix(parts: list[Variance]) -> list[float]:
    """The whole covariance, row by row: places first, then velocities."""
    n = len(parts)
    out = np.zeros((2 * n, 2 * n))
    for i, p in enumerate(parts):
        out[i, i], out[i, i + n], out[i + n, i], out[i + n, i + n] = p.a, p.b, p.c, p.d
    return out.ravel().tolist()


def from_matrix(part: Variance, values: list, i: int, n: int) -> None:
    """Take the ``i``-th of ``n`` coordinates from a whole covariance."""
    w = 2 * n
    part.a, part.b, part.c, part.d = (float(values[j]) for j in (i * w + i, i * w + i + n, (i + n) * w + i, (i + n) * w + i + n))


class Filter:
    """Constant-velocity Kalman filter of one box: centre, size and their changes."""

    __slots__ = ("x", "v", "id", "age", "centre", "size")

    def __init__(self, box: tuple, ident: int):
        self.x, self.v, self.id, self.age = self.measure(box), [0.0] * 4, ident, 0
        # Variances at the start, of a step, and of a measurement.
        self.centre, self.size = Variance(10.0, 100.0, 1.0, 0.1, 1.0), Variance(20.0, 100.0, 10.0, 1.0, 10.0)

    @staticmethod
    def measure(box: tuple) -> list[float]:
        return [(box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1]]

    def predict(self) -> None:
        self.x = list(map(add, self.x, self.v))
        self.centre.predict()
        self.size.predict()
        self.age += 1

    def update(self, box: tuple) -> None:
        (k, kv), (s, sv) = self.centre.update(), self.size.update()
        d = list(map(sub, self.measure(box), self.x))
        x, v = self.x, self.v
        self.x = [x[0] + k * d[0], x[1] + k * d[1], x[2] + s * d[2], x[3] + s * d[3]]
        self.v = [v[0] + kv * d[0], v[1] + kv * d[1], v[2] + sv * d[2], v[3] + sv * d[3]]
        self.age = 0

    @property
    def box(self) -> tuple:
        cx, cy, w, h = self.x
        return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


class Kalman:
    """Predict, drop filters unmatched for over ``max_age`` frames, match at ``least`` IoU, update; every live filter is given out.

    Only frames with detections count, so that a filter ages by them alone."""

    VISITS, STATE = "seen", "next long, ids array<long>, ages array<long>, x array<double>, covariance array<double>"

    def __init__(self, n: int = 9, least: float = 0.2, max_age: int = 5):
        self.n, self.least, self.max_age, self.next = n, least, max_age, 1
        self.live: list[Filter] = []

    def dump(self) -> tuple:
        covariance = [v for f in self.live for v in matrix([f.centre, f.centre, f.size, f.size])]
        return self.next, [f.id for f in self.live], [f.age for f in self.live], [v for f in self.live for v in (*f.x, *f.v)], covariance

    def load(self, next_id: int, ids: list, ages: list, x: list, covariance: list) -> None:
        self.next, self.live = next_id, []
        for i, (ident, age) in enumerate(zip(ids, ages)):
            f = Filter((0.0,) * 4, int(ident))
            f.age, f.x, f.v = int(age), [float(v) for v in x[8 * i : 8 * i + 4]], [float(v) for v in x[8 * i + 4 : 8 * i + 8]]
            from_matrix(f.centre, covariance[64 * i : 64 * i + 64], 0, 4)
            from_matrix(f.size, covariance[64 * i : 64 * i + 64], 2, 4)
            self.live.append(f)

    def update(self, boxes: list[tuple], conf: list[float]) -> list[tuple[int, tuple, float]]:
        boxes, _ = best_n(boxes, conf, self.n)
        for f in self.live:
            f.predict()
        self.live = [f for f in self.live if f.age <= self.max_age]
        free = [True] * len(boxes)
        if self.live and boxes:
            table = overlaps([f.box for f in self.live], boxes)
            for row, column in enumerate(cheapest(table)):
                if column >= 0 and table[row][column] >= self.least:
                    self.live[row].update(boxes[column])
                    free[column] = False
        for box, new in zip(boxes, free):
            if new:
                self.live.append(Filter(box, self.next))
                self.next += 1
        return [(f.id, f.box, 1.0) for f in self.live]


class Single:
    """One target: position and velocity, predicted in every frame from the first on. The first detection sets the position alone; later
    ones update. Gives the detection's confidence, or 0.5 when coasting; nothing before the first detection."""

    VISITS, STATE = "all", "x array<double>, covariance array<double>, ready boolean"

    def __init__(self) -> None:
        self.x, self.ready = [0.0] * 4, False
        self.variance = Variance(1000.0, 1000.0, 0.001, 0.001, 5.0)

    def dump(self) -> tuple:
        return list(self.x), matrix([self.variance, self.variance]), self.ready

    def load(self, x: list, covariance: list, ready: bool) -> None:
        self.x, self.ready = [float(v) for v in x], bool(ready)
        from_matrix(self.variance, covariance, 0, 2)

    def update(self, boxes: list[tuple], conf: list[float]) -> list[tuple[int, tuple, float]]:
        best = int(np.argmax(conf)) if len(conf) else -1
        at = ((boxes[best][0] + boxes[best][2]) / 2, (boxes[best][1] + boxes[best][3]) / 2) if best >= 0 else None
        x, y, vx, vy = self.x
        x, y = x + vx, y + vy
        self.variance.predict()
        if not self.ready:
            if at is not None:
                (x, y), self.ready = at, True
        elif at is not None:
            k, kv = self.variance.update()
            dx, dy = at[0] - x, at[1] - y
            x, y, vx, vy = x + k * dx, y + k * dy, vx + kv * dx, vy + kv * dy
        self.x = [x, y, vx, vy]
        return [(1, (x, y, x, y), float(conf[best]) if best >= 0 else 0.5)] if self.ready else []


#: Trackers by name.
METHODS: dict[str, Callable] = {"slots": Slots, "gated": Gated, "kalman": Kalman, "single": Single}
OUT = "clip {0}, frame long, id long, x double, y double, w double, h double, conf double"


def step(tracker, columns: list[list]) -> list[tuple]:
    """One frame's detections (x, y, w, h, conf in order) through a tracker."""
    boxes = [(x, y, x + w, y + h) for x, y, w, h in zip(*columns[:4])]
    return [(i, b[0], b[1], b[2] - b[0], b[3] - b[1], c) for i, b, c in tracker.update(boxes, columns[4])]


class Walk:
    """A tracker's way through the frames of a clip, from ``first`` on (default: the first with a detection).

    ``visit`` tells what happens between two frames with detections: all, the tracker steps through every empty frame; once, through one of them,
    which is as good where an empty frame clears the state; seen, none. Each method has its own rule, which ``visit`` overrides.
    """

    def __init__(self, method: str, first: int | None = None, visit: str | None = None, **options):
        self.tracker = METHODS[method](**options)
        self.visit = visit or self.tracker.VISITS
        self.last = None if first is None else first - 1

    def __call__(self, frame: int, columns: list) -> list[tuple]:
        """Rows (frame, id, x, y, w, h, conf) for a frame's x, y, w, h and conf (lists of numbers or arrays), and for the empty frames before it."""
        out, frame = [], int(frame)
        columns = [c if isinstance(c, list) else np.asarray(c, float).tolist() for c in columns]
        gap = 0 if self.last is None else frame - self.last - 1
        if gap > 0 and self.visit != "seen":
            for number in range(self.last + 1, frame if self.visit == "all" else self.last + 2):
                out += [(number, *r) for r in step(self.tracker, [[]] * 5)]
        self.last = frame
        return out + [(frame, *r) for r in step(self.tracker, columns)]


def track(detections: DataFrame, method: str = "gated", max_gap: int | None = None, first: int | None = None, visit: str | None = None, **options) -> DataFrame:
    """Identities for detections (clip, frame, id as order, box, conf), from frame ``first`` on (default: the first with a
    detection). ``max_gap`` fills short gaps afterwards.

    A clip is scanned in order with the tracker's state alone in memory. Clips run in parallel; a method that forgets everything in an empty frame
    runs in parallel over its runs of consecutive frames as well.
    """
    kind, by = detections.schema["clip"].dataType.simpleString(), ["clip"]
    rows = detections.select("clip", "frame", "id", *(F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h", "conf")))
    schema = OUT.format(kind)
    if (visit or METHODS[method].VISITS) == "once":
        rows = rows.withColumn("_run", F.col("frame").cast("long") - F.dense_rank().over(Window.partitionBy("clip").orderBy("frame")))
        by, schema = ["clip", "_run"], schema.replace(", frame", ", _run long, frame", 1)
    out = scan_frames(rows, by, ["x", "y", "w", "h", "conf"], lambda key: Walk(method, first, visit, **options), schema, [F.desc("conf"), F.asc("id")], lists=True).drop("_run")
    return out if max_gap is None else fill_gaps(out, max_gap, whole=True)


def compare(detections: DataFrame, methods: dict[str, dict]) -> DataFrame:
    """Every method over every clip, with its name."""
    parts = [track(detections, **options).select(F.lit(name).alias("method"), "clip", "frame", "id", "x", "y", "w", "h") for name, options in methods.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_into(detections: DataFrame, methods: dict[str, dict], path: str, force: bool = False) -> DataFrame:
    """Every method over every clip, stored below ``path`` by method and clip and read again. What is there already is not computed again unless forced.

    A method is one job, whose clips come whole or not at all, so a run that was lost goes on where it stopped.
    """
    for name, options in methods.items():
        todo = detections.withColumn("method", F.lit(name))
        todo = (todo if force else unfinished_rows(todo, path, ["method", "clip"])).drop("method")
        tracks = track(todo, **options).select(F.lit(name).alias("method"), "clip", "frame", "id", "x", "y", "w", "h")
        write_partitions(tracks, path, ["method", "clip"], ["frame", "id"])
    kind = detections.schema["clip"].dataType.simpleString()
    return detections.sparkSession.read.schema(f"method string, clip {kind}, frame long, id long, x double, y double, w double, h double").parquet(path)


def score_frames(frames: DataFrame, detect: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch: int = 32) -> DataFrame:
    """Detections of ``detect`` for batches of at most ``batch`` frames; it may keep a model between calls."""

    def run(parts):
        for pdf in parts:
            for i in range(0, len(pdf), batch):
                yield detect(pdf.iloc[i : i + batch])

    return frames.mapInPandas(run, schema)

"""Tracks as tables: best boxes, gap filling, frequent ids, trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BOX = ("x", "y", "w", "h")


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """``rows`` by ``keys`` to ``parts`` tasks, for tables that grow while Spark's number of shuffle partitions does not; None leaves them as they are."""
    return rows.repartition(parts, *keys) if parts else rows


def top_n(boxes: DataFrame, n: int, least_conf: float = 0.0, parts: int | None = None) -> DataFrame:
    """The ``n`` most confident boxes of each frame; ties by ``id``. ``parts``: tasks that share the frames."""
    best = Window.partitionBy("clip", "frame").orderBy(F.desc("conf"), "id")
    return dealt(boxes.where(F.col("conf") >= least_conf), parts, "clip", "frame").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def most_seen(boxes: DataFrame, n: int) -> DataFrame:
    """(clip, id, seen): the ``n`` ids of each clip that most frames have; ties to the lower id."""
    counts = boxes.groupBy("clip", "id").agg(F.count("*").alias("seen"))
    best = Window.partitionBy("clip").orderBy(F.desc("seen"), "id")
    return counts.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n).drop("_r")


def compact_ids(boxes: DataFrame) -> DataFrame:
    """Ids renumbered 1..N in order by clip."""
    ids = boxes.select("clip", "id").distinct().withColumn("new_id", F.row_number().over(Window.partitionBy("clip").orderBy("id")))
    return boxes.join(ids, ["clip", "id"]).withColumn("id", F.col("new_id")).drop("new_id")


def postfilter(boxes: DataFrame, n: int, parts: int | None = None) -> DataFrame:
    """Clean another tracker's output: top ``n`` a frame, then the ``n`` most seen ids, renumbered. ``parts``: tasks that share the frames, and the tracks."""
    kept = top_n(boxes, n, parts=parts).drop("rank")
    seen = most_seen(kept, n).select("clip", "id")  # each once, so that an inner join, which stays behind the dealing, keeps every box once
    return compact_ids(dealt(kept, parts, "clip", "id").join(seen, ["clip", "id"]))


#: What a filled row has in columns other than its box.
FILLED = {"conf": 1.0, "class": 1, "vis": -1.0}


def fill_gaps(tracks: DataFrame, max_gap: int = 30, whole: bool = False, parts: int | None = None) -> DataFrame:
    """Linear positions for missing frames of each track, with ``filled`` marking them.

    By default the first ``max_gap`` frames of every gap are filled, longer gaps included; with ``whole`` a gap is
    filled if it has at most ``max_gap`` frames and else left empty. Of several boxes in a frame the first stays. ``conf``, ``class``
    and ``vis`` are carried where they are there; filled rows, and rows without a value, have 1, 1 and -1. Both windows take the
    tracks as they are dealt once; ``parts``: tasks that share them.
    """
    more = [c for c in FILLED if c in tracks.columns]
    own = Window.partitionBy("clip", "id")
    first = Window.partitionBy("clip", "id", "frame").orderBy(*BOX)
    by_track = dealt(tracks, parts, "clip", "id") if parts else tracks.repartition("clip", "id")
    once = by_track.withColumn("_k", F.row_number().over(first)).where("_k = 1").select("clip", "id", "frame", *BOX, *more)
    order = own.orderBy("frame")
    ahead = once.withColumn("_next", F.lead(F.struct("frame", *BOX)).over(order))
    gap = F.col("_next.frame") - F.col("frame") - 1
    count = F.when(gap <= max_gap, gap).otherwise(F.lit(0)) if whole else F.least(gap, F.lit(max_gap))
    steps = F.when(gap > 0, F.sequence(F.lit(0), count)).otherwise(F.array(F.lit(0)))
    rows = ahead.withColumn("_s", F.explode(F.transform(steps, lambda s: s.cast("int"))))
    t = F.col("_s") / (F.col("_next.frame") - F.col("frame"))
    place = lambda c: F.when(F.col("_s") > 0, F.col(c) + (F.col(f"_next.{c}") - F.col(c)) * t).otherwise(F.col(c)).alias(c)
    value = lambda c: F.when(F.col("_s") > 0, F.lit(FILLED[c])).otherwise(F.coalesce(c, F.lit(FILLED[c]))).cast(tracks.schema[c].dataType).alias(c)
    return rows.select("clip", "id", (F.col("frame") + F.col("_s")).alias("frame"), *map(place, BOX), *map(value, more), (F.col("_s") > 0).alias("filled"))


def track_table(filled: DataFrame, times: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Narrow types for storage. Rows without confidence or class have 1. ``times`` (clip, frame, unix) adds ``unix_time``, NaN where unknown; ``parts``: tasks that share that join."""
    c = F.col
    or_one = lambda k: c(k) if k in filled.columns else F.lit(1.0)
    out = filled.select("clip", c("frame").cast("int"), c("id").cast("smallint"), *(c(k).cast("float") for k in BOX), or_one("conf").cast("float").alias("conf"), or_one("class").cast("tinyint").alias("class"))
    if times is None:
        return out
    at = times.select("clip", c("frame").cast("int").alias("frame"), c("unix").cast("double").alias("unix_time"))
    return dealt(out, parts, "clip", "frame").join(dealt(at, parts, "clip", "frame"), ["clip", "frame"], "left").withColumn("unix_time", F.coalesce("unix_time", F.lit(float("nan"))))


def trail(boxes: DataFrame, length: int = 20) -> DataFrame:
    """The last ``length`` integer centres of each track."""
    back = Window.partitionBy("clip", "id").orderBy("frame").rowsBetween(1 - length, 0)
    point = F.struct((F.col("x") + F.floor(F.col("w") / 2)).cast("int").alias("cx"), (F.col("y") + F.floor(F.col("h") / 2)).cast("int").alias("cy"))
    return boxes.select("clip", "id", "frame", F.collect_list(point).over(back).alias("trail"))


def hold_last(frames: DataFrame, value: str, every: int) -> DataFrame:
    """The value of the last frame whose number is a multiple of ``every``."""
    seen = F.when(F.col("frame") % every == 0, F.col(value))
    back = Window.partitionBy("clip", "id").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("held", F.last(seen, ignorenulls=True).over(back))


def context(frames: DataFrame, value: str, length: int) -> DataFrame:
    """The last ``length`` values; a missing head is filled with the oldest."""
    back = Window.partitionBy("clip", "id").orderBy("frame").rowsBetween(1 - length, 0)
    some = F.collect_list(value).over(back)
    return frames.withColumn("_c", some).withColumn("context", F.concat(F.array_repeat(F.get("_c", F.lit(0)), F.lit(length) - F.size("_c")), "_c")).drop("_c")


def mot_line(frame: Column, ident: Column, box: tuple[Column, ...], base: int = 1) -> Column:
    """``frame,id,x,y,w,h,-1,-1,-1`` with two places."""
    return F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,-1,-1,-1", (frame + (base - 0)).cast("long"), ident.cast("long"), *(b.cast("double") for b in box))


def mot_row(frame: Column, ident: Column, box: tuple[Column, ...], conf: Column, cls: Column) -> Column:
    """The stored form of eight columns, without a header: ``frame,id,x,y,w,h,conf,class``, numbers with two places."""
    return F.format_string("%d,%d,%.2f,%.2f,%.2f,%.2f,%.2f,%d", frame.cast("long"), ident.cast("long"), *(b.cast("double") for b in box), conf.cast("double"), cls.cast("int"))


def frames_of(*tables: DataFrame) -> DataFrame:
    """(clip, frame) of every frame that any of the tables has."""
    out = tables[0].select("clip", "frame")
    for t in tables[1:]:
        out = out.unionByName(t.select("clip", "frame"))
    return out.distinct()


def shared_tracks(boxes: DataFrame) -> DataFrame:
    """(clip, frame, n): tracks that a frame shares with the one before."""
    before = boxes.select("clip", "id", (F.col("frame") + 1).alias("frame"))
    return boxes.select("clip", "id", "frame").join(before, ["clip", "id", "frame"]).groupBy("clip", "frame").agg(F.count("*").alias("n"))


def explode_keypoints(boxes: DataFrame) -> DataFrame:
    """A row a keypoint of ``keypoints`` (array of label, x, y, likelihood)."""
    return boxes.select("clip", "frame", "id", F.explode("keypoints").alias("k")).select("clip", "frame", "id", "k.*")


def to_boxes(points: DataFrame) -> DataFrame:
    """The box around each animal's keypoints."""
    x, y = F.min("x"), F.min("y")
    return points.groupBy("clip", "frame", "id").agg(x.alias("x"), y.alias("y"), (F.max("x") - x).alias("w"), (F.max("y") - y).alias("h"))

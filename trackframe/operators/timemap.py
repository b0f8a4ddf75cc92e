"""Frames and wall-clock time: anchors, interpolation, roll-over and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interpolate(anchors: DataFrame, probes: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """Piecewise-linear ``value`` at each probe, held at the ends; one shuffle of anchors and probes by ``by``.

    A probe at an anchor takes that anchor's value. Probes of a ``by`` without anchors get null.
    """
    a = anchors.groupBy(by, at).agg(F.min(value).alias("_v")).select(by, F.col(at).cast("double").alias("_p"), "_v", F.lit(0).alias("_kind"), F.lit(None).cast(probes.schema[at].dataType).alias(at))
    p = probes.select(by, F.col(at).cast("double").alias("_p"), F.lit(None).cast("double").alias("_v"), F.lit(1).alias("_kind"), at)
    both = a.unionByName(p)
    anchor = F.when(F.col("_kind") == 0, F.struct("_p", "_v"))
    back = Window.partitionBy(by).orderBy("_p", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(by).orderBy("_p", "_kind").rowsBetween(0, Window.unboundedFollowing)
    both = both.withColumns({"_lo": F.last(anchor, ignorenulls=True).over(back), "_hi": F.first(anchor, ignorenulls=True).over(ahead)})
    line = F.col("_lo._v") + (F.col("_hi._v") - F.col("_lo._v")) * (F.col("_p") - F.col("_lo._p")) / (F.col("_hi._p") - F.col("_lo._p"))
    out = F.when(F.col("_lo._p") == F.col("_p"), F.col("_lo._v")).otherwise(F.coalesce(line, F.col("_lo._v"), F.col("_hi._v")))
    return both.where("_kind = 1").select(by, at, out.alias(value))


def frame_to_unix(anchors: DataFrame, probes: DataFrame) -> DataFrame:
    return interpolate(anchors, probes, "video", "frame", "unix")


def unix_to_frame(anchors: DataFrame, probes: DataFrame) -> DataFrame:
    """Nearest frame, half to even."""
    rows = interpolate(anchors.withColumn("frame", F.col("frame").cast("double")), probes, "video", "unix", "frame")
    return rows.withColumn("frame", F.bround("frame").cast("long"))


def nearest_anchor(anchors: DataFrame, probes: DataFrame, value: str) -> DataFrame:
    """``value`` of the anchor with the least distance in frames; of two as near, the earlier."""
    a = anchors.select("video", "frame", F.struct("frame", value).alias("_a"), F.lit(0).alias("_kind"))
    p = probes.select("video", "frame", F.lit(None).cast(a.schema["_a"].dataType).alias("_a"), F.lit(1).alias("_kind"))
    back = Window.partitionBy("video").orderBy("frame", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("video").orderBy("frame", "_kind").rowsBetween(0, Window.unboundedFollowing)
    both = a.unionByName(p).withColumns({"_lo": F.last("_a", ignorenulls=True).over(back), "_hi": F.first("_a", ignorenulls=True).over(ahead)})
    lo = F.col("_hi").isNull() | (F.col("frame") - F.col("_lo.frame") <= F.col("_hi.frame") - F.col("frame"))
    return both.where("_kind = 1").select("video", "frame", F.when(lo, F.col(f"_lo.{value}")).otherwise(F.col(f"_hi.{value}")).alias(value))


def last_anchor(anchors: DataFrame, probes: DataFrame, value: str) -> DataFrame:
    """``value`` of the last anchor at or before each probe."""
    a = anchors.select("video", "frame", F.col(value), F.lit(0).alias("_kind"))
    p = probes.select("video", "frame", F.lit(None).cast(anchors.schema[value].dataType).alias(value), F.lit(1).alias("_kind"))
    back = Window.partitionBy("video").orderBy("frame", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(p).withColumn("_v", F.last(value, ignorenulls=True).over(back))
    return both.where("_kind = 1").select("video", "frame", F.col("_v").alias(value))


def day_offsets(readings: DataFrame) -> DataFrame:
    """(video, frame, day_offset): one day more from each reading whose time of day ``tod`` falls by over 12 hours; unread rows are left out."""
    order = Window.partitionBy("video").orderBy("frame")
    read = readings.where("tod IS NOT NULL").withColumn("_fall", (F.col("tod") - F.lag("tod").over(order) < -43200).cast("int"))
    return read.withColumn("day_offset", F.coalesce(F.sum("_fall").over(order.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long")).drop("_fall")


def monotone(anchors: DataFrame) -> DataFrame:
    """Anchors later than every anchor before them; those without a time go."""
    before = Window.partitionBy("video").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    known = anchors.where("unix IS NOT NULL").withColumn("_m", F.max("unix").over(before))
    return known.where("_m IS NULL OR unix > _m").drop("_m")


def with_seconds(anchors: DataFrame, fixed: Column) -> DataFrame:
    """Anchors whose missing time is ``fixed`` where that is known: readings that only lacked their seconds, marked ``seconds`` in ``fix``."""
    known = F.col("unix").isNull() & fixed.isNotNull()
    return anchors.withColumns({"unix": F.coalesce("unix", fixed), "fix": F.when(known, "seconds")})


def repair(anchors: DataFrame, mode: str = "reference", tolerance: float = 120.0) -> DataFrame:
    """(video, frame, unix, fix): missing times interpolated over the monotone anchors.

    reference: known times stay as they are. repair: those off by more than ``tolerance`` seconds are replaced too.
    With fewer than two clean anchors a video stays unchanged. What ``fix`` says already stays for the other rows.
    """
    clean = monotone(anchors)
    enough = clean.groupBy("video").count().where("count >= 2").select("video")
    line = frame_to_unix(clean, anchors.select("video", "frame").distinct()).withColumnRenamed("unix", "_line")
    rows = anchors.join(line, ["video", "frame"]).join(enough.withColumn("_ok", F.lit(True)), "video", "left")
    missing = F.col("unix").isNull() & F.col("_ok")
    off = F.col("_ok") & (F.abs(F.col("unix") - F.col("_line")) > tolerance) if mode == "repair" else F.lit(False)
    fixed = F.coalesce(missing | off, F.lit(False))
    return rows.select("video", "frame", F.when(fixed, F.col("_line")).otherwise(F.col("unix")).alias("unix"), F.when(fixed & F.col("unix").isNull(), "interpolated").when(fixed, "outlier").otherwise(F.col("fix") if "fix" in anchors.columns else F.lit(None)).alias("fix"))


def accuracy(checks: DataFrame) -> DataFrame:
    """Mean, median and largest |delta|, the share below 2 s, and PASS from 95 % on."""
    d = F.abs("delta")
    share = F.avg((d < 2).cast("double"))
    return checks.groupBy("video").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean_abs"), F.round(F.percentile(d, 0.5), 6).alias("median_abs"), F.round(F.max(d), 6).alias("max_abs"), F.round(share, 6).alias("share_ok"), F.when(share >= 0.95, "PASS").otherwise("FAIL").alias("verdict"))


def repair_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """By video: missing before and after, repaired by their seconds, interpolated, the share of both in percent (0 where nothing was missing),
    and steps back in time after repair; equal times are none."""
    order = Window.partitionBy("video").orderBy("frame")
    b = before.groupBy("video").agg(F.count_if(F.col("unix").isNull()).alias("missing_before"))
    known = after.where("unix IS NOT NULL").withColumn("_bad", (F.col("unix") < F.lag("unix").over(order)).cast("int"))
    bad = known.groupBy("video").agg(F.coalesce(F.sum("_bad"), F.lit(0)).alias("violations"))
    a = after.groupBy("video").agg(F.count_if(F.col("unix").isNull()).alias("missing_after"), F.count_if(F.col("fix") == "seconds").alias("repaired"), F.count_if(F.col("fix") == "interpolated").alias("interpolated"))
    out = b.join(a, "video").join(bad, "video", "left").na.fill(0, ["violations"])
    percent = F.round(100.0 * (F.col("repaired") + F.col("interpolated")) / F.greatest("missing_before", F.lit(1)), 4)
    return out.select("video", "missing_before", "missing_after", "repaired", "interpolated", percent.alias("recovery"), "violations")


def spans(anchors: DataFrame, videos: DataFrame) -> DataFrame:
    """Time of frame 0 and of the last frame, hours between them, and anchors of each video (video, total_frames) with two anchors or more."""
    known = anchors.where("unix IS NOT NULL")
    enough = known.groupBy("video").agg(F.count("*").alias("n_samples")).where("n_samples >= 2")
    ends = videos.join(enough, "video").select("video", "n_samples", F.explode(F.array(F.struct(F.lit(0).cast("long").alias("frame"), F.lit(True).alias("first")), F.struct((F.col("total_frames") - 1).cast("long").alias("frame"), F.lit(False).alias("first")))).alias("e")).select("video", "n_samples", "e.*")
    kind = anchors.schema["frame"].dataType
    at = frame_to_unix(known, ends.select("video", F.col("frame").cast(kind).alias("frame")).distinct())
    both = ends.withColumn("frame", F.col("frame").cast(kind)).join(at, ["video", "frame"]).groupBy("video").agg(F.max(F.when(F.col("first"), F.col("unix"))).alias("start"), F.max(F.when(~F.col("first"), F.col("unix"))).alias("end"), F.max("n_samples").alias("n_samples"))
    return both.select("video", "start", "end", F.round((F.col("end") - F.col("start")) / 3600, 6).alias("hours"), "n_samples")


def range_hours(ranges: DataFrame) -> DataFrame:
    """Ranges and their hours by video (video, range_start, range_end in seconds)."""
    return ranges.groupBy("video").agg(F.count("*").alias("n_ranges"), F.round(F.sum(F.col("range_end") - F.col("range_start")) / 3600, 6).alias("hours"))

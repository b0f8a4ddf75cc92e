"""Recording intervals and stimuli: gaps, classes, overlap, calendar days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def recording_gaps(valid: DataFrame, least: float = 120.0) -> DataFrame:
    """Pauses of more than ``least`` seconds between consecutive recordings of a group."""
    nxt = F.lead("start_ts").over(Window.partitionBy("grp").orderBy("start_ts"))
    return valid.withColumn("gap_end", nxt).where(F.col("gap_end") - F.col("end_ts") > least).select("grp", F.col("end_ts").alias("gap_start"), "gap_end")


def spanning(spans: DataFrame, gaps: DataFrame) -> DataFrame:
    """Spans (grp, a, b) that a gap cuts: a < gap end and b > gap start.

    Of the gaps that start before b only the latest end matters: one union ordered by time, no pairs of spans and gaps.
    """
    g = gaps.select("grp", F.col("gap_start").alias("_t"), F.lit(1).alias("_kind"), "gap_end")
    s = spans.select("grp", F.col("b").alias("_t"), F.lit(0).alias("_kind"), F.struct(*spans.columns).alias("_row"))
    before = Window.partitionBy("grp").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = s.unionByName(g, allowMissingColumns=True).withColumn("_end", F.max("gap_end").over(before))
    return both.where((F.col("_kind") == 0) & (F.col("_row.a") < F.col("_end"))).select("_row.*")


def before_gaps(events: DataFrame, gaps: DataFrame) -> DataFrame:
    """The last event before each gap's start; an event at the very start is not before it."""
    e = events.select("grp", F.col("start_ts").alias("_t"), F.lit(1).alias("_kind"), F.col("start_ts").alias("last_event"))
    g = gaps.select("grp", F.col("gap_start").alias("_t"), F.lit(0).alias("_kind"), "gap_start")
    before = Window.partitionBy("grp").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(g, allowMissingColumns=True).withColumn("last_event", F.max("last_event").over(before))
    return both.where("_kind = 0 AND last_event IS NOT NULL").select("grp", "gap_start", "last_event").distinct()


def onset_classes(events: DataFrame, gaps: DataFrame, near: float = 600.0, far: float = 4320.0) -> DataFrame:
    """(grp, a, b, seconds, kind, interval) of every event at a; b, seconds and interval are null for a group's last.

    interval: skip where a gap cuts the way to the next onset, cluster below ``near``, drift above ``far``, else normal.
    kind: cluster for the events at both ends of an interval below ``near``, pre_reboot for another that is the last before
    a gap, else normal.
    """
    order = Window.partitionBy("grp").orderBy("start_ts")
    rows = events.select("grp", F.col("start_ts").alias("a"), F.lead("start_ts").over(order).alias("b"), F.lag("start_ts").over(order).alias("_before"))
    cut = spanning(rows.where("b IS NOT NULL").select("grp", "a", "b"), gaps).distinct().withColumn("cut", F.lit(True))
    last = before_gaps(events, gaps).select("grp", F.col("last_event").alias("a")).distinct().withColumn("last", F.lit(True))
    rows = rows.join(cut, ["grp", "a", "b"], "left").join(last, ["grp", "a"], "left")
    gap = F.col("b") - F.col("a")
    interval = F.when(F.col("b").isNull(), F.lit(None)).when(F.col("cut"), "skip").when(gap < near, "cluster").when(gap > far, "drift").otherwise("normal")
    kind = F.when((gap < near) | (F.col("a") - F.col("_before") < near), "cluster").when(F.col("last"), "pre_reboot").otherwise("normal")
    return rows.select("grp", "a", "b", F.round(gap, 6).alias("seconds"), kind.alias("kind"), interval.alias("interval"))


def rolling_mean(points: DataFrame, width: int = 10) -> DataFrame:
    """Mean of each full window of ``width`` points, for groups with more points than that."""
    order = Window.partitionBy("grp").orderBy("a")
    rows = points.withColumns({"_n": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy("grp")), "mean": F.avg("seconds").over(order.rowsBetween(1 - width, 0))})
    return rows.where((F.col("_n") >= width) & (F.col("_all") > width)).select("grp", "a", F.round("mean", 6).alias("mean"))


def by_day(spans: DataFrame) -> DataFrame:
    """Intervals cut at midnights (UTC): day, first and last hour."""
    at = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long"))
    days = spans.withColumn("day", F.explode(F.sequence(F.to_date(at("start_ts")), F.to_date(at("end_ts")))))
    begin = F.unix_micros(F.col("day").cast("timestamp")) / F.lit(1e6)
    out = days.select("grp", "day", F.round(F.greatest(F.col("start_ts") - begin, F.lit(0.0)) / 3600, 6).alias("from_hour"), F.round(F.least(F.col("end_ts") - begin, F.lit(86400.0)) / 3600, 6).alias("to_hour"))
    return out.where("to_hour > from_hour")


def interval_summary(classes: DataFrame) -> DataFrame:
    """By group of ``onset_classes``: onsets by interval, those before a gap, and the mean seconds of all but skipped ones."""
    counts = [F.count_if(F.col("interval") == k).alias(k) for k in ("skip", "cluster", "drift", "normal")]
    mean = F.round(F.avg(F.when(F.col("interval") != "skip", F.col("seconds"))), 6)
    return classes.groupBy("grp").agg(*counts, F.count_if(F.col("kind") == "pre_reboot").alias("pre_reboot"), mean.alias("mean"))


def duration_class(seconds: Column, intended: float) -> Column:
    """Within 10 % normal, up to half more long, beyond that very_long, else short."""
    part = seconds / intended
    return F.when(part < 0.9, "short").when(part <= 1.1, "normal").when(part <= 1.5, "long").otherwise("very_long")


def duration_summary(spans: DataFrame, intended: float) -> DataFrame:
    d = F.col("end_ts") - F.col("start_ts")
    ok = F.abs(d - intended) <= 0.1 * intended
    return spans.groupBy("grp").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("mean"), F.round(F.percentile(d, 0.5), 6).alias("median"), F.round(F.min(d), 6).alias("least"), F.round(F.max(d), 6).alias("most"), F.count_if(ok).alias("n_ok"), F.round(F.avg(ok.cast("double")), 6).alias("share_ok"))

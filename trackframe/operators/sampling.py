"""Constrained random samples: clips with gaps and ranges, segments without overlap."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators.catalog import far_enough, in_valid_range
from trackframe.operators.ranks import seeded
from trackframe.operators.scratch import written

#: Slots of the unit interval for weighted draws.
SLOTS = 4096
#: Grid places of a video that one row holds.
PART = 1024


def uniform(seed: int, *parts) -> Column:
    """A number in [0, 1) from the hash of a seed and columns."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**8))


def draw_candidates(videos: DataFrame, tries: int, duration: float, seed: int, after: int = 0) -> DataFrame:
    """Candidate clips numbered ``after`` + 1 to ``tries``: a video with probability in proportion to its frames, then a start in [5, seconds - duration - 5]."""
    order = Window.orderBy("video")  # a row a video
    w = videos.withColumn("_hi", F.sum("frames").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("frames").over(Window.partitionBy()))
    w = w.select("video", "seconds", ((F.col("_hi") - F.col("frames")) / F.col("_all")).alias("_lo"), (F.col("_hi") / F.col("_all")).alias("_hi"))
    # Both sides meet in slots of the unit interval, so that a try sees only the videos of its slot.
    slot = lambda c: F.floor(F.least(c, F.lit(1 - 1e-12)) * SLOTS)
    w = w.withColumn("_slot", F.explode(F.sequence(slot(F.col("_lo")), slot(F.col("_hi")))))
    t = videos.sparkSession.range(after + 1, tries + 1).select(F.col("id").alias("try")).withColumns({"_u": uniform(seed, F.col("try"), "video"), "_s": uniform(seed, F.col("try"), "start")})
    picked = t.withColumn("_at", slot(F.col("_u"))).join(w, (F.col("_at") == F.col("_slot")) & (F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    start = F.lit(5.0) + F.col("_s") * (F.col("seconds") - duration - 10.0)
    return picked.select("try", "video", F.round(start, 6).alias("start_sec"), F.round(start + duration, 6).alias("end_sec"))


class _Taken:
    """Accepted intervals of a video in order. They never overlap, so a new one can only come too near to its two neighbours."""

    def __init__(self, gap: float):
        self.gap, self.starts, self.ends = gap, [], []

    def take(self, start: float, end: float) -> bool:
        at = bisect.bisect_left(self.starts, start)
        if at and start < self.ends[at - 1] + self.gap or at < len(self.starts) and end > self.starts[at] - self.gap:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def accepted(candidates: DataFrame, gap: float) -> DataFrame:
    """Candidates in order of their number that keep ``gap`` to all accepted before them in their video."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        taken, rows = _Taken(gap), pdf.sort_values("try")
        return rows[[taken.take(r.start_sec, r.end_sec) for r in rows.itertuples(index=False)]]

    rows = candidates.select("try", "video", "start_sec", "end_sec")
    return rows.groupBy("video").applyInPandas(one, rows.schema)


def accept(candidates: DataFrame, n: int, gap: float) -> DataFrame:
    """The first ``n`` accepted candidates."""
    return accepted(candidates, gap).orderBy("try").limit(n)


def sample_clips(videos: DataFrame, n: int, duration: float, seed: int, taken: DataFrame, ranges: DataFrame, anchored: DataFrame, gap: float = 60.0, most: int = 100) -> DataFrame:
    """``n`` clips (try, video, start_sec, end_sec) that keep ``gap`` to the ``taken`` ones and to each other and lie in a valid range.

    Tries come in rounds that double, from ``n`` on, until ``n`` are accepted or ``most`` times ``n`` are spent. A try depends on earlier ones alone, so
    rounds give what one long loop gives. Accepted clips of earlier rounds take part in the next one's order with their numbers.
    """
    schema = "try long, video string, start_sec double, end_sec double"
    kept, lo, hi = videos.sparkSession.createDataFrame([], schema), 0, n
    while lo < most * n:
        fresh = in_valid_range(far_enough(draw_candidates(videos, hi, duration, seed, lo), taken, gap), ranges, anchored)
        kept = written(accepted(kept.unionByName(fresh.select(*kept.columns)), gap), "accepted")
        if kept.count() >= n:
            break
        lo, hi = hi, min(2 * hi, most * n)
    return kept.orderBy("try").limit(n)


def audit_frames(videos: DataFrame, anchors: DataFrame, n: int, seed: int, grid: int = 100) -> DataFrame:
    """``n`` seeded frames a video (video, frames) for checking: multiples of ``grid`` that are no anchor of it (video, frame).

    A video's multiples come in parts of ``PART``, each one row that meets the anchors of its part and gives its first ``n`` alone; so neither the
    grid nor a long video's share of it is shuffled, and no join is broadcast by a size that was guessed before the parts were counted.
    """
    span = F.lit(grid * PART)
    last = F.floor((F.col("frames") - 1) / grid)
    parts = videos.where("frames > 0").select("video", last.alias("_last"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / PART))).alias("_p"))
    known = anchors.select("video", F.col("frame").cast("long").alias("frame")).where((F.col("frame") >= 0) & (F.col("frame") % grid == 0))
    known = known.groupBy("video", F.floor(F.col("frame") / span).alias("_p")).agg(F.collect_set("frame").alias("_known"))
    every = F.transform(F.sequence(F.col("_p") * PART, F.least(F.col("_last"), (F.col("_p") + 1) * PART - 1)), lambda k: k * grid)
    free = F.array_except(every, F.coalesce("_known", F.array().cast("array<bigint>")))
    hashed = F.transform(free, lambda f: F.struct(seeded(seed, F.col("video"), f).alias("_h"), f.alias("frame")))
    first = parts.join(known.hint("merge"), ["video", "_p"], "left").select("video", F.explode(F.slice(F.sort_array(hashed), 1, n)).alias("c")).select("video", "c.*")
    place = F.row_number().over(Window.partitionBy("video").orderBy("_h", "frame"))
    return first.withColumn("_r", place).where(F.col("_r") <= n).select("video", "frame")


def segments(spans: DataFrame, n: int, length: int, seed: int) -> DataFrame:
    """``n`` segments of ``length`` frames for each video (video, first, last), without overlap and sorted; as many as fit where fewer do, the whole range where it is shorter.

    The frames that no segment takes are dealt by sorted seeded numbers, so that every draw fits.
    """
    size = F.col("last") - F.col("first") + 1
    k = F.least(F.lit(n), F.floor(size / length))
    free = size - k * length
    at = F.array_sort(F.transform(F.sequence(F.lit(1), k), lambda i: F.floor(uniform(seed, F.col("video"), i) * (free + 1))))
    some = F.transform(at, lambda x, i: F.struct((F.col("first") + x + i * length).cast("long").alias("first"), (F.col("first") + x + (i + 1) * length - 1).cast("long").alias("last")))
    all_of = F.array(F.struct(F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last")))
    return spans.select("video", F.explode(F.when(size <= length, all_of).otherwise(some)).alias("s")).select("video", "s.first", "s.last")

"""Detection and tracking quality."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.operators.matching import assign, frame_pairs, match
from trackframe.operators.scratch import written

ALPHAS = [0.05 + i * 0.05 for i in range(19)]


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def totals(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """(clip, n_gt, n_pred) of every clip on either side."""
    one = lambda df, g, p: df.select("clip", F.lit(g).alias("g"), F.lit(p).alias("p"))
    return one(gt, 1, 0).unionByName(one(pred, 0, 1)).groupBy("clip").agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred"))


def detection_quality(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """TP, FP, FN, precision, recall and F1 (4 places, 0 where undefined) and identity switches by clip."""
    before = F.lag("pid").over(Window.partitionBy("clip", "gid").orderBy("frame"))
    hits = match(gt, pred, threshold).withColumn("_before", before).groupBy("clip").agg(F.count("*").alias("tp"), F.count_if(F.col("_before") != F.col("pid")).alias("idsw"))
    out = totals(gt, pred).join(hits, "clip", "left").na.fill(0, ["tp", "idsw"])
    tp, p, r = F.col("tp"), ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_gt"))
    return out.select("clip", "tp", (F.col("n_pred") - tp).alias("fp"), (F.col("n_gt") - tp).alias("fn"), "idsw", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"))


def fallback_mota(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """MOTA = 1 - (FP + FN + switches) / GT, and detection F1 under the name ``idf1_fallback``."""
    q = detection_quality(gt, pred, threshold)
    n = F.col("tp") + F.col("fn")
    mota = F.when(n > 0, 1 - (F.col("fp") + F.col("fn") + F.col("idsw")) / n).otherwise(F.lit(0.0))
    f1 = ratio(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fp") + F.col("fn"))
    return q.select("clip", F.round(mota, 4).alias("mota"), F.round(f1, 4).alias("idf1_fallback"), "idsw")


def hota(gt: DataFrame, pred: DataFrame, variant: str = "matched") -> DataFrame:
    """HOTA, DetA and AssA by clip, means over the thresholds 0.05 to 0.95, 4 places.

    The assignment is made once. ``variant`` matched: association counts matched frames only; published: all frames of either id.
    """
    matched = match(gt, pred, 0.0)
    reach = sum(((F.col("iou") >= a).cast("int") for a in ALPHAS), F.lit(0))
    pairs = matched.groupBy("clip", "gid", "pid", reach.alias("reach")).agg(F.count("*").alias("n"))
    by_alpha = pairs.where("reach > 0").withColumn("a", F.explode(F.sequence(F.lit(1), F.col("reach")))).groupBy("clip", "a", "gid", "pid").agg(F.sum("n").alias("tpa"))
    if variant == "published":
        size = lambda df, c, n: df.groupBy("clip", F.col("id").alias(c)).agg(F.count("*").alias(n))
        by_alpha = by_alpha.join(size(gt, "gid", "ng"), ["clip", "gid"]).join(size(pred, "pid", "np"), ["clip", "pid"])
    else:
        by_alpha = by_alpha.withColumns({"ng": F.sum("tpa").over(Window.partitionBy("clip", "a", "gid")), "np": F.sum("tpa").over(Window.partitionBy("clip", "a", "pid"))})
    share = F.col("tpa") * F.col("tpa") / (F.col("ng") + F.col("np") - F.col("tpa"))
    per_alpha = by_alpha.groupBy("clip", "a").agg(F.sum("tpa").alias("tp"), F.sum(share).alias("s"))
    grid = totals(gt, pred).withColumn("a", F.explode(F.sequence(F.lit(1), F.lit(len(ALPHAS))))).join(per_alpha, ["clip", "a"], "left").na.fill(0)
    det, ass = ratio(F.col("tp"), F.col("n_gt") + F.col("n_pred") - F.col("tp")), ratio(F.col("s"), F.col("tp"))
    return grid.groupBy("clip").agg(F.round(F.avg(F.sqrt(det * ass)), 4).alias("hota"), F.round(F.avg(det), 4).alias("deta"), F.round(F.avg(ass), 4).alias("assa"))


def components(pairs: DataFrame, write=None) -> DataFrame:
    """``pairs`` (clip, gid, pid, ...) with ``part``, the smallest gid that a chain of pairs of the clip leads to.

    Round after round a pair takes the smallest number among the pairs that share its pid, then its gid, and then the number that this number's own
    gid has by now, which halves the way along chains. ``write`` cuts the lineage of each round (default: a written table).
    """
    write = write or written
    now = write(pairs.withColumn("part", F.col("gid")))
    while True:
        over_p = now.withColumn("_p", F.min("part").over(Window.partitionBy("clip", "pid")))
        over_g = over_p.withColumn("_g", F.min("_p").over(Window.partitionBy("clip", "gid")))
        of = over_g.groupBy(F.col("clip").alias("_clip"), F.col("gid").alias("_gid")).agg(F.min("_g").alias("_at"))
        after = write(over_g.join(of, (F.col("clip") == F.col("_clip")) & (F.col("_g") == F.col("_gid"))).select(*pairs.columns, F.col("part").alias("_was"), F.least("_g", "_at").alias("part")))
        now = after.drop("_was")
        if after.where("part <> _was").isEmpty():
            return now


def idf1_global(gt: DataFrame, pred: DataFrame, threshold: float = 0.5) -> DataFrame:
    """IDF1 by the identity assignment with most frames in common.

    Ids that no chain of overlaps connects cannot compete, so each component of the id pairs of a clip is solved alone: a single pair needs no
    solver, and the clips of one long timeline spread over tasks by component.
    """
    overlap = frame_pairs(gt, pred).where(F.col("iou") >= threshold).groupBy("clip", "gid", "pid").agg(F.count("*").alias("n"))
    kind = {f.name: f.dataType.simpleString() for f in overlap.schema}
    parted = components(overlap).withColumn("_size", F.count("*").over(Window.partitionBy("clip", "part")))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        (gids, i), (pids, j) = np.unique(pdf["gid"], return_inverse=True), np.unique(pdf["pid"], return_inverse=True)
        table = np.zeros((len(gids), len(pids)))
        table[i, j] = pdf["n"]
        chosen = assign(-table)
        return pd.DataFrame({"clip": [pdf["clip"].iloc[0]], "idtp": [int(sum(table[a, b] for a, b in enumerate(chosen) if b >= 0))]})

    solved = parted.where("_size > 1").select("clip", "part", "gid", "pid", "n").groupBy("clip", "part").applyInPandas(best, f"clip {kind['clip']}, idtp long")
    idtp = parted.where("_size = 1").select("clip", F.col("n").alias("idtp")).unionByName(solved).groupBy("clip").agg(F.sum("idtp").alias("idtp"))
    out = totals(gt, pred).join(idtp, "clip", "left").na.fill(0, ["idtp"])
    return out.select("clip", "idtp", F.round(ratio(2.0 * F.col("idtp"), F.col("n_gt") + F.col("n_pred")), 4).alias("idf1"))


def one_timeline(gt: DataFrame, pred: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with all clips laid one after another as clip ``overall``: each starts after the last frame of those before it."""
    last = gt.select("clip", "frame").unionByName(pred.select("clip", "frame")).groupBy("clip").agg((F.max("frame") + 1).alias("span"))
    offset = last.withColumn("offset", F.coalesce(F.sum("span").over(Window.orderBy("clip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("clip", "offset")  # a row a clip
    shift = lambda df: df.join(offset, "clip").withColumn("frame", F.col("frame") + F.col("offset")).withColumn("clip", F.lit("overall")).drop("offset")
    return shift(gt), shift(pred)


def count_errors(boxes: DataFrame, target: int) -> DataFrame:
    """(clip, frames, missing): frames 1..last whose number of boxes is not ``target``; a frame without boxes counts as 0."""
    n = boxes.groupBy("clip", "frame").agg(F.count("*").alias("n"))
    return n.groupBy("clip").agg(F.max("frame").cast("long").alias("frames"), (F.max("frame") - F.count_if(F.col("n") == target)).cast("long").alias("missing"))



"""Keypoint heat maps in long form (frame, kp, yy, xx, logit)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAP = ("frame", "kp")


def softmax(cells: DataFrame) -> DataFrame:
    own = Window.partitionBy(*MAP)
    top = cells.withColumn("_e", F.exp(F.col("logit").cast("double") - F.max(F.col("logit").cast("double")).over(own)))
    return top.withColumn("p", F.col("_e") / F.sum("_e").over(own)).drop("_e")


def local_maxima(cells: DataFrame, value: str = "p") -> DataFrame:
    """Cells that no neighbour in the 3 x 3 around them exceeds: a row pass, then a column pass over it."""
    row = Window.partitionBy(*MAP, "yy").orderBy("xx").rangeBetween(-1, 1)
    column = Window.partitionBy(*MAP, "xx").orderBy("yy").rangeBetween(-1, 1)
    passed = cells.withColumn("_r", F.max(value).over(row)).withColumn("_m", F.max("_r").over(column))
    return passed.where(F.col(value) == F.col("_m")).drop("_r", "_m")


def peaks(cells: DataFrame, n: int = 3, least: float = 0.2) -> DataFrame:
    """Up to ``n`` local maxima of at least ``least`` of the map's largest value."""
    p = softmax(cells).withColumn("_top", F.max("p").over(Window.partitionBy(*MAP)))
    best = Window.partitionBy(*MAP).orderBy(F.desc("p"), "yy", "xx")
    return local_maxima(p).where(F.col("p") > least * F.col("_top")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n).select(*MAP, "rank", "yy", "xx", "p")

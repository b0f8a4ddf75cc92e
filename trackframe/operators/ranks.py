"""Places in a seeded or sorted order over whole tables, without putting a table or a large group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets of a group by the first digits of its hash.
BUCKETS = 4096


def seeded(seed: int, *parts: Column) -> Column:
    """Hex hash of a seed and values: a fixed random order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def placed(rows: DataFrame, order: Column, key: Column, by: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``_r``, the place (from 1) within ``by`` in the order of a hex hash, and ``_n``, the group's rows.

    A group is cut into buckets by its hash; places inside a bucket are counted in the bucket's task and added to the
    number of rows in the buckets before it.
    """
    hashed = rows.withColumn("_h", order).withColumn("_b", (F.conv(F.substring("_h", 1, 3), 16, 10).cast("int")))
    sizes = hashed.groupBy(*by, "_b").agg(F.count("*").alias("_m"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(by)), F.col("_b").alias("_at"), F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(group).alias("_n"))
    same = F.col("_b") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    within = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", key))
    out = hashed.withColumn("_k", within).join(offsets, same).withColumn("_r", F.col("_k") + F.col("_before"))
    return out.select(*rows.columns, "_r", "_n")

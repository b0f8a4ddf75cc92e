"""Line dedup over overlapping windows of three lines, with DataFrame functions alone.

Every three consecutive lines make a window, told by the MD5 of its text (128 bits). A window that also stands
earlier, in a document with a smaller key or before it in the same one, covers its three lines; covered lines go.

Null text stays null and counts as one line. Texts of fewer than three lines, empty ones among them, have no window and stay as they
are. Rows that share a key count as one document: the same positions go from each. A null key is smaller than all others. Very
long texts are cut into lines in one row and whole; an empty table gives an empty table. Other columns stay untouched whatever
their names, but for ``n_lines`` and ``n_removed``, which this operator replaces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackframe.llm.common import unused, written

KEY, COVERED = "key", "covered"


def _lines(text: str):
    return F.split(F.col(f"`{text}`"), "\n", -1)


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(KEY, COVERED): positions of the lines to remove, for documents that have any."""
    lines = docs.select(F.col(f"`{key}`").alias(KEY), _lines(text).alias("l")).where(F.size("l") >= width)
    window = F.transform(F.sequence(F.lit(0), F.size("l") - width), lambda i: F.struct(i.alias("pos"), F.unhex(F.md5(F.array_join(F.slice("l", i + 1, width), "\n").cast("binary"))).alias("h")))
    windows = lines.select(KEY, F.explode(window).alias("w")).select(KEY, "w.pos", "w.h")
    place = F.struct(KEY, "pos")
    # Written, so that the join stands on plain exchanges and a common window's rows can be split over tasks.
    firsts = written(windows.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") != F.col("last")).select("h", "first"), "firsts")
    later = windows.join(firsts, "h").where(place != F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + (width - 1)))))
    return later.groupBy(KEY).agg(covered.alias(COVERED))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """``docs`` with the covered lines removed from ``text``, and the columns ``n_lines`` and ``n_removed``."""
    own, gone, lines = unused(docs, "key"), unused(docs, "covered"), unused(docs, "lines")
    covered = repeated_lines(docs, key, text, width).select(F.col(KEY).alias(own), F.col(COVERED).alias(gone))
    cut = docs.withColumn(lines, _lines(text)).drop(text)  # the lines go through the join, the text does not
    joined = cut.join(covered, F.col(f"`{key}`").eqNullSafe(F.col(own)), "left")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    cleaned = F.when(F.col(gone).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col(lines), i)), "\n"))
    out = joined.withColumns({text: cleaned, "n_lines": F.coalesce(F.size(lines), F.lit(1)).cast("long"), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long")})
    columns = [text if c == text else c for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*(F.col(f"`{c}`") for c in columns), "n_lines", "n_removed")

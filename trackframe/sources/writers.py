"""Writers of tracking files and guarded table writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions.text import fingerprint, link_name
from trackframe.operators.tracks import mot_line, mot_row, track_table


def write_mot(tracks: DataFrame, path: str, base: int = 0) -> None:
    """One text folder a clip, lines in frame and id order; ``base`` is added to frames."""
    line = mot_line(F.col("frame"), F.col("id"), tuple(F.col(c) for c in "xywh"), base)
    tracks.repartition("clip").sortWithinPartitions("clip", "frame", "id").select("clip", line.alias("value")).write.partitionBy("clip").text(path)


def write_mot_rows(tracks: DataFrame, path: str) -> None:
    """The stored form of eight columns without a header (frame, id, x, y, w, h, conf, class), a folder a clip; without confidence or class 1."""
    c = lambda k: F.coalesce(F.col(k), F.lit(1)) if k in tracks.columns else F.lit(1)
    line = mot_row(F.col("frame"), F.col("id"), tuple(F.col(k) for k in "xywh"), c("conf"), c("class"))
    tracks.repartition("clip").sortWithinPartitions("clip", "frame", "id").select("clip", line.alias("value")).write.partitionBy("clip").text(path)


def finished(spark: SparkSession, path: str, by: Sequence[str], least_bytes: int = 1024) -> DataFrame:
    """Partitions (columns ``by``, as text) below ``path`` whose files have more than ``least_bytes`` together; contents are not read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in by))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path", "length")
    value = lambda c: F.url_decode(F.replace(F.regexp_extract("path", rf"/{c}=([^/]+)/", 1), F.lit("+"), F.lit("%2B")))
    return files.groupBy(*(value(c).alias(c) for c in by)).agg(F.sum("length").alias("_bytes")).where(F.col("_bytes") > least_bytes).drop("_bytes")


def unfinished_rows(rows: DataFrame, path: str, by: Sequence[str], least_bytes: int = 1024) -> DataFrame:
    """Rows whose partition below ``path`` is not there yet, or too small to be whole."""
    done = finished(rows.sparkSession, path, by, least_bytes).select(*(F.col(c).alias(f"_done_{c}") for c in by))
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c).cast("string") == F.col(f"_done_{c}"))
    return rows.join(done, same, "left_anti")


def write_partitions(rows: DataFrame, path: str, by: Sequence[str], order: Sequence[str] = ()) -> None:
    """Replace the partitions that ``rows`` has, each whole at the job's end, and leave all others."""
    rows.repartition(*by).sortWithinPartitions(*by, *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_tracks(filled: DataFrame, path: str, force: bool = False, times: DataFrame | None = None, resume: bool = False) -> None:
    """Narrow types, sorted by frame and id, zstd, a folder a clip.

    Where a clip is there already the write is refused; with ``resume`` such clips are skipped, with ``force`` they are replaced. Other clips stay as
    they are. ``times`` (clip, frame, unix) adds ``unix_time`` to the stored table.
    """
    fresh = filled if force else unfinished_rows(filled, path, ["clip"])
    if not force and not resume:
        there = finished(filled.sparkSession, path, ["clip"]).join(filled.select(F.col("clip").cast("string").alias("clip")).distinct(), "clip").limit(5).collect()
        if there:
            raise FileExistsError(f"{path} has clips already: {[r.clip for r in there]}")
    write_partitions(track_table(fresh, times), path, ["clip"], ["frame", "id"])


def write_detections(dets: DataFrame, path: str) -> None:
    """A folder a clip with one file."""
    r = lambda c, n: F.round(c, n).alias(c)
    dets.repartition("clip").select("clip", "frame_idx", *(r(c, 2) for c in ("x1", "y1", "x2", "y2")), r("conf", 4)).write.partitionBy("clip").option("header", True).csv(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """Append; no rows leave the table as it is."""
    if rows.limit(1).count():
        rows.write.mode("append").parquet(path)


def write_manifest(rows: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Columns in order, missing ones as empty text."""
    have = set(rows.columns)
    rows.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns)).write.option("header", True).option("emptyValue", "").csv(path)


def label_text(boxes: DataFrame) -> DataFrame:
    """One text a frame of label lines in order (clip, frame, line)."""
    return boxes.groupBy("clip", "frame").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("text"))


def score_report(scores: DataFrame) -> DataFrame:
    """(method, report JSON): ``overall`` and ``clips`` by name."""
    clips = F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("clip").isNotNull(), F.struct("clip", "metrics")))))
    overall = F.first(F.when(F.col("clip").isNull(), F.col("metrics")), ignorenulls=True)
    return scores.withColumn("metrics", F.to_json("metrics")).groupBy("method").agg(overall.alias("o"), clips.alias("c")).select("method", F.to_json(F.struct(F.from_json("o", "map<string,double>").alias("overall"), F.transform_values("c", lambda k, v: F.from_json(v, "map<string,double>")).alias("clips"))).alias("report"))


def video_index(videos: DataFrame) -> DataFrame:
    """(wave, n_videos, document): the wave's videos as nested JSON, sorted by path."""
    item = F.struct(*(F.col(c) for c in sorted(c for c in videos.columns if c != "wave")))
    return videos.groupBy("wave").agg(F.count("*").alias("n_videos"), F.to_json(F.sort_array(F.collect_list(item))).alias("document"))


def write_guarded(df: DataFrame, path: str, force: bool = False, partition_by: Sequence[str] = ()) -> None:
    """Never over existing data unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").partitionBy(*partition_by).parquet(path)


def update_rows(table: DataFrame, key: str, value, **changes) -> DataFrame:
    """``table`` with fields of one row changed; an unknown field is refused."""
    unknown = set(changes) - set(table.columns)
    if unknown:
        raise KeyError(f"unknown fields: {sorted(unknown)}")
    return table.select(*(F.when(F.col(key) == value, F.lit(changes[c])).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in table.columns))


def with_provenance(df: DataFrame, **fields) -> DataFrame:
    """Constant columns that say which run made the rows."""
    return df.withColumns({k: F.lit(v) for k, v in fields.items()})


def run_summary(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row a run: its provenance columns and its number of rows."""
    return rows.groupBy(*fields).agg(F.count("*").alias("n_rows"))


def write_metadata(rows: DataFrame, path: str) -> None:
    """JSON records, absent values left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def rebuild_index(found: DataFrame, path: str, key: str) -> None:
    """Write the index anew from metadata records: one row a key, the greatest where several are; records without the key go."""
    last = found.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*(c for c in found.columns if c != key))).alias("r"))
    last.select(key, "r.*").write.mode("overwrite").parquet(path)


def write_dataset(manifest: DataFrame, path: str, classes: Sequence[str] = ("animal",), recipe: str = "{}") -> DataFrame:
    """Write the manifest in a folder a split, and beside it what freezes the dataset; return the counts by split as written.

    ``dataset`` holds one JSON record: the class names in order, the recipe as given and its fingerprint, and the splits. A manifest with
    chamber, wave, clip and frame gets the name of each link in ``link``.
    """
    spark = manifest.sparkSession
    names = [c for c in ("chamber", "wave", "clip", "frame") if c in manifest.columns]
    rows = manifest.withColumn("link", link_name(*(F.col(c).cast("string") for c in names))) if len(names) == 4 else manifest
    rows.write.mode("errorifexists").partitionBy("split").parquet(f"{path}/manifest")
    counts = spark.read.parquet(f"{path}/manifest").groupBy("split").agg(F.count("*").alias("n"))
    splits = counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("split", "n")))).alias("splits"))  # a row a split
    record = splits.select(F.array(*map(F.lit, classes)).alias("classes"), F.lit(recipe).alias("recipe"), fingerprint(F.lit(recipe)).alias("recipe_hash"), "splits")
    record.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(f"{path}/dataset")
    return counts

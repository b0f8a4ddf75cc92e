"""Readers of tracking files; many files at once, the clip or video from the path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackframe.functions.text import stem

VIDEO_EXTENSIONS = ("mp4", "avi", "mkv", "mov", "webm")


def clip_of_path() -> Column:
    """The clip's folder (clip=...), else the file's stem."""
    path = F.col("_metadata.file_path")
    return F.coalesce(F.nullif(F.regexp_extract(path, r"/clip=([^/]+)/", 1), F.lit("")), stem(path))


def mot(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """MOT text: blanks and # lines skipped; ``strict`` drops lines of fewer than six fields, else they give nulls."""
    lines = spark.read.text(path).select(clip_of_path().alias("clip"), F.trim("value").alias("v")).where("v <> '' AND NOT v LIKE '#%'")
    parts = lines.select("clip", F.split("v", ",").alias("p"))
    if strict:
        parts = parts.where(F.size("p") >= 6)
    at = lambda i, t: F.trim(F.get("p", F.lit(i))).try_cast("double").cast(t)
    names = ["frame", "id", "x", "y", "w", "h", "conf"]
    return parts.select("clip", *(at(i, "long" if i < 2 else "double").alias(n) for i, n in enumerate(names)))


def detections_csv(spark: SparkSession, path: str) -> DataFrame:
    """frame_idx, x1, y1, x2, y2, conf with a header, frames from 0."""
    fields = ["frame_idx", "x1", "y1", "x2", "y2", "conf"]
    return spark.read.option("header", True).schema("frame_idx int, x1 double, y1 double, x2 double, y2 double, conf double").csv(path).select(clip_of_path().alias("clip"), *fields)


def tracks(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, frames: DataFrame | None = None) -> DataFrame:
    """Track Parquet with the frame range pushed to the scan, or the frames of another table."""
    out = spark.read.parquet(path)
    out = out if first is None else out.where(F.col("frame") >= first)
    out = out if last is None else out.where(F.col("frame") <= last)
    return out if frames is None else out.join(frames.select("frame").distinct(), "frame", "left_semi")


def json_documents(spark: SparkSession, path: str, kind: str, lines: bool = False) -> DataFrame:
    """Whole JSON files as one typed column ``doc``; with ``lines`` a file holds many documents, one a line."""
    return spark.read.text(path, wholetext=not lines).select(F.from_json("value", kind).alias("doc"), F.col("_metadata.file_path").alias("path"))


def anchors(spark: SparkSession, path: str) -> DataFrame:
    """Time anchors (video, frame, unix, ocr_raw) of videos with at least two samples; keys that start with _ are no videos."""
    docs = json_documents(spark, path, "map<string,struct<fps_nominal:double,total_frames:bigint,samples:array<struct<frame:bigint,ocr_raw:string,unix:double>>>>")
    rows = docs.select(F.explode("doc").alias("video", "v")).where(~F.col("video").startswith("_") & (F.size("v.samples") >= 2))
    return rows.select("video", "v.fps_nominal", F.explode("v.samples").alias("s")).select("video", "fps_nominal", "s.frame", "s.unix", "s.ocr_raw")


def rois(spark: SparkSession, path: str) -> DataFrame:
    """(video, corners) entry by entry: a corner's value that is no number is null, an entry that is no list of lists has null corners."""
    entries = json_documents(spark, path, "map<string,string>").select(F.explode("doc").alias("video", "v"))
    corners = F.transform(F.from_json("v", "array<array<string>>"), lambda p: F.transform(p, lambda x: x.try_cast("double")))
    return entries.select("video", corners.alias("corners"))


def roi_ok(corners: Column) -> Column:
    """Four corners of two numbers each."""
    return F.coalesce((F.size(corners) == 4) & F.forall(corners, lambda p: (F.size(p) == 2) & p[0].isNotNull() & p[1].isNotNull()), F.lit(False))


def valid_ranges(spark: SparkSession, path: str, zone: str = "America/New_York") -> DataFrame:
    rows = json_documents(spark, path, "map<string,array<struct<start:string,end:string>>>").select(F.explode("doc").alias("video", "r")).select("video", F.explode("r").alias("r"))
    at = lambda c: F.unix_micros(F.to_utc_timestamp(F.to_timestamp(F.regexp_replace(c, "T", " ")), zone)) / F.lit(1e6)
    return rows.select("video", at(F.col("r.start")).alias("range_start"), at(F.col("r.end")).alias("range_end"))


def interval_pairs(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pairs of each document in order; ``lines``: one document a line, for as many documents as would not do as files of their own."""
    return json_documents(spark, path, "array<array<double>>", lines).select(F.posexplode("doc").alias("seq", "p")).select(F.col("seq").cast("long"), F.col("p")[0].alias("start_ts"), F.col("p")[1].alias("end_ts"))


def manifest(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """CSV with trimmed names and values; columns that a file lacks are empty text."""
    raw = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    have = {c.strip(): c for c in raw.columns}
    return raw.select(*(F.coalesce(F.trim(F.col(f"`{have[c]}`")), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in columns))


def run_metrics(spark: SparkSession, root: str, files: str = "*/results.csv") -> DataFrame:
    """(run, epoch, metrics map) of all runs under ``root``, a folder a run (``name`` or ``run=name``) with a file by ``files``; runs without it are skipped.

    Headers may differ from run to run. Names and values are trimmed, but values of blanks alone, which are no empty ones.
    """
    run = F.regexp_replace(F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1), "^run=", "")
    return metrics_of(spark.read.text(f"{root}/{files}", wholetext=True).select(run.alias("run"), "value"))


def metrics_of(texts: DataFrame) -> DataFrame:
    """(run, epoch, metrics map) of runs' CSV files as texts (run, value), however they are stored; see ``run_metrics``."""
    lines = texts.select("run", F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    names = F.transform(F.split(F.get("l", F.lit(0)), ","), lambda x: F.trim(x))
    rows = lines.select("run", names.alias("names"), F.posexplode(F.slice("l", 2, 1_000_000_000)).alias("n", "line"))
    values = F.transform(F.split("line", ","), lambda x: F.when(F.trim(x) == "", x).otherwise(F.trim(x)))
    pairs = F.map_from_entries(F.filter(F.arrays_zip(F.col("names"), values.alias("values")), lambda e: e["names"].isNotNull()))
    return rows.select("run", (F.col("n") + 1).alias("row"), pairs.alias("metrics")).select("run", F.coalesce(F.col("metrics")["epoch"].try_cast("int"), F.col("row").cast("int")).alias("epoch"), "metrics")


def label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(clip, frame_stem, line): all label files below ``path``; files that start with _ and index lists are skipped."""
    file, clip = F.substring_index("_metadata.file_path", "/", -1), F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1)
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(path)
    rows = rows.select(clip.alias("clip"), file.alias("file"), F.col("value").alias("line"))
    return rows.where(~F.col("file").startswith("_") & ~F.col("file").isin("train.txt", "val.txt", "test.txt")).select("clip", stem(F.col("file")).alias("frame_stem"), "line")


def listing(spark: SparkSession, path: str, extensions: Sequence[str] = VIDEO_EXTENSIONS, keyword: str | None = None) -> DataFrame:
    """Files below ``path`` by extension, and by a word in the stem (any case); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    keep = F.lower("path").rlike(rf"\.({'|'.join(extensions)})$")
    return files.where(keep if keyword is None else keep & F.lower(stem(F.col("path"))).contains(keyword.lower()))


def keypoint_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide keypoints under four header lines (scorer, individual, bodypart, coordinate) as one row a point."""
    lines = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("video"), F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    head = lambda i: F.split(F.get("l", F.lit(i)), ",")
    rows = lines.select("video", head(1).alias("who"), head(2).alias("part"), head(3).alias("coord"), F.explode(F.slice("l", 5, 1_000_000_000)).alias("line"))
    cells = rows.select("video", F.split("line", ",").alias("v"), "who", "part", "coord").select("video", F.get("v", F.lit(0)).cast("long").alias("frame"), F.posexplode(F.arrays_zip("who", "part", "coord", "v")).alias("i", "c")).where("i > 0")
    pick = lambda k: F.max(F.when(F.col("c.coord") == k, F.col("c.v").try_cast("double"))).alias(k)
    return cells.groupBy("video", "frame", F.col("c.who").alias("individual"), F.col("c.part").alias("bodypart")).agg(pick("x"), pick("y"), pick("likelihood"))


def keypoint_detections(spark: SparkSession, path: str) -> DataFrame:
    """(video, frame, track_id, x, y, w, h, keypoints) of wide keypoint files: one nested detection an individual and frame, without a box.

    ``track_id`` is the individual's place among the header's individuals, from 1; its keypoints (label, x, y, likelihood) stand in the
    order of the header. Only the first scorer's columns count.
    """
    lines = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("video"), F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("l"))
    head = lambda i: F.slice(F.split(F.get("l", F.lit(i)), ","), 2, 1_000_000)
    heads = lines.select("video", head(0).alias("scorer"), head(1).alias("who"), head(2).alias("part"), head(3).alias("coord"), F.explode(F.slice("l", 5, 1_000_000_000)).alias("line"))
    values = F.slice(F.split("line", ","), 2, 1_000_000).alias("v")
    rows = heads.select("video", F.get(F.split("line", ","), F.lit(0)).try_cast("long").alias("frame"), F.array_distinct("who").alias("all"), F.get("scorer", F.lit(0)).alias("first"), F.posexplode(F.arrays_zip("scorer", "who", "part", "coord", values)).alias("i", "c"))
    own = rows.where(F.col("c.scorer") == F.col("first")).select("video", "frame", F.array_position("all", F.col("c.who")).cast("int").alias("track_id"), "i", "c.*")
    pick = lambda k: F.max(F.when(F.col("coord") == k, F.col("v").try_cast("double"))).alias(k)
    points = own.groupBy("video", "frame", "track_id", F.col("part").alias("label")).agg(F.min("i").alias("i"), pick("x"), pick("y"), pick("likelihood"))
    nested = points.groupBy("video", "frame", "track_id").agg(F.array_sort(F.collect_list(F.struct("i", "label", "x", "y", "likelihood"))).alias("p"))
    keypoints = F.transform("p", lambda p: F.struct(*(p[k].alias(k) for k in ("label", "x", "y", "likelihood"))))
    return nested.select("video", "frame", "track_id", *(F.lit(0.0).alias(k) for k in "xywh"), keypoints.alias("keypoints"))


def metadata(spark: SparkSession, path: str, schema: str, whole_files: bool = True) -> DataFrame:
    """JSON records by a fixed schema: unknown keys go, absent ones are null, unreadable files (or lines) are skipped."""
    rows = spark.read.option("multiLine", whole_files).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").schema(schema + ", _bad string").json(path)
    return rows.where("_bad IS NULL").drop("_bad")


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Nested score report as (method, clip, metrics); clip is null for overall."""
    docs = json_documents(spark, path, "map<string,struct<overall:map<string,double>,clips:map<string,map<string,double>>>>").select(F.explode("doc").alias("method", "r"))
    return docs.select("method", F.lit(None).cast("string").alias("clip"), F.col("r.overall").alias("metrics")).unionByName(docs.select("method", F.explode("r.clips").alias("clip", "metrics")))

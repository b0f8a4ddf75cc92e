"""Clips, videos, labels, batches: selection, pairing, reconciliation, splits and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackframe.functions.text import stem
from trackframe.operators.ranks import placed, seeded

#: A date, and maybe a time and a zone.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?(Z|[+-]\d{2}:?\d{2})?)?$"
EXTENSIONS = ("png", "jpg", "jpeg", "bmp")


def among(column: str, wanted: Sequence[str] | None) -> Column:
    """True for ``["*"]``, an empty list and a listed value."""
    return F.lit(True) if not wanted or list(wanted) == ["*"] else F.col(column).isin(list(wanted))


def select_clips(clips: DataFrame, chambers=None, waves=None, layouts=None, without_videos=(), without_paths=()) -> DataFrame:
    keep = among("chamber", chambers) & among("wave", waves) & among("layout", layouts)
    return clips.where(keep & ~F.col("source_video").isin(list(without_videos)) & ~F.col("clip_path").isin(list(without_paths)))


def browse_clips(clips: DataFrame, labels: DataFrame, chamber=None, video_part: str | None = None, annotated: bool | None = None) -> DataFrame:
    rows = clips.where(among("chamber", chamber))
    if video_part:
        rows = rows.where(F.lower("source_video").contains(video_part.lower()))
    if annotated is not None:
        rows = rows.join(labels.select("clip_path").distinct(), "clip_path", "left_semi" if annotated else "left_anti")
    return rows


def since(rows: DataFrame, column: str, start: str) -> DataFrame:
    """Rows whose time (ISO 8601 text, a date alone being its midnight, zone ignored) is not before ``start``; blank and unreadable ones go."""
    at = lambda c: F.when(c.rlike(ISO), F.regexp_replace(F.regexp_replace(c, r"(Z|[+-]\d{2}:?\d{2})$", ""), r"([T ]\d{2})$", "$1:00").try_cast("timestamp_ntz"))
    return rows.where(at(F.col(column)) >= at(F.lit(start)))


def filter_experiments(rows: DataFrame, chamber_type: str | None = None, dataset_name: str | None = None, start: str | None = None) -> DataFrame:
    """Experiments of a chamber type and a dataset that started at ``start`` or later; what is not given does not matter."""
    for column, value in (("chamber_type", chamber_type), ("dataset_name", dataset_name)):
        rows = rows.where(F.col(column) == value) if value else rows
    return since(rows, "started_at", start) if start else rows


def long_enough(videos: DataFrame, clip_sec: float, margin: float = 10.0) -> DataFrame:
    """Videos with frames and at least clip + margin seconds; a rate of 0 counts as 30."""
    rate = F.coalesce(F.nullif("fps", F.lit(0.0)), F.lit(30.0))
    return videos.withColumn("fps", rate).withColumn("seconds", F.col("frames") / F.col("fps")).where((F.col("frames") >= 1) & (F.col("seconds") >= clip_sec + margin))


def unfinished(inputs: DataFrame, outputs: DataFrame, least_bytes: int = 1024, force: bool = False) -> DataFrame:
    """Inputs (stem) without an output of more than ``least_bytes``."""
    return inputs if force else inputs.join(outputs.where(F.col("length") > least_bytes).select("stem"), "stem", "left_anti")


def too_close(candidates: DataFrame, taken: DataFrame, gap: float, width: float = 600.0) -> DataFrame:
    """Candidates (video, start_sec, end_sec) that overlap a taken interval of their video, or come nearer than ``gap``; exactly ``gap`` apart is far enough.

    Taken intervals, widened by the gap, are dealt to time slots, so that a candidate meets only those of its slots.
    """
    slots = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    t = taken.select(F.col("video").alias("_v"), (F.col("start_sec") - gap).alias("_a"), (F.col("end_sec") + gap).alias("_b")).withColumn("_slot", slots(F.col("_a"), F.col("_b")))
    c = candidates.withColumn("slot", slots(F.col("start_sec"), F.col("end_sec")))
    hit = c.join(t, (F.col("video") == F.col("_v")) & (F.col("slot") == F.col("_slot")) & (F.col("start_sec") < F.col("_b")) & (F.col("end_sec") > F.col("_a")), "left_semi")
    return hit.drop("slot").distinct()


def far_enough(candidates: DataFrame, taken: DataFrame, gap: float) -> DataFrame:
    keys = ["video", "start_sec", "end_sec"]
    return candidates.join(too_close(candidates.select(*keys), taken, gap), keys, "left_anti")


def in_valid_range(candidates: DataFrame, ranges: DataFrame, anchored: DataFrame, width: float = 600.0) -> DataFrame:
    """Candidates inside one range of their video. Without ranges: no. With ranges but no anchors: yes.

    Ranges are dealt to time slots, so that a candidate meets only those of the slot where it starts.
    """
    slots = F.explode(F.sequence(F.floor(F.col("range_start") / width), F.floor(F.col("range_end") / width)))
    r = ranges.select(F.col("video").alias("_v"), F.col("range_start").alias("_a"), F.col("range_end").alias("_b"), slots.alias("_slot"))
    here = (F.col("video") == F.col("_v")) & (F.floor(F.col("start_sec") / width) == F.col("_slot"))
    inside = (F.col("start_sec") >= F.col("_a")) & (F.col("end_sec") <= F.col("_b"))
    loose = ranges.select("video").distinct().join(anchored.select("video").distinct(), "video", "left_anti")
    fit = candidates.join(r, here & inside, "left_semi").join(loose, "video", "left_anti")
    return fit.unionByName(candidates.join(loose, "video", "left_semi"))


def pair_images(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Each label with its image; of several, by extension png, jpg, jpeg, bmp."""
    rank = F.array_position(F.array(*map(F.lit, EXTENSIONS)), F.col("ext"))
    best = Window.partitionBy("clip", "stem").orderBy("_rank")
    one = images.withColumn("_rank", rank).where("_rank > 0").withColumn("_k", F.row_number().over(best)).where("_k = 1").select("clip", "stem", "ext")
    return labels.join(one, ["clip", "stem"])


def orphans(images: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.join(images, ["clip", "stem"], "left_anti")


def with_fallback(rows: DataFrame, table: DataFrame, name: str = "video", value: str = "value") -> DataFrame:
    """``value`` under the exact name, else under a name of the same stem, else under ``_default``.

    Of several rows of one name or stem the first by ``pos`` counts where the table has that column, else the first by name.
    """
    first = F.struct(*(F.col(c) for c in ("pos", "name") if c in table.columns))
    t = lambda k, of: table.groupBy(of.alias(f"_{k}")).agg(F.min_by("value", first).alias(f"_v{k}"))
    out = rows.join(t("n", F.col("name")), F.col(name) == F.col("_n"), "left").join(t("s", stem(F.col("name"))), stem(F.col(name)) == F.col("_s"), "left")
    out = out.join(F.broadcast(t("d", F.col("name")).where("_d = '_default'")), F.lit(True), "left")  # one row
    return out.withColumn(value, F.coalesce("_vn", "_vs", "_vd")).drop("_n", "_vn", "_s", "_vs", "_d", "_vd")


def uncovered(expected: DataFrame, table: DataFrame, name: str = "video") -> DataFrame:
    """Names that have an entry neither by name nor by stem, the stems of both sides being compared."""
    return expected.join(table.select(stem(F.col("name")).alias("_s")), stem(F.col(name)) == F.col("_s"), "left_anti")


def reconcile(old: DataFrame, listing: DataFrame) -> DataFrame:
    """Catalogue (path, size, missing) against a listing (path, size, readable): new, refreshed, unreadable or missing.

    Unreadable files are missing too, with the size known before if there is one; newly missing are those alone that the listing lost.
    """
    o, n = old.select("path", F.col("size").alias("old_size"), F.col("missing").alias("was_missing")), listing.select("path", F.col("size").alias("new_size"), "readable")
    j = o.join(n, "path", "full_outer")
    status = F.when(F.col("new_size").isNull(), "missing").when(~F.col("readable"), "unreadable").when(F.col("old_size").isNull(), "new").otherwise("refreshed")
    gone = status.isin("missing", "unreadable")
    size = F.when(gone, F.col("old_size")).otherwise(F.col("new_size"))
    return j.select("path", size.alias("size"), gone.alias("missing"), status.alias("status"), ((status == "missing") & ~F.coalesce("was_missing", F.lit(False))).alias("newly_missing"))


def ratio_split(rows: DataFrame, ratios: dict[str, float], stratum: str | None, key: str, seed: int) -> DataFrame:
    """Every row in one split: seeded order within its stratum, cut at half-even rounded shares. Splits of ratio 0 are absent."""
    ranked = placed(rows, seeded(seed, F.col(key)), F.col(key), [stratum] if stratum else [])
    parts, total, split = [(k, v) for k, v in ratios.items() if v > 0], sum(ratios.values()), None
    acc = 0.0
    for i, (name, share) in enumerate(parts):
        acc += share
        within = F.lit(True) if i == len(parts) - 1 else F.col("_r") <= F.bround(F.lit(acc / total) * F.col("_n"))
        split = F.when(within, name) if split is None else split.when(within, name)
    return ranked.withColumn("split", split).drop("_r", "_n")


def hold_out(frames: DataFrame, share: float, seed: int) -> DataFrame:
    """Whole clips to val: max(1, int(clips x share)); where that would take all clips, max(1, int(frames x share)) single frames instead."""
    clips = placed(frames.select("clip").distinct(), seeded(seed, F.col("clip")), F.col("clip"))
    take = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    by_clip = clips.select(F.col("clip").alias("_clip"), (F.col("_r") <= take).alias("_val"), (take >= F.col("_n")).alias("_all"))
    single = placed(frames, seeded(seed, F.col("clip"), F.col("frame")), F.col("frame"))
    own = F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    rows = single.join(by_clip, F.col("clip") == F.col("_clip"))
    return rows.withColumn("split", F.when(F.when(F.col("_all"), own).otherwise(F.col("_val")), "val").otherwise("train")).select(*frames.columns, "split")


def sample_rows(rows: DataFrame, n: int, key: Column, seed: int, by: Sequence[str] = ()) -> DataFrame:
    """``n`` rows of each group in seeded hash order."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), key))
    if not by:
        return rows.orderBy(order).limit(n)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], written: str | None = None) -> DataFrame:
    """Rows by key, the last write wins; null text becomes "", booleans 0 and 1.

    ``written`` orders several new rows of one key; without it the one with the greatest values in column order wins.
    """
    both = old.withColumn("_w", F.lit(0)).unionByName(new.withColumn("_w", F.lit(1)), allowMissingColumns=True)
    ties = [F.desc(written)] if written else []
    last = Window.partitionBy(*keys).orderBy(F.desc("_w"), *ties, *(F.desc(F.col(c).cast("string")) for c in new.columns))
    rows = both.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_w")
    flat = lambda f: F.col(f.name).cast("int").alias(f.name) if f.dataType.simpleString() == "boolean" else F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if f.dataType.simpleString() == "string" else F.col(f.name)
    return rows.select(*map(flat, rows.schema.fields))


def register_sources(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sources (chamber_id, drive_uuid, drive_label, waves array) after registering ``new`` ones (chamber_id, drive_uuid, drive_label).

    A known chamber takes the new drive, keeps its waves, and keeps its label where the new one is blank; an unknown one starts
    without waves. ``created`` tells which. New rows of one chamber: the greatest drive wins.
    """
    n = new.groupBy("chamber_id").agg(F.max(F.struct("drive_uuid", "drive_label")).alias("_new"))
    waves = F.coalesce("waves", F.array().cast("array<string>")).alias("waves")
    label = F.when(F.col("_new").isNull(), F.coalesce("drive_label", F.lit(""))).otherwise(F.coalesce(F.nullif("_new.drive_label", F.lit("")), "drive_label", F.lit("")))
    rows = old.withColumn("_old", F.lit(True)).join(n, "chamber_id", "full_outer")
    return rows.select("chamber_id", F.coalesce("_new.drive_uuid", "drive_uuid").alias("drive_uuid"), label.alias("drive_label"), waves, F.col("_old").isNull().alias("created"))


def triage(manifest: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): the manifest with each frame's decision (frame key, status), rejected frames split out."""
    marked = manifest.join(decisions.select("frame_key", "status"), "frame_key", "left").withColumn("status", F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("pending")))
    return marked.where("status <> 'rejected'"), marked.where("status = 'rejected'")


def mark_annotated(manifest: DataFrame, labels: DataFrame) -> DataFrame:
    """``annotated`` yes or no by whether a frame has a label."""
    has = labels.select("frame_key").distinct().withColumn("_has", F.lit(True))
    return manifest.join(has, "frame_key", "left").withColumn("annotated", F.when(F.col("_has"), "yes").otherwise("no")).drop("_has")


def tallies(rows: DataFrame, status: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows approved, rejected and pending; a blank status is pending."""
    s = F.coalesce(F.nullif(F.lower(F.trim(status)), F.lit("")), F.lit("pending"))
    return rows.groupBy(*by).agg(*(F.count_if(s == k).alias(k) for k in ("approved", "rejected", "pending")))


def outcomes(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def split_counts(manifest: DataFrame, split: str) -> DataFrame:
    """Frames of one split by clip, with where the clip comes from."""
    return manifest.where(F.col("split") == split).groupBy("clip").agg(F.min("chamber").alias("chamber"), F.min("wave").alias("wave"), F.count("*").alias("n_frames"))


def dataset_summary(manifest: DataFrame) -> DataFrame:
    """By split: frames, clips, and the chambers and waves in order."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return manifest.groupBy("split").agg(F.count("*").alias("frames"), F.countDistinct("clip").alias("clips"), listed("chamber").alias("chambers"), listed("wave").alias("waves"))


def progress(expected: DataFrame, state: DataFrame, keys: Sequence[str] = ("wave", "split")) -> DataFrame:
    """Batches collected for each expected pair, zeros too; ``missing`` where there is none."""
    n = state.groupBy(*keys).agg(F.count("*").alias("n"))
    return expected.select(*keys).distinct().join(n, list(keys), "left").na.fill(0, ["n"]).withColumn("missing", F.col("n") == 0)


def new_batches(found: DataFrame, state: DataFrame) -> DataFrame:
    """Batches not yet in state, by source, wave, split and batch."""
    return found.join(state, ["source", "wave", "split", "batch"], "left_anti")


def video_files(videos: DataFrame, tracks: DataFrame, rois: DataFrame) -> DataFrame:
    """Videos with their track file and region by stem; ``warning`` names what is missing."""
    v = videos.withColumn("stem", stem(F.col("path")))
    t, r = tracks.select(stem(F.col("path")).alias("stem"), F.col("path").alias("track")), rois.select("stem", "roi")
    out = v.join(t, "stem", "left").join(r, "stem", "left")
    return out.withColumn("warning", F.concat_ws(",", F.when(F.col("track").isNull(), "track"), F.when(F.col("roi").isNull(), "roi")))


def listing_by(rows: DataFrame, column: str, descending: bool = True) -> DataFrame:
    """Rows sorted by a column as text, null as blank."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return rows.orderBy(text.desc() if descending else text.asc())


def next_pending(items: DataFrame, current: int, total: int, pending: Column, index: str = "idx") -> DataFrame:
    """The next pending item after ``current``, going round."""
    ahead = F.pmod(F.col(index) - F.lit(current + 1) + F.lit(total), F.lit(total))
    return items.where(pending).orderBy(ahead).limit(1)


def next_number(names: DataFrame, prefix: str, name: str = "name") -> DataFrame:
    """Largest number that follows ``prefix`` at once in a name, plus one, as two digits or as many as it has; 01 where there is none."""
    rest = F.when(F.startswith(F.col(name), F.lit(prefix)), F.substr(F.col(name), F.lit(len(prefix) + 1)))
    n = F.when(rest.rlike("^[0-9]+$"), rest.try_cast("long"))
    return names.agg(F.format_string("%02d", F.coalesce(F.max(n), F.lit(0)) + 1).alias("next_number"))


def union_listing(*listings: DataFrame, key: str = "path") -> DataFrame:
    """Rows of several listings, each ``key`` once: the first listing's row where several have it."""
    both = None
    for i, rows in enumerate(listings):
        one = rows.withColumn("_from", F.lit(i))
        both = one if both is None else both.unionByName(one, allowMissingColumns=True)
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy("_from"))).where("_r = 1").drop("_r", "_from")


def combined(parts: dict[str, DataFrame], name: str = "origin") -> DataFrame:
    """Rows of several sources one after another, with the source's name in ``name``; columns that a part lacks are null."""
    out = None
    for origin, rows in parts.items():
        one = rows.withColumn(name, F.lit(origin))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out

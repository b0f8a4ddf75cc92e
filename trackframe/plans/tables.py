"""Registered queries over time, intervals, clips, catalogues, runs and grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from trackframe.functions import text as t
from trackframe.operators import catalog, curation, heatmap, intervals, runs, sampling, timemap
from trackframe.plans.fixtures import view
from trackframe.sources import writers
from trackframe.sources.readers import roi_ok

ASOF = """pts AS (SELECT video, CAST(frame AS DOUBLE) AS p, min(unix) AS v FROM {known} k GROUP BY video, frame),
seg AS (SELECT video, p, v, lead(p) OVER (PARTITION BY video ORDER BY p) AS p2, lead(v) OVER (PARTITION BY video ORDER BY p) AS v2, min(p) OVER (PARTITION BY video) AS lo FROM pts)"""


def md5_order(seed: int, key: str) -> str:
    return f"md5('{seed}|' || {key})"


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(text, 'O', '0'), '(?i)\b(UTC|GMT)\s*[+-]?\d\d?(:?\d\d)?\b', '', 'g'), '(?i)\b(EST|GMT)\b', '', 'g'), '\s{2,}', ' ', 'g'))"
#: By event_id % 16: the format that the recognised text has; Oct loses its O, and a day of at most 12 is read as the month's number.
FORMATS = "CASE event_id % 16 WHEN 1 THEN 'h:m:s a d-MMM-yy' WHEN 2 THEN 'h:m:s a d-MMM-yyyy' WHEN 3 THEN 'h:m:s a d/M/yyyy' WHEN 4 THEN 'h:m:s a d/M/yy' WHEN 5 THEN CASE WHEN day(ts) <= 12 THEN 'h:m:s a d/M/yyyy' ELSE 'h:m:s a M/d/yyyy' END WHEN 6 THEN 'H:m:s d-MMM-yy' WHEN 7 THEN 'H:m:s d-MMM-yyyy' WHEN 8 THEN 'H:m:s d/M/yyyy' WHEN 9 THEN 'H:m:s d/M/yy' WHEN 10 THEN 'h:m:s a' WHEN 11 THEN 'H:m:s' WHEN 12 THEN 'h:m a' WHEN 13 THEN 'H:m' WHEN 14 THEN 'h:m:s a' WHEN 15 THEN 'H:m:s' END"
NO_TIME = "event_id % 16 = 0 OR (event_id % 16 IN (1, 2, 6, 7) AND month(ts) = 10)"
#: Formats that users type, by event_id % 8, and whether they have seconds.
TYPED = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd H:mm", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-M-d'T'HH:mm", "M/d/yyyy H:mm", "M/d/yyyy h:mm a", "yyyy-MM-dd h:mm a", "yyyy-MM-dd h:mm:ss a")


def typed(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "ts")
    text = F.coalesce(*(F.when(F.col("event_id") % 8 == i, F.date_format("ts", f)) for i, f in enumerate(TYPED)))
    return e.select("event_id", t.user_time(F.concat(F.lit(" "), text), "UTC").alias("unix"))


def lost_seconds(s, d):
    """Anchors of which half of those without a time had only lost their seconds."""
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) * 60.0).alias("minute"))
    a = view(s, d, "anchors").join(e, "event_id")
    return timemap.with_seconds(a, F.when(F.col("event_id") % 34 == 0, F.col("minute"))).select("video", "frame", "unix", "fix")


LOST = "ax AS (SELECT a.video, a.frame, a.unix AS was, coalesce(a.unix, CASE WHEN a.event_id % 34 = 0 THEN floor(epoch(e.ts) / 60) * 60 END) AS unix FROM {anchors} a JOIN {events} e ON e.event_id = a.event_id)"


def accuracy_checks(s, d):
    a = view(s, d, "known")
    return a.select(F.col("video") % 50, (F.pmod(F.col("event_id") * 7, F.lit(41)) / 10 - 2.0).alias("delta")).toDF("video", "delta")


def ocr_parsed(s, d):
    o = view(s, d, "ocr").withColumn("clean", t.clean_ocr(F.col("text")))
    fixed = o.withColumn("fmt", t.time_format(F.col("clean")))
    base = F.to_date(F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    return fixed.withColumn("unix", t.parse_time(F.col("clean"), F.col("fmt"), base, F.lit(0), "UTC"))


def days(s, d):
    a = view(s, d, "anchors").withColumn("tod", F.pmod(F.col("unix"), F.lit(86400.0)))
    return timemap.day_offsets(a).select("video", "frame", "day_offset")


def gaps_of(s, d):
    return intervals.recording_gaps(view(s, d, "valid"))


GAPS = "gp AS (SELECT grp, end_ts AS gap_start, nx AS gap_end FROM (SELECT *, lead(start_ts) OVER (PARTITION BY grp ORDER BY start_ts) AS nx FROM {valid} v) z WHERE nx - end_ts > 120)"
ONSETS = "sp AS (SELECT * FROM (SELECT grp, start_ts AS a, lead(start_ts) OVER (PARTITION BY grp ORDER BY start_ts) AS b FROM {stimuli} s) z WHERE b IS NOT NULL)"
LASTS = "la AS (SELECT gp.grp, gap_start, max(start_ts) AS last_event FROM gp JOIN {stimuli} s ON s.grp = gp.grp AND start_ts < gap_start GROUP BY gp.grp, gap_start)"
ONSET = "ev AS (SELECT grp, start_ts AS a, lead(start_ts) OVER o AS b, lag(start_ts) OVER o AS before FROM {stimuli} s WINDOW o AS (PARTITION BY grp ORDER BY start_ts))"
KINDS = f"""{GAPS}, {ONSET}, {LASTS}, oc AS (SELECT grp, a, b, round(b - a, 6) AS seconds,
CASE WHEN b - a < 600 OR a - before < 600 THEN 'cluster' WHEN EXISTS (SELECT 1 FROM la WHERE la.grp = ev.grp AND last_event = a) THEN 'pre_reboot' ELSE 'normal' END AS kind,
CASE WHEN b IS NULL THEN NULL WHEN EXISTS (SELECT 1 FROM gp WHERE gp.grp = ev.grp AND a < gap_end AND b > gap_start) THEN 'skip' WHEN b - a < 600 THEN 'cluster' WHEN b - a > 4320 THEN 'drift' ELSE 'normal' END AS interval FROM ev)"""


def onsets(s, d):
    return intervals.onset_classes(view(s, d, "stimuli"), gaps_of(s, d))


def images(s, d):
    return view(s, d, "images"), view(s, d, "labels_of")


def grid(s, d):
    e = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("frame"), F.col("label").alias("kp"), F.posexplode("embedding").alias("i", "logit")).where("i < 64")
    return e.select("frame", "kp", F.floor(F.col("i") / 8).cast("int").alias("yy"), (F.col("i") % 8).cast("int").alias("xx"), F.col("logit").cast("double").alias("logit"))


GRID = "gr AS (SELECT vec_id AS frame, label AS kp, CAST((i - 1) // 8 AS INT) AS yy, CAST((i - 1) % 8 AS INT) AS xx, embedding[i]::DOUBLE AS logit FROM embeddings, range(1, 65) r(i)), sm AS (SELECT *, exp(logit - max(logit) OVER w) / sum(exp(logit - mx)) OVER w AS p FROM (SELECT *, max(logit) OVER (PARTITION BY frame, kp) AS mx FROM gr) z WINDOW w AS (PARTITION BY frame, kp))"
PEAK = "lm AS (SELECT a.frame, a.kp, a.yy, a.xx, a.p FROM sm a JOIN sm b ON a.frame = b.frame AND a.kp = b.kp AND abs(a.yy - b.yy) <= 1 AND abs(a.xx - b.xx) <= 1 GROUP BY ALL HAVING a.p >= max(b.p))"


def hashes(s, d):
    bit = lambda e: F.aggregate(F.transform(F.slice(e, 1, 62), lambda x: (x > 0).cast("long")), F.lit(0).cast("long"), lambda a, b: a * 2 + b)
    e = s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", bit(F.col("embedding")).alias("h"))
    lead = e.select(F.col("vec_id").alias("base"), F.col("h").alias("hb"))
    rows = e.select("vec_id", (F.col("vec_id") - F.col("vec_id") % 4).alias("base"), (F.col("vec_id") % 4).alias("k")).join(lead, "base")
    return rows.select(F.col("vec_id").alias("seq"), F.col("hb").bitwiseXOR((F.shiftleft(F.lit(1), 8) - 1).cast("long").bitwiseAND(F.element_at(F.array(F.lit(0), F.lit(3), F.lit(15), F.lit(63)), (F.col("k") + 1).cast("int")).cast("long"))).alias("hash"))


def split_frames(s, d):
    f = view(s, d, "frames").withColumn("key", F.concat_ws("/", F.col("clip").cast("string"), F.col("frame").cast("string")))
    return catalog.ratio_split(f, {"train": 0.6, "val": 0.2, "test": 0.2, "none": 0.0}, "clip", "key", 42).select("clip", "frame", "split")


def catalog_rows(s, d):
    return catalog.reconcile(view(s, d, "old_catalog"), view(s, d, "new_listing"))


RECON = "SELECT coalesce(o.path, n.path) AS path, CASE WHEN n.path IS NULL OR NOT n.readable THEN o.size ELSE n.size END AS size, n.path IS NULL OR NOT n.readable AS missing, CASE WHEN n.path IS NULL THEN 'missing' WHEN NOT n.readable THEN 'unreadable' WHEN o.path IS NULL THEN 'new' ELSE 'refreshed' END AS status, n.path IS NULL AND NOT coalesce(o.missing, false) AS newly_missing FROM {old_catalog} o FULL JOIN {new_listing} n ON o.path = n.path"


def best_runs(s, d):
    return runs.best_epochs(view(s, d, "metrics"), runs.first_filled("a", "b"))


BEST = "be AS (SELECT run, epoch, score FROM (SELECT run, epoch, CASE WHEN coalesce(nullif(a, ''), b) = '' THEN 0 ELSE TRY_CAST(coalesce(nullif(a, ''), b) AS DOUBLE) END AS score, row_number() OVER (PARTITION BY run ORDER BY CASE WHEN coalesce(nullif(a, ''), b) = '' THEN 0 ELSE TRY_CAST(coalesce(nullif(a, ''), b) AS DOUBLE) END DESC NULLS LAST, epoch) AS r FROM {metrics} m) z WHERE r = 1 AND score > -1)"
HEX = "CAST(('0x' || substr(md5('9|' || CAST(i AS STRING) || '|WHAT'), 1, 8)) AS BIGINT)::DOUBLE / 4294967296"

BATCH = "chamber AS source, wave, layout AS split, video AS batch"


def batches(s, d, condition="true"):
    return view(s, d, "clips").where(condition).select(F.col("chamber").alias("source"), "wave", F.col("layout").alias("split"), F.col("video").alias("batch"))


def triaged(s, d):
    """Both outputs of a triage, told apart by folder."""
    key = F.concat(F.lit("c"), F.col("clip").cast("string"), F.lit("/f"), F.col("frame").cast("string")).alias("frame_key")
    frames = view(s, d, "frames").select(key, "frame")
    decided = frames.select("frame_key", F.when(F.col("frame") % 5 == 0, "rejected").when(F.col("frame") % 5 == 1, "approved").otherwise(" ").alias("status")).where("status <> ' '")
    labels = view(s, d, "labels_of").select(F.concat("clip", F.lit("/"), "stem").alias("frame_key"))
    kept, rejected = catalog.triage(catalog.mark_annotated(frames.select("frame_key"), labels), decided)
    return kept.withColumn("folder", F.lit("")).unionByName(rejected.withColumn("folder", F.lit("_rejected")))


def sources_of(s, d, condition):
    c = view(s, d, "customers").where(condition)
    return c.select(F.concat(F.lit("ch"), F.col("c_custkey").cast("string")).alias("chamber_id"), F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("drive_uuid"), F.concat(F.lit("label"), F.col("nation").cast("string")).alias("drive_label"))


QUERIES = {
    # Time
    "j5_asof_time": (
        lambda s, d: timemap.frame_to_unix(view(s, d, "known"), view(s, d, "probes")).select("video", "frame", F.round("unix", 2).alias("unix")),
        f"WITH {ASOF} SELECT p.video, p.frame, round(CASE WHEN p.frame < lo THEN v WHEN p2 IS NULL OR p.frame = p THEN v ELSE v + (v2 - v) * (p.frame - p) / (p2 - p) END, 2) AS unix FROM {{probes}} p JOIN seg ON seg.video = p.video AND ((p.frame >= p AND (p2 IS NULL OR p.frame < p2)) OR (p.frame < lo AND p = lo))",
    ),
    "j6_inverse_time": (
        lambda s, d: timemap.unix_to_frame(timemap.monotone(view(s, d, "known")), view(s, d, "probes").select("video", (F.lit(1.7e9) + F.col("frame") * 37).alias("unix")).distinct()),
        """WITH mo AS (SELECT * FROM (SELECT *, max(unix) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {known} k) z WHERE m IS NULL OR unix > m),
pr AS (SELECT DISTINCT video, 1700000000::DOUBLE + frame * 37 AS unix FROM {probes} p), seg AS (SELECT video, unix AS p, frame AS v, lead(unix) OVER o AS p2, lead(frame) OVER o AS v2, min(unix) OVER (PARTITION BY video) AS lo FROM mo WINDOW o AS (PARTITION BY video ORDER BY unix))
SELECT pr.video, pr.unix, CAST(round_even(CASE WHEN pr.unix < lo THEN v WHEN p2 IS NULL OR pr.unix = p THEN v ELSE v + (v2 - v) * (pr.unix - p) / (p2 - p) END, 0) AS BIGINT) AS frame FROM pr JOIN seg ON seg.video = pr.video AND ((pr.unix >= p AND (p2 IS NULL OR pr.unix < p2)) OR (pr.unix < lo AND p = lo))""",
    ),
    "j7_nearest_anchor": (
        lambda s, d: timemap.nearest_anchor(view(s, d, "known"), view(s, d, "probes"), "event_id"),
        "SELECT video, frame, event_id FROM (SELECT p.video, p.frame, k.event_id, row_number() OVER (PARTITION BY p.video, p.frame ORDER BY abs(k.frame - p.frame), k.frame) AS r FROM {probes} p JOIN {known} k ON k.video = p.video) z WHERE r = 1",
    ),
    "j8_last_anchor": (
        lambda s, d: timemap.last_anchor(view(s, d, "known"), view(s, d, "probes"), "event_id"),
        "SELECT p.video, p.frame, max_by(k.event_id, k.frame) AS event_id FROM {probes} p LEFT JOIN {known} k ON k.video = p.video AND k.frame <= p.frame GROUP BY p.video, p.frame",
    ),
    "w7_midnight": (days, "SELECT video, frame, CAST(coalesce(sum(CAST(f AS INT)) OVER (PARTITION BY video ORDER BY frame), 0) AS BIGINT) AS day_offset FROM (SELECT video, frame, tod - lag(tod) OVER (PARTITION BY video ORDER BY frame) < -43200 AS f FROM (SELECT video, frame, unix - floor(unix / 86400) * 86400 AS tod FROM {known} k) y) z"),
    "w8_monotone": (
        lambda s, d: timemap.monotone(view(s, d, "anchors")).select("video", "frame", F.round("unix", 6).alias("unix")),
        "SELECT video, frame, round(unix, 6) AS unix FROM (SELECT *, max(unix) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {known} k) z WHERE m IS NULL OR unix > m",
    ),
    "w9_repair": (
        lambda s, d: timemap.repair(view(s, d, "anchors")).select("video", "frame", F.round("unix", 2).alias("unix"), "fix"),
        """WITH mo AS (SELECT * FROM (SELECT *, max(unix) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM {known} k) z WHERE m IS NULL OR unix > m),
seg AS (SELECT video, frame AS p, unix AS v, lead(frame) OVER o AS p2, lead(unix) OVER o AS v2, min(frame) OVER (PARTITION BY video) AS lo, count(*) OVER (PARTITION BY video) AS n FROM mo WINDOW o AS (PARTITION BY video ORDER BY frame))
SELECT a.video, a.frame, round(CASE WHEN a.unix IS NULL AND n >= 2 THEN CASE WHEN a.frame < lo OR p2 IS NULL THEN v ELSE v + (v2 - v) * (a.frame - p) / (p2 - p) END ELSE a.unix END, 2) AS unix, CASE WHEN a.unix IS NULL AND n >= 2 THEN 'interpolated' END AS fix FROM {anchors} a LEFT JOIN seg ON seg.video = a.video AND ((a.frame >= p AND (p2 IS NULL OR a.frame < p2)) OR (a.frame < lo AND p = lo))""",
    ),
    "p8_file_date": (
        lambda s, d: view(s, d, "customers").select("c_custkey", t.file_date(F.concat(F.lit("rec_"), F.lpad((F.col("c_custkey") * 7919 % 400000).cast("string"), 6, "0"), F.lit(".mp4"))).alias("day")),
        "SELECT c_custkey, CAST(try_strptime(lpad(CAST(c_custkey * 7919 % 400000 AS STRING), 6, '0'), '%d%m%y') AS DATE) AS day FROM {customers} c",
    ),
    "p9_clean_text": (
        lambda s, d: view(s, d, "ocr").select("event_id", t.clean_ocr(F.col("text")).alias("clean")),
        f"SELECT event_id, {CLEAN} AS clean FROM {{ocr}} o",
    ),
    "p10_time_format": (
        lambda s, d: ocr_parsed(s, d).select("event_id", "fmt"),
        f"SELECT event_id, CASE WHEN {NO_TIME} THEN NULL ELSE {FORMATS} END AS fmt FROM {{events}} e",
    ),
    "p11_parse_time": (
        lambda s, d: ocr_parsed(s, d).select("event_id", F.round("unix", 3).alias("unix")),
        f"SELECT event_id, CASE WHEN {NO_TIME} THEN NULL WHEN event_id % 16 IN (12, 13) THEN epoch(date_trunc('minute', ts)) WHEN event_id % 16 = 5 AND day(ts) <= 12 THEN epoch(make_timestamp(year(ts), day(ts), month(ts), hour(ts), minute(ts), floor(second(ts)))) ELSE epoch(date_trunc('second', ts)) END AS unix FROM {{events}} e",
    ),
    "p12_missing_seconds": (
        lambda s, d: ocr_parsed(s, d).select("event_id", t.add_seconds(F.col("clean")).alias("text"), t.repair_seconds(F.col("clean"), "h:m:s a", F.to_date(F.timestamp_micros((F.col("t") * 1_000_000).cast("long"))), F.lit(0), "UTC").alias("unix")),
        rf"SELECT event_id, regexp_replace({CLEAN}, '(?i)^(\d?\d:\d\d)\s+(AM|PM)\b(.*)$', '\1:00 \2\3') AS text, CASE WHEN event_id % 16 = 12 THEN floor(t / 60) * 60 END AS unix FROM {{ocr}} o",
    ),
    "p13_user_time": (
        typed,
        "SELECT event_id, CAST(epoch(date_trunc(CASE WHEN event_id % 8 IN (0, 2, 7) THEN 'second' ELSE 'minute' END, ts)) AS DOUBLE) AS unix FROM {events} e",
    ),
    "p19_local_string": (
        lambda s, d: view(s, d, "anchors").select("event_id", t.local_string(F.col("unix"), "UTC").alias("at")),
        "SELECT event_id, CASE WHEN unix IS NULL THEN '—' ELSE strftime(make_timestamp(CAST(trunc(unix * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S') END AS at FROM {anchors} a",
    ),
    "p25_ocr_cost": (
        lambda s, d: view(s, d, "videos").select("video", t.ocr_calls(F.col("frames"), 1000).alias("calls"), F.round(t.ocr_cost(t.ocr_calls(F.col("frames"), 1000), 20), 6).alias("cost")),
        "SELECT video, frames // 1000 + 1 AS calls, round(greatest(frames // 1000 + 1 - 20, 0) * 1.5 / 1000, 6) AS cost FROM {videos} v",
    ),
    "p26_actual_rate": (
        lambda s, d: view(s, d, "known").withColumns({"f0": F.lag("frame").over(Window.partitionBy("video").orderBy("frame")), "u0": F.lag("unix").over(Window.partitionBy("video").orderBy("frame"))}).where("f0 IS NOT NULL").select("video", "frame", F.round(t.actual_rate(F.col("frame") - F.col("f0"), F.col("unix") - F.col("u0"), 30.0), 6).alias("fps")),
        "SELECT video, frame, round(CASE WHEN unix = u0 THEN 30 ELSE abs(frame - f0) / (unix - u0) END, 6) AS fps FROM (SELECT *, lag(frame) OVER o AS f0, lag(unix) OVER o AS u0 FROM {known} k WINDOW o AS (PARTITION BY video ORDER BY frame)) z WHERE f0 IS NOT NULL",
    ),
    "a15_accuracy": (
        lambda s, d: timemap.accuracy(accuracy_checks(s, d)),
        "SELECT video, count(*) AS n, round(avg(abs(delta)), 6) AS mean_abs, round(quantile_cont(abs(delta), 0.5), 6) AS median_abs, round(max(abs(delta)), 6) AS max_abs, round(avg(CAST(abs(delta) < 2 AS INT)), 6) AS share_ok, CASE WHEN avg(CAST(abs(delta) < 2 AS INT)) >= 0.95 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT video % 50 AS video, (event_id * 7 % 41)::DOUBLE / 10 - 2 AS delta FROM {known} k) z GROUP BY video",
    ),
    "a18_repair_report": (
        lambda s, d: timemap.repair_report(view(s, d, "anchors"), timemap.repair(lost_seconds(s, d))),
        f"""WITH {LOST}, mo AS (SELECT video, frame, unix FROM (SELECT *, max(unix) OVER (PARTITION BY video ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ax WHERE unix IS NOT NULL) z WHERE m IS NULL OR unix > m),
seg AS (SELECT video, frame AS p, unix AS v, lead(frame) OVER o AS p2, lead(unix) OVER o AS v2, min(frame) OVER (PARTITION BY video) AS lo, count(*) OVER (PARTITION BY video) AS n FROM mo WINDOW o AS (PARTITION BY video ORDER BY frame)),
af AS (SELECT a.video, a.frame, was, a.unix AS known, CASE WHEN a.unix IS NULL AND n >= 2 THEN CASE WHEN a.frame < lo OR p2 IS NULL THEN v ELSE v + (v2 - v) * (a.frame - p) / (p2 - p) END ELSE a.unix END AS unix FROM ax a LEFT JOIN seg ON seg.video = a.video AND ((a.frame >= p AND (p2 IS NULL OR a.frame < p2)) OR (a.frame < lo AND p = lo))),
st AS (SELECT video, count(*) FILTER (unix < before) AS violations FROM (SELECT video, unix, lag(unix) OVER (PARTITION BY video ORDER BY frame) AS before FROM af WHERE unix IS NOT NULL) z GROUP BY video)
SELECT af.video, count(*) FILTER (was IS NULL) AS missing_before, count(*) FILTER (unix IS NULL) AS missing_after, count(*) FILTER (was IS NULL AND known IS NOT NULL) AS repaired, count(*) FILTER (known IS NULL AND unix IS NOT NULL) AS interpolated, round(100.0::DOUBLE * count(*) FILTER (was IS NULL AND unix IS NOT NULL) / greatest(count(*) FILTER (was IS NULL), 1), 4) AS recovery, any_value(coalesce(violations, 0)) AS violations
FROM af LEFT JOIN st ON st.video = af.video GROUP BY af.video""",
    ),
    "a20_spans": (
        lambda s, d: timemap.spans(view(s, d, "known"), view(s, d, "known").groupBy("video").agg((F.max("frame") - 249).alias("total_frames"))).select("video", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), F.round("hours", 4).alias("hours"), "n_samples"),
        f"""WITH {ASOF}, pr AS (SELECT video, 0 AS frame, n FROM (SELECT video, max(frame) AS m, count(*) AS n FROM {{known}} k GROUP BY video) z UNION SELECT video, m - 250, n FROM (SELECT video, max(frame) AS m, count(*) AS n FROM {{known}} k GROUP BY video) z),
r AS (SELECT pr.video, pr.frame, n, CASE WHEN pr.frame < lo THEN v WHEN p2 IS NULL OR pr.frame = p THEN v ELSE v + (v2 - v) * (pr.frame - p) / (p2 - p) END AS u FROM pr JOIN seg ON seg.video = pr.video AND ((pr.frame >= p AND (p2 IS NULL OR pr.frame < p2)) OR (pr.frame < lo AND p = lo)))
SELECT video, round(min_by(u, frame), 3) AS start, round(max_by(u, frame), 3) AS end, round(round((max_by(u, frame) - min_by(u, frame)) / 3600, 6), 4) AS hours, max(n) AS n_samples FROM r WHERE n >= 2 GROUP BY video""",
    ),
    "a20_range_hours": (
        lambda s, d: timemap.range_hours(view(s, d, "ranges")),
        "SELECT video, count(*) AS n_ranges, round(sum(range_end - range_start) / 3600, 6) AS hours FROM {ranges} r GROUP BY video",
    ),
    # Intervals
    "w5_recording_gaps": (gaps_of, f"WITH {GAPS} SELECT grp, gap_start, gap_end FROM gp"),
    "j11_spans_gap": (
        lambda s, d: intervals.spanning(view(s, d, "stimuli").select("grp", F.col("start_ts").alias("a"), F.lead("start_ts").over(Window.partitionBy("grp").orderBy("start_ts")).alias("b")).where("b IS NOT NULL"), gaps_of(s, d)),
        f"WITH {GAPS}, {ONSETS} SELECT grp, a, b FROM sp WHERE EXISTS (SELECT 1 FROM gp WHERE gp.grp = sp.grp AND a < gap_end AND b > gap_start)",
    ),
    "j12_before_gaps": (lambda s, d: intervals.before_gaps(view(s, d, "stimuli"), gaps_of(s, d)), f"WITH {GAPS}, {LASTS} SELECT grp, gap_start, last_event FROM la"),
    "w4_onset_classes": (onsets, f"WITH {KINDS} SELECT grp, a, b, seconds, kind, interval FROM oc"),
    "w6_rolling_mean": (
        lambda s, d: intervals.rolling_mean(onsets(s, d).where("interval <> 'skip'")),
        f"WITH {KINDS} SELECT grp, a, round(m, 6) AS mean FROM (SELECT grp, a, avg(seconds) OVER (PARTITION BY grp ORDER BY a ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m, row_number() OVER (PARTITION BY grp ORDER BY a) AS r, count(*) OVER (PARTITION BY grp) AS n FROM oc WHERE interval <> 'skip') z WHERE r >= 10 AND n > 10",
    ),
    "w14_by_day": (
        lambda s, d: intervals.by_day(view(s, d, "valid")),
        "WITH z AS (SELECT grp, start_ts, end_ts, unnest(generate_series(CAST(floor(start_ts / 86400) AS BIGINT), CAST(floor(end_ts / 86400) AS BIGINT))) AS k FROM {valid} v), r AS (SELECT grp, DATE '1970-01-01' + CAST(k AS INT) AS day, round(greatest(start_ts - k * 86400, 0) / 3600, 6) AS from_hour, round(least(end_ts - k * 86400, 86400) / 3600, 6) AS to_hour FROM z) SELECT * FROM r WHERE to_hour > from_hour",
    ),
    "a13_interval_summary": (
        lambda s, d: intervals.interval_summary(onsets(s, d)),
        f"WITH {KINDS} SELECT grp, " + ", ".join(f"count(*) FILTER (interval = '{k}') AS {k}" for k in ("skip", "cluster", "drift", "normal")) + ", count(*) FILTER (kind = 'pre_reboot') AS pre_reboot, round(avg(seconds) FILTER (interval <> 'skip'), 6) AS mean FROM oc GROUP BY grp",
    ),
    "a14_duration_summary": (
        lambda s, d: intervals.duration_summary(view(s, d, "stimuli"), 140.0),
        "SELECT grp, count(*) AS n, round(avg(d), 6) AS mean, round(quantile_cont(d, 0.5), 6) AS median, round(min(d), 6) AS least, round(max(d), 6) AS most, count(*) FILTER (abs(d - 140) <= 14) AS n_ok, round(avg(CAST(abs(d - 140) <= 14 AS INT)), 6) AS share_ok FROM (SELECT grp, end_ts - start_ts AS d FROM {stimuli} s) z GROUP BY grp",
    ),
    "p22_duration_class": (
        lambda s, d: view(s, d, "stimuli").groupBy("grp", intervals.duration_class(F.round(F.col("end_ts") - F.col("start_ts")), 120.0).alias("kind")).agg(F.count("*").alias("n")),
        "SELECT grp, CASE WHEN r < 0.9 THEN 'short' WHEN r <= 1.1 THEN 'normal' WHEN r <= 1.5 THEN 'long' ELSE 'very_long' END AS kind, count(*) AS n FROM (SELECT grp, round(end_ts - start_ts) / 120 AS r FROM {stimuli} s) z GROUP BY ALL",
    ),
    # Names and labels
    "p6_modality": (
        lambda s, d: view(s, d, "customers").select("c_custkey", t.modality(F.col("file")).alias("a"), t.modality(F.col("file"), "index").alias("b")),
        "SELECT c_custkey, CASE WHEN lower(file) LIKE '%ir%' AND lower(file) NOT LIKE '%rgb%' THEN 'ir' ELSE 'rgb' END AS a, CASE WHEN lower(file) LIKE '%rgb%' THEN 'rgb' WHEN lower(file) LIKE '%ir%' THEN 'ir' ELSE 'unknown' END AS b FROM {customers} c",
    ),
    "p7_names": (
        lambda s, d: view(s, d, "clips").select("clip_id", t.clip_name(F.col("chamber"), F.col("wave"), t.stem(F.col("source_video")), F.col("start_sec"), True).alias("name"), t.frame_stem(F.col("video"), F.col("clip_id") * 37).alias("frame")),
        "SELECT clip_id, chamber || '_' || wave || '_' || replace(source_video, '.mkv', '') || '_s' || CAST(CAST(start_sec AS INT) AS STRING) || '_transformed.mp4' AS name, video || '_f' || printf('%06d', clip_id * 37) AS frame FROM {clips} c",
    ),
    "p14_label_issues": (
        lambda s, d: view(s, d, "lines").select("clip", "frame", "id", F.array_join(t.label_issues(F.when(F.col("q") % 29 == 5, F.lit(" \t ")).otherwise(F.col("line")), 1), ",").alias("issues"), F.array_join(t.label_issues(F.col("line"), None), ",").alias("unbounded")),
        "SELECT clip, frame, id, CASE q % 29 WHEN 1 THEN 'fields' WHEN 2 THEN 'not_numeric' WHEN 3 THEN 'class' WHEN 4 THEN 'range' ELSE '' END AS issues, CASE q % 29 WHEN 1 THEN 'fields' WHEN 2 THEN 'not_numeric' WHEN 4 THEN 'range' ELSE '' END AS unbounded FROM {lines} l",
    ),
    "p15_roi_shape": (
        lambda s, d: view(s, d, "customers").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.lit("[[1,2],[3,4],[5,6],[7,8]]")).when(F.col("c_custkey") % 3 == 1, F.lit("[[1,2],[3,4],[5,6]]")).otherwise(F.lit("[[1,2],[3],[5,6],[7,8]]")).alias("j")).select("c_custkey", roi_ok(F.from_json("j", "array<array<double>>")).alias("ok")),
        "SELECT c_custkey, c_custkey % 3 = 0 AS ok FROM {customers} c",
    ),
    "p21_fingerprint": (
        lambda s, d: view(s, d, "customers").select("c_custkey", t.fingerprint(F.format_string('{"b": {"y": [1, %d], "x" : "t"},  "a": %d}', F.col("c_custkey") % 10, "nation")).alias("hash")),
        """SELECT c_custkey, sha256('{"a":' || nation || ',"b":{"x":"t","y":[1,' || c_custkey % 10 || ']}}') AS hash FROM {customers} c""",
    ),
    "p24_metric_names": (
        lambda s, d: view(s, d, "metrics").select("run", "epoch", runs.first_filled("a", "b").alias("score")),
        "SELECT run, epoch, CASE WHEN coalesce(nullif(a, ''), b) = '' THEN 0 ELSE TRY_CAST(coalesce(nullif(a, ''), b) AS DOUBLE) END AS score FROM {metrics} m",
    ),
    "p18_evenly_spaced": (
        lambda s, d: view(s, d, "videos").select("video", F.explode(t.evenly_spaced(F.col("frames").cast("int"), 7)).alias("i")),
        "SELECT video, CAST(round_even(k * (frames - 1) / 6, 0) AS INT) AS i FROM {videos} v, range(0, 7) r(k)",
    ),
    "p16_dhash": (
        lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", t.dhash(F.col("embedding"), 8, 8).alias("hash")),
        "SELECT vec_id, CAST(sum(CASE WHEN embedding[r * 8 + c + 2] > embedding[r * 8 + c + 1] THEN 1::BIGINT << CAST(55 - (r * 7 + c) AS INT) ELSE 0 END) AS BIGINT) AS hash FROM embeddings, range(0, 8) a(r), range(0, 7) b(c) GROUP BY vec_id",
    ),
    "p17_hamming": (
        lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", t.hamming(F.col("vec_id"), F.col("vec_id") * 31).cast("int").alias("bits")),
        "SELECT vec_id, CAST(bit_count(xor(vec_id, vec_id * 31)) AS INT) AS bits FROM embeddings",
    ),
    "q8_first_wins": (
        lambda s, d: curation.first_wins(hashes(s, d), 5).select("seq"),
        "WITH RECURSIVE b AS (SELECT vec_id, list_reduce(list_transform(embedding[1:62], lambda x: CASE WHEN x > 0 THEN 1::BIGINT ELSE 0::BIGINT END), lambda a, c: a * 2 + c) AS h FROM embeddings), x AS (SELECT b.vec_id AS seq, xor(c.h, [0, 3, 15, 63][b.vec_id % 4 + 1]::BIGINT) AS hash FROM b JOIN b c ON c.vec_id = b.vec_id - b.vec_id % 4), o AS (SELECT row_number() OVER (ORDER BY seq) AS n, seq, hash FROM x), k AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS seqs, []::BIGINT[] AS hs UNION ALL SELECT o.n, CASE WHEN len(list_filter(hs, lambda y: bit_count(xor(y, o.hash)) <= 5)) = 0 THEN list_append(seqs, o.seq) ELSE seqs END, CASE WHEN len(list_filter(hs, lambda y: bit_count(xor(y, o.hash)) <= 5)) = 0 THEN list_append(hs, o.hash) ELSE hs END FROM k JOIN o ON o.n = k.n + 1) SELECT unnest(seqs) AS seq FROM (SELECT seqs FROM k ORDER BY n DESC LIMIT 1) z",
    ),
    # Clips and catalogues
    "f1_recipe": (
        lambda s, d: catalog.select_clips(view(s, d, "clips"), ["ch_1", "ch_2"], ["*"], ["structured"], ["vid_7_RGB.mkv"], ["clips/c1.mp4"]).select("clip_id"),
        "SELECT clip_id FROM {clips} c WHERE chamber IN ('ch_1', 'ch_2') AND layout = 'structured' AND source_video <> 'vid_7_RGB.mkv' AND clip_path <> 'clips/c1.mp4'",
    ),
    "f2_browse": (
        lambda s, d: catalog.browse_clips(view(s, d, "clips"), view(s, d, "clips").where("clip_id % 3 = 0").select("clip_path"), ["ch_3"], "VID_1", True).select("clip_id"),
        "SELECT clip_id FROM {clips} c WHERE chamber = 'ch_3' AND lower(source_video) LIKE '%vid_1%' AND clip_id % 3 = 0",
    ),
    "f3_since": (
        lambda s, d: catalog.since(s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 9 == 0, F.lit("")).when(F.col("event_id") % 9 == 1, F.date_format("ts", "yyyy-MM-dd")).when(F.col("event_id") % 9 == 2, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00'")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).alias("started_at"), "ts"), "started_at", "2024-01-15T06:00").select("event_id"),
        "SELECT event_id FROM events WHERE event_id % 9 <> 0 AND date_trunc(CASE WHEN event_id % 9 = 1 THEN 'day' ELSE 'second' END, ts) >= TIMESTAMP '2024-01-15 06:00:00'",
    ),
    "f4_long_enough": (
        lambda s, d: catalog.long_enough(view(s, d, "videos").drop("seconds"), 3000.0).select("video", "fps", F.round("seconds", 6).alias("seconds")),
        "SELECT video, CASE WHEN fps = 0 THEN 30 ELSE fps END AS fps, round(frames / CASE WHEN fps = 0 THEN 30 ELSE fps END, 6) AS seconds FROM {videos} v WHERE frames / CASE WHEN fps = 0 THEN 30 ELSE fps END >= 3010",
    ),
    "f6_unfinished": (
        lambda s, d: catalog.unfinished(view(s, d, "customers").select(t.stem(F.col("file")).alias("stem")), view(s, d, "customers").where("c_custkey % 2 = 0").select(t.stem(F.col("file")).alias("stem"), (F.col("c_custkey") * 3).alias("length"))),
        "SELECT replace(file, '.mkv', '') AS stem FROM {customers} c WHERE NOT (c_custkey % 2 = 0 AND c_custkey * 3 > 1024)",
    ),
    "j9_far_enough": (
        lambda s, d: catalog.far_enough(view(s, d, "candidates"), view(s, d, "taken"), 5.0),
        "SELECT video, start_sec, end_sec FROM {candidates} c WHERE NOT EXISTS (SELECT 1 FROM {taken} t WHERE t.video = c.video AND c.start_sec < t.end_sec + 5 AND c.end_sec > t.start_sec - 5)",
    ),
    "j10_in_valid_range": (
        lambda s, d: catalog.in_valid_range(view(s, d, "candidates"), view(s, d, "ranges"), view(s, d, "anchored")),
        "SELECT video, start_sec, end_sec FROM {candidates} c WHERE EXISTS (SELECT 1 FROM {ranges} r WHERE r.video = c.video AND ((c.start_sec >= range_start AND c.end_sec <= range_end) OR NOT EXISTS (SELECT 1 FROM {anchored} a WHERE a.video = c.video)))",
    ),
    "j4_video_files": (
        lambda s, d: catalog.video_files(view(s, d, "customers").select("c_custkey", F.concat(F.lit("/in/"), "file").alias("path")), view(s, d, "customers").where("c_custkey % 3 = 0").select(F.concat(F.lit("/out/"), F.regexp_replace("file", "mkv", "parquet")).alias("path")), view(s, d, "customers").where("c_custkey % 4 <> 0").select(t.stem(F.col("file")).alias("stem"), F.lit("r").alias("roi"))).select("c_custkey", "track", "warning"),
        "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '/out/' || replace(file, 'mkv', 'parquet') END AS track, concat_ws(',', CASE WHEN c_custkey % 3 <> 0 THEN 'track' END, CASE WHEN c_custkey % 4 = 0 THEN 'roi' END) AS warning FROM {customers} c",
    ),
    "j13_image_pairs": (
        lambda s, d: catalog.pair_images(*images(s, d)).select("clip", "stem", "ext"),
        "SELECT clip, stem, ext FROM (SELECT l.clip, l.stem, i.ext, row_number() OVER (PARTITION BY l.clip, l.stem ORDER BY list_position(['png', 'jpg', 'jpeg', 'bmp'], ext)) AS r FROM {labels_of} l JOIN {images} i ON i.clip = l.clip AND i.stem = l.stem) z WHERE r = 1",
    ),
    "u2_orphan_labels": (lambda s, d: catalog.orphans(*images(s, d)).select("clip", "stem"), "SELECT clip, stem FROM {labels_of} l EXCEPT SELECT clip, stem FROM {images} i"),
    "j14_annotated": (
        lambda s, d: catalog.browse_clips(view(s, d, "clips"), view(s, d, "clips").where("clip_id % 3 = 0").select("clip_path"), annotated=False).select("clip_id"),
        "SELECT clip_id FROM {clips} c WHERE clip_path NOT IN (SELECT clip_path FROM {clips} d WHERE clip_id % 3 = 0)",
    ),
    "j15_fallback": (
        lambda s, d: catalog.with_fallback(view(s, d, "customers").select("c_custkey", F.col("file").alias("video")), view(s, d, "customers").where("c_custkey % 4 < 2").select(F.when(F.col("c_custkey") % 4 == 0, F.col("file")).otherwise(F.concat(t.stem(F.col("file")), F.lit(".mp4"))).alias("name"), F.col("c_custkey").alias("value")).unionByName(s.range(1).select(F.lit("_default").alias("name"), F.lit(-1).cast("long").alias("value")))).select("c_custkey", "value"),
        "SELECT c_custkey, CASE WHEN c_custkey % 4 < 2 THEN c_custkey ELSE -1 END AS value FROM {customers} c",
    ),
    "j16_uncovered": (
        lambda s, d: catalog.uncovered(view(s, d, "customers").select(F.col("file").alias("video")), view(s, d, "customers").where("c_custkey % 4 < 2").select(F.when(F.col("c_custkey") % 4 == 0, F.col("file")).otherwise(F.concat(t.stem(F.col("file")), F.lit(".mp4"))).alias("name"))),
        "SELECT file AS video FROM {customers} c WHERE c_custkey % 4 >= 2",
    ),
    "j17_reconcile": (catalog_rows, RECON),
    "j18_new_batches": (
        lambda s, d: catalog.new_batches(batches(s, d).distinct(), batches(s, d, "clip_id % 32 = 0").distinct()),
        f"SELECT DISTINCT {BATCH} FROM {{clips}} c EXCEPT SELECT {BATCH} FROM {{clips}} d WHERE clip_id % 32 = 0",
    ),
    "a9_split_counts": (
        lambda s, d: catalog.split_counts(split_frames(s, d).withColumns({"chamber": F.concat(F.lit("ch"), F.col("clip") % 5), "wave": F.concat(F.lit("w"), F.col("clip") % 3)}), "val"),
        "SELECT clip, 'ch' || clip % 5 AS chamber, 'w' || clip % 3 AS wave, CAST(round_even(0.8::DOUBLE * n, 0) - round_even(0.6::DOUBLE * n, 0) AS BIGINT) AS n_frames FROM (SELECT clip, count(*) AS n FROM {frames} f GROUP BY clip) z WHERE round_even(0.8::DOUBLE * n, 0) > round_even(0.6::DOUBLE * n, 0)",
    ),
    "a10_dataset_summary": (
        lambda s, d: catalog.dataset_summary(view(s, d, "clips").select(F.col("layout").alias("split"), F.col("video").alias("clip"), "chamber", "wave")),
        "SELECT layout AS split, count(*) AS frames, count(DISTINCT video) AS clips, string_agg(DISTINCT chamber, ',' ORDER BY chamber) AS chambers, string_agg(DISTINCT wave, ',' ORDER BY wave) AS waves FROM {clips} c GROUP BY layout",
    ),
    "a11_triage": (
        lambda s, d: catalog.tallies(view(s, d, "clips").withColumn("status", F.element_at(F.array(F.lit("approved"), F.lit("rejected"), F.lit(" "), F.lit("pending")), (F.col("clip_id") % 4 + 1).cast("int"))), "status", ["chamber"]),
        "SELECT chamber, count(*) FILTER (clip_id % 4 = 0) AS approved, count(*) FILTER (clip_id % 4 = 1) AS rejected, count(*) FILTER (clip_id % 4 >= 2) AS pending FROM {clips} c GROUP BY chamber",
    ),
    "a12_progress": (
        lambda s, d: catalog.progress(view(s, d, "clips").select("wave", F.explode(F.array(F.lit("legacy"), F.lit("structured"), F.lit("other"))).alias("split")), view(s, d, "clips").select("wave", F.col("layout").alias("split"))),
        "SELECT w.wave, l.layout AS split, count(c.clip_id) AS n, count(c.clip_id) = 0 AS missing FROM (SELECT DISTINCT wave FROM {clips} c) w CROSS JOIN (VALUES ('legacy'), ('structured'), ('other')) l(layout) LEFT JOIN {clips} c ON c.wave = w.wave AND c.layout = l.layout GROUP BY ALL",
    ),
    "a19_outcomes": (
        lambda s, d: catalog.outcomes(catalog_rows(s, d)),
        f"SELECT status, count(*) AS n FROM ({RECON}) z GROUP BY status",
    ),
    "r1_candidates": (
        lambda s, d: sampling.draw_candidates(view(s, d, "videos"), 2000, 3.0, 9),
        f"WITH v AS (SELECT video, seconds, sum(frames) OVER (ORDER BY video) AS hi, frames, sum(frames) OVER () AS a FROM {{videos}} v), t AS (SELECT i, {HEX.replace('WHAT', 'video')} AS u, {HEX.replace('WHAT', 'start')} AS s FROM range(1, 2001) r(i)) SELECT i AS try, video, round(5 + s * (seconds - 13), 6) AS start_sec, round(5 + s * (seconds - 13) + 3, 6) AS end_sec FROM t JOIN v ON u >= (hi - frames)::DOUBLE / a AND u < hi::DOUBLE / a",
    ),
    "r1_accepted": (lambda s, d: sampling.accept(catalog.far_enough(sampling.draw_candidates(view(s, d, "videos"), 2000, 3.0, 9), view(s, d, "taken"), 5.0), 100, 60.0), None),
    "r1_sampled": (lambda s, d: sampling.sample_clips(view(s, d, "videos"), 100, 3.0, 9, view(s, d, "taken"), view(s, d, "ranges"), view(s, d, "anchored"), 5.0), None),
    "r6_audit_grid": (
        lambda s, d: sampling.audit_frames(view(s, d, "known").groupBy("video").agg((F.max("frame") + 1).alias("frames")), view(s, d, "known"), 5, 8),
        "SELECT video, frame FROM (SELECT video, frame, row_number() OVER (PARTITION BY video ORDER BY md5('8|' || CAST(video AS STRING) || '|' || CAST(frame AS STRING)), frame) AS r FROM (SELECT video, unnest(range(0, CAST(m AS BIGINT) + 1, 100)) AS frame FROM (SELECT video, max(frame) AS m FROM {known} k GROUP BY video) x) y ANTI JOIN {known} k2 ON k2.video = y.video AND k2.frame = y.frame) z WHERE r <= 5",
    ),
    "r2_ratio_split": (
        split_frames,
        f"SELECT clip, frame, CASE WHEN r <= round_even(0.6::DOUBLE * n, 0) THEN 'train' WHEN r <= round_even(0.8::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY {md5_order(42, 'k')}, k) AS r, count(*) OVER (PARTITION BY clip) AS n FROM (SELECT clip, frame, CAST(clip AS STRING) || '/' || CAST(frame AS STRING) AS k FROM {{frames}} f) y) z",
    ),
    "r3_hold_out": (
        lambda s, d: catalog.hold_out(view(s, d, "frames"), 0.15, 5).groupBy("clip", "split").agg(F.count("*").alias("n")),
        f"""WITH k AS (SELECT clip, row_number() OVER (ORDER BY {md5_order(5, 'CAST(clip AS STRING)')}) AS r, count(*) OVER () AS m FROM (SELECT DISTINCT clip FROM {{frames}} f) y),
e AS (SELECT clip, row_number() OVER (ORDER BY {md5_order(5, 'k')}) AS fr, count(*) OVER () AS fm FROM (SELECT clip, CAST(clip AS STRING) || '|' || CAST(frame AS STRING) AS k FROM {{frames}} f) y)
SELECT e.clip, CASE WHEN CASE WHEN greatest(1, floor(m * 0.15)) >= m THEN fr <= greatest(1, floor(fm * 0.15)) ELSE r <= greatest(1, floor(m * 0.15)) END THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM e JOIN k ON k.clip = e.clip GROUP BY ALL""",
    ),
    "r3_hold_out_frames": (
        lambda s, d: catalog.hold_out(view(s, d, "frames").where("clip = 0"), 0.15, 5),
        f"SELECT clip, frame, CASE WHEN row_number() OVER (ORDER BY {md5_order(5, 'k')}) <= greatest(1, floor(count(*) OVER () * 0.15)) THEN 'val' ELSE 'train' END AS split FROM (SELECT clip, frame, CAST(clip AS STRING) || '|' || CAST(frame AS STRING) AS k FROM {{frames}} f WHERE clip = 0) y",
    ),
    "r4_sample": (
        lambda s, d: catalog.sample_rows(view(s, d, "frames"), 40, F.concat_ws("/", F.col("clip").cast("string"), F.col("frame").cast("string")), 3, ["clip"]),
        f"SELECT clip, frame FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY {md5_order(3, 'k')}) AS r FROM (SELECT clip, frame, CAST(clip AS STRING) || '/' || CAST(frame AS STRING) AS k FROM {{frames}} f) y) z WHERE r <= 40",
    ),
    "r5_segments": (
        lambda s, d: sampling.segments(view(s, d, "frames").groupBy(F.col("clip").alias("video")).agg(F.min("frame").alias("first"), F.max("frame").alias("last")), 3, 50, 4),
        """WITH v AS (SELECT clip AS video, min(frame) AS first, max(frame) AS last FROM {frames} f GROUP BY clip), k AS (SELECT *, least(3, (last - first + 1) // 50) AS k, last - first + 1 - 50 * least(3, (last - first + 1) // 50) AS free FROM v WHERE last - first + 1 > 50),
d AS (SELECT video, first, row_number() OVER (PARTITION BY video ORDER BY x) - 1 AS i, x FROM (SELECT video, first, CAST(floor(CAST(('0x' || substr(md5('4|' || CAST(video AS STRING) || '|' || CAST(i AS STRING)), 1, 8)) AS BIGINT)::DOUBLE / 4294967296 * (free + 1)) AS BIGINT) AS x FROM k JOIN range(1, 4) r(i) ON i <= k) z)
SELECT video, first + x + i * 50 AS first, first + x + i * 50 + 49 AS last FROM d UNION ALL SELECT video, first, last FROM v WHERE last - first + 1 <= 50""",
    ),
    "r6_audit": (
        lambda s, d: catalog.sample_rows(view(s, d, "frames").where("frame % 100 <> 0 AND frame % 10 = 0"), 5, F.concat_ws("/", F.col("clip").cast("string"), F.col("frame").cast("string")), 8, ["clip"]),
        f"SELECT clip, frame FROM (SELECT clip, frame, row_number() OVER (PARTITION BY clip ORDER BY {md5_order(8, 'k')}) AS r FROM (SELECT clip, frame, CAST(clip AS STRING) || '/' || CAST(frame AS STRING) AS k FROM {{frames}} f WHERE frame % 100 <> 0 AND frame % 10 = 0) y) z WHERE r <= 5",
    ),
    "k3_listing": (
        lambda s, d: catalog.listing_by(view(s, d, "clips").select("clip_id", "start_sec"), "start_sec").limit(200).agg(F.concat_ws(",", F.collect_list(F.col("start_sec").cast("string"))).alias("listed")),
        "SELECT string_agg(t, ',' ORDER BY t DESC) AS listed FROM (SELECT CAST(start_sec AS STRING) AS t FROM {clips} c ORDER BY 1 DESC LIMIT 200) z",
    ),
    "k6_next_number": (
        lambda s, d: catalog.next_number(view(s, d, "customers").select(F.concat(F.lit("ch.1_batch"), F.when(F.col("c_custkey") % 3 == 0, F.lit("_999")).when(F.col("c_custkey") % 5 == 0, F.lit("7b")).otherwise((F.col("c_custkey") % 157).cast("string"))).alias("name")), "ch.1_batch"),
        "SELECT printf('%02d', max(c_custkey % 157) + 1) AS next_number FROM {customers} c WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0",
    ),
    "k7_next_pending": (
        lambda s, d: catalog.next_pending(view(s, d, "clips"), 501, 1_000_000_000, F.col("clip_id") % 5 == 2, "clip_id").select("clip_id"),
        "SELECT arg_min(clip_id, ((clip_id - 502) % 1000000000 + 1000000000) % 1000000000) AS clip_id FROM {clips} c WHERE clip_id % 5 = 2",
    ),
    "u3_union_listing": (
        lambda s, d: catalog.union_listing(view(s, d, "clips").where("clip_id % 2 = 0").select("source_video"), view(s, d, "clips").where("clip_id % 3 = 0").select("source_video"), key="source_video"),
        "SELECT source_video FROM {clips} c WHERE clip_id % 2 = 0 UNION SELECT source_video FROM {clips} d WHERE clip_id % 3 = 0",
    ),
    "u5_concat": (
        lambda s, d: catalog.combined({"taken": view(s, d, "taken"), "new": view(s, d, "candidates")}).groupBy("video", "origin").agg(F.count("*").alias("n")),
        "SELECT video, origin, count(*) AS n FROM (SELECT *, 'taken' AS origin FROM {taken} t UNION ALL SELECT *, 'new' FROM {candidates} c) z GROUP BY video, origin",
    ),
    "m1_upsert": (
        lambda s, d: catalog.upsert(view(s, d, "old_catalog").withColumn("note", F.lit(None).cast("string")), view(s, d, "new_listing").select("path", F.col("size"), F.col("readable").alias("missing"), F.explode(F.array(F.lit("b"), F.lit("a"))).alias("note")).withColumn("at", F.when(F.col("note") == "a", 2).otherwise(1)), ["path"], "at").drop("at"),
        "SELECT coalesce(n.path, o.path) AS path, coalesce(n.size, o.size) AS size, CAST(coalesce(n.readable, o.missing) AS INT) AS missing, CASE WHEN n.path IS NULL THEN '' ELSE 'a' END AS note FROM {old_catalog} o FULL JOIN {new_listing} n ON n.path = o.path",
    ),
    "m5_dataset": (
        lambda s, d: split_frames(s, d).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("clip").alias("clips")),
        "SELECT split, count(*) AS n, count(DISTINCT clip) AS clips FROM (SELECT clip, CASE WHEN r <= round_even(0.6::DOUBLE * n, 0) THEN 'train' WHEN r <= round_even(0.8::DOUBLE * n, 0) THEN 'val' ELSE 'test' END AS split FROM (SELECT clip, row_number() OVER (PARTITION BY clip) AS r, count(*) OVER (PARTITION BY clip) AS n FROM {frames} f) y) z GROUP BY split",
    ),
    "m6_triage_marks": (
        lambda s, d: triaged(s, d),
        "SELECT frame_key, CASE WHEN frame % 7 <> 0 THEN 'yes' ELSE 'no' END AS annotated, CASE WHEN frame % 5 = 0 THEN 'rejected' WHEN frame % 5 = 1 THEN 'approved' ELSE 'pending' END AS status, CASE WHEN frame % 5 = 0 THEN '_rejected' ELSE '' END AS folder FROM (SELECT frame, 'c' || CAST(clip AS STRING) || '/f' || CAST(frame AS STRING) AS frame_key FROM {frames} f) z",
    ),
    "m7_register": (
        lambda s, d: catalog.register_sources(sources_of(s, d, "c_custkey % 3 <> 0").withColumn("waves", F.array(F.col("drive_uuid"))), sources_of(s, d, "c_custkey % 2 = 0").withColumn("drive_uuid", F.concat(F.lit("new"), "drive_uuid")).withColumn("drive_label", F.when(F.col("drive_uuid").endswith("4"), "").otherwise(F.col("drive_label")))).select("chamber_id", "drive_uuid", "drive_label", F.array_join("waves", ",").alias("waves"), "created"),
        "SELECT 'ch' || c_custkey AS chamber_id, CASE WHEN c_custkey % 2 = 0 THEN 'newd' ELSE 'd' END || c_custkey AS drive_uuid, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 10 = 4 THEN '' ELSE 'label' || nation END AS drive_label, CASE WHEN c_custkey % 3 <> 0 THEN 'd' || c_custkey ELSE '' END AS waves, c_custkey % 3 = 0 AS created FROM {customers} c WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    ),
    "s18_video_index": (
        lambda s, d: writers.video_index(view(s, d, "clips").select("wave", F.col("clip_path").alias("path"), "start_sec")).select("wave", "n_videos", F.explode(F.from_json("document", "array<struct<path:string,start_sec:double>>")).alias("v")).groupBy("wave", "n_videos").agg(F.count("v.path").alias("n"), F.sum("v.start_sec").alias("seconds")),
        "SELECT wave, count(*) AS n_videos, count(*) AS n, sum(start_sec) AS seconds FROM {clips} c GROUP BY wave",
    ),
    # Runs, lineage, grids
    "a16_best_epochs": (best_runs, f"WITH {BEST} SELECT run, epoch, score FROM be"),
    "k2_leaderboard": (lambda s, d: runs.leaderboard(best_runs(s, d), 10), f"WITH {BEST} SELECT * FROM (SELECT run, epoch, score, row_number() OVER (ORDER BY score DESC, run) AS rank FROM be) z WHERE rank <= 10"),
    "a17_composite": (
        lambda s, d: runs.composite(view(s, d, "totals_of"), {"quality": 0.7, "cost": -0.2, "fixed": 0.1}),
        "SELECT candidate, quality, cost, fixed, round((quality - a) / (b - a) * 0.7 + (1 - (cost - e) / (f - e)) * 0.2 + 0.05, 4) AS score FROM {totals_of} t CROSS JOIN (SELECT min(quality) AS a, max(quality) AS b, min(cost) AS e, max(cost) AS f FROM {totals_of} u) m",
    ),
    "a22_winner": (lambda s, d: runs.leaderboard(best_runs(s, d), 1).select("run", "score"), f"WITH {BEST} SELECT run, score FROM be ORDER BY score DESC, run LIMIT 1"),
    "j19_lineage": (
        lambda s, d: runs.lineage(view(s, d, "artifacts"), view(s, d, "meta")),
        "SELECT path, dir, coalesce(kind, 'unknown') AS kind, depth FROM (SELECT a.path, m.dir, m.kind, CAST(len(string_split(a.path, '/')) - len(string_split(m.dir, '/')) AS INT) AS depth, row_number() OVER (PARTITION BY a.path ORDER BY length(m.dir) DESC NULLS LAST) AS r FROM {artifacts} a LEFT JOIN {meta} m ON starts_with(a.path, m.dir || '/')) z WHERE r = 1",
    ),
    "j19_trace": (
        lambda s, d: runs.trace(view(s, d, "traced"), view(s, d, "experiments"), view(s, d, "runs_of"), view(s, d, "datasets")),
        """SELECT path, kind, CASE WHEN kind IN ('eval', 'experiment_artifact') THEN edir WHEN kind = 'batch_output' THEN x.dir END AS experiment_dir, batch_dir, CASE WHEN kind = 'dataset' THEN CASE WHEN is_dir THEN path ELSE parent END END AS dataset_dir
FROM (SELECT *, CASE WHEN kind = 'batch_output' THEN coalesce(bdir, parent) END AS batch_dir FROM (SELECT a.path, is_dir, regexp_replace(a.path, '/[^/]*$', '') AS parent, e.dir AS edir, b.dir AS bdir,
  CASE WHEN a.path LIKE '%/eval_config.yaml' THEN 'eval' WHEN a.path LIKE '%/_meta.json' OR (b.dir IS NOT NULL AND (a.path LIKE '%.parquet' OR a.path LIKE '%.TXT')) THEN 'batch_output' WHEN a.path LIKE '%/manifest.csv' OR t.dir IS NOT NULL THEN 'dataset' WHEN e.dir IS NOT NULL THEN 'experiment_artifact' ELSE 'unknown' END AS kind
  FROM {traced} a LEFT JOIN {experiments} e ON starts_with(a.path, e.dir || '/') LEFT JOIN {runs_of} b ON starts_with(a.path, b.dir || '/') LEFT JOIN {datasets} t ON t.dir = a.path AND is_dir) y) z
LEFT JOIN {runs_of} r ON r.dir = batch_dir LEFT JOIN {experiments} x ON x.root = r.root AND x.chamber_type = r.chamber_type AND x.name = r.experiment_name""",
    ),
    "a21_softmax": (
        lambda s, d: heatmap.softmax(grid(s, d)).select("frame", "kp", "yy", "xx", F.round("p", 8).alias("p")),
        f"WITH {GRID} SELECT frame, kp, yy, xx, round(p, 8) AS p FROM sm",
    ),
    "w15_local_maxima": (
        lambda s, d: heatmap.local_maxima(heatmap.softmax(grid(s, d))).select("frame", "kp", "yy", "xx"),
        f"WITH {GRID}, {PEAK} SELECT frame, kp, yy, xx FROM lm",
    ),
    "k5_peaks": (
        lambda s, d: heatmap.peaks(grid(s, d)).select("frame", "kp", "rank", "yy", "xx", F.round("p", 8).alias("p")),
        f"WITH {GRID}, {PEAK} SELECT frame, kp, rank, yy, xx, round(p, 8) AS p FROM (SELECT lm.*, row_number() OVER (PARTITION BY lm.frame, lm.kp ORDER BY lm.p DESC, yy, xx) AS rank FROM lm JOIN (SELECT frame, kp, max(p) AS top FROM sm GROUP BY frame, kp) m ON m.frame = lm.frame AND m.kp = lm.kp WHERE lm.p > 0.2::DOUBLE * top) z WHERE rank <= 3",
    ),
    "s15_wide_keypoints": (
        lambda s, d: s.read.parquet(f"{d}/embeddings.parquet").select("vec_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda k: F.struct((k + 1).alias("track_id"), F.round(F.get("embedding", k * 3).cast("double"), 6).alias("x"), F.round(F.get("embedding", k * 3 + 1).cast("double"), 6).alias("y")))).alias("p")).select("vec_id", "p.*"),
        "SELECT vec_id, CAST(k + 1 AS INT) AS track_id, round(embedding[k * 3 + 1]::DOUBLE, 6) AS x, round(embedding[k * 3 + 2]::DOUBLE, 6) AS y FROM embeddings, range(0, 2) r(k)",
    ),
}

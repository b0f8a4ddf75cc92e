"""Registered queries over boxes and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackframe.functions import geometry as g
from trackframe.functions import text as t
from trackframe.operators import catalog, curation, matching, metrics, tracking, tracks
from trackframe.plans.fixtures import parts, table, view
from trackframe.sources import writers

XYWH = "xywh"
IOU = "greatest(0, least(g.x+g.w, p.x+p.w) - greatest(g.x, p.x)) * greatest(0, least(g.y+g.h, p.y+p.h) - greatest(g.y, p.y))"
PAIRS = f"SELECT clip, frame, gid, pid, i / (a - i) AS iou FROM (SELECT g.clip, g.frame, g.id AS gid, p.id AS pid, {IOU} AS i, g.w*g.h + p.w*p.h AS a FROM {{gt}} g JOIN {{pred}} p ON g.clip = p.clip AND g.frame = p.frame) z"
MATCHED = f"pairs AS ({PAIRS}), m AS (SELECT * FROM pairs WHERE iou >= 0.5)"
COUNTS = "n AS (SELECT coalesce(a.clip, b.clip) AS clip, coalesce(a.n, 0) AS n_gt, coalesce(b.n, 0) AS n_pred FROM (SELECT clip, count(*) AS n FROM {gt} g GROUP BY clip) a FULL JOIN (SELECT clip, count(*) AS n FROM {pred} p GROUP BY clip) b ON a.clip = b.clip)"
SWITCHED = "s AS (SELECT * FROM (SELECT clip, frame, gid, lag(pid) OVER (PARTITION BY clip, gid ORDER BY frame) AS previous_pid, pid FROM m) z WHERE previous_pid IS NOT NULL AND previous_pid <> pid)"
QUALITY = f"{MATCHED}, {COUNTS}, {SWITCHED}, q AS (SELECT n.clip, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, n_gt - coalesce(tp, 0) AS fn, coalesce(idsw, 0) AS idsw, n_gt, n_pred FROM n LEFT JOIN (SELECT clip, count(*) AS tp FROM m GROUP BY clip) h ON n.clip = h.clip LEFT JOIN (SELECT clip, count(*) AS idsw FROM s GROUP BY clip) i ON n.clip = i.clip)"
PR = "CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END"
RE = "CASE WHEN n_gt > 0 THEN tp / n_gt ELSE 0 END"


def hota_sql(gt: str, pred: str) -> str:
    pairs = PAIRS.replace("{gt}", gt).replace("{pred}", pred)
    return f"""pairs AS (SELECT * FROM ({pairs}) y WHERE iou > 0),
al AS (SELECT i AS a, 0.05 + (i - 1) * 0.05::DOUBLE AS alpha FROM range(1, 20) r(i)),
tpa AS (SELECT clip, a, gid, pid, count(*) AS n FROM pairs JOIN al ON iou >= alpha GROUP BY ALL),
ass AS (SELECT clip, a, sum(n) AS tp, sum(n * n / (ng + np - n)) AS s FROM (SELECT *, sum(n) OVER (PARTITION BY clip, a, gid) AS ng, sum(n) OVER (PARTITION BY clip, a, pid) AS np FROM tpa) z GROUP BY clip, a),
{COUNTS.replace("{gt}", gt).replace("{pred}", pred)},
v AS (SELECT n.clip, coalesce(tp, 0) / (n_gt + n_pred - coalesce(tp, 0)) AS det, CASE WHEN coalesce(tp, 0) > 0 THEN s / tp ELSE 0 END AS ass FROM n CROSS JOIN al LEFT JOIN ass ON n.clip = ass.clip AND al.a = ass.a)
SELECT clip, round(avg(sqrt(det * ass)), 4) AS hota, round(avg(det), 4) AS deta, round(avg(ass), 4) AS assa FROM v GROUP BY clip"""


FILL = """WITH f AS (SELECT clip, id, frame, x, y, w, h, conf, lead(frame) OVER o AS nf, lead(x) OVER o AS nx, lead(y) OVER o AS ny, lead(w) OVER o AS nw, lead(h) OVER o AS nh FROM {pred} g WINDOW o AS (PARTITION BY clip, id ORDER BY frame)),
r AS (SELECT *, unnest(range(0, 1 + CASE WHEN nf - frame > 1 THEN %s ELSE 0 END)) AS s FROM f)
SELECT clip, id, frame + s AS frame, round(CASE WHEN s > 0 THEN x + (nx - x) * s / (nf - frame) ELSE x END, 6) AS x, round(CASE WHEN s > 0 THEN y + (ny - y) * s / (nf - frame) ELSE y END, 6) AS y, round(CASE WHEN s > 0 THEN w + (nw - w) * s / (nf - frame) ELSE w END, 6) AS w, round(CASE WHEN s > 0 THEN h + (nh - h) * s / (nf - frame) ELSE h END, 6) AS h, round(CASE WHEN s > 0 THEN 1 ELSE conf END, 6) AS conf, s > 0 AS filled FROM r"""


def shares(s, d):
    """Tasks that share boxes, by the rows of the table that they come from."""
    return parts(s, table(s, d, "lineitem"))


def filled(s, d, whole):
    out = tracks.fill_gaps(view(s, d, "pred"), 5, whole, shares(s, d))
    return out.select("clip", "id", "frame", *(F.round(c, 6).alias(c) for c in (*XYWH, "conf")), "filled")


def merged(s, d):
    gt, pred = metrics.one_timeline(view(s, d, "gt"), view(s, d, "pred"))
    return metrics.hota(gt, pred)


MERGED = """lastf AS (SELECT clip, max(frame) + 1 AS span FROM (SELECT clip, frame FROM {gt} g UNION ALL SELECT clip, frame FROM {pred} p) z GROUP BY clip),
off AS (SELECT clip, coalesce(sum(span) OVER (ORDER BY clip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM lastf),
g1 AS (SELECT 'overall' AS clip, g.frame + o AS frame, id, x, y, w, h FROM {gt} g JOIN off ON g.clip = off.clip),
p1 AS (SELECT 'overall' AS clip, p.frame + o AS frame, id, x, y, w, h FROM {pred} p JOIN off ON p.clip = off.clip),
"""

ROI = ((889, 63), (315, 61), (327, 622), (870, 629))


def rectified(s, d):
    c = g.sort_corners(F.array(*(F.array(F.lit(float(a)), F.lit(float(b))) for a, b in ROI)))
    u, v = g.rectify(F.col("x"), F.col("y"), F.col("c"), F.lit(640.0), F.lit(640.0))
    return view(s, d, "gt").withColumn("c", c).select("clip", "frame", "id", F.round(u, 4).alias("u"), F.round(v, 4).alias("v"))


def rectified_by_clip(s, d):
    """Every clip in the region of its video, which is kept under the name of another file of the same stem."""
    corners = lambda shift: F.array(*(F.array(F.lit(float(a)) + shift, F.lit(float(b))) for a, b in ROI))
    clips = view(s, d, "frames").select("clip").distinct()
    regions = clips.where("clip % 7 <> 0").select(F.concat(F.lit("c"), F.col("clip").cast("string"), F.lit(".mp4")).alias("name"), corners(8.0 * (F.col("clip") % 5)).alias("value"))
    regions = regions.unionByName(s.range(1).select(F.lit("_default").alias("name"), corners(F.lit(0.0)).alias("value")))
    of = catalog.with_fallback(clips.withColumn("video", F.concat(F.lit("c"), F.col("clip").cast("string"), F.lit(".mkv"))), regions).select("clip", "value")
    u, v = g.rectify(F.col("x"), F.col("y"), g.sort_corners(F.col("value")), F.lit(640.0), F.lit(640.0))
    return view(s, d, "gt").join(of, "clip").select("clip", "frame", "id", F.round(u, 3).alias("u"), F.round(v, 3).alias("v"))


RECTIFY = """WITH k AS (SELECT 315.0::DOUBLE x0, 61.0::DOUBLE y0, 889.0::DOUBLE x1, 63.0::DOUBLE y1, 870.0::DOUBLE x2, 629.0::DOUBLE y2, 327.0::DOUBLE x3, 622.0::DOUBLE y3),
k2 AS (SELECT *, x0-x1+x2-x3 AS sx, y0-y1+y2-y3 AS sy, x1-x2 AS dx1, x3-x2 AS dx2, y1-y2 AS dy1, y3-y2 AS dy2 FROM k),
k3 AS (SELECT *, (sx*dy2-dx2*sy)/(dx1*dy2-dx2*dy1) AS g, (dx1*sy-sx*dy1)/(dx1*dy2-dx2*dy1) AS h FROM k2),
k4 AS (SELECT x0, y0, g, h, x1-x0+g*x1 AS a, x3-x0+h*x3 AS b, y1-y0+g*y1 AS d, y3-y0+h*y3 AS e FROM k3)
SELECT t.clip, t.frame, t.id, round(639 * ((e-y0*k4.h)*t.x + (x0*k4.h-b)*t.y + b*y0-x0*e) / ((k4.d*k4.h-e*k4.g)*t.x + (b*k4.g-k4.a*k4.h)*t.y + k4.a*e-b*k4.d), 4) AS u, round(639 * ((y0*k4.g-k4.d)*t.x + (k4.a-x0*k4.g)*t.y + x0*k4.d-k4.a*y0) / ((k4.d*k4.h-e*k4.g)*t.x + (b*k4.g-k4.a*k4.h)*t.y + k4.a*e-b*k4.d), 4) AS v FROM {gt} t CROSS JOIN k4"""

MIN_IOU = f"""r AS (SELECT g.*, dense_rank() OVER (PARTITION BY clip ORDER BY frame) AS r FROM {{gt}} g),
mi AS (SELECT clip, frame, min(i / (a - i)) AS min_iou FROM (SELECT g.clip, g.frame, {IOU} AS i, g.w*g.h + p.w*p.h AS a FROM r g JOIN r p ON g.clip = p.clip AND g.id = p.id AND g.r = p.r + 1) z GROUP BY clip, frame)"""


def q_rows(s, d, method, **options):
    out = tracking.track(view(s, d, "pred"), method, **options)
    return out.select("clip", "frame", "id", *(F.round(c, 4).alias(c) for c in "xywh"))


QUERIES = {
    "p1_box_forms": (
        lambda s, d: view(s, d, "gt").select("clip", "frame", "id", (F.col("x") + F.col("w")).alias("x2"), (F.col("y") + F.col("h")).alias("y2"), g.center(*map(F.col, XYWH))[0].alias("cx"), g.center(*map(F.col, XYWH))[1].alias("cy"), (F.col("x") + F.floor(F.col("w") / 2)).alias("tx")),
        "SELECT clip, frame, id, x + w AS x2, y + h AS y2, x + w / 2 AS cx, y + h / 2 AS cy, x + floor(w / 2) AS tx FROM {gt} g",
    ),
    "p2_iou": (
        lambda s, d: matching.frame_pairs(view(s, d, "gt"), view(s, d, "pred")).groupBy("clip", "gid").agg(F.count("*").alias("pairs"), F.round(F.sum("iou"), 6).alias("total")),
        f"SELECT clip, gid, count(*) AS pairs, round(sum(iou), 6) AS total FROM ({PAIRS}) q GROUP BY clip, gid",
    ),
    "p3_rectify": (rectified, RECTIFY),
    "p3_region_by_clip": (rectified_by_clip, RECTIFY.replace("{gt} t", "(SELECT clip, frame, id, x - CASE WHEN clip % 7 = 0 THEN 0 ELSE 8 * (clip % 5) END AS x, y FROM {gt} g0) t").replace(", 4)", ", 3)")),
    "p4_output_size": (
        lambda s, d: view(s, d, "gt").withColumn("c", F.array(F.array("x", "y"), F.array(F.col("x") + F.col("w"), F.col("y") + 3), F.array(F.col("x") + F.col("w") + 7, F.col("y") + F.col("h")), F.array(F.col("x") - 2, F.col("y") + F.col("h") + 1))).select("clip", "frame", "id", g.output_size(F.col("c"))[0].alias("width"), g.output_size(F.col("c"))[1].alias("height")),
        "SELECT clip, frame, id, CAST(trunc(greatest(sqrt((w+9)*(w+9) + 1), sqrt(w*w + 9))) AS INT) AS width, CAST(trunc(greatest(sqrt(49 + (h-3)*(h-3)), sqrt(4 + (h+1)*(h+1)))) AS INT) AS height FROM {gt} g",
    ),
    "p5_yolo_label": (
        lambda s, d: view(s, d, "gt").select("clip", "frame", "id", g.yolo_label(*map(F.col, XYWH), 640.0, 480.0).alias("line")),
        "SELECT clip, frame, id, '0 ' || printf('%.6f %.6f %.6f %.6f', round_even(least(1, greatest(0, (x + w / 2) / 640)), 6), round_even(least(1, greatest(0, (y + h / 2) / 480)), 6), round_even(w / 640, 6), round_even(h / 480, 6)) AS line FROM {gt} g",
    ),
    "p20_frame_of_second": (
        lambda s, d: view(s, d, "clips").select("clip_id", t.frame_of(F.col("start_sec"), F.lit(29.97)).alias("first"), F.round(t.second_of(t.frame_of(F.col("start_sec"), F.lit(29.97)), F.lit(29.97)), 6).alias("at")),
        "SELECT clip_id, CAST(trunc(start_sec * 29.97) AS INT) AS first, round(trunc(start_sec * 29.97) / 29.97, 6) AS at FROM {clips} c",
    ),
    "p23_badges": (
        lambda s, d: view(s, d, "gt").groupBy("clip", "frame").agg(F.count("*").alias("n")).select("clip", "frame", t.count_badge(F.col("n"), 5).alias("badge"), t.missing_badge((5 - F.least("n", F.lit(5))) / 20).alias("missing")),
        "SELECT clip, frame, CASE n WHEN 5 THEN 'ok' WHEN 4 THEN 'warn' ELSE 'bad' END AS badge, CASE WHEN n >= 5 THEN 'ok' WHEN (5 - least(n, 5)) / 20 <= 0.1 THEN 'yellow' ELSE 'bad' END AS missing FROM (SELECT clip, frame, count(*) AS n FROM {gt} g GROUP BY clip, frame) z",
    ),
    "j1_frame_pairs": (
        lambda s, d: matching.frame_pairs(view(s, d, "gt"), view(s, d, "pred")).where("iou > 0").select("clip", "frame", "gid", "pid", F.round("iou", 6).alias("iou")),
        f"SELECT clip, frame, gid, pid, round(iou, 6) AS iou FROM ({PAIRS}) q WHERE iou > 0",
    ),
    "j2_assignment": (
        lambda s, d: matching.match(view(s, d, "gt"), view(s, d, "pred")).select("clip", "frame", "gid", "pid", F.round("iou", 6).alias("iou")),
        f"SELECT clip, frame, gid, pid, round(iou, 6) AS iou FROM ({PAIRS}) q WHERE iou >= 0.5",
    ),
    "w3_id_switches": (
        lambda s, d: matching.switches(matching.match(view(s, d, "gt"), view(s, d, "pred"))),
        f"WITH {MATCHED}, {SWITCHED} SELECT clip, frame, gid, previous_pid, pid FROM s",
    ),
    "a1_count_errors": (
        lambda s, d: metrics.count_errors(view(s, d, "gt"), 5),
        "WITH c AS (SELECT clip, frame, count(*) AS n FROM {gt} g GROUP BY clip, frame), l AS (SELECT clip, max(frame) AS frames FROM c GROUP BY clip), a AS (SELECT clip, frames, unnest(range(1, frames + 1)) AS frame FROM l) SELECT a.clip, a.frames, count(*) FILTER (coalesce(n, 0) <> 5) AS missing FROM a LEFT JOIN c ON a.clip = c.clip AND a.frame = c.frame GROUP BY a.clip, a.frames",
    ),
    "a2_detection_quality": (
        lambda s, d: metrics.detection_quality(view(s, d, "gt"), view(s, d, "pred")),
        f"WITH {QUALITY} SELECT clip, tp, fp, fn, idsw, round({PR}, 4) AS precision, round({RE}, 4) AS recall, round(CASE WHEN ({PR}) + ({RE}) > 0 THEN 2 * ({PR}) * ({RE}) / (({PR}) + ({RE})) ELSE 0 END, 4) AS f1 FROM q",
    ),
    "a3_fallback_mota": (
        lambda s, d: metrics.fallback_mota(view(s, d, "gt"), view(s, d, "pred")),
        f"WITH {QUALITY} SELECT clip, round(1 - (fp + fn + idsw) / n_gt, 4) AS mota, round(2 * tp / (2 * tp + fp + fn), 4) AS idf1_fallback, idsw FROM q",
    ),
    "a4_hota": (lambda s, d: metrics.hota(view(s, d, "gt"), view(s, d, "pred")), "WITH " + hota_sql("{gt}", "{pred}")),
    "a5_idf1_global": (lambda s, d: metrics.idf1_global(view(s, d, "gt"), view(s, d, "pred")), None),
    "a6_merged_timeline": (merged, "WITH " + MERGED + hota_sql("g1", "p1")),
    "k1_top_n": (
        lambda s, d: tracks.top_n(view(s, d, "pred"), 3, parts=shares(s, d)).select("clip", "frame", "id", "conf", "rank"),
        "SELECT clip, frame, id, conf, rank FROM (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY conf DESC, id) AS rank FROM {pred} p) z WHERE rank <= 3",
    ),
    "f5_confident": (
        lambda s, d: tracks.top_n(view(s, d, "pred"), 5, 0.6).groupBy("clip").agg(F.count("*").alias("n"), F.round(F.sum("conf"), 6).alias("conf")),
        "SELECT clip, count(*) AS n, round(sum(conf), 6) AS conf FROM (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY conf DESC, id) AS r FROM {pred} p WHERE conf >= 0.6) z WHERE r <= 5 GROUP BY clip",
    ),
    "k4_most_seen": (
        lambda s, d: tracks.most_seen(view(s, d, "pred"), 4),
        "SELECT clip, id, seen FROM (SELECT clip, id, count(*) AS seen, row_number() OVER (PARTITION BY clip ORDER BY count(*) DESC, id) AS r FROM {pred} p GROUP BY clip, id) z WHERE r <= 4",
    ),
    "w13_compact_ids": (
        lambda s, d: tracks.compact_ids(view(s, d, "pred")).groupBy("clip", "id").agg(F.count("*").alias("n")),
        "SELECT clip, id, count(*) AS n FROM (SELECT clip, dense_rank() OVER (PARTITION BY clip ORDER BY id) AS id FROM {pred} p) z GROUP BY clip, id",
    ),
    "q5_postfilter": (
        lambda s, d: tracks.postfilter(view(s, d, "pred"), 4, shares(s, d)).select("clip", "frame", "id", "x", "y"),
        "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip, frame ORDER BY conf DESC, id) AS r FROM {pred} p) z WHERE r <= 4), k AS (SELECT clip, id, row_number() OVER (PARTITION BY clip ORDER BY count(*) DESC, id) AS r FROM t GROUP BY clip, id) SELECT t.clip, frame, CAST(dense_rank() OVER (PARTITION BY t.clip ORDER BY t.id) AS INT) AS id, x, y FROM t JOIN k ON t.clip = k.clip AND t.id = k.id AND k.r <= 4",
    ),
    "w1_gap_fill": (lambda s, d: filled(s, d, False), FILL % "least(nf - frame - 1, 5)"),
    "w2_gap_fill_whole": (lambda s, d: filled(s, d, True), FILL % "(CASE WHEN nf - frame - 1 <= 5 THEN nf - frame - 1 ELSE 0 END)"),
    "w10_hold_last": (
        lambda s, d: tracks.hold_last(view(s, d, "gt"), "x", 3).select("clip", "id", "frame", "held"),
        "SELECT clip, id, frame, last_value(CASE WHEN frame % 3 = 0 THEN x END IGNORE NULLS) OVER (PARTITION BY clip, id ORDER BY frame ROWS UNBOUNDED PRECEDING) AS held FROM {gt} g",
    ),
    "w11_context": (
        lambda s, d: tracks.context(view(s, d, "gt"), "q", 4).select("clip", "id", "frame", F.array_join("context", ",").alias("context")),
        "WITH c AS (SELECT clip, id, frame, list(q) OVER (PARTITION BY clip, id ORDER BY frame ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l FROM {gt} g) SELECT clip, id, frame, array_to_string(list_concat(list_transform(range(0, 4 - len(l)), lambda i: l[1]), l), ',') AS context FROM c",
    ),
    "w12_trail": (
        lambda s, d: tracks.trail(view(s, d, "gt"), 20).select("clip", "id", "frame", F.size("trail").alias("n"), F.aggregate("trail", F.lit(0), lambda a, p: a + p["cx"] + p["cy"]).alias("total")),
        "SELECT clip, id, frame, CAST(count(*) OVER o AS INT) AS n, CAST(sum(CAST(x + floor(w / 2) AS INT) + CAST(y + floor(h / 2) AS INT)) OVER o AS INT) AS total FROM {gt} g WINDOW o AS (PARTITION BY clip, id ORDER BY frame ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    ),
    "s2_mot_lines": (
        lambda s, d: view(s, d, "pred").select("clip", tracks.mot_line(F.col("frame"), F.col("id"), tuple(map(F.col, XYWH))).alias("line")),
        "SELECT clip, printf('%d,%d,%.2f,%.2f,%.2f,%.2f,-1,-1,-1', frame + 1, id, x, y, w, h) AS line FROM {pred} p",
    ),
    "s2_mot_rows": (
        lambda s, d: view(s, d, "pred").select("clip", tracks.mot_row(F.col("frame"), F.col("id"), tuple(map(F.col, XYWH)), F.col("conf"), F.lit(1)).alias("line")),
        "SELECT clip, printf('%d,%d,%.2f,%.2f,%.2f,%.2f,%.2f,1', frame, id, x, y, w, h, conf) AS line FROM {pred} p",
    ),
    "s4_track_table": (
        lambda s, d: tracks.track_table(tracks.fill_gaps(view(s, d, "pred"), 5, parts=shares(s, d)), view(s, d, "frames").select("clip", "frame", (F.col("frame") * 2.5).alias("unix")), shares(s, d)).groupBy("clip", "id").agg(F.count("*").alias("n"), F.min("frame").alias("first"), F.sum("class").alias("classes"), F.round(F.sum("conf"), 3).alias("conf"), F.round(F.sum(F.nanvl("unix_time", F.lit(0.0))), 1).alias("unix")),
        "WITH o AS (" + FILL % "least(nf - frame - 1, 5)" + ") SELECT o.clip, CAST(id AS SMALLINT) AS id, count(*) AS n, CAST(min(o.frame) AS INT) AS first, count(*) AS classes, round(sum(conf), 3) AS conf, round(sum(CASE WHEN f.frame IS NULL THEN 0 ELSE o.frame * 2.5 END), 1)::DOUBLE AS unix FROM o LEFT JOIN {frames} f ON f.clip = o.clip AND f.frame = o.frame GROUP BY o.clip, id",
    ),
    "s19_yolo_texts": (
        lambda s, d: writers.label_text(view(s, d, "gt").withColumn("line", g.yolo_label(*map(F.col, XYWH), 1280.0, 720.0))),
        "SELECT clip, frame, string_agg(l, chr(10) ORDER BY l) AS text FROM (SELECT clip, frame, '0 ' || printf('%.6f %.6f %.6f %.6f', round_even((x + w / 2) / 1280, 6), round_even((y + h / 2) / 720, 6), round_even(w / 1280, 6), round_even(h / 720, 6)) AS l FROM {gt} g) z GROUP BY clip, frame",
    ),
    "u1_frames_union": (
        lambda s, d: tracks.frames_of(view(s, d, "gt"), view(s, d, "pred")).groupBy("clip").agg(F.count("*").alias("n")),
        "SELECT clip, count(*) AS n FROM (SELECT clip, frame FROM {gt} g UNION SELECT clip, frame FROM {pred} p) z GROUP BY clip",
    ),
    "u4_shared_tracks": (
        lambda s, d: tracks.shared_tracks(view(s, d, "gt")),
        "SELECT clip, frame, count(*) AS n FROM (SELECT clip, id, frame FROM {gt} g INTERSECT SELECT clip, id, frame + 1 FROM {gt} h) z GROUP BY clip, frame",
    ),
    "j3_min_iou": (
        lambda s, d: curation.min_ious(view(s, d, "gt")).select("clip", "frame", F.round("min_iou", 6).alias("min_iou")),
        f"WITH {MIN_IOU} SELECT clip, frame, round(min_iou, 6) AS min_iou FROM mi",
    ),
    "a7_percentiles": (
        lambda s, d: curation.percentiles(curation.min_ious(view(s, d, "gt")), "clip", "min_iou"),
        f"WITH {MIN_IOU} SELECT clip, count(*) AS n, " + ", ".join(f"round(quantile_cont(min_iou, {q}), 6) AS p{int(q * 100)}" for q in (0, 0.05, 0.25, 0.5, 0.75, 0.95, 1)) + " FROM mi GROUP BY clip",
    ),
    "a8_threshold_simulation": (
        lambda s, d: curation.simulate(curation.min_ious(view(s, d, "gt")), view(s, d, "gt")),
        f"WITH {MIN_IOU}, th AS (SELECT unnest([0.70, 0.75, 0.80, 0.85, 0.88, 0.90, 0.92, 0.94, 0.96, 0.98])::DOUBLE AS threshold), k AS (SELECT threshold, count(*) FILTER (min_iou < threshold) + (SELECT count(DISTINCT clip) FROM {{gt}} c) AS kept FROM th CROSS JOIN mi GROUP BY threshold) SELECT threshold, kept, CAST(floor(kept * 0.85) AS BIGINT) AS train, kept - CAST(floor(kept * 0.85) AS BIGINT) AS val FROM k",
    ),
    "d2_keypoints": (
        lambda s, d: tracks.to_boxes(tracks.explode_keypoints(view(s, d, "gt").withColumn("keypoints", F.array(F.struct(F.lit("nose").alias("label"), F.col("x").alias("x"), (F.col("y") + F.col("h")).alias("y"), F.lit(0.5).alias("likelihood")), F.struct(F.lit("tail").alias("label"), (F.col("x") + F.col("w")).alias("x"), F.col("y").alias("y"), F.lit(0.5).alias("likelihood")))))),
        "SELECT clip, frame, id, x, y, x + w - x AS w, y + h - y AS h FROM {gt} g",
    ),
    "q1_slots": (lambda s, d: q_rows(s, d, "slots", n=9), None),
    "q2_gated": (lambda s, d: q_rows(s, d, "gated", n=9), None),
    "q3_kalman": (lambda s, d: q_rows(s, d, "kalman", n=9), None),
    "q4_gated_filled": (lambda s, d: tracking.track(view(s, d, "pred"), "gated", max_gap=10, n=9).select("clip", "frame", "id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "filled"), None),
    "q6_keep_by_iou": (lambda s, d: curation.keep_frames(view(s, d, "gt"), 0.9), None),
    "q7_keep_by_displacement": (lambda s, d: curation.keep_frames(view(s, d, "gt"), 6.0, "displacement"), None),
    "q9_compare": (lambda s, d: tracking.compare(view(s, d, "pred"), {"gated": {"method": "gated"}, "slots": {"method": "slots"}}).groupBy("method", "clip").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")), None),
    "x2_single_target": (lambda s, d: q_rows(s, d, "single", first=1), None),
}

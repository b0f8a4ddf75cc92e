"""Tables that change in place, resumed outputs, lineage, samples, and values that were wrong once."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from trackframe.functions import text as t
from trackframe.operators import catalog, metrics, runs, sampling, timemap, tracking, tracks
from trackframe.sources import readers, versions, writers

BOXES = "clip long, frame long, id long, x double, y double, w double, h double, conf double"


def test_versions_replace_each_other_and_survive_a_lost_write(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.current(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, path)
    new = spark.createDataFrame([("a", 1, True), ("b", None, None)], "k string, v int, ok boolean")
    assert versions.upsert_into(new, path, ["k"]) == 1
    itself = versions.read_version(spark, path).where("k = 'a'").withColumn("v", F.col("v") + 10)
    assert versions.upsert_into(itself, path, ["k"]) == 2
    rows = lambda n=None: {(r.k, r.v, r.ok) for r in versions.read_version(spark, path, n).collect()}
    assert rows() == {("a", 11, 1), ("b", None, None)} and rows(1) == {("a", 1, 1), ("b", None, None)}

    def lost(rows):
        return rows.select("k", F.when(F.col("k") == "b", F.raise_error(F.lit("lost"))).otherwise(F.col("v")).cast("int").alias("v"), "ok")

    with pytest.raises(Exception, match="lost"):
        versions.change(spark, path, lost)
    with pytest.raises(KeyError):
        versions.update_in(spark, path, "k", "a", unheard=1)
    assert versions.current(spark, path) == 2 and rows() == {("a", 11, 1), ("b", None, None)}
    assert versions.update_in(spark, path, "k", "a", v=5) == 3
    with pytest.raises(versions.Conflict):
        versions.write_version(new, path, after=2)
    assert rows() == {("a", 5, 1), ("b", None, None)}
    assert versions.vacuum(spark, path, keep=1) >= 3 and rows() == {("a", 5, 1), ("b", None, None)} and versions.current(spark, path) == 3


def test_runs_end_with_their_outcomes(spark, tmp_path):
    path = str(tmp_path / "runs")
    versions.start_run(spark, path, "r1", "2024-01-01T00:00:00", wave="w2")
    versions.start_run(spark, path, "r2", "2024-01-02T00:00:00", wave="w3")
    versions.finish_run(spark, path, "r1", "2024-01-01T05:00:00", spark.createDataFrame([("ok",), ("ok",), ("failed",), (None,)], "status string"))
    got = {r.run: (r.wave, r.ended_at, r.n_ok, r.n_failed, r.n_skipped) for r in versions.read_version(spark, path).collect()}
    assert got == {"r1": ("w2", "2024-01-01T05:00:00", 2, 1, 0), "r2": ("w3", "", 0, 0, 0)}


def detections(spark, clips, shift=0.0):
    return spark.createDataFrame([(c, f, i, 40.0 * i + f + shift, 0.0, 20.0, 20.0, 0.9) for c in clips for f in range(40) for i in range(3)], BOXES)


def test_comparison_goes_on_where_it_stopped(spark, tmp_path):
    path, methods = str(tmp_path / "cmp"), {"g": {"method": "gated"}, "s": {"method": "slots"}}
    first = tracking.compare_into(detections(spark, [1, 2]), methods, path)
    assert first.groupBy("method", "clip").count().count() == 4
    # Other boxes for the clips that are done: they must not be computed again. A clip whose file is too small is.
    (small,) = (tmp_path / "cmp" / "method=g" / "clip=2").glob("part-*")
    small.write_bytes(b"x" * 100)
    got = tracking.compare_into(detections(spark, [1, 2, 3], 1000.0), methods, path)
    lowest = {(r.method, r.clip): r.x for r in got.groupBy("method", "clip").agg(F.min("x").alias("x")).collect()}
    assert lowest == {("g", 1): 0.0, ("s", 1): 0.0, ("g", 2): 1000.0, ("s", 2): 0.0, ("g", 3): 1000.0, ("s", 3): 1000.0}
    forced = tracking.compare_into(detections(spark, [1], 500.0), methods, path, force=True)
    assert {r.x for r in forced.where("clip = 1").groupBy("method").agg(F.min("x").alias("x")).collect()} == {500.0} and forced.where("clip = 3").count() == 240


def test_track_files_by_clip(spark, tmp_path):
    path = str(tmp_path / "tracks")
    filled = lambda clips, shift=0.0: detections(spark, clips, shift).withColumn("filled", F.lit(False))
    times = spark.createDataFrame([(1, 0, 99.5)], "clip long, frame long, unix double")
    writers.write_tracks(filled([1]), path, times=times)
    with pytest.raises(FileExistsError):
        writers.write_tracks(filled([1, 2], 700.0), path)
    writers.write_tracks(filled([1, 2], 700.0), path, resume=True)
    rows = spark.read.parquet(path)
    assert {(r.clip, r.x) for r in rows.groupBy("clip").agg(F.min("x").alias("x")).collect()} == {(1, 0.0), (2, 700.0)}
    assert rows.schema["id"].dataType.simpleString() == "smallint"
    assert spark.read.parquet(f"{path}/clip=1").where("unix_time = 99.5").count() == 3
    writers.write_tracks(filled([1], 5.0), path, force=True)
    assert spark.read.parquet(path).groupBy("clip").agg(F.min("x").alias("x")).where("clip = 1").first().x == 5.0 and spark.read.parquet(path).where("clip = 2").count() == 120
    odd = spark.createDataFrame([("a b+c%/d", 1)], "clip string, v long")
    writers.write_partitions(odd.select("v", "clip"), str(tmp_path / "odd"), ["clip"])
    assert writers.finished(spark, str(tmp_path / "odd"), ["clip"], 10).collect()[0].clip == "a b+c%/d"
    writers.write_mot_rows(detections(spark, [4]), str(tmp_path / "rows"))
    assert spark.read.text(str(tmp_path / "rows")).where("value = '0,0,0.00,0.00,20.00,20.00,0.90,1'").count() == 1


def test_global_idf1_matches_permutations(spark):
    """Sixty random id graphs, one a clip, against every assignment; and the same clips on one timeline."""
    draw = random.Random(11)
    gt, pred = [], []
    for clip in range(60):
        for f in range(12):
            spots = draw.sample(range(8), 4)
            gt += [(clip, f, i, 50.0 * s, 0.0, 20.0, 20.0, 1.0) for i, s in enumerate(spots) if draw.random() > 0.2]
            pred += [(clip, f, draw.choice([10, 11, 12, 13]) + 10 * k, 50.0 * s, 0.0, 20.0, 20.0, 1.0) for k, s in enumerate(spots) if draw.random() > 0.3]
    g, p = spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES)

    def brute(a, b):
        at = {(f, x): i for _, f, i, x, *_ in a}
        n = {}
        for _, f, j, x, *_ in b:
            if (f, x) in at:
                n[at[f, x], j] = n.get((at[f, x], j), 0) + 1
        ids, others = sorted({i for i, _ in n}), sorted({j for _, j in n})
        others += [None] * len(ids)
        best = {frozenset(): 0}
        for i in ids:  # over sets of ids that are taken
            after = dict(best)
            for used, total in best.items():
                for j in others:
                    if j is not None and j not in used and (i, j) in n:
                        key = used | {j}
                        after[key] = max(after.get(key, 0), total + n[i, j])
            best = after
        return max(best.values())

    got = {r.clip: r.idtp for r in metrics.idf1_global(g, p).collect()}
    for clip in range(60):
        assert got[clip] == brute([r for r in gt if r[0] == clip], [r for r in pred if r[0] == clip])
    small = [r for r in gt if r[0] < 3], [r for r in pred if r[0] < 3]
    merged = [[(0, r[1] + 12 * r[0], *r[2:]) for r in side] for side in small]
    line = metrics.one_timeline(*(spark.createDataFrame(side, BOXES) for side in small))
    assert metrics.idf1_global(*line).first().idtp == brute(*merged)


def test_components_of_long_chains(spark):
    """A chain of ids in random order and two islands: found in few rounds."""
    order = list(range(64))
    random.Random(2).shuffle(order)
    edges = [(0, order[k], 1000 + k) for k in range(64)] + [(0, order[k + 1], 1000 + k) for k in range(63)] + [(0, 500, 9000), (1, 5, 1000)]
    got = {(r.clip, r.gid): r.part for r in metrics.components(spark.createDataFrame(edges, "clip long, gid long, pid long")).collect()}
    assert {got[0, k] for k in range(64)} == {0} and got[0, 500] == 500 and got[1, 5] == 5


def test_sampled_clips_match_one_loop(spark):
    schema = "video string, frames long, seconds double"
    videos = spark.createDataFrame([("a", 9000, 300.0), ("b", 30000, 1000.0), ("c", 3000, 100.0)], schema)
    taken = spark.createDataFrame([("b", 100.0, 400.0)], "video string, start_sec double, end_sec double")
    ranges = spark.createDataFrame([("a", 0.0, 250.0), ("b", 0.0, 900.0)], "video string, range_start double, range_end double")
    anchored = spark.createDataFrame([("a",), ("b",), ("c",)], "video string")
    for n, most in ((6, 100), (200, 3)):
        order = sorted(map(tuple, sampling.draw_candidates(videos, most * n, 4.0, 5).collect()))
        kept = []
        for k, video, a, b in order:
            inside = any(v == video and a >= lo and b <= hi for v, lo, hi in (("a", 0, 250), ("b", 0, 900)))
            near = any(v == video and a < e + 10 and b > s - 10 for _, v, s, e in [(0, "b", 100.0, 400.0), *kept])
            if inside and not near and len(kept) < n:
                kept.append((k, video, a, b))
        got = [tuple(r) for r in sampling.sample_clips(videos, n, 4.0, 5, taken, ranges, anchored, 10.0, most).orderBy("try").collect()]
        assert got == kept and kept
    rounds = sampling.draw_candidates(videos, 40, 4.0, 5).collect()
    parts = sampling.draw_candidates(videos, 15, 4.0, 5).unionByName(sampling.draw_candidates(videos, 40, 4.0, 5, 15)).collect()
    assert sorted(rounds) == sorted(parts)


def test_audit_takes_no_anchor(spark):
    videos = spark.createDataFrame([("v", 1001), ("w", 1), ("z", 0)], "video string, frames long")
    anchors = spark.createDataFrame([("v", 100), ("v", 200)], "video string, frame long")
    got = [(r.video, r.frame) for r in sampling.audit_frames(videos, anchors, 20, 1).collect()]
    assert sorted(got) == [("v", f) for f in (0, *range(300, 1001, 100))] + [("w", 0)]
    assert sampling.audit_frames(videos, anchors, 3, 1).where("video = 'v'").count() == 3


def test_audit_of_long_videos(spark):
    """Parts of a video's grid give what the whole grid gives, and no join is broadcast by a guess of the grid's size."""
    videos = spark.createDataFrame([("long", 250_001), ("edge", 102_400), ("v", 901)], "video string, frames long")
    taken = {"long": {*range(0, 250_001, 700)}, "edge": {102_300, 150}, "v": {f * 100 for f in range(8)}}
    anchors = spark.createDataFrame([(v, f) for v, fs in taken.items() for f in fs] * 2, "video string, frame long")
    got = sampling.audit_frames(videos, anchors, 40, 3)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    plain = lambda v, f: (hashlib.md5(f"3|{v}|{f}".encode()).hexdigest(), f)
    free = {v: sorted((f for f in range(0, n, 100) if f not in taken[v]), key=lambda f: plain(v, f)) for v, n in (("long", 250_001), ("edge", 102_400), ("v", 901))}
    assert sorted(map(tuple, got.collect())) == sorted((v, f) for v, fs in free.items() for f in fs[:40])


def test_lineage_by_precedence(spark):
    paths = [
        ("/w/models/expA/phase1/yolo8n/weights/best.pt", False), ("/w/datasets/full_v1", True), ("/w/datasets/full_v1/manifest.csv", False), ("/w/models/expA/eval/full_v1/eval_config.yaml", False),
        ("/w/batch_runs/run42/_meta.json", False), ("/w/loose.txt", False), ("/w/batch_runs/run42/v/1/2/tracks.PARQUET", False), ("/w/batch_runs/run42/1/2/3/4/5/deep.csv", False), ("/w/batch_runs/run42/plot.pt", False),
        ("/w/models/expA/phase1/out/t.parquet", False), ("/w/models/expA/phase1", True), ("/w/models/expA/a.parquet", False), ("/w/models/expA/1/2/3/4/5/6/7/8/9/x.pt", False), ("/w/models/expA/1/2/3/4/5/6/7/8/9/10/x.pt", False),
    ]
    experiments = spark.createDataFrame([("/w/models/expA", "/w", "c", "expA")], "dir string, root string, chamber_type string, name string")
    batches = spark.createDataFrame([("/w/batch_runs/run42", "/w", "c", "expA"), ("/w/models/expA/phase1", "/w", "c", "gone")], "dir string, root string, chamber_type string, experiment_name string")
    datasets = spark.createDataFrame([("/w/datasets/full_v1",)], "dir string")
    got = {r.path: (r.kind, r.experiment_dir, r.batch_dir, r.dataset_dir) for r in runs.trace(spark.createDataFrame(paths, "path string, is_dir boolean"), experiments, batches, datasets).collect()}
    exp, run = "/w/models/expA", "/w/batch_runs/run42"
    assert [got[p] for p, _ in paths] == [
        ("experiment_artifact", exp, None, None), ("dataset", None, None, "/w/datasets/full_v1"), ("dataset", None, None, "/w/datasets/full_v1"), ("eval", exp, None, None),
        ("batch_output", exp, run, None), ("unknown", None, None, None), ("batch_output", exp, run, None), ("unknown", None, None, None), ("unknown", None, None, None),
        ("batch_output", None, f"{exp}/phase1", None), ("experiment_artifact", exp, None, None), ("experiment_artifact", exp, None, None), ("experiment_artifact", exp, None, None), ("unknown", None, None, None),
    ]
    assert runs.trace(spark.createDataFrame([(run + "/_meta.json",)], "path string"), experiments, batches).first().kind == "batch_output"


def test_wide_keypoints_keep_the_header_order(spark, tmp_path):
    head = ["scorer,n,n,n,n,n,n,other,other,other", "individuals,zoe,zoe,zoe,amy,amy,amy,zoe,zoe,zoe", "bodyparts,tail,tail,tail,nose,nose,nose,nose,nose,nose", "coords" + ",x,y,likelihood" * 3]
    (tmp_path / "clip7.csv").write_text("\n".join([*head, "0,1,2,0.5,3,4,0.6,9,9,9", "1,5,6,0.7,,,0.1,9,9,9"]) + "\n")
    got = readers.keypoint_detections(spark, str(tmp_path / "clip7.csv")).orderBy("frame", "track_id").collect()
    assert [(r.video, r.frame, r.track_id, r.x, r.h, [tuple(k) for k in r.keypoints]) for r in got] == [
        ("clip7", 0, 1, 0.0, 0.0, [("tail", 1.0, 2.0, 0.5)]), ("clip7", 0, 2, 0.0, 0.0, [("nose", 3.0, 4.0, 0.6)]), ("clip7", 1, 1, 0.0, 0.0, [("tail", 5.0, 6.0, 0.7)]), ("clip7", 1, 2, 0.0, 0.0, [("nose", None, None, 0.1)]),
    ]


def test_regions_are_read_entry_by_entry(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": [[1,2],[3,4],[5,6],[7,8]], "b": [[1,2],["x",4],[5,6],[7,8]], "c": "none", "d": [[1,2]], "e": null}')
    got = {r.video: r.ok for r in readers.rois(spark, str(tmp_path / "r.json")).select("video", readers.roi_ok(F.col("corners")).alias("ok")).collect()}
    assert got == {"a": True, "b": False, "c": False, "d": False, "e": False}


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def test_long_numbers_are_not_cut(spark):
    assert [value(spark, t.frame_stem(F.lit("c"), F.lit(n))) for n in (7, 1_234_567, 1_234_568)] == ["c_f000007", "c_f1234567", "c_f1234568"]
    number = lambda *names: catalog.next_number(spark.createDataFrame([(n,) for n in names], "name string"), "a.b_batch").first()[0]
    assert number("a.b_batch120", "a.b_batch07", "a.b_batch_500", "axb_batch900", "a.b_batch") == "121"
    assert number("a.b_batch08") == "09" and number("other") == "01"


def test_blank_lines_and_open_classes(spark):
    assert value(spark, t.label_issues(F.lit("  \t"), 1)) == [] and value(spark, t.label_issues(F.lit(""), None)) == []
    assert value(spark, t.label_issues(F.lit("900 0.5 0.5 0.1 0.1"), None)) == [] and value(spark, t.label_issues(F.lit("-1 0.5 0.5 0.1 0.1"), None)) == ["class"]


def test_since_reads_iso_times(spark):
    rows = spark.createDataFrame([("2024-02-01", "a"), ("2024-02-01T10:20:30Z", "a"), ("2024-02-01 10", "b"), ("2024-01-31T23:59:59.5+02:00", "a"), ("", "a"), ("2024-2-1", "a"), (None, "a")], "started_at string, chamber_type string")
    got = lambda *args, **k: sorted(r.started_at for r in catalog.filter_experiments(rows, *args, **k).collect())
    assert got(start="2024-02-01") == ["2024-02-01", "2024-02-01 10", "2024-02-01T10:20:30Z"]
    assert got("a", start="2024-02-01T10:00") == ["2024-02-01T10:20:30Z"]


def test_regions_serve_other_extensions(spark):
    rows = spark.createDataFrame([("Cam1.mkv",), ("Cam2.mkv",), ("Cam3.avi",)], "video string")
    table = spark.createDataFrame([("Cam1.mp4", 1, 1), ("Cam2.mkv", 2, 2), ("Cam2.avi", 3, 0), ("_default", 9, 3), ("Cam1.avi", 4, 2)], "name string, value int, pos int")
    assert {(r.video, r.value) for r in catalog.with_fallback(rows, table).collect()} == {("Cam1.mkv", 1), ("Cam2.mkv", 2), ("Cam3.avi", 9)}
    assert [r.video for r in catalog.uncovered(rows, table).collect()] == ["Cam3.avi"]


def test_unreadable_files_are_not_newly_missing(spark):
    old = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 3, True)], "path string, size long, missing boolean")
    listing = spark.createDataFrame([("a", 9, False), ("d", 4, False), ("e", 5, True)], "path string, size long, readable boolean")
    got = {r.path: (r.size, r.missing, r.status, r.newly_missing) for r in catalog.reconcile(old, listing).collect()}
    assert got == {"a": (1, True, "unreadable", False), "b": (2, True, "missing", True), "c": (3, True, "missing", False), "d": (None, True, "unreadable", False), "e": (5, False, "new", False)}


def test_runs_without_scores_count_zero(spark):
    rows = spark.createDataFrame([("r1", 1, "", None), ("r1", 2, "", ""), ("r2", 1, " ", "0.5"), ("r2", 2, "", "0.25"), ("r3", 1, "x", "")], "run string, epoch int, a string, b string")
    assert {tuple(r) for r in runs.best_epochs(rows, runs.first_filled("a", "b")).collect()} == {("r1", 1, 0.0), ("r2", 2, 0.25)}


def test_repair_report_counts(spark):
    rows = [("v", 0, 10.0, None), ("v", 1, None, 11.0), ("v", 2, None, None), ("v", 3, 13.0, None), ("v", 4, 13.0, None), ("v", 5, 12.0, None), ("w", 0, 5.0, None), ("w", 1, 6.0, None)]
    before = spark.createDataFrame(rows, "video string, frame long, unix double, fixed double")
    after = timemap.repair(timemap.with_seconds(before, F.col("fixed")).select("video", "frame", "unix", "fix"))
    got = {r.video: tuple(r)[1:] for r in timemap.repair_report(before, after).collect()}
    assert got == {"v": (2, 0, 1, 1, 100.0, 1), "w": (0, 0, 0, 0, 0.0, 0)}


def test_listings_without_doubles(spark):
    one, two = (spark.createDataFrame(r, "path string, kind string") for r in ([("a", "rgb")], [("a", "ir"), ("b", "ir")]))
    assert {tuple(r) for r in catalog.union_listing(one, two).collect()} == {("a", "rgb"), ("b", "ir")}
    assert {(r.path, r.origin) for r in catalog.combined({"x": one, "y": two}).collect()} == {("a", "x"), ("a", "y"), ("b", "y")}


def test_tracks_are_dealt_once_and_to_any_number_of_tasks(spark):
    rows = spark.range(400).select((F.col("id") % 3).alias("clip"), (F.col("id") % 5).alias("id"), (F.col("id") * 3).alias("frame"), *(F.col("id").cast("double").alias(c) for c in "xywh"), (F.col("id") % 7 / 10).alias("conf"))
    times = rows.select("clip", "frame", (F.col("frame") * 2.0).alias("unix")).where("frame % 2 = 0")
    plan = tracks.fill_gaps(rows, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    forms = (
        lambda parts: tracks.fill_gaps(rows, 2, parts=parts),
        lambda parts: tracks.track_table(tracks.fill_gaps(rows, 2, parts=parts), times, parts).fillna(-1.0),
        lambda parts: tracks.top_n(rows, 2, parts=parts),
        lambda parts: tracks.postfilter(rows, 2, parts),
    )
    for form in forms:
        whole, shared = form(None), form(11)
        assert "clip" in shared.columns and sorted(map(repr, whole.collect())) == sorted(map(repr, shared.collect())) != []
        assert ", 11), REPARTITION_BY_NUM" in shared._jdf.queryExecution().executedPlan().toString()

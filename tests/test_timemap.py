import pytest
from pyspark.sql import functions as F

from trackframe.functions import text as t
from trackframe.operators import catalog, curation, intervals, ranks, runs, sampling, scratch, timemap

ANCHORS = "video string, frame long, unix double"


def anchors(spark):
    return spark.createDataFrame([("v", 2000, 1066.7), ("v", 0, 1000.0), ("v", 1000, 1033.3)], ANCHORS)


@pytest.mark.parametrize("frame,unix", [(0, 1000.0), (500, 1016.65), (1000, 1033.3), (-5, 1000.0), (9999, 1066.7)])
def test_frame_to_unix(spark, frame, unix):
    out = timemap.frame_to_unix(anchors(spark), spark.createDataFrame([("v", frame)], "video string, frame long")).first()
    assert out.unix == pytest.approx(unix)


def test_unix_to_frame_and_unknown_video(spark):
    probes = spark.createDataFrame([("v", 1016.65), ("w", 5.0)], "video string, unix double")
    assert {(r.video, r.frame) for r in timemap.unix_to_frame(anchors(spark), probes).collect()} == {("v", 500), ("w", None)}


def test_monotone_and_repair(spark):
    a = spark.createDataFrame([("v", 0, 10.0), ("v", 1, None), ("v", 2, 5.0), ("v", 3, 40.0)], ANCHORS)
    assert [r.frame for r in timemap.monotone(a).orderBy("frame").collect()] == [0, 3]
    kept = {r.frame: (r.unix, r.fix) for r in timemap.repair(a).collect()}
    assert kept[1] == (20.0, "interpolated") and kept[2] == (5.0, None)
    assert {r.frame: r.fix for r in timemap.repair(a, "repair", 10.0).collect()}[2] == "outlier"


def test_midnight(spark):
    rows = spark.createDataFrame([("v", 0, 86000.0), ("v", 1, 100.0), ("v", 2, None), ("v", 3, 200.0)], "video string, frame long, tod double")
    assert {r.frame: r.day_offset for r in timemap.day_offsets(rows).collect()} == {0: 0, 1: 1, 3: 1}


@pytest.mark.parametrize("text,clean", [("8:3O:12 PM  EST", "8:30:12 PM"), ("1l2 o 3o4 GMT+2", "112 o 304"), ("O1 Oct", "01 0ct"), ("8:35:30 pm est", "8:35:30 pm"), ("8:35 UTC 5", "8:35"), ("20:35:30 utc-05:00", "20:35:30"), ("8:35 EET", "8:35 EET")])
def test_clean(spark, text, clean):
    assert spark.range(1).select(t.clean_ocr(F.lit(text))).first()[0] == clean


def test_parse(spark):
    df = spark.createDataFrame([("8:35:30 PM",), ("no",), ("1:02:03 10-Mar-2024",)], "s string").withColumn("f", t.time_format(F.col("s")))
    out = [r[0] for r in df.select(t.parse_time(F.col("s"), F.col("f"), F.to_date(F.lit("2024-01-02")), F.lit(1), "UTC")).collect()]
    assert out == [1704314130.0, None, 1710032523.0]


@pytest.mark.parametrize("line,issues", [("0 0.5 0.5 0.1 0.1", []), ("0 1.5 0.5 0.1 0.1", ["range"]), ("3 0.5 0.5 0.1 0.1", ["class"]), ("0 0.5 0.5", ["fields"]), ("0 NaN 0.5 0.1 0.1", [])])
def test_labels(spark, line, issues):
    assert spark.range(1).select(t.label_issues(F.lit(line), 1)).first()[0] == issues


def test_minimum_gap(spark):
    taken = spark.createDataFrame([("v", 100.0, 110.0)], "video string, start_sec double, end_sec double")
    c = spark.createDataFrame([("v", 105.0, 115.0), ("v", 140.0, 143.0), ("v", 310.0, 313.0), ("w", 105.0, 115.0), ("v", 170.0, 173.0)], taken.schema)
    assert {(r.video, r.start_sec) for r in catalog.far_enough(c, taken, 60.0).collect()} == {("v", 310.0), ("w", 105.0), ("v", 170.0)}


def test_split_uses_every_row_once(spark):
    out = catalog.ratio_split(spark.range(20).withColumn("g", F.col("id") % 3), {"train": 0.6, "val": 0.2, "test": 0.2, "x": 0}, "g", "id", 42)
    assert out.count() == 20 and out.select("id").distinct().count() == 20
    assert {r.split for r in out.select("split").distinct().collect()} == {"train", "val", "test"}
    assert sorted(out.collect()) == sorted(catalog.ratio_split(spark.range(20).withColumn("g", F.col("id") % 3), {"train": 0.6, "val": 0.2, "test": 0.2, "x": 0}, "g", "id", 42).collect())


@pytest.mark.parametrize("threshold", [0, 3, 5])
def test_first_wins_matches_the_loop(spark, threshold):
    import random

    draw = random.Random(threshold)
    base = [draw.getrandbits(62) for _ in range(6)]
    rows = [(i, draw.choice(base) ^ sum(1 << draw.randrange(62) for _ in range(draw.randrange(5)))) for i in range(120)]
    kept = []
    for i, h in rows:
        if not threshold or all(bin(h ^ k).count("1") > threshold for _, k in kept):
            kept.append((i, h))
    out = curation.first_wins(spark.createDataFrame(rows, "seq long, hash long"), threshold)
    assert sorted((r.seq, r.hash) for r in out.collect()) == kept


def test_keep_frames(spark):
    rows = [(0, f, 1, float(x), 0.0, 10.0, 10.0) for f, x in ((1, 0), (2, 1), (3, 2), (4, 9), (5, 9))]
    boxes = spark.createDataFrame(rows, "clip long, frame long, id long, x double, y double, w double, h double")
    assert [r.frame for r in curation.keep_frames(boxes, 0.7).orderBy("frame").collect()] == [1, 3, 4]
    assert [r.frame for r in curation.keep_frames(boxes, 5.0, "displacement").orderBy("frame").collect()] == [1, 4]


def test_lineage_and_runs(spark):
    a = spark.createDataFrame([("/w/e/p/r/weights/best.pt",), ("/x/y",)], "path string")
    m = spark.createDataFrame([("/w/e", "experiment"), ("/w", "root")], "dir string, kind string")
    assert {r.path: (r.dir, r.kind, r.depth) for r in runs.lineage(a, m).collect()} == {"/w/e/p/r/weights/best.pt": ("/w/e", "experiment", 4), "/x/y": (None, "unknown", None)}
    metrics = spark.createDataFrame([("a", 1, "0.4"), ("a", 2, "0.55"), ("b", 1, " "), ("c", 1, "0.5")], "run string, epoch int, s string")
    best = runs.leaderboard(runs.best_epochs(metrics, runs.first_filled("s")))
    assert [(r.run, r.epoch, r["rank"]) for r in best.orderBy("rank").collect()] == [("a", 2, 1), ("c", 1, 2)]


def test_onsets(spark):
    e = spark.createDataFrame([(0, float(x), 0.0) for x in (0, 100, 2000, 9000, 9700, 12000)], "grp long, start_ts double, end_ts double")
    gaps = spark.createDataFrame([(0, 9800.0, 9999.0), (0, 2000.0, 2100.0)], "grp long, gap_start double, gap_end double")
    rows = intervals.onset_classes(e, gaps).orderBy("a").collect()
    # 100 is the last before 2000, where an event at the start of the gap itself is not before it; a cluster marks both its ends.
    assert [r.kind for r in rows] == ["cluster", "cluster", "normal", "normal", "pre_reboot", "normal"]
    assert [r.interval for r in rows] == ["cluster", "normal", "skip", "normal", "skip", None]
    assert {(r.gap_start, r.last_event) for r in intervals.before_gaps(e, gaps).collect()} == {(9800.0, 9700.0), (2000.0, 100.0)}
    assert intervals.before_gaps(e.limit(0), gaps).count() == 0


TIMES = "08:35:30 PM 18-Jun-25|08:35:30 PM 18-Jun-2025|08:35:30 PM 18/06/2025|08:35:30 PM 18/06/25|08:35:30 PM 06/18/2025|20:35:30 18-Jun-25|20:35:30 18-Jun-2025|20:35:30 18/06/2025|20:35:30 18/06/25|08:35:30 PM|20:35:30|08:35 PM|20:35".split("|")


def test_every_time_format(spark):
    df = spark.createDataFrame([(x,) for x in TIMES], "s string").withColumn("f", t.time_format(F.col("s")))
    rows = df.select("f", t.parse_time(F.col("s"), F.col("f"), F.to_date(F.lit("2025-06-18")), F.lit(0), "UTC").alias("u")).collect()
    assert [r.f for r in rows] == [f for f, _ in t.TIME_FORMATS]
    assert {r.u for r in rows[:-2]} == {1750278930.0} and {r.u for r in rows[-2:]} == {1750278900.0}


@pytest.mark.parametrize("text,unix", [("2025-06-18 20:35:30", 1750278930.0), ("2025-06-18T20:35", 1750278900.0), (" 2025-06-18T20:35:30", 1750278930.0), ("6/18/2025 8:35 PM", 1750278900.0), ("2025-06-18 8:35:30 PM", 1750278930.0), ("2025/06/18 20:35", None)])
def test_user_time(spark, text, unix):
    assert spark.range(1).select(t.user_time(F.lit(text), "UTC")).first()[0] == unix


def test_missing_seconds(spark):
    one = lambda x: spark.range(1).select(t.add_seconds(F.lit(x)), t.repair_seconds(F.lit(x), "h:m:s a", F.to_date(F.lit("2025-06-18")), F.lit(0), "UTC")).first()
    assert one("8:35 pm")[:] == ("8:35:00 pm", 1750278900.0) and one("8:35pm")[:] == ("8:35pm", None) and one("8:35:30 PM")[1] is None


def test_spans_probe_the_first_and_last_frame(spark):
    a = spark.createDataFrame([("v", 100, 1000.0), ("v", 200, 5000.0), ("v", 300, 2000.0), ("w", 0, 1.0)], "video string, frame long, unix double")
    n = spark.createDataFrame([("v", 251), ("w", 9)], "video string, total_frames long")
    rows = timemap.spans(a, n).collect()
    assert [(r.video, r.start, r.end, r.hours, r.n_samples) for r in rows] == [("v", 1000.0, 3500.0, round(2500 / 3600, 6), 3)]


def test_fingerprint_is_canonical_at_any_depth(spark):
    h = lambda x: spark.range(1).select(t.fingerprint(F.lit(x))).first()[0]
    assert h('{"a": {"x": 1, "y": [1, 2]}, "b": 2}') == h('{"b":2,"a":{"y":[1,2],"x":1}}') != h('{"b":2,"a":{"y":[2,1],"x":1}}')


def test_hold_out_of_single_frames(spark):
    five = spark.createDataFrame([(0, f) for f in range(5)], "clip long, frame long")
    for seed in range(5):
        assert catalog.hold_out(five, 0.15, seed).where("split = 'val'").count() == 1
    assert catalog.hold_out(five.limit(0), 0.15, 1).count() == 0


def test_places_in_a_seeded_order(spark):
    rows = spark.range(3000).withColumn("g", F.col("id") % 2)
    for by in ([], ["g"]):
        got = [(r.g, r._r, r._n) for r in ranks.placed(rows, ranks.seeded(3, F.col("id")), F.col("id"), by).collect()]
        want = [(g, r, 1500) for g in (0, 1) for r in range(1, 1501)] if by else None
        assert sorted(got) == want if by else sorted(r for _, r, _ in got) == list(range(1, 3001))


def test_segments_never_overlap(spark):
    spans = spark.createDataFrame([("a", 0, 999), ("b", 5, 30), ("c", 0, 119), ("d", 0, 49)], "video string, first long, last long")
    by = {}
    for r in sampling.segments(spans, 5, 50, 7).orderBy("video", "first").collect():
        by.setdefault(r.video, []).append((r.first, r.last))
    assert by["b"] == [(5, 30)] and by["d"] == [(0, 49)] and len(by["a"]) == 5 and len(by["c"]) == 2
    for v, last in (("a", 999), ("c", 119)):
        assert all(b - a == 49 for a, b in by[v]) and by[v][0][0] >= 0 and by[v][-1][1] <= last
        assert all(x[1] < y[0] for x, y in zip(by[v], by[v][1:]))


def test_accepted_candidates_match_the_loop(spark):
    videos = spark.createDataFrame([("a", 9000, 300.0), ("b", 3000, 100.0)], "video string, frames long, seconds double")
    c = sampling.draw_candidates(videos, 200, 3.0, 4)
    want, taken = [], []
    for r in sorted(c.collect(), key=lambda r: r["try"]):
        if all(v != r.video or not (r.start_sec < e + 10 and r.end_sec > s - 10) for v, s, e in taken):
            taken.append((r.video, r.start_sec, r.end_sec))
            want.append(r["try"])
    assert c.count() == 200 and [r["try"] for r in sampling.accept(c, 12, 10.0).orderBy("try").collect()] == want[:12]


def test_register_keeps_waves_and_labels(spark):
    old = spark.createDataFrame([("c1", "d1", "L1", ["w1"]), ("c2", "d2", "L2", None)], "chamber_id string, drive_uuid string, drive_label string, waves array<string>")
    new = spark.createDataFrame([("c1", "n1", ""), ("c3", "n3", None)], "chamber_id string, drive_uuid string, drive_label string")
    got = {r.chamber_id: (r.drive_uuid, r.drive_label, r.waves, r.created) for r in catalog.register_sources(old, new).collect()}
    assert got == {"c1": ("n1", "L1", ["w1"], False), "c2": ("d2", "L2", [], False), "c3": ("n3", "", [], True)}


def test_upsert_takes_the_last_write(spark):
    old = spark.createDataFrame([("k", 1, 0)], "key string, v int, at int")
    new = spark.createDataFrame([("k", 5, 1), ("k", 3, 2)], "key string, v int, at int")
    assert [(r.key, r.v) for r in catalog.upsert(old, new, ["key"], "at").collect()] == [("k", 3)]


def test_traced_batches_find_their_experiment(spark):
    a = spark.createDataFrame([("/w/out/b1/x.parquet",), ("/w/out/b1/a/b/c/d/e/deep",), ("/w/exp/p/r/best.pt",), ("/z/y",)], "path string")
    e = spark.createDataFrame([("/w/exp", "/w", "t", "exp")], "dir string, root string, chamber_type string, name string")
    b = spark.createDataFrame([("/w/out/b1", "/w", "t", "exp")], "dir string, root string, chamber_type string, experiment_name string")
    got = {r.path: (r.kind, r.experiment_dir, r.batch_dir) for r in runs.trace(a, e, b).collect()}
    assert got == {"/w/out/b1/x.parquet": ("batch_output", "/w/exp", "/w/out/b1"), "/w/out/b1/a/b/c/d/e/deep": ("unknown", None, None), "/w/exp/p/r/best.pt": ("experiment_artifact", "/w/exp", None), "/z/y": ("unknown", None, None)}


def test_shared_folder_is_needed_on_a_cluster(spark):
    class Cluster:
        conf = {}

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = dict

    with pytest.raises(ValueError):
        scratch.shared_path(Cluster, "x")

import json

import pytest
from pyspark.sql import functions as F

from trackframe.functions import text
from trackframe.operators.tracking import track
from trackframe.plans import files
from trackframe.sources import readers, writers
from trackframe.streaming import online

ROWS = [("a", 1, 1, 0.0, 0.0, 10.0, 10.0), ("a", 3, 1, 2.0, 0.0, 10.0, 10.0), ("b", 1, 2, 5.0, 5.0, 1.0, 1.0)]
BOXES = "clip string, frame long, id long, x double, y double, w double, h double"


def test_mot_round_trip(spark, tmp_path):
    t = spark.createDataFrame(ROWS, BOXES)
    writers.write_mot(t, str(tmp_path / "mot"))
    back = readers.mot(spark, str(tmp_path / "mot/*/*.txt"), strict=True)
    assert sorted((r.frame, r.id, r.x) for r in back.collect()) == [(1, 1, 0.0), (1, 2, 5.0), (3, 1, 2.0)]
    (tmp_path / "c.txt").write_text("# note\n\n1,2,3,4,5,6,0.5\n1,2,3\n")
    assert readers.mot(spark, str(tmp_path / "c.txt"), strict=True).collect()[0].conf == 0.5
    assert readers.mot(spark, str(tmp_path / "c.txt")).count() == 2


def test_track_parquet(spark, tmp_path):
    from trackframe.operators.tracks import fill_gaps

    path = str(tmp_path / "tracks")
    writers.write_tracks(fill_gaps(spark.createDataFrame(ROWS, BOXES)), path)
    with pytest.raises(Exception):
        writers.write_tracks(fill_gaps(spark.createDataFrame(ROWS, BOXES)), path)
    back = readers.tracks(spark, path, first=2, last=2)
    assert back.count() == 1 and back.schema["x"].dataType.simpleString() == "float" and back.schema["id"].dataType.simpleString() == "smallint"


def test_json_sources(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"_meta": {}, "v.mkv": {"fps_nominal": 25, "samples": [{"frame": 5, "unix": 2.0}, {"frame": 0, "unix": 1.0}]}, "w.mkv": {"samples": [{"frame": 0, "unix": 1.0}]}}))
    assert sorted((r.video, r.frame, r.unix) for r in readers.anchors(spark, str(tmp_path / "t.json")).collect()) == [("v.mkv", 0, 1.0), ("v.mkv", 5, 2.0)]
    (tmp_path / "r.json").write_text(json.dumps({"v": [[1, 2], [3, 4], [5, 6], [7, 8]], "w": [[1, 2]]}))
    assert {r.video: r.ok for r in readers.rois(spark, str(tmp_path / "r.json")).select("video", readers.roi_ok(F.col("corners")).alias("ok")).collect()} == {"v": True, "w": False}
    (tmp_path / "g.json").write_text(json.dumps({"v": [{"start": "2024-01-01T00:00:00", "end": "2024-01-01T01:00:00"}]}))
    r = readers.valid_ranges(spark, str(tmp_path / "g.json")).first()
    assert (r.range_start, r.range_end - r.range_start) == (1704085200.0, 3600.0)
    (tmp_path / "i.json").write_text("[[1, 2.5], [3, 4]]")
    assert [tuple(r) for r in readers.interval_pairs(spark, str(tmp_path / "i.json")).collect()] == [(0, 1.0, 2.5), (1, 3.0, 4.0)]
    (tmp_path / "s.json").write_text(json.dumps({"m": {"overall": {"HOTA": 0.5}, "clips": {"a": {"HOTA": 0.25}}}}))
    s = readers.scores(spark, str(tmp_path / "s.json"))
    assert {(r.method, r.clip, r.metrics["HOTA"]) for r in s.collect()} == {("m", None, 0.5), ("m", "a", 0.25)}
    assert json.loads(writers.score_report(s).first().report) == {"overall": {"HOTA": 0.5}, "clips": {"a": {"HOTA": 0.25}}}


def test_csv_and_label_sources(spark, tmp_path):
    for run, text in (("r1", "epoch, m/F1(B)\n1, 0.4\n2, 0.5\n"), ("r2", "epoch,other\n1,9\n")):
        (tmp_path / "phase" / run).mkdir(parents=True)
        (tmp_path / "phase" / run / "results.csv").write_text(text)
    (tmp_path / "phase" / "r3").mkdir()
    m = readers.run_metrics(spark, str(tmp_path / "phase"))
    assert {(r.run, r.epoch, r.metrics.get("m/F1(B)")) for r in m.collect()} == {("r1", 1, "0.4"), ("r1", 2, "0.5"), ("r2", 1, None)}
    (tmp_path / "l" / "clipA").mkdir(parents=True)
    for name in ("f1.txt", "_x.txt", "train.txt"):
        (tmp_path / "l" / "clipA" / name).write_text("0 0.5 0.5 0.1 0.1\n")
    assert [tuple(r) for r in readers.label_lines(spark, str(tmp_path / "l")).collect()] == [("clipA", "f1", "0 0.5 0.5 0.1 0.1")]
    (tmp_path / "m.csv").write_text("a , b\n 1 ,2 \n")
    assert [tuple(r) for r in readers.manifest(spark, str(tmp_path / "m.csv"), ["a", "b", "c"]).collect()] == [("1", "2", "")]
    (tmp_path / "v").mkdir()
    for name in ("x_RGB.mp4", "y_IR.avi", "z.txt"):
        (tmp_path / "v" / name).write_text("1")
    assert readers.listing(spark, str(tmp_path / "v")).count() == 2 and readers.listing(spark, str(tmp_path / "v"), keyword="rgb").count() == 1
    (tmp_path / "k.csv").write_text("scorer,s,s,s\nindividuals,i1,i1,i1\nbodyparts,nose,nose,nose\ncoords,x,y,likelihood\n0,1.0,2.0,0.9\n")
    assert [tuple(r) for r in readers.keypoint_csv(spark, str(tmp_path / "k.csv")).collect()] == [("k", 0, "i1", "nose", 1.0, 2.0, 0.9)]
    for name, text in (("a.json", '{"name": "e", "extra": 1}'), ("b.json", "{broken")):
        (tmp_path / name).write_text(text)
    assert [tuple(r) for r in readers.metadata(spark, str(tmp_path / "[ab].json"), "name string, ended string").collect()] == [("e", None)]


def test_guarded_writes(spark, tmp_path):
    path = str(tmp_path / "m")
    writers.append_manifest(spark.range(2), path)
    writers.append_manifest(spark.range(0), path)
    writers.append_manifest(spark.range(1), path)
    assert spark.read.parquet(path).count() == 3
    table = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert {tuple(r) for r in writers.update_rows(table, "k", "b", v=5).collect()} == {("a", 1), ("b", 5)}
    with pytest.raises(KeyError):
        writers.update_rows(table, "k", "b", w=5)
    assert writers.with_provenance(table, run="r").first().run == "r"


def test_metadata_index_and_dataset(spark, tmp_path):
    rows = spark.createDataFrame([("e1", 3, None), ("e2", 4, "n"), (None, 5, "x")], "experiment_name string, n_clips long, notes string")
    writers.write_metadata(rows, str(tmp_path / "meta"))
    found = readers.metadata(spark, str(tmp_path / "meta"), "experiment_name string, n_clips long, notes string", False)
    writers.rebuild_index(found, str(tmp_path / "index"), "experiment_name")
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "index")).select("experiment_name", "n_clips", "notes").collect()} == {("e1", 3, None), ("e2", 4, "n")}
    manifest = spark.createDataFrame([("train", 1), ("train", 2), ("val", 3)], "split string, frame long")
    assert {(r.split, r.n) for r in writers.write_dataset(manifest, str(tmp_path / "ds")).collect()} == {("train", 2), ("val", 1)}


def files_by_clip(path):
    return {p.name: len(list(p.glob("part-*"))) for p in path.glob("clip=*")}


def test_detections_have_one_file_a_clip(spark, tmp_path):
    rows = spark.range(400).repartition(8).selectExpr("id % 5 AS clip", "id AS frame_idx", "1.0D AS x1", "2.0D AS y1", "3.0D AS x2", "4.0D AS y2", "0.5D AS conf")
    writers.write_detections(rows, str(tmp_path / "d"))
    assert files_by_clip(tmp_path / "d") == {f"clip={i}": 1 for i in range(5)}
    assert readers.detections_csv(spark, str(tmp_path / "d")).groupBy("clip").count().where("count = 80").count() == 5


def test_listed_clips_have_one_file_each(spark, tmp_path, monkeypatch):
    rows = spark.range(400).repartition(8).selectExpr("id % 5 AS clip", "id AS frame")
    monkeypatch.setattr(files, "view", lambda *_: rows)
    monkeypatch.setattr(files, "shared_path", lambda *_: str(tmp_path / "l"))
    assert sorted(r.clip for r in files.listed_files(spark, "").collect()) == [str(i) for i in range(5)]
    assert files_by_clip(tmp_path / "l") == {f"clip={i}": 1 for i in range(5)}


def test_label_issues_split_a_line_once(spark):
    lines = {"0 0.1 0.2 0.3 0.4": "", "0 0.1 0.2 0.3": "fields", " \t ": "", "": "", "0 x 0.2 0.3 0.4": "not_numeric", "1 0.1 0.2 0.3 0.4": "class", "-1 0.1 0.2 0.3 1.4": "class,range", "0 NaN 0.2 0.3 0.4": "", " 0\t0.1  0.2 0.3 -0.4 ": "range", "0.5 1 1 1 1": "not_numeric", "0 0 0 0 0 0": "fields"}
    frame = spark.createDataFrame([(x,) for x in (*lines, None)], "line string").repartition(2).select("line", F.array_join(text.label_issues(F.col("line"), 1), ",").alias("i"))
    assert {r.line: r.i for r in frame.collect()} == {**lines, None: ""}
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_many_documents_of_pairs_in_one_file(spark, tmp_path):
    rows = spark.range(50).coalesce(1).selectExpr("concat('[[', id, ',', id + 1, '],[', id + 5, ',', id + 9, ']]') AS value")
    rows.write.text(str(tmp_path / "p"))
    got = readers.interval_pairs(spark, str(tmp_path / "p"), lines=True)
    assert sorted(map(tuple, got.collect())) == sorted(x for i in range(50) for x in ((0, float(i), i + 1.0), (1, i + 5.0, i + 9.0)))


def test_pair_files_grow_with_bytes(spark, tmp_path, monkeypatch):
    """Not with the groups: 300 of them do not give 300 files."""
    monkeypatch.setattr(files, "view", lambda *_: spark.range(900).selectExpr("id % 300 AS grp", "CAST(id AS DOUBLE) AS start_ts", "id + 2.0D AS end_ts"))
    monkeypatch.setattr(files, "shared_path", lambda *_: str(tmp_path / "p"))
    assert tuple(files.pair_files(spark, "").first()) == (900, 2, 1800.0)
    assert len(list((tmp_path / "p").rglob("part-*"))) <= 8


def test_label_lines_take_names_without_patterns(spark, tmp_path):
    """Names are cut from the path of every line; a pattern on each cost more than reading the line."""
    (tmp_path / "clip=a b").mkdir()
    for name in ("f1.txt", "_x.txt", "train.txt"):
        (tmp_path / "clip=a b" / name).write_text("0 1\n0 2\n")
    rows = readers.label_lines(spark, str(tmp_path))
    assert sorted((r.frame_stem, r.line) for r in rows.collect()) == [("f1", "0 1"), ("f1", "0 2")]
    counts = rows.groupBy("clip").count()
    assert counts.count() == 1 and "regexp" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_metric_files_grow_with_bytes(spark, tmp_path, monkeypatch):
    """Not with the runs: 300 of them do not give 300 files; headers differ, and a blank value stays unreadable."""
    rows = spark.range(900).selectExpr("concat('run', id % 300) AS run", "1 + id DIV 300 AS epoch", "CASE WHEN id % 300 = 7 THEN ' ' ELSE CAST(id DIV 300 AS STRING) END AS a", "'' AS b")
    monkeypatch.setattr(files, "view", lambda *_: rows)
    monkeypatch.setattr(files, "shared_path", lambda *_: str(tmp_path / "m"))
    best = {r.run: (r.epoch, r.score) for r in files.metric_files(spark, "").collect()}
    assert best == {f"run{i}": (3, 2.0) for i in range(300) if i != 7}
    assert len(list((tmp_path / "m").rglob("part-*"))) <= 8

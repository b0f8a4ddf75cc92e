"""Ordered scans in batch and as streams, and collection that can be repeated."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trackframe.operators import curation, scans, tracking
from trackframe.streaming import online


def moving(clips=3, frames=60, seed=1, objects=4):
    """Boxes that drift, come and go, with frames and stretches without any."""
    draw = np.random.default_rng(seed)
    rows = []
    for clip in range(clips):
        at = draw.uniform(0, 200, (objects, 2))
        for f in range(3, frames):
            at = at + draw.normal(0, 4, at.shape)
            if f % 17 in (5, 6) or 30 < f < 39:
                continue
            rows += [(clip, f, i, float(x), float(y), 30.0, 30.0, float(round(draw.uniform(0.3, 1), 2))) for i, (x, y) in enumerate(at) if draw.random() > 0.15]
    return rows


def walked(rows, method, first=None, visit=None, **options):
    """The kernel over whole clips, in one process."""
    out = []
    frame = pd.DataFrame(rows, columns=["clip", "frame", "id", "x", "y", "w", "h", "conf"]).sort_values(["clip", "frame", "conf", "id"], ascending=[True, True, False, True])
    for clip, of_clip in frame.groupby("clip"):
        walk = tracking.Walk(method, first, visit, **options)
        for f, g in of_clip.groupby("frame"):
            out += [(clip, *r) for r in walk(f, [g[c].to_numpy() for c in ("x", "y", "w", "h", "conf")])]
    return rounded(out)


def rounded(rows):
    return sorted((int(r[0]), int(r[1]), int(r[2]), *(round(float(v), 6) for v in r[3:8])) for r in rows)


@pytest.mark.parametrize("method, options", [("slots", {"n": 3}), ("gated", {"n": 4}), ("kalman", {"n": 4}), ("kalman", {"n": 4, "visit": "all"}), ("single", {}), ("single", {"first": 0})])
@pytest.mark.parametrize("batch", [7, 10_000])
def test_scan_equals_the_whole_clip(spark, method, options, batch):
    """Whatever the size of an Arrow batch: frames and clips may lie across its ends."""
    rows = moving()
    frame = spark.createDataFrame(rows, online.DETECTIONS).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        assert rounded(tracking.track(frame, method, **options).collect()) == walked(rows, method, **options)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_kalman_visits_frames_with_detections_alone(spark):
    """A filter lives through any number of empty frames, and none gives a box."""
    rows = [(0, f, 0, 10.0, 10.0, 20.0, 20.0, 0.9) for f in (1, 2, 12, 13)]
    out = tracking.track(spark.createDataFrame(rows, online.DETECTIONS), "kalman").collect()
    assert sorted((r.frame, r.id) for r in out) == [(1, 1), (2, 1), (12, 1), (13, 1)]
    dense = tracking.track(spark.createDataFrame(rows, online.DETECTIONS), "kalman", visit="all").collect()
    assert {r.frame for r in dense} == {1, 2, 3, 4, 5, 6, 7, 12, 13} and {r.id for r in dense} == {1, 2}


def test_a_long_clip_runs_in_parts(spark):
    """One clip of 60 000 frames: runs of consecutive frames are keys of their own where the method forgets, and nothing holds a clip."""
    rows = spark.range(60_000).where("id % 1000 <> 7").select(F.lit(0).cast("long").alias("clip"), F.col("id").alias("frame"), F.explode(F.array(F.lit(0), F.lit(1))).alias("id"))
    rows = rows.select("clip", "frame", F.col("id").cast("long"), (F.col("frame") % 50 + 100 * F.col("id")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(60.0).alias("w"), F.lit(20.0).alias("h"), (0.9 - F.col("id") / 10).alias("conf"))
    seen = []

    class Step:
        def __call__(self, frame, columns):
            return [(int(frame), len(columns[0]))]

    counted = scans.scan_frames(rows, ["clip"], ["x"], lambda key: Step(), "clip long, frame long, n long")
    assert counted.agg(F.count("*"), F.sum("n"), F.min("n")).first()[:] == (59_940, 119_880, 2)
    out = tracking.track(rows, "slots", n=2)
    assert out.groupBy("id").count().orderBy("id").collect() == [(1, 59_940), (2, 59_940)]
    assert "mapinarrow" in out._jdf.queryExecution().toString().lower() and not seen


def kept_by_loop(rows, differs):
    out = []
    frame = pd.DataFrame(rows, columns=["clip", "frame", "id", "x", "y", "w", "h", "conf"])
    for clip, of_clip in frame.groupby("clip"):
        last = None
        for f, g in of_clip.groupby("frame"):
            own = {i: b for i, b in zip(g["id"], g[["x", "y", "w", "h"]].to_numpy())}
            shared = [i for i in own if last and i in last]
            if not shared or differs([last[i] for i in shared], [own[i] for i in shared]):
                out.append((clip, f))
                last = own
    return sorted(out)


def least(a, b):
    value = 1.0
    for p, q in zip(a, b):
        w, h = (min(p[k] + p[k + 2], q[k] + q[k + 2]) - max(p[k], q[k]) for k in (0, 1))
        inter = max(w, 0) * max(h, 0)
        value = min(value, inter / (p[2] * p[3] + q[2] * q[3] - inter))
    return value


@pytest.mark.parametrize("shift", [0, 1000])
def test_kept_frames_match_the_loop(spark, shift):
    """Random clips; with ``shift`` tracks get new ids every 20 frames, so that clips fall into parts."""
    rows = [(c, f, i + shift * (f // 20), *rest) for c, f, i, *rest in moving(clips=4, frames=90, seed=3)]
    frame = spark.createDataFrame(rows, online.DETECTIONS).repartition(4)
    parts = curation.fresh_starts(frame).select("clip", "_part").distinct().count()
    assert parts == 4 if not shift else parts > 12
    got = sorted((r.clip, r.frame) for r in curation.keep_frames(frame, 0.6).collect())
    assert got == kept_by_loop(rows, lambda a, b: least(a, b) < 0.6)
    far = lambda a, b: max(np.hypot(q[0] + q[2] / 2 - p[0] - p[2] / 2, q[1] + q[3] / 2 - p[1] - p[3] / 2) for p, q in zip(a, b)) >= 9.0
    got = sorted((r.clip, r.frame) for r in curation.keep_frames(frame, 9.0, "displacement").collect())
    assert got == kept_by_loop(rows, far) and len(got) < len({r[:2] for r in rows})


@pytest.mark.parametrize("method, first", [("single", 0), ("slots", None), ("gated", None), ("kalman", None)])
def test_stream_equals_batch_over_a_restart(spark, tmp_path, method, first):
    """State is typed and survives a restart; late frames are dropped and counted."""
    rows = moving(clips=2, frames=40, seed=5)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    late = [(c, 4, 9, 0.0, 0.0, 9.0, 9.0, 0.9) for c in (0, 1)]
    for part in ([r for r in rows if r[1] < 18], [r for r in rows if r[1] >= 18] + late):
        spark.createDataFrame(part, online.DETECTIONS).coalesce(1).write.mode("append").parquet(src)
        online.collect_new(online.track_stream(online.live_frames(spark, src), method, first, n=4) if method != "single" else online.track_stream(online.live_frames(spark, src), method, first), out, str(tmp_path / "ck"))
    got = spark.read.parquet(out)
    options = {} if method == "single" else {"n": 4}
    assert rounded(got.collect()) == walked(rows, method, first, **options)
    assert {(r.clip, r.stale) for r in got.groupBy("clip").agg(F.max("stale").alias("stale")).collect()} == {(0, 1), (1, 1)}


@pytest.mark.parametrize("method", list(tracking.METHODS))
def test_state_of_a_tracker_comes_back_whole(method):
    rows = [r for r in moving(clips=1, frames=30)]
    walk, twin = tracking.Walk(method), tracking.Walk(method)
    for f in sorted({r[1] for r in rows}):
        columns = [np.array(c) for c in list(zip(*[r for r in rows if r[1] == f]))[3:8]]
        fresh = tracking.Walk(method)
        fresh.last = twin.last
        fresh.tracker.load(*twin.tracker.dump())
        twin = fresh
        assert rounded((0, *r) for r in walk(f, columns)) == rounded((0, *r) for r in twin(f, columns))


def test_newest_frames_over_triggers(spark, tmp_path):
    """Latest gives one frame a trigger, never an older one; all gives every newer one. Counters never fall and drops are counted."""
    box = (1, 0.0, 0.0, 5.0, 5.0, 0.9)
    triggers = [[1, 2, 3], [2, 3], [3, 5, 4], [9]]
    for mode, want in (("latest", [(3, 1, 2), (5, 2, 6), (9, 3, 6)]), ("all", [(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 3), (5, 5, 3), (9, 6, 3)])):
        src, out = str(tmp_path / f"in-{mode}"), str(tmp_path / f"out-{mode}")
        for frames in triggers:
            spark.createDataFrame([(7, f, *box) for f in frames], online.DETECTIONS).coalesce(1).write.mode("append").parquet(src)
            online.collect_new(online.newest(online.live_frames(spark, src), mode), out, str(tmp_path / f"ck-{mode}"))
        assert [(r.frame, r.counter, r.dropped) for r in spark.read.parquet(out).orderBy("frame").collect()] == want
    with pytest.raises(ValueError):
        online.newest(online.live_frames(spark, src), "some")


def test_collected_batches_are_taken_once(spark, tmp_path):
    """A trigger that runs again replaces what it wrote; a batch that comes again is left out; gaps show at the end."""
    src, target, check = (str(tmp_path / k) for k in ("in", "out", "ck"))
    schema = "source string, wave string, split string, batch string, image string"
    row = lambda batch, image, split="train": ("s", "w1", split, batch, image)
    for part in ([row("b1", "a"), row("b1", "b")], [row("b1", "c"), row("b2", "d", "val")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        online.collect_batches(spark.readStream.schema(schema).parquet(src), target, check)
    images = lambda: sorted(r.image for r in spark.read.parquet(f"{target}/rows").collect())
    assert images() == ["a", "b", "d"]
    for entry in (tmp_path / "ck" / "commits").glob("*1*"):
        entry.unlink()  # as if the job had been lost before the last trigger was marked as done
    online.collect_batches(spark.readStream.schema(schema).parquet(src), target, check)
    assert images() == ["a", "b", "d"] and online.collected(spark, target).count() == 2
    expected = spark.createDataFrame([("w1", "train"), ("w1", "val"), ("w2", "train")], "wave string, split string")
    assert {tuple(r) for r in online.finalise(spark, target, expected).collect()} == {("w1", "train", 1, False), ("w1", "val", 1, False), ("w2", "train", 0, True)}
    assert {r.n for r in online.finalise(spark, str(tmp_path / "none"), expected).collect()} == {0}


@pytest.mark.parametrize("method", list(tracking.METHODS))
def test_frames_of_few_boxes_need_no_arrays(method, monkeypatch):
    """What made the trackers slow: an array solver, an IoU table and matrix inverses for every frame."""

    def refuse(*_):
        raise AssertionError("an array kernel ran on a frame of few boxes")

    rows = moving(clips=2)
    for owner, name in ((tracking, "assign"), (tracking, "iou_table"), (np.linalg, "inv")):
        monkeypatch.setattr(owner, name, refuse)
    assert walked(rows, method)


def test_filters_equal_their_matrix_form():
    """The filter by coordinates against the one of eight by eight matrices, through updates and frames without."""
    draw, box = np.random.default_rng(5), np.array([10.0, 20.0, 40.0, 60.0])
    own, move, see = tracking.Filter(tuple(box), 1), np.eye(8) + np.eye(8, k=4), np.eye(4, 8)
    x, p = np.concatenate([own.measure(box), np.zeros(4)]), np.diag([10.0, 10, 20, 20, 100, 100, 100, 100])
    for i in range(60):
        own.predict()
        x, p = move @ x, move @ p @ move.T + np.diag([1.0, 1, 10, 10, 0.1, 0.1, 1, 1])
        if i % 4:
            box = box + draw.normal(0, 3, 4)
            own.update(tuple(box))
            gain = p @ see.T @ np.linalg.inv(see @ p @ see.T + np.diag([1.0, 1, 10, 10]))
            x, p = x + gain @ (np.array(own.measure(box)) - see @ x), (np.eye(8) - gain @ see) @ p
        assert np.allclose([*own.x, *own.v], x, rtol=1e-12) and np.allclose(tracking.matrix([own.centre, own.centre, own.size, own.size]), p.ravel(), rtol=1e-12)

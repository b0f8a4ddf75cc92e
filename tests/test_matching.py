import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackframe.operators import matching, metrics, tracking, tracks

BOXES = "clip long, frame long, id long, x double, y double, w double, h double"


def brute(weight):
    n, m = weight.shape
    if n > m:
        return brute(weight.T)
    return max(sum(weight[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


@pytest.mark.parametrize("seed", range(40))
def test_assignment_is_optimal(seed):
    draw = np.random.default_rng(seed)
    weight = np.round(draw.random((draw.integers(1, 6), draw.integers(1, 6))), 1)
    rows = matching.assign(-weight)
    used = [j for j in rows if j >= 0]
    assert len(used) == len(set(used)) == min(weight.shape)
    assert sum(weight[i, j] for i, j in enumerate(rows) if j >= 0) == pytest.approx(brute(weight))


def test_empty_assignment():
    assert list(matching.assign(np.zeros((2, 0)))) == [-1, -1]


def test_contested_frames_go_through_the_solver(spark):
    # Frame 1: two overlapping lanes, the best sum crosses over. Frame 2: no prediction. Frame 3: no truth.
    gt = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 10.0, 10.0), (0, 1, 2, 4.0, 0.0, 10.0, 10.0), (0, 2, 1, 0.0, 0.0, 10.0, 10.0)], BOXES)
    pred = spark.createDataFrame([(0, 1, 7, 1.0, 0.0, 10.0, 10.0), (0, 1, 8, 5.0, 0.0, 10.0, 10.0), (0, 3, 9, 0.0, 0.0, 5.0, 5.0)], BOXES)
    found = {(r.frame, r.gid, r.pid) for r in matching.match(gt, pred, 0.5).collect()}
    assert found == {(1, 1, 7), (1, 2, 8)}
    q = metrics.detection_quality(gt, pred).first()
    assert (q.tp, q.fp, q.fn, q.idsw) == (2, 1, 1, 0)
    assert (q.precision, q.recall, q.f1) == (0.6667, 0.6667, 0.6667)


def test_hota_of_a_perfect_tracker(spark):
    gt = spark.createDataFrame([(0, f, i, 50.0 * i, 0.0, 10.0, 10.0) for f in range(4) for i in (1, 2)], BOXES)
    for variant in ("matched", "published"):
        r = metrics.hota(gt, gt, variant).first()
        assert (r.hota, r.deta, r.assa) == (1.0, 1.0, 1.0)
    assert metrics.idf1_global(gt, gt).first().idf1 == 1.0
    empty = gt.limit(0)
    assert metrics.hota(gt, empty).first().hota == 0.0


def test_gap_fill_rules_differ(spark):
    t = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 1.0, 1.0), (0, 5, 1, 4.0, 8.0, 1.0, 1.0), (0, 5, 1, 9.0, 9.0, 1.0, 1.0)], BOXES)
    rows = lambda whole: [(r.frame, r.x, r.filled) for r in tracks.fill_gaps(t, 2, whole).orderBy("frame").collect()]
    assert rows(False) == [(1, 0.0, False), (2, 1.0, True), (3, 2.0, True), (5, 4.0, False)]
    assert rows(True) == [(1, 0.0, False), (5, 4.0, False)]


def dets(spark, rows):
    return spark.createDataFrame(rows, BOXES + ", conf double")


def test_trackers(spark):
    moving = dets(spark, [(0, f, i, 100.0 * i + f, 0.0, 20.0, 20.0, 0.9 - i / 10) for f in range(1, 6) for i in (0, 1)] + [(0, 6, 0, 500.0, 0.0, 20.0, 20.0, 0.9)])
    out = {m: {(r.frame, r.id) for r in tracking.track(moving, m, n=2).collect()} for m in ("slots", "gated", "kalman")}
    assert out["gated"] == {(f, i) for f in range(1, 6) for i in (1, 2)} | {(6, 3)}
    assert {i for f, i in out["slots"]} == {1, 2}
    assert {(6, 1), (6, 2), (6, 3)} <= out["kalman"]
    one = tracking.track(moving.where("id = 0 AND frame < 6"), "single").orderBy("frame").collect()
    assert len(one) == 5 and one[-1].x == pytest.approx(15, abs=1)


def test_score_frames_batches(spark):
    seen = tracking.score_frames(spark.range(100).repartition(1), lambda pdf: pdf.assign(n=len(pdf)), "id long, n long", 32)
    assert seen.agg(F.max("n"), F.count("*")).first()[:] == (32, 100)


def test_kalman_by_hand(spark):
    """One box over three frames against the filter's equations written out for one axis: centre and its change."""
    xs = [100.0, 104.0, 111.0]
    out = tracking.track(dets(spark, [(0, f + 1, 0, x - 10, 0.0, 20.0, 20.0, 0.9) for f, x in enumerate(xs)]), "kalman", n=1).orderBy("frame").collect()
    p, v, a, b, c = xs[0], 0.0, 10.0, 0.0, 100.0  # state and covariance [[a, b], [b, c]]
    want = [p]
    for z in xs[1:]:
        p, a, b, c = p + v, a + 2 * b + c + 1.0, b + c, c + 0.1
        k, m, y = a / (a + 1.0), b / (a + 1.0), z - p
        p, v, a, b, c = p + k * y, v + m * y, (1 - k) * a, (1 - k) * b, c - m * b
        want.append(p)
    assert [r.x + 10 for r in out] == pytest.approx(want)


def test_single_target_by_hand(spark):
    """Predicted from frame 1 on; the first detection, in frame 3, sets the position and nothing else."""
    seen = {3: 50.0, 4: 53.0, 6: 60.0}
    out = tracking.track(dets(spark, [(0, f, 0, x - 5, 0.0, 10.0, 10.0, 0.8) for f, x in seen.items()]), "single", first=1).orderBy("frame").collect()
    p, v, a, b, c, want, ready = 0.0, 0.0, 1000.0, 0.0, 1000.0, [], False
    for f in range(1, 7):
        p, a, b, c = p + v, a + 2 * b + c + 0.001, b + c, c + 0.001
        if f in seen and ready:
            k, m, y = a / (a + 5.0), b / (a + 5.0), seen[f] - p
            p, v, a, b, c = p + k * y, v + m * y, (1 - k) * a, (1 - k) * b, c - m * b
        elif f in seen:
            p, ready = seen[f], True
        if ready:
            want.append((f, pytest.approx(p), 0.8 if f in seen else 0.5))
    assert [(r.frame, r.x, r.conf) for r in out] == want


def test_contested_frames_match_brute_force(spark):
    draw = np.random.default_rng(3)
    box = lambda f, i: (0, f, i, float(draw.integers(0, 12)), float(draw.integers(0, 12)), 10.0, 10.0)
    gt, pred = [box(f, i) for f in range(40) for i in range(4)], [box(f, i) for f in range(40) for i in range(5)]
    found = matching.match(spark.createDataFrame(gt, BOXES), spark.createDataFrame(pred, BOXES), 0.0).groupBy("frame").agg(F.sum("iou").alias("s")).collect()
    for r in found:
        a, b = (np.array([[x, y, x + w, y + h] for _, f, _, x, y, w, h in side if f == r.frame]) for side in (gt, pred))
        assert r.s == pytest.approx(brute(tracking.iou_table(a, b)))
    assert len(found) == 40


def test_detection_quality_counts_switches_once(spark):
    gt = spark.createDataFrame([(0, f, 1, 0.0, 0.0, 10.0, 10.0) for f in range(6)], BOXES)
    pred = spark.createDataFrame([(0, f, 7 if f in (0, 1, 4) else 8, 0.0, 0.0, 10.0, 10.0) for f in range(6)], BOXES)
    assert metrics.detection_quality(gt, pred).first().idsw == matching.switches(matching.match(gt, pred)).count() == 3


def test_gap_fill_carries_confidence(spark):
    t = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 1.0, 1.0, 0.42), (0, 3, 1, 4.0, 8.0, 1.0, 1.0, None)], BOXES + ", conf double")
    assert [(r.frame, round(r.conf, 6), r["class"]) for r in tracks.track_table(tracks.fill_gaps(t, 5)).orderBy("frame").collect()] == [(1, 0.42, 1), (2, 1.0, 1), (3, 1.0, 1)]


def test_gated_filled_and_compare(spark):
    d = dets(spark, [(0, f, 0, float(f), 0.0, 20.0, 20.0, 0.9) for f in (1, 2, 5, 6)])
    filled = {(r.frame, r.id, r.x, r.filled) for r in tracking.track(d, "gated", max_gap=2, n=1).collect()}
    assert filled == {(1, 1, 1.0, False), (2, 1, 2.0, False), (3, 1, 3.0, True), (4, 1, 4.0, True), (5, 1, 5.0, False), (6, 1, 6.0, False)}
    both = tracking.compare(d, {"a": {"method": "gated"}, "b": {"method": "slots"}}).groupBy("method").count().collect()
    assert {(r.method, r["count"]) for r in both} == {("a", 4), ("b", 4)}


def test_repeated_ids_are_counted(spark):
    t = spark.createDataFrame([(0, 1, 1, 0.0, 0.0, 1.0, 1.0), (0, 1, 1, 2.0, 0.0, 1.0, 1.0), (0, 2, 1, 0.0, 0.0, 1.0, 1.0)], BOXES)
    assert matching.repeated_ids(t).first().repeated == 1 and matching.unique_ids(t).count() == 2


def test_small_and_large_solver_agree(monkeypatch):
    """With ties as frames have them: most boxes overlap nothing."""
    draw = np.random.default_rng(2)
    for _ in range(300):
        cost = 1 - np.where(draw.random(draw.integers(1, 9, 2)) < 0.6, 0, np.round(draw.random(), 1))
        few = matching.assign(cost).tolist()
        assert few == matching.assign_few(cost.tolist())
        monkeypatch.setattr(matching, "SMALL", 0)
        assert few == matching.assign(cost).tolist()
        monkeypatch.undo()
